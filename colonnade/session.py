"""Session helpers: a local session for tests and bench, reliable checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after its rows and bytes were measured to be at most these.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colonnade")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a cluster's own setting decides there
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local folder would lose the data
    with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="colonnade-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reread(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own beside the checkpoints and read it again.

    A checkpoint goes on with the size Spark had estimated for its plan, so a loop that joins its state with itself squares
    that number every round until it fills the driver. What is read again has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist with spill to disk; a lost block is recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# Rows of one partition of a table that is read many times, at most about.
PART_ROWS = 100_000
# Tables of fewer rows stay as they lie; larger ones are dealt to every core.
SMALL_ROWS = 10_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal ``df`` out evenly before it is kept: at most about PART_ROWS rows a partition, and no idle core.

    A compressed file, or a coalesced shuffle, can leave millions of rows, or all of them, to one task. ``rows`` is the number
    of rows where it is known.
    """
    n = df.count() if rows is None else rows
    if n <= SMALL_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-n // PART_ROWS), min(cores, -(-n // SMALL_ROWS))))


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: texts, binaries and arrays by their length, other values 16 bytes."""
    size = F.lit(0)
    for f in df.schema:
        column = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 * F.coalesce(F.size(column), F.lit(0))
        else:
            size = size + 16
    return size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when it is measured to hold at most ``rows`` rows and ``size`` bytes, else leave the join to Spark.

    The frame is persisted first so that the measurement is not a second computation.
    """
    kept = keep(df)
    seen = kept.select(_row_bytes(df).alias("_b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("_b").alias("b")).first()
    if seen["n"] <= rows and (seen["b"] or 0) <= size:
        return F.broadcast(kept)
    return kept
