"""Helpers shared by the training-data operators: row keys, settled tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.session import materialise, shared_folder

# Texts are handed to numpy in blocks of about this many characters, so that a task's memory does not follow its rows.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows of a settled table that a task holds, about, where their number is known.
SETTLED_ROWS = 20_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder, dealt out evenly; ``rows`` says how many it has at most, if that is known.

    The even deal also forgets the key the rows were grouped by, so that a later join shuffles both sides and Spark may
    split a hot key. A checkpoint that kept the key would pin a hot key to one task.
    """
    parts = shuffle_width(df.sparkSession) if rows is None else max(1, -(-rows // SETTLED_ROWS))
    return materialise(df.repartition(parts))


def reread(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own beside the checkpoints and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` or the first variant of it that ``df`` does not have as a column (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell apart rows of different id or text; identical rows share a key."""
    ident, text = ref(id_col).cast("string"), ref(text_col)
    return (
        F.xxhash64(ident, F.lit(1), text, text.isNull()),
        F.xxhash64(F.lit(2), text.isNull(), text, ident, ident.isNull()),
    )


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with the two key columns added under unused names."""
    names = [fresh(df, "_key_a"), fresh(df, "_key_b")]
    a, b = row_key(id_col, text_col)
    return df.withColumns(dict(zip(names, (a, b), strict=True))), names


def drop_keys(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is not among ``keys`` (columns key_a, key_b)."""
    return _by_key(docs, keys, id_col, text_col, "left_anti")


def keep_keys(
    docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False
) -> DataFrame:
    """Rows of ``docs`` whose key is among ``keys`` (columns key_a, key_b); with ``once``, one row of each key.

    The rows are dealt and sorted by the key for the join, so keeping one of each needs no other shuffle.
    """
    return _by_key(docs, keys, id_col, text_col, "left_semi", once)


def _by_key(
    docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str, once: bool = False
) -> DataFrame:
    tagged, (a, b) = keyed(docs, id_col, text_col)
    other = keys.select(F.col("key_a").alias(a), F.col("key_b").alias(b))
    joined = tagged.join(other, [a, b], how)
    joined = joined.dropDuplicates([a, b]) if once else joined
    return joined.select(*[ref(c) for c in docs.columns])


def text_blocks(texts: Sequence, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` holding about ``limit`` characters each; one long text is a block of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of one task's edges, each as links from its smallest node to the others."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        yield pd.DataFrame({"a": [find(x) for x in nodes], "b": nodes})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (long columns a, b).

    Returns one row per node that has an edge: (node, component), component being the smallest node reachable.
    Edges are dealt out in bounded parts, each of which first shrinks its own components to stars. Then every round takes
    the smallest label among a node and its neighbours, and the label of that label, so paths shrink geometrically.
    Labels live in checkpointed tables; only counts reach the driver. Self-loops, repeated edges and an empty table are
    fine; a graph that has not settled after ``max_rounds`` raises.
    """
    edges = materialise(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct())
    size = edges.count()
    edges = edges.repartition(max(1, -(-size // SETTLED_ROWS))).mapInPandas(stars, "a long, b long")
    edges = materialise(edges)
    size = 2 * edges.count()  # rows of both directions; nodes are fewer
    both = settle(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), size)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), size)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select(
            "node", F.least("component", "_near").alias("_low"), F.col("component").alias("_old")
        )
        lower = settle(lower, size)
        if not lower.where("_low <> _old").limit(1).count():
            return labels
        jump = lower.select(F.col("node").alias("_low"), F.col("_low").alias("_next"))
        labels = settle(lower.join(jump, "_low").select("node", F.least("_low", "_next").alias("component")), size)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
