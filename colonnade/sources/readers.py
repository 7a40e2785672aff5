"""Sources: delimited text, JSON, Parquet, many-file Feather and Stata, HTML tables, upload validation, fingerprints."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref

# Delimiters tried on unlabelled text, the default when none occurs, and the sniffed length.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 5000
# Accepted and refused extensions, the size limit and the leading bytes expected per binary format.
ALLOWED = ("csv", "tsv", "txt", "json", "parquet", "feather", "dta", "html", "htm", "xlsx", "xls")
REFUSED = ("pkl", "pickle")
MAX_BYTES = 100 * 1024 * 1024
MAGIC = {"parquet": "50415231", "feather": "4152524F5731", "xlsx": "504B0304", "xls": "D0CF11E0"}


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return normalise_missing(spark.read.csv(path, header=True, inferSchema=True, sep=sep))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Most frequent candidate in the first 5000 bytes of the file, of a folder's first file (the comma when none occurs).

    A line takes a byte at least, so as many lines as bytes always reach the end of that head.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        return ","
    lines = spark.read.text(first).limit(SNIFF_BYTES + 1).collect()
    head = "\n".join(r["value"] for r in lines)[:SNIFF_BYTES]
    best = max(DELIMITERS, key=head.count)
    return best if head.count(best) else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, detect_delimiter(spark, path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays, or one object per line where the first filled line of a file does not start with a bracket.

    Every file of a folder is judged by itself. Only the names of the files reach the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.where(F.length(F.trim("value")) > 0).withColumn("nth", F.monotonically_increasing_id())
    first = lines.groupBy("file").agg(F.ltrim(F.min_by("value", F.struct("at", "nth"))).startswith("[").alias("array"))
    names = {True: [], False: []}
    for r in first.toLocalIterator():
        names[r["array"]].append(r["file"])
    parts = [spark.read.json(sorted(files), multiLine=array) for array, files in names.items() if files]
    if not parts:
        return spark.read.json(path)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return normalise_missing(out)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole or column-restricted; an empty list keeps the rows with no columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[ref(c) for c in columns])


def _many_files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield parse(bytes(content)).assign(_source=name)

    return files.mapInPandas(read, schema + ", _source string")


def _feather(content: bytes) -> pd.DataFrame:
    return pd.read_feather(io.BytesIO(content))


def _stata(content: bytes) -> pd.DataFrame:
    return pd.read_stata(io.BytesIO(content))


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many Feather files of one schema, one file per row of work."""
    return _many_files(spark, path, _feather, schema)


def read_stata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _many_files(spark, path, _stata, schema)


class _Tables(HTMLParser):
    """Collects the cells of the outermost tables of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.depth = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._close()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_tables(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [[row for row in t if row] for t in parser.tables]


def extract_tables(pages: DataFrame, page_id: str, html: str, first_only: bool = False) -> DataFrame:
    """(page id, table_no, row_no, cells) of the tables in each page; pages without the tag never reach Python."""
    rows = pages.where(F.lower(ref(html)).contains("<table")).select(ref(page_id).alias("page_id"), ref(html).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    only = first_only

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, text in zip(pdf["page_id"], pdf["html"], strict=True):
                found = html_tables(text)
                for t, table in enumerate(found[:1] if only else found):
                    out += [(pid, t, r, cells) for r, cells in enumerate(table)]
            if out:
                yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "cells"])

    return rows.mapInPandas(parse, f"page_id {kind}, table_no int, row_no int, cells array<string>")


def load_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of the files in a folder, zero-byte files included; no content beyond ``max_bytes``.

    The bound reaches the file scan, so larger files are listed and not read.

    Spark's file scan leaves empty files out, so their names are taken from the folder listing.
    """
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = every.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    files = files.unionAll(large)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    empty = [(s.getPath().toString(), 0, bytearray()) for s in listing if s.isFile() and s.getLen() == 0]
    return files.unionAll(spark.createDataFrame(empty, files.schema)) if empty else files


def validate_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Verdict per file of a ``binaryFile`` frame (path, length, content): ``valid`` and the first ``reason`` against it."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    head = F.hex(F.substring("content", 1, 8))
    magic = F.lit(False)
    for e, m in MAGIC.items():
        magic = magic | ((ext == e) & F.coalesce(~head.startswith(m), F.lit(False)))
    reason = (
        F.when(F.col("path").contains("..") | (name == "") | name.contains("\\"), "unsafe name")
        .when(ext.isin(*REFUSED), "refused extension")
        .when(~name.contains(".") | ~ext.isin(*ALLOWED), "unknown extension")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
        .when(magic, "content does not match extension")
    )
    return files.select("path", "length", reason.isNull().alias("valid"), reason.alias("reason"))


def fingerprints(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """SHA-256 of the content, with a zero byte and the sheet name appended when there is one."""
    content = F.col("content")
    if sheet is not None:
        content = F.concat(content, F.unhex(F.lit("00")), F.encode(F.lit(sheet), "UTF-8"))
    return files.select("path", F.sha2(content, 256).alias("digest"))
