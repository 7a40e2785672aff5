"""WARC archives of page captures and an external merge of their indexes.

Writing: every page becomes one WARC record in a gzip archive file, written by Spark's text writer with the record
separator as its line end, so the files go wherever Spark can write. Equal payloads of ``min_dedup`` bytes or more are
stored once: the record with the smallest page_id is the response, the others are revisits that refer to it.

Reading: each archive file is parsed record by record by its Content-Length and checked against its digest. The index
entries of one file, sorted by URL key and time, are a run. Runs are cut at common splitters; each range of the key space
merges its slices of all runs with a loser tree, which gives one global order (range, position).

Defined cases: a null html is an empty payload; a null url has the empty URL key and no URI in its record; a record
without page_id carries none and is a revisit when a twin has one; rows that share the smallest page_id of their payload
are all responses; repeated rows are records of their own; an empty table gives an empty archive and index; payloads may
hold anything, record separators included.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.context import ref
from colonnade.llm.common import settle, shuffle_width
from colonnade.session import materialise, shared_folder

MIN_DEDUP = 100
FILE_RECORDS = 20_000
RANGE_ROWS = 100_000
SPLIT_SAMPLE = 64  # sampled entries per range, from which the splitters are taken
END = "\r\n\r\n"
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01T00:00:00Z; the tables have no capture time, so page_id counts seconds


def decide(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """page_id, url, payload, digest, size, capture time, and refers_to (null for a response) of every page."""
    rows = pages.select(ref("page_id").alias("page_id"), ref("url").alias("url"), F.coalesce(ref("html"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    large = F.when(F.col("size") >= min_dedup, F.col("digest"))
    groups = rows.withColumn("twin", large).where(F.col("twin").isNotNull()).groupBy("twin")
    groups = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.withColumn("twin", large).join(settle(groups), "twin", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    seconds = F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(F.col("page_id"), F.lit(10**9)), F.lit(0))
    return joined.select("page_id", "url", "payload", "digest", "size", seconds.alias("captured"), refers.alias("refers_to"))


def record(revisit: Column) -> Column:
    """One WARC record as text, without its final separator. A revisit carries its headers only."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))),
        line("X-Payload-Length", F.col("size")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, min_dedup: int = MIN_DEDUP) -> None:
    rows = decide(pages, min_dedup).select(record(F.col("refers_to").isNotNull()).alias("value"))
    writer = rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    writer.text(path)


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked file, headers, block) of every record."""
    offset = 0
    while True:
        first = stream.readline()
        if not first:
            return
        if first.strip() != b"WARC/1.0":
            raise ValueError(f"no WARC record at {offset}")
        size, headers = len(first), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != END.encode():
            raise ValueError(f"record at {offset} does not end where it should")
        yield offset, headers, block
        offset += size + 2 + len(block) + 4


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query in lower case; no scheme, www, port or fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "", re.I)
    if not m:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


ENTRY = "url_key string, captured string, page_id long, archive string, seq int, start long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archive files; within a file (a run) seq numbers them in sorted order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(value: str | None) -> int | None:
        return int(value[len("<urn:page:") : -1]) if value else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                entries = []
                for offset, head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{name}: the record at {offset} is damaged")
                    entries.append(
                        (url_key(head.get("WARC-Target-URI")), head["WARC-Date"], number(head.get("WARC-Record-ID")), name, 0, offset,
                         head["WARC-Type"], number(head.get("WARC-Refers-To")), int(head["X-Payload-Length"]), digest)
                    )
                entries.sort(key=entry_key)
                yield frame([(*e[:4], i, *e[5:]) for i, e in enumerate(entries)])

    return files.mapInPandas(run, ENTRY)


def entry_key(e: tuple) -> tuple:
    """URL key, time, then page_id (none last) and place, so that the order is total."""
    return (e[0], e[1], e[2] is None, e[2] or 0, e[3], e[5])


def frame(entries: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in ENTRY.split(", ")]
    out = pd.DataFrame(entries, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


class LoserTree:
    """k-way merge: inner nodes keep the losers of their matches, so each output replays one path of log2 k matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.heads = [entry_key(r[0]) if r else None for r in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for i in range(len(runs)):
            self.replay(i)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def replay(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:  # first to arrive while the tree is built: it waits for its rival
                self.losers[node] = winner
                return
            if self.beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[winner := self.losers[0]] is not None:
            run, place = self.runs[winner], self.at[winner]
            yield run[place]
            self.at[winner] = place + 1
            self.heads[winner] = entry_key(run[place + 1]) if place + 1 < len(run) else None
            self.replay(winner)


def merge_runs(entries: DataFrame) -> DataFrame:
    """All entries in one order: range_id, position (within the range). The splitters come from a bounded sample."""
    entries = materialise(entries)
    spark, total = entries.sparkSession, entries.count()
    ranges = max(shuffle_width(spark), math.ceil(total / RANGE_ROWS))
    every = max(1, total // (ranges * SPLIT_SAMPLE))
    names = ["url_key", "captured", "page_id", "archive", "seq", "start"]
    sample = entries.where(F.pmod(F.xxhash64("archive", "start"), F.lit(every)) == 0).select(*names).collect()
    keys = sorted(entry_key(tuple(r)) for r in sample)
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    shared = spark.sparkContext.broadcast(cuts)
    fields = [f.split()[0] for f in ENTRY.split(", ")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = tuples(pdf)
            yield pdf.assign(range_id=[bisect_right(shared.value, entry_key(r)) for r in rows])

    def tuples(pdf: pd.DataFrame) -> list[tuple]:
        return [tuple(None if x is pd.NA or x != x else x for x in r) for r in pdf[fields].astype(object).itertuples(index=False)]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["archive", "seq"])  # the shuffle mixed the slices; seq restores each run's own order
        runs = [tuples(part) for _, part in pdf.groupby("archive", sort=True)]
        merged = frame(list(LoserTree(runs)))
        return merged.assign(range_id=key[0], position=range(len(merged)))

    placed = entries.withColumn("page_id", F.col("page_id")).mapInPandas(place, f"{ENTRY}, range_id int")
    return placed.groupBy("range_id").applyInPandas(merge, f"{ENTRY}, range_id int, position long")


def captures(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Write the archives, read them back, merge their indexes: the global capture history, one row per page."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_dedup)
    return merge_runs(read_runs(spark, path))


def capture_report(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    kind = pages.schema["page_id"].dataType
    cast = kind if isinstance(kind, T.IntegralType) else T.LongType()
    return captures(pages, min_dedup).select(
        F.col("page_id").cast(cast).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(cast).alias("refers_to"),
    )
