"""Line dedup: suffix ranks of line sequences by distributed prefix doubling, repeated runs, later copies deleted.

A document is a sequence of line ids (hash of the trimmed line; blank lines are no part of it). Only lines that occur
more than once can lie in a repeated run, so unique lines end every suffix. Rank tables are built by prefix doubling: the
rank of the 2h lines from a position is the place of (rank of its first h lines, rank of the next h) among all such pairs
that occur more than once, sorted by range over the cluster. Positions whose block became unique drop out.

A run counts when it holds at least ``min_words`` words. The suffix array is therefore needed only down to the shortest
block of that many words from each position (and up to each position): its lines are named by two ranks that cover it,
suffixes with equal names share at least that prefix, and such a class is an interval of the suffix array whose longest
common prefix reaches the block. In each interval the first copy (by doc_id, then position) stays and all others are
deleted. Every maximal repeated run is the union of its blocks, so cutting the array at this depth deletes the same lines
as the whole array would: a block lies in an earlier copy exactly if each longer run around it does or it does by itself.

Defined cases: blank lines go only inside a deleted block; null and empty texts have no lines and stay as they are; ties in doc_id go by row key; rows equal in id
and text are one document and share its result; rows without an id come last; documents of which nothing but blank lines
would be left are removed by ``deduplicate`` (kept, with an empty text, by ``line_report``); a very long document is one
group of its own lines only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import fresh, keyed, row_key, settle
from colonnade.session import materialise

MIN_WORDS = 50
KEY = ["key_a", "key_b"]


def _line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank lines: doc_id, key_a, key_b, idx (among them), pos (among all lines), id (two hashes), words."""
    a, b = row_key(id_col, text_col)
    rows = docs.select(ref(id_col).alias("doc_id"), a.alias("key_a"), b.alias("key_b"), ref(text_col).alias("text"))
    trimmed = F.transform(_line_array(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.trim(F.rtrim(x, F.lit("\r"))).alias("line")))
    filled = F.filter(trimmed, lambda s: s["line"] != "")
    rows = rows.where(F.col("text").isNotNull()).select("doc_id", *KEY, F.posexplode(filled).alias("idx", "s"))
    line = F.col("s.line")
    return rows.select(
        "doc_id", *KEY, "idx", F.col("s.pos").alias("pos"),
        F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(3), line).alias("h2"),
        F.greatest(F.regexp_count(line, F.lit(r"\S+")), F.lit(1)).cast("long").alias("words"),
    )


def repeated_lines(all_lines: DataFrame) -> DataFrame:
    """Lines whose id occurs at more than one place of the corpus."""
    place = F.xxhash64(*KEY, "idx")
    ids = all_lines.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    return all_lines.join(settle(ids.where("lo <> hi").select("h1", "h2")), ["h1", "h2"])


def runs(hits: DataFrame, min_words: int) -> DataFrame:
    """Positions in stretches of repeated lines that hold at least ``min_words`` words, with the stretch number."""
    rows = hits.repartition(*KEY).dropDuplicates([*KEY, "idx"])
    order = W.partitionBy(*KEY).orderBy("idx")
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(order))
    rows = rows.withColumn("run_words", F.sum("words").over(W.partitionBy(*KEY, "run")))
    return rows.where(F.col("run_words") >= min_words).drop("run_words")


def blocks(active: DataFrame, min_words: int) -> DataFrame:
    """Shortest blocks of ``min_words`` words that start or end at each position: doc_id, key, idx, n (lines), pos_end."""
    cols = ["doc_id", *KEY, "idx", "pos", "words", "run"]
    rows = active.select(*cols).repartition(*KEY).sortWithinPartitions(*KEY, "idx")
    kind = active.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for pdf in batches:
            cur = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            mark = cur[[*KEY, "run"]].to_numpy(np.int64)
            edge = np.flatnonzero((np.diff(mark, axis=0) != 0).any(axis=1)) + 1
            cut = int(edge[-1]) if len(edge) else 0  # the last stretch may go on in the next batch
            left = cur.iloc[cut:].reset_index(drop=True)
            if cut:
                yield of(cur.iloc[:cut], np.concatenate([[0], edge]))
        if left is not None and len(left):
            yield of(left, np.zeros(1, dtype=np.int64))

    def of(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        n = len(part)
        begins = begins[begins < n]
        ends = np.append(begins[1:], n)
        stop = np.repeat(ends, ends - begins)
        begin = np.repeat(begins, ends - begins)
        total = np.cumsum(part["words"].to_numpy(np.int64))
        before = total - part["words"].to_numpy(np.int64)
        at = np.arange(n)
        last = np.searchsorted(total, before + min_words)  # first place where the block is full
        forward = last < stop
        first = np.searchsorted(before, total - min_words, side="right") - 1  # last start of a full block that ends here
        backward = first >= begin
        start = np.concatenate([at[forward], first[backward]])
        end = np.concatenate([last[forward], at[backward]])
        pairs = np.unique(np.stack([start, end]), axis=1)
        out = part.iloc[pairs[0]][["doc_id", *KEY, "idx", "pos"]].reset_index(drop=True)
        return out.assign(n=pairs[1] - pairs[0] + 1, pos_end=part["pos"].to_numpy()[pairs[1]])

    return rows.mapInPandas(find, f"doc_id {kind}, key_a long, key_b long, idx int, pos int, n long, pos_end int")


def ranked(pairs: DataFrame) -> DataFrame:
    """Rank of every pair (r1, r2) that occurs more than once: its place in the sorted order (not dense)."""
    often = pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1").select("r1", "r2")
    placed = often.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")
    return materialise(placed.withColumn("rank", F.monotonically_increasing_id()))


def rank_levels(active: DataFrame, levels: int, size: int) -> list[DataFrame]:
    """Rank tables (key, idx, rank) of the blocks of 1, 2, 4, ... lines; only blocks that occur more than once."""
    pairs = active.select(*KEY, "idx", F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    out = []
    for k in range(levels):
        table = settle(pairs.join(ranked(pairs), ["r1", "r2"]).select(*KEY, "idx", "rank"), size)
        out.append(table)
        ahead = W.partitionBy(*KEY).orderBy("idx").rangeBetween(1 << k, 1 << k)
        pairs = table.withColumn("r2", F.max("rank").over(ahead)).where(F.col("r2").isNotNull())
        pairs = pairs.select(*KEY, "idx", F.col("rank").alias("r1"), "r2")
    return out


def later_copies(all_lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Line ranges to delete: key_a, key_b, pos, pos_end (positions among all lines, both ends included)."""
    active = materialise(runs(repeated_lines(all_lines), min_words))
    size = active.count()
    active = settle(active, size)
    found = settle(blocks(active, min_words), 2 * size)
    longest = found.agg(F.max("n")).first()[0] or 0
    named = None
    for k, level in enumerate(rank_levels(active, int(longest).bit_length(), size)):
        mine = found.where((F.col("n") >= 1 << k) & (F.col("n") < 2 << k)).withColumn("tail", (F.col("idx") + F.col("n") - (1 << k)).cast("int"))
        mine = mine.join(level.withColumnRenamed("rank", "ra"), [*KEY, "idx"])
        mine = mine.join(level.select(*KEY, F.col("idx").alias("tail"), F.col("rank").alias("rb")), [*KEY, "tail"])
        named = mine if named is None else named.unionAll(mine)
    if named is None:
        return found.select(*KEY, "pos", "pos_end").limit(0)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *KEY, "idx")
    named = settle(named.select("n", "ra", "rb", *KEY, "pos", "pos_end", order.alias("place")), 2 * size)
    # An interval of the suffix array: all suffixes that share this block. One row each, combined before the shuffle.
    intervals = named.groupBy("n", "ra", "rb").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    copies = named.join(settle(intervals.where("copies > 1").drop("copies"), size), ["n", "ra", "rb"])
    return copies.where(F.col("place") != F.col("first")).select(*KEY, "pos", "pos_end")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with deletions: key_a, key_b, gone (positions of deleted lines)."""
    ranges = later_copies(materialise(lines(docs, id_col, text_col)), min_words)
    gone = F.explode(F.sequence("pos", "pos_end")).alias("pos")
    return ranges.distinct().select(*KEY, gone).groupBy(*KEY).agg(F.collect_set("pos").alias("gone"))


def _cleaned(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the text cut, and the name of a column that holds the number of deleted lines."""
    tagged, (a, b) = keyed(docs, id_col, text_col)
    gone, count = fresh(tagged, "_gone"), fresh(tagged, "_deleted")
    cut = materialise(deletions(docs, min_words, id_col, text_col)).select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("gone").alias(gone))
    joined = tagged.join(cut, [a, b], "left")
    split = _line_array(ref(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), ref(gone))
    text = F.when(ref(gone).isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")).otherwise(ref(text_col))
    out = joined.select(*[text.alias(c) if c == text_col else ref(c) for c in docs.columns], F.coalesce(F.size(ref(gone)), F.lit(0)).alias(count))
    return out, count


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the texts; documents that lose everything go."""
    out, count = _cleaned(docs, min_words, id_col, text_col)
    left = (ref(count) <= 0) | (F.trim(F.translate(ref(text_col), "\r\n\t", "")) != "")
    return out.where(left).select(*[ref(c) for c in docs.columns])


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, lines_deleted, text_sha256 (of the text that is left; null for a null text)."""
    out, count = _cleaned(docs.select("doc_id", "text"), min_words, "doc_id", "text")
    return out.select("doc_id", F.greatest(ref(count), F.lit(0)).cast("long").alias("lines_deleted"), F.sha2("text", 256).alias("text_sha256"))
