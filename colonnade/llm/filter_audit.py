"""Filter interaction audit by contraction of contingency tensors.

Five filters look at every document; what they decide together is one of 32 patterns. Per part of the corpus the documents
of each pattern are counted (all, good and toxic ones), and the counts are reshaped to a 2x2x2x2x2 tensor. Whatever an order
of the filters does at a step is a contraction of that tensor: along the axes of earlier filters it keeps what passes, along
the axis of the step's own filter what fails, along the others all. One einsum gives every order and step at once.

A filter for exact copies fails every document whose text a smaller id has. Equal texts agree in all other filters, so it
suffices to know, per text, the smallest id and how many rows carry it: digests are counted and combined before each
shuffle, and no group of copies ever meets in one task.

Defined cases: a null text is empty; a null source is the empty string; a null id is no smaller than any other and is not a
copy of a smaller one; repeated rows of the smallest id all pass; a label counts if any row of ``labels`` with that id
bears it; without documents the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import settle

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # of a hundred words
MAX_CAPITALS = 2  # of a hundred code points
MARKS = "#$%&*|"
# Parts contracted at once; each gives orders x steps rows.
PART_BLOCK = 64


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: few words, few distinct words, many capitals, marks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def pattern_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, pattern (bit i set: filter i fails), n, good, toxic: documents of each part and pattern."""
    text = F.coalesce(ref(text_col), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(ref(id_col).alias("id"), F.coalesce(ref(source_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
    rows = rows.groupBy("digest", "bits", "part", "id").agg(F.count("*").alias("n"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    no = F.lit(False)
    rows = rows.join(marked, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # Of each text, part and label: all rows, and the smallest id with its rows.
    per_text = rows.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("head"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    per_text = settle(per_text)
    lowest = per_text.groupBy("digest").agg(F.min("head.id").alias("lowest"))
    per_text = per_text.join(lowest, "digest")
    first = F.when(F.col("head.id") == F.col("lowest"), F.col("head.n")).otherwise(0) + F.col("nameless")
    outcome = F.array(
        F.struct(F.col("bits").alias("pattern"), first.alias("n")),
        F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("pattern"), (F.col("n") - first).alias("n")),
    )
    counts = per_text.select("part", "good", "toxic", F.explode(outcome).alias("o")).select("part", "good", "toxic", "o.*")
    return counts.groupBy("part", "pattern").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def selectors() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All orders of the filters; per order and step the filter's number and what is selected along each axis.

    Axis vectors are (1, 0) for pass, (0, 1) for fail, (1, 1) for all; the selections have shape (orders x steps, axes, 2):
    removed here, left after the step, and failing whatever else happens; the last is by filter: failing this one only.
    """
    passes, fails, both = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    size = len(FILTERS)
    orders = list(permutations(range(size)))
    own, removed, kept, failing = [], [], [], []
    for order in orders:
        for step, mine in enumerate(order):
            earlier = order[:step]
            own.append(mine)
            removed.append([fails if a == mine else passes if a in earlier else both for a in range(size)])
            kept.append([passes if a == mine or a in earlier else both for a in range(size)])
            failing.append([fails if a == mine else both for a in range(size)])
    names = ["".join(FILTERS[i] for i in order) for order in orders]
    return names, np.array(own), np.array(removed), np.array(kept), np.array(failing)


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums (parts x measures x selections) of ``tensor`` (parts x measures x 2 x 2 x 2 x 2 x 2) under ``chosen``."""
    return np.einsum("pmabcde,sa,sb,sc,sd,se->pms", tensor, *[chosen[:, a] for a in range(len(FILTERS))], optimize=True)


def audit(counts: DataFrame) -> DataFrame:
    """Per part, order and step what pattern counts (part, pattern, n, good, toxic) say."""
    cells = 1 << len(FILTERS)
    slots = [
        F.coalesce(F.sum(F.when(F.col("pattern") == i, F.col(m))), F.lit(0)).cast("long")
        for m in ("n", "good", "toxic")
        for i in range(cells)
    ]
    wide = counts.groupBy("part").agg(F.array(*slots).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own, removed, kept, failing = selectors()
        steps = len(FILTERS)
        alone = np.array([[[0, 1] if a == f else [1, 0] for a in range(steps)] for f in range(steps)])
        letters = np.array(list(FILTERS))[own]
        order, step = np.repeat(np.array(names, dtype=object), steps), np.tile(np.arange(1, steps + 1), len(names))
        for pdf in batches:
            for lo in range(0, len(pdf), PART_BLOCK):
                part = pdf.iloc[lo : lo + PART_BLOCK]
                # Bit i of a pattern is axis i, so the last bit comes first in memory.
                tensor = np.stack(part["cells"].to_numpy()).astype(np.int64).reshape(-1, 3, *[2] * steps)
                tensor = tensor.transpose(0, 1, *range(steps + 1, 1, -1))
                gone = contract(tensor, removed)
                total = contract(tensor[:, :1], failing)[:, 0]
                value = np.stack([gone[:, 0, own == f].sum(axis=1) for f in range(steps)], axis=1)
                only = contract(tensor[:, :1], alone)[:, 0]
                parts = len(part)
                yield pd.DataFrame(
                    {
                        "part": np.repeat(part["part"].to_numpy(), len(own)), "filter_order": np.tile(order, parts),
                        "step": np.tile(step, parts), "filter": np.tile(letters, parts),
                        "kept": contract(tensor[:, :1], kept)[:, 0].ravel(), "removed": gone[:, 0].ravel(),
                        "redundant": (total - gone[:, 0]).ravel(), "unique_fails": only[:, own].ravel(),
                        "good_lost": gone[:, 1].ravel(), "toxic_lost": gone[:, 2].ravel(), "shapley": value[:, own].ravel(),
                    }
                )

    return wide.mapInPandas(
        run,
        "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long",
    )


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step of the five filters over ``docs``."""
    return audit(pattern_counts(docs, labels))
