"""Merges, cross-tabulations, melts, pivots and pair lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref

MISSING_LABEL = "nan"


def merge_on(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Left merge of two result tables on ``key``; other columns get the suffixes."""
    a = left.select(ref(key), *[ref(c).alias(c + suffixes[0]) for c in left.columns if c != key])
    b = right.select(ref(key), *[ref(c).alias(c + suffixes[1]) for c in right.columns if c != key])
    return a.join(b, key, "left")


def align_difference(treated: DataFrame, control: DataFrame, time: str, value: str) -> DataFrame:
    """Treated minus control at the treated times; times the control lacks are dropped."""
    c = control.select(ref(time), ref(value).alias("_control"))
    return treated.join(c, time, "left").select(ref(time), (ref(value) - F.col("_control")).alias("difference")).dropna()


def crosstab_long(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Counts per non-empty cell of two columns (a, b, count)."""
    ca, cb = (ref(c) if isinstance(c, str) else c for c in (a, b))
    return df.groupBy(ca.alias("a"), cb.alias("b")).agg(F.count("*").alias("count"))


MAX_PIVOT_LEVELS = 1000


def crosstab_wide(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row per level of ``a``, one column per level of ``b``; the number of levels of ``b`` is checked first."""
    df = df.where(ref(a).isNotNull() & ref(b).isNotNull())
    levels = df.select(ref(b).cast("string").alias("b")).distinct().limit(MAX_PIVOT_LEVELS + 1).collect()
    if len(levels) > MAX_PIVOT_LEVELS:
        raise ValueError(f"{b} has more than {MAX_PIVOT_LEVELS} levels; use crosstab_long")
    names = sorted(r["b"] for r in levels)
    return df.groupBy(ref(a)).pivot(b, names).agg(F.count(F.lit(1))).fillna(0)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot([ref(c) for c in ids], [ref(c) for c in values], "variable", "value")


def pivot_mean(df: DataFrame, row: str, col: str, value: str, levels: Sequence) -> DataFrame:
    return df.groupBy(ref(row)).pivot(col, list(levels)).agg(F.avg(ref(value)))


def upper_pairs(matrix: DataFrame) -> DataFrame:
    """Pairs i < j of a square matrix in long form (x, y, value, i, j)."""
    return matrix.where(F.col("i") < F.col("j")).drop("i", "j")


def category_text(col: str) -> Column:
    """The value as a category label, missing included as its own category."""
    return F.coalesce(ref(col).cast("string"), F.lit(MISSING_LABEL))


def top_or_other(df: DataFrame, col: str, keep: int, name: str) -> DataFrame:
    """Replace categories outside the ``keep`` most frequent by ``Other`` (ties broken by label)."""
    labelled = df.withColumn(name, category_text(col))
    top = (
        labelled.groupBy(name).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), name).limit(keep)
        .select(F.col(name).alias("_top"))
    )
    joined = labelled.join(F.broadcast(top), F.col(name) == F.col("_top"), "left")
    return joined.withColumn(name, F.coalesce("_top", F.lit("Other"))).drop("_top")


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def derive_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Place derived features beside the originals."""
    return df.withColumns(columns)
