"""Row and column selection: previews, drops, filters, duplicates, complete cases and their audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, numeric_columns, ref
from colonnade.functions.expressions import percent
from colonnade.operators.profile import flagged_columns, missing_report
from colonnade.session import broadcast_if_small


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*[ref(c) for c in order]).limit(n)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[ref(c) for c in cols])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*flagged_columns(df, "constant"))


def drop_id_columns(df: DataFrame) -> DataFrame:
    return df.drop(*flagged_columns(df, "possible_id"))


def columns_over_missing(df: DataFrame, threshold: float) -> list[str]:
    if threshold >= 100:
        return []
    rows = missing_report(df).where(F.col("missing_percent") > threshold).select("column").collect()
    names = {r["column"] for r in rows}
    return [c for c in df.columns if c in names]


def drop_missing_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Drop columns whose missing share exceeds ``threshold`` percent; 100 drops none."""
    return df.drop(*columns_over_missing(df, threshold))


def condition(df: DataFrame, col: str, op: str, value: str | float | None = None) -> Column:
    """True for the rows that the condition removes.

    Numbers compare with the value cast to double, everything else as text; ``contains`` is a regular expression on
    the text form. A missing value matches ``is missing`` and ``!=`` only.
    """
    c = ref(col)
    if op == "is missing":
        return c.isNull()
    if op == "contains":
        return F.coalesce(c.cast("string").rlike(str(value)), F.lit(False))
    numeric = col in numeric_columns(df)
    left, right = (c.cast("double"), F.lit(float(value))) if numeric else (c.cast("string"), F.lit(str(value)))
    tests = {
        "==": left == right, "!=": left != right, ">": left > right,
        ">=": left >= right, "<": left < right, "<=": left <= right,
    }
    if op not in tests:
        raise ValueError(f"unknown condition {op!r}")
    return F.coalesce(tests[op], F.lit(op == "!="))


def remove_rows(df: DataFrame, col: str, op: str, value: str | float | None = None) -> DataFrame:
    df = normalise_missing(df)
    return df.where(~condition(df, col, op, value))


def matching_rows(df: DataFrame, col: str, op: str, value: str | float | None = None) -> DataFrame:
    df = normalise_missing(df)
    return df.where(condition(df, col, op, value))


def remove_rows_by_id(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed in the single-column frame ``ids``."""
    listed = broadcast_if_small(ids.select(ref(ids.columns[0]).alias(id_col)).distinct())
    return df.join(listed, id_col, "left_anti")


def id_lookup_report(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """How many of the listed ids exist and how many do not."""
    listed = ids.select(ref(ids.columns[0]).alias("_id")).distinct()
    known = df.select(ref(id_col).alias("_id"), F.lit(True).alias("_hit")).dropDuplicates(["_id"])
    hit = F.col("_hit").isNotNull()
    return listed.join(known, "_id", "left").agg(
        F.count_if(hit).alias("valid_ids"), F.count_if(~hit).alias("unknown_ids")
    )


def any_missing(cols: Sequence[str]) -> Column:
    test = F.lit(False)
    for c in cols:
        test = test | ref(c).isNull()
    return test


def drop_missing_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    df = normalise_missing(df)
    return df.where(~any_missing(cols or df.columns))


def count_missing_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    df = normalise_missing(df)
    return df.agg(F.count_if(any_missing(cols or df.columns)).alias("rows_with_missing"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` second-or-later occurrences, ordered by all columns.

    Equal rows are counted before the shuffle and at most ``n`` copies of one row are written out, so a row repeated
    in a third of the table costs no more than any other.
    """
    cols = [ref(c) for c in df.columns]
    repeated = df.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1")
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("_n") - 1, F.lit(n)).cast("int")))
    return repeated.orderBy(*cols).limit(n).select(*cols, copies.alias("_k")).orderBy(*cols).limit(n).drop("_k")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The model frame: required columns only, rows with a missing value in any of them left out."""
    return drop_missing_rows(normalise_missing(df).select(*[ref(c) for c in cols]))


def case_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Source, eligible and excluded rows of a model frame, with the rule applied."""
    df = normalise_missing(df)
    out = df.agg(F.count("*").alias("source_rows"), F.count_if(~any_missing(cols)).alias("eligible_rows"))
    excluded = F.col("source_rows") - F.col("eligible_rows")
    return out.select(
        "*",
        excluded.alias("excluded_rows"),
        F.coalesce(percent(excluded, F.col("source_rows")), F.lit(0.0)).alias("excluded_percent"),
        F.lit("complete cases: " + ", ".join(cols)).alias("rule"),
    )


class RowsExcluded(ValueError):
    """Raised when the policy forbids leaving rows out."""


EXCLUDED_WARNING_PERCENT = 30.0


def model_frame(df: DataFrame, cols: Sequence[str], policy: str = "stop") -> tuple[DataFrame, dict]:
    """Complete cases under a row policy: ``stop`` raises when any row would be left out, ``exclude`` goes on.

    The audit comes back as a dict; ``warning`` is set when more than 30 % of the rows are excluded.
    """
    if policy not in ("stop", "exclude"):
        raise ValueError("policy is 'stop' or 'exclude'")
    audit = case_audit(df, cols).first().asDict()
    if audit["excluded_rows"] and policy == "stop":
        raise RowsExcluded(f"{audit['excluded_rows']} of {audit['source_rows']} rows hold missing values")
    audit["warning"] = audit["excluded_percent"] > EXCLUDED_WARNING_PERCENT
    return complete_cases(df, cols), audit


def split_accounting(df: DataFrame, split_col: str) -> DataFrame:
    """Rows per split and whether train and test add up to all rows."""
    out = df.agg(
        F.count_if(ref(split_col) == "train").alias("train_rows"),
        F.count_if(ref(split_col) == "test").alias("test_rows"),
        F.count("*").alias("eligible_rows"),
    )
    return out.withColumn("accounted", F.col("train_rows") + F.col("test_rows") == F.col("eligible_rows"))


def loss_band(lost_percent: Column) -> Column:
    return F.when(lost_percent > 30, "high").when(lost_percent > 10, "moderate").otherwise("low")


def cleaning_impact(df: DataFrame, removed: Column) -> DataFrame:
    """Rows before and after a removal, the share lost and its band, without writing the cleaned table."""
    out = df.agg(F.count("*").alias("rows_before"), F.count_if(~F.coalesce(removed, F.lit(False))).alias("rows_after"))
    lost = F.coalesce(percent(F.col("rows_before") - F.col("rows_after"), F.col("rows_before")), F.lit(0.0))
    return out.select("*", lost.alias("lost_percent"), loss_band(lost).alias("band"))


def relabel(df: DataFrame, col: str, labels: dict[str, str], name: str) -> DataFrame:
    """Add a display label; values without one keep their own text."""
    if not labels:
        return df.withColumn(name, ref(col).cast("string"))
    pairs = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, ref(col).cast("string")), ref(col).cast("string")))
