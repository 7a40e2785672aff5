"""The whole quality analysis of a table, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import categorical_columns, normalise_missing, numeric_columns
from colonnade.operators import profile, rows
from colonnade.operators.reshape import union_tables
from colonnade.session import keep
from colonnade.sources.writers import render_html

SMALL_TABLE = 100


def _rank() -> Column:
    return F.when(F.col("priority") == "High", 1).when(F.col("priority") == "Medium", 2).otherwise(3)


def _advice(area: str, priority: Column, text: Column) -> list[Column]:
    return [F.lit(area).alias("area"), priority.alias("priority"), text.alias("recommendation")]


def recommendations(df: DataFrame, cardinality_threshold: int = 50, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rule-based advice on size, missing values, duplicates, constant, identifier, high-cardinality and date columns
    and outliers, most urgent first. Every rule is an expression over a report table; ``known`` holds those at hand."""
    known = known or {}
    df = normalise_missing(df)
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    # Report tables of one row per column, each read by several rules.
    core = known["summary"] if "summary" in known else keep(profile.core_metrics(df))
    flags = known["flags"] if "flags" in known else keep(profile.column_flags(df, cardinality_threshold))
    missing = profile.missing_report(df).where("missing_count > 0")
    share = F.col("missing_percent")
    advice = F.when(share < 5, "low: remove the rows or impute").when(share <= 30, "moderate: impute before modelling").otherwise(
        "high: decide whether to keep, impute or drop")
    method = F.when(F.col("column").isin(numeric), "the median is safer than the mean").when(
        F.col("column").isin(categorical), "use the mode or an Unknown category").otherwise("look at the type first")
    small = F.col("row_count") < SMALL_TABLE
    parts = [
        core.select(*_advice("dataset size", F.when(small, "Medium").otherwise("Low"), F.when(small, "fewer than 100 rows: conclude with care").otherwise("enough rows to explore"))),
        core.select(*_advice("duplicates", F.when(F.col("duplicate_rows") > 0, "Medium").otherwise("Low"), F.when(
            F.col("duplicate_rows") > 0, F.concat(F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows: remove them first"))).otherwise("no duplicate rows"))),
        missing.select(*_advice("missing values", F.when(share < 5, "Low").when(share <= 30, "Medium").otherwise("High"),
                                F.concat_ws("; ", F.concat_ws(" ", "column", F.bround(share, 2).cast("string"), F.lit("% missing")), advice, method))),
        core.where("missing_cells = 0").select(*_advice("missing values", F.lit("Low"), F.lit("no missing values"))),
    ]
    listed = [("constant", "constant columns", "High", "one value only: "), ("possible_id", "id columns", "Medium", "identifiers, leave out of models: "),
              ("high_cardinality", "high cardinality", "Medium", "many categories, group or encode: ")]
    for flag, area, priority, text in listed:
        # At most one name per column of the table.
        names = flags.where(F.col(flag)).agg(F.array_sort(F.collect_list("column")).alias("n")).where(F.size("n") > 0)
        parts.append(names.select(*_advice(area, F.lit(priority), F.concat(F.lit(text), F.concat_ws(", ", "n")))))
    if any(t == "string" for _, t in df.dtypes):
        names = profile.date_like_columns(df).where("date_like").agg(F.array_sort(F.collect_list("column")).alias("n")).where(F.size("n") > 0)
        parts.append(names.select(*_advice("date columns", F.lit("Low"), F.concat(F.lit("dates held as text: "), F.concat_ws(", ", "n")))))
    if numeric:
        out = known["outliers"] if "outliers" in known else keep(profile.outliers_iqr(df, numeric))
        some = out.where("outliers > 0")
        parts.append(some.select(*_advice("outliers", F.lit("Medium"), F.concat_ws(" ", "column", F.bround("outlier_percent", 2).cast("string"), F.lit("% outside the fences: check them")))))
        none = out.agg(F.sum("outliers").alias("k")).where("k = 0")
        parts.append(none.select(*_advice("outliers", F.lit("Low"), F.lit("no outliers"))))
    return union_tables(parts).orderBy(_rank(), "area", "recommendation")


def recommendation_counts(advice: DataFrame) -> DataFrame:
    return advice.groupBy("priority").agg(F.count("*").alias("count"))


def quality_reports(df: DataFrame, cardinality_threshold: int = 50) -> dict[str, DataFrame]:
    """All report tables of a dataset by name, computed when read."""
    df = normalise_missing(df)
    numeric = numeric_columns(df)
    # Of one row per column each; the grouping of all cells behind three of them, and of all rows, is done once.
    columns = keep(profile.dtype_report(df))
    known = {"summary": keep(profile.core_metrics(df)), "flags": keep(profile.column_flags(df, cardinality_threshold, columns))}
    if numeric:
        known["outliers"] = keep(profile.outliers_iqr(df, numeric))
    out = {
        "summary": known["summary"], "missing": profile.missing_report(df), "column_types": columns,
        "unique": profile.unique_report(df, columns), "flags": known["flags"],
        "duplicates": rows.duplicate_preview(df), "recommendations": recommendations(df, cardinality_threshold, known),
    }
    if numeric:
        out["outliers"] = known["outliers"]
    return out


def quality_overview(df: DataFrame, cardinality_threshold: int = 50) -> DataFrame:
    """One row: size, missing and duplicate counts, worst column status and the number of flagged columns."""
    flags = profile.column_flags(df, cardinality_threshold).agg(
        F.count_if("possible_id").alias("id_columns"), F.count_if("constant").alias("constant_columns"), F.count_if("high_cardinality").alias("high_cardinality_columns"))
    return profile.core_metrics(df).join(F.broadcast(profile.dataset_status(df))).join(F.broadcast(flags))


def html_report(df: DataFrame, title: str) -> str:
    reports = quality_reports(df)
    return render_html(title, reports)


def causal_html_report(title: str, balance: DataFrame, effects: DataFrame, bounds: DataFrame | None = None) -> str:
    """Balance, effects and, if computed, sensitivity bounds as one page."""
    sections = {"Balance": balance, "Effects": effects}
    if bounds is not None:
        sections["Sensitivity bounds"] = bounds
    return render_html(title, sections)
