"""Profiling: counts, types, uniqueness, outliers and per-column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import as_text, categorical_columns, normalise_missing, numeric_columns, ref
from colonnade.functions.expressions import kurtosis_adjusted, percent, ratio, skew_adjusted
from colonnade.functions.ordering import running_totals
from colonnade.functions.quantiles import quantile_columns

# Texts longer than this are counted by their SHA-256, so that a distinct count does not shuffle whole documents.
KEY_LENGTH = 64

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _per_column(df: DataFrame, cols: Sequence[str], metrics: dict[str, object]) -> DataFrame:
    """One aggregate over all columns, turned into one row per column. ``metrics`` maps names to column functions."""
    if not cols:
        raise ValueError("no columns to report on")
    rows = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(m) for m, make in metrics.items()]) for c in cols
    ]
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def core_metrics(df: DataFrame, include_duplicates: bool = True) -> DataFrame:
    """Rows, columns, missing cells and their share; duplicate rows only on request since they need a shuffle."""
    df = normalise_missing(df)
    missing = sum((F.count_if(ref(c).isNull()) for c in df.columns), F.lit(0))
    width = len(df.columns)
    base = df.agg(F.count("*").alias("row_count"), missing.cast("long").alias("missing_cells"))
    if include_duplicates:
        base = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count("*").alias("_n"))
        per_row = sum((ref(c).isNull().cast("int") for c in df.columns), F.lit(0))
        base = base.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(per_row * F.col("_n")), F.lit(0)).cast("long").alias("missing_cells"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    return base.select(
        "*",
        F.lit(width).alias("column_count"),
        F.coalesce(percent(F.col("missing_cells"), F.col("row_count") * width), F.lit(0.0)).alias("missing_percent"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    df = normalise_missing(df)
    report = _per_column(
        df,
        df.columns,
        {
            "missing_count": lambda c: F.count_if(ref(c).isNull()),
            "missing_percent": lambda c: percent(F.count_if(ref(c).isNull()), F.count("*")),
        },
    )
    return report.orderBy(F.desc("missing_percent"), "column")


def column_values(df: DataFrame, cols: Sequence[str], whole_values: bool = True) -> DataFrame:
    """(column, value text, count) for every distinct value, missing included; combined before the shuffle."""
    df = normalise_missing(df)

    def key(c: str) -> Column:
        text = as_text(df, c)
        return text if whole_values else F.when(F.length(text) > KEY_LENGTH, F.sha2(text, 256)).otherwise(text)

    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), key(c).alias("value")) for c in cols]))
    return df.select(cells.alias("_c")).groupBy("_c.column", "_c.value").agg(F.count("*").alias("count"))


def dtype_report(df: DataFrame) -> DataFrame:
    """Data type, non-null, missing, missing % and distinct count of every column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    counts = column_values(df, df.columns, whole_values=False).groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0)).alias("non_null_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_values"),
    )
    names = F.create_map(*[F.lit(x) for item in types.items() for x in item])
    return counts.select(
        "column",
        names[F.col("column")].alias("data_type"),
        "non_null_count",
        "missing_count",
        percent(F.col("missing_count"), F.col("missing_count") + F.col("non_null_count")).alias("missing_percent"),
        "unique_values",
    )


def unique_report(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Distinct values and their share of ALL rows; ``report`` is the ``dtype_report`` where it is at hand."""
    report = dtype_report(df) if report is None else report
    rows = F.col("missing_count") + F.col("non_null_count")
    return report.select(
        "column", "unique_values", percent(F.col("unique_values"), rows).alias("unique_percent")
    ).orderBy(F.desc("unique_values"), "column")


def quality_status(missing_percent: Column) -> Column:
    return F.when(missing_percent < 5, "Good").when(missing_percent <= 30, "Warning").otherwise("Critical")


def dataset_status(df: DataFrame) -> DataFrame:
    """Status band of the column with the largest share of missing values."""
    worst = missing_report(df).agg(F.max("missing_percent").alias("max_missing_percent"))
    return worst.select("*", quality_status(F.col("max_missing_percent")).alias("status"))


# A column whose lower-cased name holds one of these parts counts as an identifier.
ID_NAME_PARTS = ("id", "code", "number")
ID_UNIQUE_RATIO = 0.90


def id_name(column: Column) -> Column:
    test = F.lit(False)
    for part in ID_NAME_PARTS:
        test = test | F.lower(column).contains(part)
    return test


def column_flags(df: DataFrame, cardinality_threshold: int = 50, report: DataFrame | None = None) -> DataFrame:
    """Distinct count with the flags possible_id, constant and high_cardinality, one row per column."""
    categorical = categorical_columns(df)
    report = dtype_report(df) if report is None else report
    rows = F.col("missing_count") + F.col("non_null_count")
    high = F.col("column").isin(categorical) if categorical else F.lit(False)
    return report.select(
        "column",
        "unique_values",
        (id_name(F.col("column")) | (ratio(F.col("unique_values"), rows) > ID_UNIQUE_RATIO)).alias("possible_id"),
        (F.col("unique_values") <= 1).alias("constant"),
        (high & (F.col("unique_values") > cardinality_threshold)).alias("high_cardinality"),
    )


def flagged_columns(df: DataFrame, flag: str, **options: int) -> list[str]:
    """Names of the flagged columns, in table order (one short row per column reaches the driver)."""
    names = {r["column"] for r in column_flags(df, **options).where(F.col(flag)).select("column").collect()}
    return [c for c in df.columns if c in names]


# Fixed formats tried when a text is tested for being a date.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
DATE_SHARE = 0.70


def parse_timestamp(text: Column) -> Column:
    tried = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tried)


def date_like_columns(df: DataFrame, share: float = DATE_SHARE) -> DataFrame:
    """Share of the non-missing texts that parse as a date, per text column, over all rows.

    Texts of up to KEY_LENGTH are grouped first and tried once each; longer ones are tried row by row and never shuffled.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        raise ValueError("no columns to report on")
    short = F.length("text") <= KEY_LENGTH
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ref(c).alias("text")) for i, c in enumerate(texts)]))
    cells = df.select(cells.alias("_c")).select("_c.i", "_c.text")
    counts = cells.groupBy("i", F.when(short, F.col("text")).alias("value"), F.when(~short, parse_timestamp(F.col("text")).isNotNull()).alias("long")).agg(
        F.count("text").alias("n"))
    hit = F.when(F.col("value").isNotNull(), parse_timestamp(F.col("value")).isNotNull()).otherwise(F.coalesce("long", F.lit(False)))
    sums = counts.groupBy("i").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("parsed"), F.sum("n").alias("known"))
    per = sums.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("parsed", "known")))).alias("_m"))  # one entry per column
    part = [F.struct(F.lit(c).alias("column"), ratio(F.coalesce(F.col("_m")[i]["parsed"], F.lit(0)), F.coalesce(F.col("_m")[i]["known"], F.lit(0))).alias("parsed_share")) for i, c in enumerate(texts)]
    out = per.select(F.explode(F.array(*part)).alias("_r")).select("_r.*")
    return out.select("*", F.coalesce(F.col("parsed_share") > share, F.lit(False)).alias("date_like"))


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences at 1.5 IQR and the values outside them, per column (and group)."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    bounds = iqr_bounds(df, cols, by)
    from colonnade.functions.quantiles import melt
    from colonnade.session import broadcast_if_small

    small = F.broadcast(bounds) if not by else broadcast_if_small(bounds)
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return (
        melt(df, cols, by)
        .join(small, [*by, "column"])
        .groupBy(*by, "column", "q1", "q3", "iqr", "lower", "upper")
        .agg(F.count_if(outside).alias("outliers"), percent(F.count_if(outside), F.count("*")).alias("outlier_percent"))
    )


def iqr_bounds(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    q = quantile_columns(df, cols, {"q1": 0.25, "q3": 0.75}, by)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *by, "column", "n", "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"),
    )


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Values further than ``threshold`` standard deviations from the mean; constant columns are left out."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    stats = df.agg(
        *[F.avg(ref(c)).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(ref(c)).alias(f"s_{i}") for i, c in enumerate(cols)],
    )
    # One row of means and deviations, so broadcasting it is bounded by the number of columns.
    joined = df.select(*[ref(c).cast("double").alias(f"x_{i}") for i, c in enumerate(cols)]).join(F.broadcast(stats))
    rows = []
    for i, c in enumerate(cols):
        z = ratio(F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")), F.col(f"s_{i}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.max(f"m_{i}").alias("mean"),
                F.max(f"s_{i}").alias("std"),
                F.lit(float(threshold)).alias("threshold"),
                F.count_if(z > threshold).alias("outliers"),
                percent(F.count_if(z > threshold), F.count(f"x_{i}")).alias("outlier_percent"),
            )
        )
    out = joined.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    return out.where(F.col("std") > 0)


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, missing, moments, quartiles, range and coefficient of variation of each numeric column."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    moments = _per_column(
        df,
        cols,
        {
            "n_missing": lambda c: F.count_if(ref(c).isNull()),
            "mean": lambda c: F.avg(ref(c)),
            "std": lambda c: F.stddev_samp(ref(c)),
            "skewness": lambda c: skew_adjusted(ref(c).cast("double")),
            "kurtosis": lambda c: kurtosis_adjusted(ref(c).cast("double")),
            "min": lambda c: F.min(ref(c).cast("double")),
            "max": lambda c: F.max(ref(c).cast("double")),
            "cv_percent": lambda c: percent(F.stddev_samp(ref(c)), F.avg(ref(c))),
        },
    )
    return moments.join(F.broadcast(quantile_columns(df, cols, QUARTILES)), "column")


def numeric_advice(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rule-based advice per numeric column: skewness, kurtosis, missing share, outliers."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    p = numeric_profile(df, cols).join(F.broadcast(outliers_iqr(df, cols).select("column", "outliers")), "column")
    skew, share = F.abs(F.col("skewness")), percent(F.col("n_missing"), F.col("n") + F.col("n_missing"))

    def issue(test: Column, name: str, measure: Column, priority: Column) -> Column:
        value = F.struct(F.lit(name).alias("issue"), measure.alias("measure"), priority.alias("priority"))
        return F.when(test, value)

    rules = F.array(
        issue(skew > 1, "high skewness", F.col("skewness"), F.lit("High")),
        issue((skew > 0.5) & (skew <= 1), "moderate skewness", F.col("skewness"), F.lit("Medium")),
        issue(F.abs(F.col("kurtosis")) > 3, "high kurtosis", F.col("kurtosis"), F.lit("Medium")),
        issue(share > 0, "missing values", share, missing_priority(share)),
        issue(F.col("outliers") > 0, "outliers", F.col("outliers").cast("double"), F.lit("Medium")),
    )
    return p.select("column", F.explode(F.array_compact(rules)).alias("_i")).select("column", "_i.*")


def missing_priority(share: Column) -> Column:
    return F.when(share > 30, "High").when(share > 5, "Medium").otherwise("Low")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of the non-missing values with % and the cumulative sum of the rounded %, most frequent first."""
    counts = column_values(df.select(ref(col)), [col]).where(F.col("value").isNotNull()).select("value", "count")
    whole = counts.agg(F.sum("count").alias("_n"))
    share = F.bround(percent(F.col("count"), F.col("_n")), 2)
    shares = counts.join(F.broadcast(whole)).select("value", "count", share.alias("percent"))
    total = running_totals(shares, ["-count", "value"], {"percent": "cumulative_percent"})
    return total.withColumn("cumulative_percent", F.bround("cumulative_percent", 2))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, missing, unique, mode and its share, entropy in bits and entropy over its maximum, per column."""
    cols = list(cols or categorical_columns(df))
    counts = column_values(df, cols)
    known = F.when(F.col("value").isNotNull(), F.col("count"))
    # Entropy from sums: log2(n) - sum(c*log2(c))/n. The mode is the smallest value among the most frequent.
    best = F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("count"), F.col("value").alias("v"))))
    stats = counts.groupBy("column").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
        best["v"].alias("mode"),
        F.max(known).alias("mode_count"),
        F.sum(known * F.log2(known)).alias("_clogc"),
    )
    n = F.col("n").cast("double")
    entropy = F.greatest(F.log2(n) - ratio(F.col("_clogc"), n), F.lit(0.0))
    stats = stats.withColumn("entropy", entropy)
    top = F.when(F.col("n_unique") > 1, F.log2(F.col("n_unique").cast("double"))).otherwise(1.0)
    return stats.select(
        "column", "n", "n_missing", "n_unique", "mode",
        percent(F.col("mode_count"), F.col("n")).alias("mode_percent"),
        "entropy", (F.col("entropy") / top).alias("normalized_entropy"),
    )


RARE_PERCENT = 5.0
DOMINANT_PERCENT = 90.0


def rare_categories(df: DataFrame, col: str) -> DataFrame:
    """Categories holding less than 5 % of the non-missing rows each."""
    counts = column_values(df.select(ref(col)), [col]).where(F.col("value").isNotNull())
    whole = counts.agg(F.sum("count").alias("_n"))
    share = percent(F.col("count"), F.col("_n"))
    return counts.join(F.broadcast(whole)).select("value", "count", share.alias("percent")).where(
        F.col("percent") < RARE_PERCENT
    )


def categorical_advice(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rule-based advice per categorical column: missing, rare categories, cardinality, dominant category."""
    cols = list(cols or categorical_columns(df))
    p = categorical_profile(df, cols)
    counts = column_values(df, cols).where(F.col("value").isNotNull())
    sizes = counts.groupBy("column").agg(F.sum("count").alias("_n"))
    rare = (
        counts.join(F.broadcast(sizes), "column")
        .groupBy("column")
        .agg(F.count_if(percent(F.col("count"), F.col("_n")) < RARE_PERCENT).alias("n_rare"))
    )
    p = p.join(F.broadcast(rare), "column", "left")
    share = percent(F.col("n_missing"), F.col("n") + F.col("n_missing"))

    def issue(test: Column, name: str, measure: Column, priority: Column) -> Column:
        value = F.struct(F.lit(name).alias("issue"), measure.cast("double").alias("measure"), priority.alias("priority"))
        return F.when(test, value)

    rules = F.array(
        issue(share > 0, "missing values", share, missing_priority(share)),
        issue(F.col("n_rare") > 0, "rare categories", F.col("n_rare"), F.lit("Medium")),
        issue(F.col("n_unique") > 50, "high cardinality", F.col("n_unique"), F.lit("Medium")),
        issue(F.col("mode_percent") > DOMINANT_PERCENT, "dominant category", F.col("mode_percent"), F.lit("High")),
    )
    return p.select("column", F.explode(F.array_compact(rules)).alias("_i")).select("column", "_i.*")


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value of each column as text (smallest among ties) and its count."""
    counts = column_values(df, cols).where(F.col("value").isNotNull())
    best = F.min(F.struct(-F.col("count"), F.col("value").alias("v"), F.col("count").alias("c")))
    return counts.groupBy("column").agg(best.alias("_b")).select(
        "column", F.col("_b.v").alias("top"), F.col("_b.c").alias("freq")
    )


def summary_table(df: DataFrame) -> DataFrame:
    """All columns in one table: type, valid, missing %, unique, moments for numbers, mode for the rest."""
    df = normalise_missing(df)
    numeric = numeric_columns(df)
    rest = [c for c in df.columns if c not in numeric]
    out = dtype_report(df).select("column", "data_type", F.col("non_null_count").alias("n_valid"), "missing_percent",
                                  F.col("unique_values").alias("n_unique"))
    if numeric:
        moments = _per_column(
            df,
            numeric,
            {
                "mean": lambda c: F.avg(ref(c)),
                "std": lambda c: F.stddev_samp(ref(c)),
                "skewness": lambda c: skew_adjusted(ref(c).cast("double")),
                "min": lambda c: F.min(ref(c).cast("double")),
                "max": lambda c: F.max(ref(c).cast("double")),
            },
        )
        out = out.join(F.broadcast(moments), "column", "left")
        needs = F.when(F.abs("skewness") > 1, "YES").otherwise("NO")
    else:
        needs = F.lit("N/A")
    needs = F.when(F.col("column").isin(numeric), needs).otherwise("N/A") if numeric else needs
    if rest:
        modes = column_modes(df, rest).select("column", F.substring("top", 1, 20).alias("mode"))
        out = out.join(F.broadcast(modes), "column", "left")
    return out.withColumn("needs_transform", needs)


def describe_all(df: DataFrame) -> DataFrame:
    """count, unique, top, freq for text; count, mean, std, min, quartiles, max for numbers."""
    df = normalise_missing(df)
    numeric = numeric_columns(df)
    text = [c for c in df.columns if c not in numeric]
    out = _per_column(df, df.columns, {"count": lambda c: F.count(ref(c))})
    if text:
        unique = column_values(df, text, whole_values=False).groupBy("column").agg(F.count("value").alias("unique"))
        out = out.join(F.broadcast(unique), "column", "left")
        out = out.join(F.broadcast(column_modes(df, text)), "column", "left")
    if numeric:
        p = numeric_profile(df, numeric).select("column", "mean", "std", "min", "q1", "median", "q3", "max")
        out = out.join(F.broadcast(p), "column", "left")
    return out


def type_frequency(df: DataFrame) -> DataFrame:
    types = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "data_type string")
    return types.groupBy("data_type").agg(F.count("*").alias("columns"))


def qq_points(df: DataFrame, col: str, points: int = 1000) -> DataFrame:
    """Normal quantiles against sample values at evenly spaced ranks (all of them when the sample is smaller).

    The plotting positions are Filliben's order-statistic medians.
    """
    from colonnade.functions.quantiles import melt
    from colonnade.functions.special import normal_quantile_column

    counts = melt(df, [col]).groupBy("value").agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, ["value"], {"_c": "_upto"}, grand=True)
    n = F.col("_upto_all").cast("double")
    # Ranks 1..n thinned to a grid of at most ``points`` ranks, each block of equal values keeping its own ranks.
    step = F.greatest(n - 1, F.lit(1.0)) / F.least(n - 1, F.lit(float(points - 1)))
    first = F.ceil((F.col("_upto") - F.col("_c")) / step - F.lit(1e-9))
    last = F.ceil(F.col("_upto") / step - F.lit(1e-9)) - 1
    grid = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = ranked.select("value", n.alias("n"), step.alias("_s"), F.explode(grid).alias("_g"))
    i = F.floor(F.col("_g") * F.col("_s") + F.lit(1e-9)) + 1
    top = F.pow(F.lit(0.5), 1 / F.col("n"))
    median = F.when(i == 1, 1 - top).when(i == F.col("n"), top).otherwise((i - 0.3175) / (F.col("n") + 0.365))
    return rows.select(
        i.cast("long").alias("rank"), median.alias("probability"), F.col("value").alias("sample_quantile")
    ).withColumn("normal_quantile", normal_quantile_column("probability"))
