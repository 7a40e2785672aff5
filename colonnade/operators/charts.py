"""Numbers behind the charts, computed on all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref
from colonnade.functions.expressions import percent, ratio, skew_adjusted
from colonnade.functions.ordering import running_totals
from colonnade.functions.quantiles import melt, quantile_columns
from colonnade.operators.reshape import category_text, crosstab_long, top_or_other
from colonnade.session import broadcast_if_small


def _range(df: DataFrame, col: str, lo: str, hi: str) -> list[Column]:
    """Limits of a histogram axis; a constant column gets half a unit on each side."""
    a, b = F.min(ref(col)), F.max(ref(col))
    flat = a == b
    return [F.when(flat, a - 0.5).otherwise(a).alias(lo), F.when(flat, b + 0.5).otherwise(b).alias(hi)]


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin, the last one closed."""
    return F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram with the probability density; every bin is reported, empty ones too.

    With ``by`` all groups share the bins of the whole column and have their own density.
    """
    values = melt(df, [col], by).select(*by, "value")
    limits = values.agg(*_range(values, "value", "lo", "hi"))
    binned = values.join(F.broadcast(limits)).select(
        *by, "lo", "hi", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    )
    counts = binned.groupBy(*by, "lo", "hi", "bin").agg(F.count("*").alias("c"))
    # Counts per group as one map, so that empty bins can be filled in without another join.
    packed = counts.groupBy(*by, "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"), F.sum("c").alias("_n")
    )
    rows = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    count = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0))
    return rows.select(
        *by, "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        count.cast("long").alias("count"),
        (count / (F.col("_n") * width)).alias("density"),
    )


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Counts per non-empty cell of a ``bins`` by ``bins`` grid over the complete pairs."""
    pairs = normalise_missing(df.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))).dropna()
    limits = pairs.agg(*_range(pairs, "x", "xlo", "xhi"), *_range(pairs, "y", "ylo", "yhi"))
    cells = pairs.join(F.broadcast(limits)).select(
        _bin(F.col("x"), F.col("xlo"), F.col("xhi"), bins).alias("x_bin"),
        _bin(F.col("y"), F.col("ylo"), F.col("yhi"), bins).alias("y_bin"),
    )
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))


def ecdf_quantiles(df: DataFrame, col: str, points: int = 2000) -> DataFrame:
    """Empirical distribution as ``points`` exact, evenly spaced quantiles (fewer when there are fewer rows)."""
    counts = melt(df, [col]).groupBy("value").agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, ["value"], {"_c": "_end"}, grand=True)
    n = F.col("_end_all")
    m = F.least(n, F.lit(points))
    gaps = F.greatest(m - 1, F.lit(1))
    first = F.col("_end") - F.col("_c")
    # Position g*(n-1)/(m-1) has whole part floor(g*(n-1)/(m-1)); integer arithmetic keeps it exact.
    g_low = F.floor((first * gaps + n - 2) / F.greatest(n - 1, F.lit(1)))
    g_low = F.when(n == 1, 0).otherwise(g_low)
    g_high = F.when(n == 1, 0).otherwise(F.floor((F.col("_end") * gaps - 1) / F.greatest(n - 1, F.lit(1))))
    g_high = F.least(g_high, m - 1)
    here = F.when(g_high >= g_low, F.sequence(g_low.cast("long"), g_high.cast("long")))
    # The upper neighbour of an interpolated position is the value at the next rank.
    up_low = F.floor(((first - 1) * gaps + n - 2) / F.greatest(n - 1, F.lit(1)))
    up_low = F.when(first == 0, 0).otherwise(up_low)
    up_high = F.least(F.floor(((F.col("_end") - 1) * gaps - 1) / F.greatest(n - 1, F.lit(1))), m - 1)
    above = F.when((up_high >= up_low) & (n > 1), F.sequence(up_low.cast("long"), up_high.cast("long")))
    at = F.explode(
        F.concat(
            F.transform(F.coalesce(here, F.array().cast("array<bigint>")), lambda g: F.struct(g.alias("g"), F.lit(0).alias("k"))),
            F.transform(F.coalesce(above, F.array().cast("array<bigint>")), lambda g: F.struct(g.alias("g"), F.lit(1).alias("k"))),
        )
    )
    picks = ranked.select("value", n.alias("n"), m.alias("m"), gaps.alias("gaps"), at.alias("_p"))
    wide = picks.groupBy(F.col("_p.g").alias("g"), "n", "m", "gaps").agg(
        F.max(F.when(F.col("_p.k") == 0, F.col("value"))).alias("x0"),
        F.max(F.when(F.col("_p.k") == 1, F.col("value"))).alias("x1"),
    )
    rest = ((F.col("g") * (F.col("n") - 1)) % F.col("gaps")) / F.col("gaps")
    value = F.when(rest == 0, F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * rest)
    return wide.select(F.col("g").alias("point"), (F.col("g") / F.col("gaps")).alias("probability"), value.alias("value"))


def variable_summary(df: DataFrame, col: str) -> DataFrame:
    df = normalise_missing(df)
    c = ref(col).cast("double")
    stats = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), skew_adjusted(c).alias("skewness"))
    return stats.join(F.broadcast(quantile_columns(df, [col], {"median": 0.5}).select("median")))


def box_statistics(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends (last values inside the fences), values outside, count and mean, per group."""
    q = quantile_columns(df, [col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).drop("column", "n")
    small = broadcast_if_small(q) if by else F.broadcast(q)
    values = melt(df, [col], by)
    joined = values.join(small, list(by)) if by else values.join(small)
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col("value")
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.min(F.when(v >= low, v)).alias("whisker_low"),
        F.max(F.when(v <= high, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("outliers"),
    )


def top_categories(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Most frequent categories with their share of ALL rows; missing is a category."""
    counts = df.groupBy(category_text(col).alias("category")).agg(F.count("*").alias("count"))
    whole = counts.agg(F.sum("count").alias("_n"))
    return (
        counts.orderBy(F.desc("count"), "category").limit(n).join(F.broadcast(whole))
        .select("category", "count", percent(F.col("count"), F.col("_n")).alias("percent"))
    )


def mean_sd_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    df = normalise_missing(df).where(ref(category).isNotNull())
    v = ref(value)
    return df.groupBy(ref(category).alias("category")).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"),
        ratio(F.stddev_samp(v), F.sqrt(F.count(v))).alias("se"),
    )


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line with Pearson r, R squared and the t statistic of r, over the complete pairs."""
    pairs = normalise_missing(df.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))).dropna()
    out = pairs.agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"),
    )
    r2 = F.col("r") * F.col("r")
    t = ratio(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - r2))
    return out.select("*", r2.alias("r_squared"), t.alias("t_statistic"))


def bounded_crosstab(df: DataFrame, a: str, b: str, keep: int = 30) -> DataFrame:
    """Cross-tabulation with all but the ``keep`` most frequent categories of each axis merged into Other."""
    merged = top_or_other(top_or_other(df, a, keep, "_a"), b, keep, "_b")
    return crosstab_long(merged, "_a", "_b")


def radar_means(df: DataFrame, category: str, cols: Sequence[str], groups: int = 20) -> DataFrame:
    """Means per group for the largest groups, scaled to 0..1 across those groups."""
    df = normalise_missing(df)
    # Missing counts as a category when the largest groups are chosen, but has no mean of its own.
    top = (
        df.groupBy(ref(category).alias("category"))
        .agg(F.count("*").alias("_n"), *[F.avg(ref(c)).alias(c) for c in cols])
        .orderBy(F.desc("_n"), "category").limit(groups).where(F.col("category").isNotNull())
    )
    whole = W.partitionBy(F.lit(0))  # at most ``groups`` rows
    scaled = [
        ((ref(c) - F.min(ref(c)).over(whole)) / (F.max(ref(c)).over(whole) - F.min(ref(c)).over(whole) + 1e-9)).alias(c)
        for c in cols
    ]
    return top.select("category", *scaled)


def line_display(
    df: DataFrame, x: str, ys: Sequence[str], row_id: str, color: str | None = None, max_points: int = 20_000
) -> DataFrame:
    """Ordered mean buckets, at most ``max_points`` in all, shared out by group size; first x of each bucket.

    A table that already fits is returned as it is, one bucket per row.
    """
    df = normalise_missing(df)
    by = ["_g"] if color else []
    rows = df.where(ref(x).isNotNull()).select(
        *([category_text(color).alias("_g")] if color else []),
        ref(x).alias("x"), ref(row_id).alias("_id"), *[ref(y).cast("double").alias(y) for y in ys],
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = running_totals(rows, ["x", "_id"], {"_one": "_pos"}, by, grand=True)
    n = F.col("_pos_all")
    total = rows.agg(F.count("*").alias("_total"))
    ranked = ranked.join(F.broadcast(total))
    share = F.greatest(F.bround(n / F.col("_total") * max_points), F.lit(1.0)).cast("long")
    alloc = F.when(F.col("_total") <= max_points, n).otherwise(share)
    bucket = F.least(F.floor((F.col("_pos") - 1) * alloc / n), alloc - 1)
    out = ranked.groupBy(*by, bucket.alias("bucket")).agg(F.min("x").alias("x"), *[F.avg(y).alias(y) for y in ys])
    return out.withColumnRenamed("_g", "color") if color else out


def hierarchy(df: DataFrame, path: Sequence[str], value: str | None = None, keep: int = 5000) -> DataFrame:
    """Counts or sums per path of categories; incomplete paths dropped, the largest ``keep`` reported."""
    df = normalise_missing(df)
    measure = F.count("*") if value is None else F.sum(ref(value))
    out = df.groupBy(*[ref(p) for p in path]).agg(measure.alias("size")).dropna()
    return out.orderBy(F.desc("size"), *[ref(p) for p in path]).limit(keep)


def waterfall(df: DataFrame, category: str, value: str, n: int = 15) -> DataFrame:
    """Largest sums by category with the running total of the bars."""
    df = normalise_missing(df).where(ref(category).isNotNull())
    sums = df.groupBy(ref(category).alias("category")).agg(F.coalesce(F.sum(ref(value)), F.lit(0.0)).alias("amount"))
    top = sums.orderBy(F.desc("amount"), "category").limit(n)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("amount"), "category").rowsBetween(W.unboundedPreceding, 0)
    return top.select("category", "amount", F.sum("amount").over(order).alias("running_total"))


def calendar_heatmap(df: DataFrame, date: str, value: str) -> DataFrame:
    """Mean by month name and day of month, years merged, in long form."""
    df = normalise_missing(df)
    when = F.try_to_timestamp(ref(date).cast("string"))
    rows = df.select(when.alias("t"), ref(value).alias("v")).dropna()
    return rows.groupBy(F.date_format("t", "MMMM").alias("month"), F.dayofmonth("t").alias("day")).agg(
        F.avg("v").alias("mean")
    )


def calendar_matrix(df: DataFrame, date: str, value: str) -> DataFrame:
    """The calendar heat-map as a matrix: one row per month name, one column per day."""
    return calendar_heatmap(df, date, value).groupBy("month").pivot("day", list(range(1, 32))).agg(F.first("mean"))


SAMPLE_SALTS = 64


def display_sample(
    df: DataFrame, row_id: str, max_points: int = 20_000, stratify: str | None = None, seed: int = 42
) -> DataFrame:
    """Repeatable sample for drawing only: at most ``max_points`` rows, shared out by stratum when it has 2-50 levels.

    Rows are ranked by a hash of their id. The ranking runs in salted parts first, so a hot stratum is split.
    """
    stratum = ref(stratify).cast("string") if stratify else F.lit(None).cast("string")
    if stratify:
        levels = len(df.select(stratum).distinct().limit(51).collect())
        if not 2 <= levels <= 50:
            stratum = F.lit(None).cast("string")
    rows = df.withColumns({"_s": stratum, "_h": F.xxhash64(ref(row_id), F.lit(seed))})
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    share = F.greatest(F.bround(F.col("_n") / F.col("_total") * max_points), F.lit(1.0)).cast("long")
    alloc = F.when(F.col("_total") <= max_points, F.col("_n")).otherwise(share)
    sizes = sizes.join(F.broadcast(total)).select(F.col("_s").alias("_k"), alloc.alias("_alloc"))
    rows = rows.join(F.broadcast(sizes), F.col("_s").eqNullSafe(F.col("_k")))
    part = W.partitionBy("_s", F.pmod("_h", F.lit(SAMPLE_SALTS))).orderBy("_h", ref(row_id))
    rows = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= F.col("_alloc"))
    whole = W.partitionBy("_s").orderBy("_h", ref(row_id))
    rows = rows.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= F.col("_alloc"))
    # Rounding and the minimum of one row may overshoot slightly; the final limit is on at most 50 strata.
    return rows.orderBy("_h", ref(row_id)).limit(max_points).select(*[ref(c) for c in df.columns]) if stratify else (
        rows.select(*[ref(c) for c in df.columns])
    )


def nearest_row(df: DataFrame, time: str, at: str) -> DataFrame:
    """The row whose time is closest to ``at`` (the earlier one on a tie)."""
    gap = F.abs(F.unix_micros(ref(time).cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(at))))
    return df.orderBy(gap, ref(time)).limit(1)


def quantile_bins(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins: exact quantile edges, equal edges merged; adds ``bin`` numbered from 0.

    The edges are ``bins + 1`` numbers, so they are carried as one broadcast row.
    """
    from colonnade.functions.quantiles import exact_quantiles

    grid = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, [col], grid).agg(F.array_sort(F.collect_set("value")).alias("_edges"))
    v = ref(col).cast("double")
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bin_no = F.size(F.filter(inner, lambda e: e < v))
    return df.where(v.isNotNull()).join(F.broadcast(edges)).withColumn("bin", bin_no).drop("_edges")
