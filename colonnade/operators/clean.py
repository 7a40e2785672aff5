"""Outlier treatment and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, numeric_columns, ref
from colonnade.functions.expressions import ratio
from colonnade.functions.quantiles import quantile_columns
from colonnade.operators.profile import column_modes, iqr_bounds
from colonnade.session import broadcast_if_small


def _bounds_iqr(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Fences per column; one row per column reaches the driver and becomes literals of the plan."""
    return {r["column"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, cols).collect()}


def _bounds_zscore(df: DataFrame, cols: Sequence[str], threshold: float) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(ref(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    out = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        if std:
            out[c] = (mean - threshold * std, mean + threshold * std)
    return out


def _capped(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    def cap(c: str) -> Column:
        low, high = bounds[c]
        x = ref(c).cast("double")
        # least/greatest skip nulls, hence the guard.
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high))).alias(c)

    return df.select(*[cap(c) if c in bounds else ref(c) for c in df.columns])


def cap_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values beyond the 1.5 IQR fences are set to the fence; missing stays missing."""
    df = normalise_missing(df)
    return _capped(df, _bounds_iqr(df, list(cols or numeric_columns(df))))


def cap_outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    df = normalise_missing(df)
    return _capped(df, _bounds_zscore(df, list(cols or numeric_columns(df)), threshold))


def _inside(c: str, bounds: tuple[float, float]) -> Column:
    x = ref(c).cast("double")
    return x.isNull() | ((x >= F.lit(bounds[0])) & (x <= F.lit(bounds[1])))


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, sequential: bool = True) -> DataFrame:
    """Rows outside the fences removed, missing values kept.

    Sequentially, the fences of a column come from the rows that survived the earlier columns: the dependent passes
    carry the earlier fences as filters that reach the scan. ``sequential=False`` takes all fences from the input.
    """
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    if not sequential:
        out = df
        for c, b in _bounds_iqr(df, cols).items():
            out = out.where(_inside(c, b))
        return out
    for c in cols:
        bounds = _bounds_iqr(df.select(*[ref(x) for x in cols]), [c])
        if c in bounds:
            df = df.where(_inside(c, bounds[c]))
    return df


def remove_outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` deviations from the mean removed, column after column."""
    df = normalise_missing(df)
    for c in list(cols or numeric_columns(df)):
        row = df.agg(F.avg(ref(c)).alias("m"), F.stddev_samp(ref(c)).alias("s")).first()
        if row["s"]:
            z = F.abs(ref(c) - F.lit(row["m"])) / F.lit(row["s"])
            df = df.where(ref(c).isNull() | (z <= threshold))
    return df


def impute_numeric(df: DataFrame, method: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numbers by ``mean``, ``median`` or ``zero``."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    if method == "zero":
        fill = dict.fromkeys(cols, 0.0)
    elif method == "mean":
        row = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        fill = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    elif method == "median":
        rows = quantile_columns(df, cols, {"median": 0.5}).select("column", "median").collect()
        fill = {r["column"]: r["median"] for r in rows}
    else:
        raise ValueError(f"unknown method {method!r}")

    def filled(c: str) -> Column:
        if fill.get(c) is None:
            return ref(c)
        return F.coalesce(ref(c).cast("double"), F.lit(float(fill[c]))).alias(c)

    return df.select(*[filled(c) if c in cols else ref(c) for c in df.columns])


def impute_group_numeric(df: DataFrame, group: str, method: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill by the mean or median of the row's group, then by that of the group-filled column.

    Rows with a missing group only get the second fill. The group statistics are joined rather than windowed, so a
    hot group is aggregated before the shuffle.
    """
    df = normalise_missing(df)
    cols = [c for c in (cols or numeric_columns(df)) if c != group]
    if method == "mean":
        known = df.where(ref(group).isNotNull())
        stats = known.groupBy(ref(group)).agg(*[F.avg(ref(c)).alias(f"_f{i}") for i, c in enumerate(cols)])
    elif method == "median":
        long = quantile_columns(df.select(ref(group), *[ref(c) for c in cols]), cols, {"median": 0.5}, [group])
        stats = long.groupBy(ref(group)).agg(
            *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_f{i}") for i, c in enumerate(cols)]
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    joined = df.join(broadcast_if_small(stats), group, "left")
    place = {c: i for i, c in enumerate(cols)}
    filled = joined.select(
        *[
            F.coalesce(ref(c).cast("double"), F.col(f"_f{place[c]}")).alias(c) if c in place else ref(c)
            for c in df.columns
        ]
    )
    return impute_numeric(filled, method, cols)


def impute_categorical(df: DataFrame, method: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing categories by the ``mode`` or by the constant ``unknown``."""
    df = normalise_missing(df)
    if method == "unknown":
        fill = dict.fromkeys(cols, "Unknown")
    elif method == "mode":
        fill = {r["column"]: r["top"] for r in column_modes(df, cols).collect()}
    else:
        raise ValueError(f"unknown method {method!r}")
    types = dict(df.dtypes)

    def filled(c: str) -> Column:
        if fill.get(c) is None:
            return ref(c)
        to = types[c] if method == "mode" else "string"
        return F.coalesce(ref(c).cast(to), F.lit(fill[c]).cast(to)).alias(c)

    return df.select(*[filled(c) if c in cols else ref(c) for c in df.columns])


def impute_group_mode(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Fill by the most frequent value of the row's group, then by the overall one after that fill.

    A row with a missing group keeps its own value. Ties go to the smallest value.
    """
    df = normalise_missing(df)
    for c in [c for c in cols if c != group]:
        counts = df.where(ref(group).isNotNull() & ref(c).isNotNull()).groupBy(ref(group), ref(c).alias("_v")).agg(
            F.count("*").alias("_n")
        )
        modes = counts.groupBy(ref(group)).agg(F.min(F.struct(-F.col("_n"), F.col("_v").alias("v")))["v"].alias("_mode"))
        joined = df.join(broadcast_if_small(modes), group, "left")
        df = joined.select(*[F.coalesce(ref(c), F.col("_mode")).alias(c) if x == c else ref(x) for x in df.columns])
        df = impute_categorical(df, "mode", [c])
    return df


def with_group_statistic(df: DataFrame, group: str, value: str, statistic: str, name: str) -> DataFrame:
    """Spread a group's mean, median or mode of ``value`` to all its rows."""
    known = df.where(ref(group).isNotNull())
    if statistic == "mean":
        stats = known.groupBy(ref(group)).agg(F.avg(ref(value)).alias(name))
    elif statistic == "median":
        stats = quantile_columns(known, [value], {name: 0.5}, [group]).select(ref(group), name)
    elif statistic == "mode":
        counts = known.where(ref(value).isNotNull()).groupBy(ref(group), ref(value).alias("_v")).agg(F.count("*").alias("_n"))
        best = F.min(F.struct(-F.col("_n"), F.col("_v").alias("v")))
        stats = counts.groupBy(ref(group)).agg(best["v"].alias(name))
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    return df.join(broadcast_if_small(stats), group, "left")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return ratio(x - mean, std)
