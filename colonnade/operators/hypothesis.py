"""Correlation and hypothesis tests. Spark computes the sufficient statistics; the driver turns them into p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, numeric_columns, ref
from colonnade.functions import special
from colonnade.functions.expressions import skew_adjusted
from colonnade.functions.dominance import signed_pairs
from colonnade.functions.ordering import average_ranks, running_totals
from colonnade.functions.quantiles import melt, quantile_columns
from colonnade.functions.results import table_of
from colonnade.operators.reshape import crosstab_long
from colonnade.session import broadcast_if_small, keep

SHAPIRO_MAX = 5000


def p_value_label(p: float) -> str:
    for bound, text in ((0.001, "p < 0.001"), (0.01, "p < 0.01"), (0.05, "p < 0.05"), (0.10, "p < 0.10")):
        if p < bound:
            return text
    return "p >= 0.10"


def effect_label(d: float) -> str:
    d = abs(d)
    return "negligible" if d < 0.2 else "small" if d < 0.5 else "medium" if d < 0.8 else "large"


def p_value_label_column(p: Column) -> Column:
    return (
        F.when(p < 0.001, "p < 0.001").when(p < 0.01, "p < 0.01").when(p < 0.05, "p < 0.05")
        .when(p < 0.10, "p < 0.10").otherwise("p >= 0.10")
    )


def effect_label_column(d: Column) -> Column:
    return (
        F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium")
        .otherwise("large")
    )


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return normalise_missing(df.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))).dropna()


# ---------------------------------------------------------------- correlation


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the tie-averaged ranks over the complete pairs, from distinct (x, y) counts."""
    pairs = keep(_pairs(df, x, y).groupBy("x", "y").agg(F.count("*").alias("c")))
    rx = average_ranks(pairs.groupBy("x").agg(F.sum("c").alias("_c")), "x", "_c").select("x", F.col("rank").alias("rx"))
    ry = average_ranks(pairs.groupBy("y").agg(F.sum("c").alias("_c")), "y", "_c").select("y", F.col("rank").alias("ry"))
    whole = pairs.agg(((F.sum("c") + 1) / 2).alias("mid"))
    ranked = pairs.join(rx, "x").join(ry, "y").join(F.broadcast(whole))
    a, b, c = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid"), F.col("c")
    return ranked.agg(
        F.sum("c").alias("n"),
        F.try_divide(F.sum(c * a * b), F.sqrt(F.sum(c * a * a)) * F.sqrt(F.sum(c * b * b))).alias("r"),
    )


def kendall(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Kendall tau-b over the complete pairs without comparing all pairs; ``buckets`` asks for about so many ranges."""
    points = keep(_pairs(df, x, y).groupBy("x", "y").agg(F.count("*").alias("c")))
    s = pair_balance(points.withColumn("w", F.col("c")), buckets)

    def ties(col: str) -> DataFrame:
        t = F.col("t").cast("double")
        return points.groupBy(col).agg(F.sum("c").alias("t")).agg(
            F.sum(t * (t - 1) / 2).alias(f"t{col}"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"a{col}"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"b{col}"),
            *([F.sum("t").alias("n")] if col == "x" else []),
        )

    out = s.join(F.broadcast(ties("x"))).join(F.broadcast(ties("y")))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt(pairs - F.col("tx")) * F.sqrt(pairs - F.col("ty")))
    return out.select("n", tau.alias("r"), "s", "tx", "ty", "ax", "ay", "bx", "by")


def pair_balance(points: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row ``s``: over all pairs of ``points`` (x, y, c, w), w of the one with smaller x times c of the other, signed by dy."""
    if buckets is None:
        return signed_pairs(points)
    return signed_pairs(points, max(1, -(-points.count() // buckets)))


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Coefficient with p-value; a Fisher-z 95 % interval for Pearson."""
    spark = df.sparkSession
    if method == "pearson":
        row = _pairs(df, x, y).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
    elif method == "spearman":
        row = spearman(df, x, y).first()
    elif method == "kendall":
        row = kendall(df, x, y).first()
    else:
        raise ValueError(f"unknown method {method!r}")
    n, r = row["n"], row["r"]
    out = {"method": method, "n": n, "r": r, "p_value": None, "ci_low": None, "ci_high": None}
    if r is not None and method == "kendall":
        pairs = n * (n - 1) / 2
        v0 = n * (n - 1) * (2 * n + 5)
        v1 = (2 * row["tx"]) * (2 * row["ty"]) / (2 * n * (n - 1)) if n > 1 else 0
        v2 = row["ax"] * row["ay"] / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
        var = (v0 - row["bx"] - row["by"]) / 18 + v1 + v2
        out["p_value"] = special.normal_two_sided(row["s"] / math.sqrt(var)) if var > 0 and pairs else None
    elif r is not None and n > 2:
        t = math.inf if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
        out["p_value"] = special.t_two_sided(t, n - 2)
        if method == "pearson" and n > 3 and abs(r) < 1:
            half = special.normal_ppf(0.975) / math.sqrt(n - 3)
            out["ci_low"], out["ci_high"] = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
    out["strength"] = effect_label(r) if r is not None else None
    return table_of(spark, [out])


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Square matrix in long form (x, y, r, i, j), pairwise complete. Pearson is one aggregate over all pairs."""
    df = normalise_missing(df)
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(range(len(cols)), 2))
    if method == "pearson":
        both = [F.corr(ref(cols[i]).cast("double"), ref(cols[j]).cast("double")).alias(f"r{i}_{j}") for i, j in pairs]
        row = df.agg(*both).first() if pairs else {}
        value = {(i, j): row[f"r{i}_{j}"] for i, j in pairs}
    else:
        one = spearman if method == "spearman" else kendall
        value = {(i, j): one(df, cols[i], cols[j]).first()["r"] for i, j in pairs}
    rows = [
        {"x": a, "y": b, "r": 1.0 if i == j else value[min(i, j), max(i, j)], "i": i, "j": j}
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return table_of(df.sparkSession, rows)


def strong_pairs(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    pairs = matrix.where((F.col("i") < F.col("j")) & (F.abs("r") >= threshold))
    return pairs.select("x", "y", "r", F.abs("r").alias("abs_r")).orderBy(F.desc("abs_r"), "x", "y")


# ---------------------------------------------------------------- normality

# Royston's (1995) polynomial coefficients for the Shapiro-Wilk weights and p-value, lowest power first.
ROYSTON_A1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
ROYSTON_A2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
ROYSTON_GAMMA = (-2.273, 0.459)


def _poly(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


SHAPIRO_CHUNK = 8192


# Normal scores computed at once.
SCORE_BLOCK = 2_000_000


def _score_sums(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` with s1 and s2: the sums of the normal scores of ranks lo..hi among n, and of their squares.

    Spans are cut into chunks first, so the ranks of a hot value are spread over tasks.
    """
    edges = F.sequence(F.col("lo"), F.col("hi"), F.lit(SHAPIRO_CHUNK).cast("long"))
    chunks = spans.select(*keys, "n", F.explode(edges).alias("a"), F.col("hi").alias("z"))
    chunks = chunks.select(*keys, "n", "a", F.least(F.col("a") + SHAPIRO_CHUNK - 1, F.col("z")).alias("b"))
    chunks = chunks.repartition(spans.sparkSession.sparkContext.defaultParallelism * 2)
    quantile = special.normal_ppf_array  # the function travels, not its module

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first, size = pdf["a"].to_numpy(), (pdf["b"] - pdf["a"] + 1).to_numpy()
            block = np.cumsum(size) // SCORE_BLOCK
            for k in np.unique(block):
                lo, hi = np.searchsorted(block, [k, k + 1])
                many = size[lo:hi]
                begin = np.cumsum(many) - many
                rank = np.repeat(first[lo:hi] - begin, many) + np.arange(many.sum())
                m = quantile((rank - 0.375) / (np.repeat(pdf["n"].to_numpy()[lo:hi], many) + 0.25))
                yield pdf.iloc[lo:hi][list(keys)].assign(s1=np.add.reduceat(m, begin), s2=np.add.reduceat(m * m, begin))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*keys).schema)
    return chunks.mapInPandas(score, f"{kinds}, s1 double, s2 double")


def shapiro_by_group(df: DataFrame, group: str, col: str) -> DataFrame:
    """Shapiro-Wilk of every group at once: group, n, statistic, p_value, p_value_fitted.

    One running total ranks the distinct values of all groups, one grouping sums values times normal scores; what is left of
    a group are nine numbers. Groups of fewer than 3 values, or of equal values, have no statistic.
    """
    rows = _complete(df, group, col)
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("c")).withColumn("s", F.col("v") * F.col("c"))
    # Sizes and means come with the running totals, range by range: a join on the group would send a hot one to one task.
    placed = running_totals(counts, ["v"], {"c": "hi", "s": "upto"}, ["g"], grand=True)
    centred = F.col("v") - F.col("upto_all") / F.col("hi_all")
    spans = keep(placed.select("g", centred.alias("value"), "c", F.col("hi_all").alias("n"), "hi", (F.col("hi") - F.col("c") + 1).alias("lo")))
    scores = _score_sums(spans, ["g", "value"]).groupBy("g").agg(F.sum(F.col("value") * F.col("s1")).alias("xs"), F.sum("s2").alias("ss"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (F.col("hi") >= rank), F.col("value")))

    n = F.col("n")
    rest = spans.groupBy("g").agg(
        F.max("n").alias("n"), F.sum(F.col("value") * F.col("value") * F.col("c")).alias("squares"), F.count("*").alias("k"),
        at(F.lit(1)).alias("e1"), at(F.lit(2)).alias("e2"), at(n - 1).alias("e3"), at(n).alias("e4"),
    )
    statistic, tail = shapiro_statistic, shapiro_p_value

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                w = None
                if r.n >= 3 and r.k > 1:
                    w = statistic(r.n, r.xs, r.ss, r.squares, {1: r.e1, 2: r.e2, r.n - 1: r.e3, r.n: r.e4})
                out.append((r.g, r.n, w, None if w is None else tail(w, r.n), w is not None and r.n <= SHAPIRO_MAX))
            yield pd.DataFrame(out, columns=["group", "n", "statistic", "p_value", "p_value_fitted"])

    schema = "group string, n long, statistic double, p_value double, p_value_fitted boolean"
    return rest.join(scores, "g").mapInPandas(test, schema)


def shapiro_wilk(df: DataFrame, col: str) -> DataFrame:
    """Shapiro-Wilk over all values, however many; needs 3 values that are not all equal (statistic null otherwise).

    Distinct values get their ranks by distributed running totals; the weights of a tie are summed over its ranks. The
    p-value approximation was fitted for up to 5000 values; ``p_value_fitted`` says whether the size lies within.
    """
    counts = keep(melt(df, [col]).groupBy("value").agg(F.count("*").alias("c")))
    whole = counts.agg(F.sum("c").alias("n"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("m"), F.count("*").alias("k")).first()
    n = whole["n"] or 0
    if n < 3 or whole["k"] < 2:
        return df.sparkSession.range(1).select(
            F.lit("shapiro_wilk").alias("test"), F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("statistic"),
            F.lit(None).cast("double").alias("p_value"), F.lit(False).alias("p_value_fitted"))
    centred = counts.select((F.col("value") - F.lit(whole["m"])).alias("value"), "c")
    spans = running_totals(centred, ["value"], {"c": "hi"}).withColumn("lo", F.col("hi") - F.col("c") + 1)
    spans = keep(spans.select("value", "lo", "hi", "c", F.lit(n).cast("long").alias("n")))
    sums = _score_sums(spans, ["value"]).agg(F.sum(F.col("value") * F.col("s1")).alias("xs"), F.sum("s2").alias("ss")).first()
    squares = spans.agg(F.sum(F.col("value") * F.col("value") * F.col("c")).alias("v")).first()["v"]
    ends = {i: None for i in (1, 2, n - 1, n)}
    for r in spans.where(" OR ".join(f"(lo <= {i} AND hi >= {i})" for i in ends)).collect():  # at most four rows
        ends |= {i: r["value"] for i in ends if r["lo"] <= i <= r["hi"]}
    spans.unpersist()
    counts.unpersist()
    w = shapiro_statistic(n, sums["xs"], sums["ss"], squares, ends)
    return table_of(df.sparkSession, [{"test": "shapiro_wilk", "n": n, "statistic": w, "p_value": shapiro_p_value(w, n), "p_value_fitted": n <= SHAPIRO_MAX}])


# Under names of their own: a function that travels to workers takes these along, not their module.
_normal_ppf, _normal_sf = special.normal_ppf, special.normal_sf


def shapiro_statistic(n: int, xs: float, ss: float, squares: float, ends: dict[int, float]) -> float:
    """W from the sum of value times score, the sums of squared scores and centred values, and the outermost values."""
    if n == 3:
        top = math.sqrt(0.5) * (ends[3] - ends[1])
        return min(top * top / squares, 1.0)
    m1 = _normal_ppf((n - 0.375) / (n + 0.25))
    m2 = _normal_ppf((n - 1.375) / (n + 0.25))
    u = 1 / math.sqrt(n)
    last = m1 / math.sqrt(ss) + _poly(ROYSTON_A1, u)
    outer, inner = ends[n] - ends[1], ends[n - 1] - ends[2]
    if n > 5:
        second = m2 / math.sqrt(ss) + _poly(ROYSTON_A2, u)
        scale = (ss - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2)
        top = (xs - m1 * outer - m2 * inner) / math.sqrt(scale) + last * outer + second * inner
    else:
        scale = (ss - 2 * m1**2) / (1 - 2 * last**2)
        top = (xs - m1 * outer) / math.sqrt(scale) + last * outer
    return min(top * top / squares, 1.0)


def shapiro_p_value(w: float, n: int) -> float:
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(1.0, max(0.0, p))
    y = math.log(1 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = _poly(ROYSTON_GAMMA, n)
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mean, sd = _poly(ROYSTON_SMALL_MEAN, n), math.exp(_poly(ROYSTON_SMALL_SD, n))
    else:
        mean, sd = _poly(ROYSTON_LARGE_MEAN, math.log(n)), math.exp(_poly(ROYSTON_LARGE_SD, math.log(n)))
    return _normal_sf((y - mean) / sd)


def kolmogorov_smirnov(df: DataFrame, col: str) -> DataFrame:
    """Largest gap between the distribution of the standardised values and the normal one."""
    counts = melt(df, [col]).groupBy("value").agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, ["value"], {"_c": "_upto"}, grand=True)
    m = F.sum(F.col("value") * F.col("_c")) / F.sum("_c")
    stats = counts.agg(m.alias("m"), F.sum("_c").alias("n"))
    ss = counts.join(F.broadcast(stats)).agg(
        F.sqrt(F.sum(F.col("_c") * F.pow(F.col("value") - F.col("m"), 2)) / (F.max("n") - 1)).alias("s"), F.max("m").alias("m")
    )
    z = ranked.join(F.broadcast(ss)).withColumn("_z", (F.col("value") - F.col("m")) / F.col("s"))
    z = z.withColumn("_f", special.normal_cdf_column("_z"))
    n = F.col("_upto_all")
    gap = F.greatest(F.col("_upto") / n - F.col("_f"), F.col("_f") - (F.col("_upto") - F.col("_c")) / n)
    row = z.agg(F.max(gap).alias("d"), F.max("_upto_all").alias("n")).first()
    p = special.kolmogorov_sf(row["d"], row["n"])
    return table_of(
        df.sparkSession, [{"test": "kolmogorov_smirnov", "n": row["n"], "statistic": row["d"], "p_value": p}]
    )


def dagostino_pearson(df: DataFrame, col: str) -> DataFrame:
    """K squared from the skewness and kurtosis z-scores; needs 8 values."""
    v = F.col("value")
    row = melt(df, [col]).agg(F.count(v).alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")).first()
    n, g1, b2 = row["n"], row["g1"], (row["g2"] or 0.0) + 3
    if n < 8:
        raise ValueError("the test needs at least 8 values")
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))
    expected = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (b2 - expected) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    base = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / abs(base)) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return table_of(
        df.sparkSession,
        [{"test": "dagostino_pearson", "n": n, "z_skew": z1, "z_kurtosis": z2, "statistic": k2, "p_value": math.exp(-k2 / 2)}],
    )


# ---------------------------------------------------------------- means


def one_sample_t(df: DataFrame, col: str, mu: float = 0.0) -> DataFrame:
    v = F.col("value")
    r = melt(df, [col]).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
    n, m, s = r["n"], r["m"], r["s"]
    se = s / math.sqrt(n)
    t = (m - mu) / se
    half = special.t_ppf(0.975, n - 1) * se
    return table_of(df.sparkSession, [{
        "n": n, "mean": m, "std": s, "t": t, "df": float(n - 1), "p_value": special.t_two_sided(t, n - 1),
        "ci_low": m - half, "ci_high": m + half, "cohens_d": (m - mu) / s,
    }])


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = normalise_missing(df).select((ref(a).cast("double") - ref(b).cast("double")).alias("difference"))
    return one_sample_t(d, "difference", 0.0)


def _complete(df: DataFrame, group: str, value: str) -> DataFrame:
    """Complete (g, v) rows."""
    return normalise_missing(df.select(ref(group).cast("string").alias("g"), ref(value).cast("double").alias("v"))).dropna()


def _groups(df: DataFrame, group: str, value: str, low: int, high: int) -> tuple[DataFrame, list[str]]:
    """Complete (g, v) rows and the sorted group names; their number is checked."""
    rows = _complete(df, group, value)
    names = sorted(r["g"] for r in rows.select("g").distinct().limit(high + 1).collect())
    if not low <= len(names) <= high:
        raise ValueError(f"{group} must have {low} to {high} groups, found {len(names)}{'+' if len(names) > high else ''}")
    return rows, names


def group_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Size, mean, deviation, variance and median of every group, however many."""
    rows = _complete(df, group, value)
    stats = rows.groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("variance")
    )
    medians = quantile_columns(rows, ["v"], {"median": 0.5}, ["g"]).select("g", "median")
    return stats.join(broadcast_if_small(medians), "g").withColumnRenamed("g", "group")


def independent_t(df: DataFrame, group: str, value: str, equal_variances: bool = False) -> DataFrame:
    """Welch (or pooled) t test of two groups with Cohen's d over the mean of the two variances."""
    rows, names = _groups(df, group, value, 2, 2)
    stats = {r["g"]: r for r in rows.groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2")).collect()}
    a, b = stats[names[0]], stats[names[1]]
    va, vb = a["s2"] / a["n"], b["s2"] / b["n"]
    if equal_variances:
        dof = a["n"] + b["n"] - 2
        pooled = ((a["n"] - 1) * a["s2"] + (b["n"] - 1) * b["s2"]) / dof
        se = math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
    else:
        se = math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    t = (a["m"] - b["m"]) / se
    spread = math.sqrt((a["s2"] + b["s2"]) / 2)
    d = (a["m"] - b["m"]) / spread if spread > 0 else 0.0
    return table_of(df.sparkSession, [{
        "group_a": names[0], "group_b": names[1], "t": t, "df": float(dof), "p_value": special.t_two_sided(t, dof),
        "cohens_d": d, "effect": effect_label(d),
    }])


def _rank_sums(rows: DataFrame, names: Sequence[str]):
    """Per-group sizes and rank sums plus the tie term, from counts per distinct value."""
    counts = rows.groupBy("v").agg(
        F.count("*").alias("c"), *[F.count_if(F.col("g") == g).alias(f"c{i}") for i, g in enumerate(names)]
    )
    ranked = average_ranks(counts, "v", "c")
    c = F.col("c").cast("double")
    return ranked.agg(
        F.sum("c").alias("n"), F.sum(c * c * c - c).alias("ties"),
        *[F.sum(f"c{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.sum(F.col(f"c{i}") * F.col("rank")).alias(f"r{i}") for i in range(len(names))],
    ).first()


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group, two-sided normal p with tie and continuity correction."""
    rows, names = _groups(df, group, value, 2, 2)
    s = _rank_sums(rows, names)
    n, n1, n2 = s["n"], s["n0"], s["n1"]
    u = s["r0"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - s["ties"] / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd if sd > 0 else 0.0
    return table_of(df.sparkSession, [{
        "group_a": names[0], "group_b": names[1], "u": u, "z": z, "p_value": min(1.0, 2 * special.normal_sf(z)),
    }])


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank test of two or more groups; rank sums stay a table, so their number does not matter."""
    cells = keep(_complete(df, group, value).groupBy("g", "v").agg(F.count("*").alias("c")))
    totals = cells.groupBy("v").agg(F.sum("c").alias("t"))
    ranks = average_ranks(totals, "v", "t").select("v", "t", "rank")
    ties = totals.agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties")).first()["ties"]
    sums = cells.join(ranks, "v").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    s = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("q")).first()
    k, n = s["k"], s["n"]
    if k < 2:
        raise ValueError(f"{group} must have at least 2 groups, found {k}")
    h = (12 / (n * (n + 1)) * s["q"] - 3 * (n + 1)) / (1 - ties / (float(n) ** 3 - n))
    return table_of(df.sparkSession, [{"groups": k, "n": n, "h": h, "df": k - 1, "p_value": special.chi2_sf(h, k - 1)}])


def _moments_by_group(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))


def _anova(rows: DataFrame) -> dict:
    """Analysis of variance from the table of group moments, in two aggregates over it."""
    stats = keep(_moments_by_group(rows))
    whole = stats.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")).first()
    n, k = whole["n"], whole["k"]
    if k < 2:
        raise ValueError(f"at least 2 groups are needed, found {k}")
    sums = stats.agg(
        F.sum(F.col("n") * (F.col("m") - F.lit(whole["grand"])) ** 2).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("within"),
    ).first()
    stats.unpersist()
    between, within = sums["between"], sums["within"]
    f = (between / (k - 1)) / (within / (n - k))
    return {
        "groups": k, "n": n, "f": f, "df_between": k - 1, "df_within": n - k, "p_value": special.f_sf(f, k - 1, n - k),
        "eta_squared": between / (between + within) if between + within else 0.0, "_mse": within / (n - k),
    }


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance with eta squared, over any number of groups."""
    out = _anova(_complete(df, group, value))
    out.pop("_mse")
    return table_of(df.sparkSession, [out])


def tukey_hsd(df: DataFrame, group: str, value: str, alpha: float = 0.05, max_groups: int = 10) -> DataFrame:
    """All pairwise mean differences with studentised-range p-values and intervals (Tukey-Kramer).

    The result has a row per pair of groups, which is what ``max_groups`` bounds.
    """
    rows, names = _groups(df, group, value, 2, max_groups)
    stats = _moments_by_group(rows).orderBy("g").collect()
    a = _anova(rows)
    low, high = 1.0, 50.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if special.studentized_range_sf(mid, len(names), a["df_within"]) > alpha else (low, mid)
    out = []
    for x, y in combinations(stats, 2):
        diff = y["m"] - x["m"]
        se = math.sqrt(a["_mse"] / 2 * (1 / x["n"] + 1 / y["n"]))
        p = special.studentized_range_sf(abs(diff) / se, len(names), a["df_within"])
        out.append({"group_a": x["g"], "group_b": y["g"], "mean_difference": diff, "q": abs(diff) / se, "p_value": p,
                    "ci_low": diff - high * se, "ci_high": diff + high * se, "reject": p < alpha})
    return table_of(df.sparkSession, out)


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median-centred Levene test of equal variances, over any number of groups."""
    rows = _complete(df, group, value)
    medians = quantile_columns(rows, ["v"], {"median": 0.5}, ["g"]).select("g", "median")
    spread = rows.join(broadcast_if_small(medians), "g").select("g", F.abs(F.col("v") - F.col("median")).alias("v"))
    out = _anova(spread)
    return table_of(df.sparkSession, [{
        "groups": out["groups"], "n": out["n"], "w": out["f"], "df_between": out["df_between"],
        "df_within": out["df_within"], "p_value": out["p_value"],
    }])


# ---------------------------------------------------------------- categories

MAX_LEVELS = 15


def chi_square_cells(df: DataFrame, a: str, b: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Observed and expected count of every cell, empty ones too; at most ``max_levels`` levels each."""
    rows = df.where(ref(a).isNotNull() & ref(b).isNotNull())
    counts = crosstab_long(rows, a, b).limit(max_levels**2 + 1).collect()
    la, lb = sorted({r["a"] for r in counts}), sorted({r["b"] for r in counts})
    if len(la) > max_levels or len(lb) > max_levels:
        raise ValueError(f"at most {max_levels} by {max_levels} levels")
    cell = {(r["a"], r["b"]): r["count"] for r in counts}
    n = sum(cell.values())
    ra = {x: sum(cell.get((x, y), 0) for y in lb) for x in la}
    rb = {y: sum(cell.get((x, y), 0) for x in la) for y in lb}
    return table_of(df.sparkSession, [
        {"a": x, "b": y, "observed": cell.get((x, y), 0), "expected": ra[x] * rb[y] / n} for x in la for y in lb
    ])


def chi_square(df: DataFrame, a: str, b: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Independence test with Cramer's V and the share of cells expected below 5; Yates correction on 2 by 2."""
    cells = chi_square_cells(df, a, b, max_levels).collect()
    rows, cols = len({c["a"] for c in cells}), len({c["b"] for c in cells})
    n = sum(c["observed"] for c in cells)
    dof = (rows - 1) * (cols - 1)
    yates = dof == 1
    chi2 = 0.0
    for c in cells:
        gap = abs(c["observed"] - c["expected"])
        gap = max(gap - min(0.5, gap), 0.0) if yates else gap
        chi2 += gap * gap / c["expected"]
    v = math.sqrt(chi2 / (n * (min(rows, cols) - 1))) if min(rows, cols) > 1 else 0.0
    low = sum(c["expected"] < 5 for c in cells)
    return table_of(df.sparkSession, [{
        "chi2": chi2, "df": dof, "n": n, "p_value": special.chi2_sf(chi2, dof) if dof else 1.0, "cramers_v": v,
        "low_expected_percent": low * 100.0 / len(cells),
    }])


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided exact test and sample odds ratio of a 2 by 2 table."""
    cells = [c["observed"] for c in chi_square_cells(df, a, b).orderBy("a", "b").collect()]
    if len(cells) != 4:
        raise ValueError("the test needs a 2 by 2 table")
    w, x, y, z = cells
    n1, n2, k = w + x, y + z, w + y
    log_all = math.lgamma(n1 + n2 + 1) - math.lgamma(k + 1) - math.lgamma(n1 + n2 - k + 1)

    def log_p(i: int) -> float:
        return (
            math.lgamma(n1 + 1) - math.lgamma(i + 1) - math.lgamma(n1 - i + 1)
            + math.lgamma(n2 + 1) - math.lgamma(k - i + 1) - math.lgamma(n2 - k + i + 1) - log_all
        )

    # Beyond 40 standard deviations the terms are zero in double precision.
    mean = k * n1 / (n1 + n2)
    sd = math.sqrt(max(mean * n2 / (n1 + n2), 1.0))
    low, high = max(0, k - n2, int(mean - 40 * sd)), min(n1, k, int(mean + 40 * sd) + 1)
    own = log_p(w)
    p = sum(math.exp(q) for q in map(log_p, range(low, high + 1)) if q <= own + 1e-7)
    odds = w * z / (x * y) if x * y else math.inf
    return table_of(df.sparkSession, [{"odds_ratio": odds, "p_value": min(1.0, p), "n": n1 + n2}])


def skewness_kurtosis(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt(df, cols).groupBy("column").agg(skew_adjusted(F.col("value")).alias("skewness"))
