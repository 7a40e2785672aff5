"""Time series: preparation, decomposition, unit-root tests, autocorrelation, interrupted series, ARIMA.

A series is a DataFrame (t, y) with a gap-free index t = 1..n. Neighbouring rows meet through equi-joins and groupings
on shifted indexes, so no window ever runs over a whole series in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref
from colonnade.functions import special
from colonnade.functions.gram import solve, weighted_sums
from colonnade.functions.ordering import positions, running_totals
from colonnade.functions.results import table_of
from colonnade.operators import linear
from colonnade.operators.hypothesis import shapiro_wilk
from colonnade.operators.profile import parse_timestamp
from colonnade.session import broadcast_if_small, keep, materialise


def prepare_series(df: DataFrame, time: str, value: str, row_id: str) -> DataFrame:
    """Complete cases in time order as (t, time, y). When any time does not parse the row id gives the order."""
    rows = normalise_missing(df).select(ref(time).alias("time"), ref(value).cast("double").alias("y"), ref(row_id).alias("_id")).dropna()
    kind = dict(rows.dtypes)["time"]
    if kind == "string":
        rows = rows.withColumn("_at", parse_timestamp(F.col("time")))
        parsed = rows.agg(F.count_if(F.col("_at").isNull()).alias("bad")).first()["bad"] == 0
        order = ["_at", "_id"] if parsed else ["_id"]
    else:
        order = ["time", "_id"]
    return positions(rows, order, name="t").select("t", "time", "y")


def series_of(df: DataFrame, time: str, value: str) -> DataFrame:
    """(t, time, y) of a frame that already has one row per time."""
    rows = df.select(ref(time).alias("time"), ref(value).cast("double").alias("y")).dropna()
    return materialise(positions(rows, ["time"], name="t").select("t", "time", "y"))


def lagged(series: DataFrame, col: str, lags: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., t, <col>_lag<k>...) with lag 0 included; only indexes present in the series are returned.

    Every value is sent to the indexes it is a lag of and the values of one index are gathered by a grouping.
    """
    ks = sorted({0, *lags})
    sent = series.select(
        *[ref(b) for b in by], ref(col).alias("_v"), "t", F.explode(F.array(*[F.lit(k) for k in ks])).alias("_k")
    ).withColumn("t", F.col("t") + F.col("_k"))
    names = {k: f"{col}_lag{k}" for k in ks}
    out = sent.groupBy(*by, "t").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(n) for k, n in names.items()])
    return out.where(F.col(names[0]).isNotNull())


def moving_average(series: DataFrame, period: int) -> DataFrame:
    """Centred moving average (t, trend); half weights at both ends for an even period, none near the edges."""
    half = period // 2
    end = 0.5 if period % 2 == 0 else 1.0
    sent = series.select("y", "t", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_o"))
    weight = F.when(F.abs("_o") == half, end).otherwise(1.0) / period
    sums = sent.groupBy((F.col("t") + F.col("_o")).alias("t")).agg(F.sum(F.col("y") * weight).alias("trend"), F.count("*").alias("_c"))
    return sums.where(F.col("_c") == 2 * half + 1).select("t", "trend")


def decompose(series: DataFrame, period: int, model: str = "additive") -> DataFrame:
    """Classical decomposition: trend, seasonal and residual of each index. Needs two full periods.

    A multiplicative request falls back to additive when any value is not positive.
    """
    r = series.agg(F.count("*").alias("n"), F.min("y").alias("lo")).first()
    if r["n"] < 2 * period:
        raise ValueError("decomposition needs at least two periods")
    times = model == "multiplicative" and r["lo"] > 0
    rows = series.join(moving_average(series, period), "t", "left").withColumn("_s", (F.col("t") - 1) % period)
    off = F.col("y") / F.col("trend") if times else F.col("y") - F.col("trend")
    season = rows.groupBy("_s").agg(F.avg(off).alias("_m"))
    level = season.agg(F.avg("_m").alias("_level"))
    season = season.join(F.broadcast(level)).select("_s", (F.col("_m") / F.col("_level") if times else F.col("_m") - F.col("_level")).alias("seasonal"))
    rows = rows.join(F.broadcast(season), "_s")
    rest = F.col("y") / F.col("trend") / F.col("seasonal") if times else F.col("y") - F.col("trend") - F.col("seasonal")
    return rows.select("t", "y", "trend", "seasonal", rest.alias("residual"), F.lit("multiplicative" if times else "additive").alias("model"))


def autocovariances(series: DataFrame, lags: int, col: str = "y") -> np.ndarray:
    """Sums of lagged products of the centred series, index 0..lags."""
    mean = series.agg(F.avg(col).alias("m")).first()["m"]
    e = series.select("t", (ref(col) - F.lit(mean)).alias("e"))
    sent = e.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("k"), "t", F.col("e").alias("b")).withColumn("t", F.col("t") + F.col("k"))
    rows = e.join(sent, "t").groupBy("k").agg(F.sum(F.col("e") * F.col("b")).alias("c")).collect()
    out = np.zeros(lags + 1)
    for r in rows:
        out[r["k"]] = r["c"]
    return out


def acf_pacf(series: DataFrame, lags: int, col: str = "y") -> DataFrame:
    """Autocorrelations, partial ones by Durbin-Levinson, and the 1.96/sqrt(n) bound."""
    n = series.count()
    c = autocovariances(series, lags, col)
    rho = c / c[0]
    pacf = [1.0]
    phi = np.zeros(0)
    for k in range(1, lags + 1):
        top = rho[k] - (phi @ rho[k - 1 : 0 : -1] if k > 1 else 0.0)
        bottom = 1 - (phi @ rho[1:k] if k > 1 else 0.0)
        a = top / bottom
        phi = np.r_[phi - a * phi[::-1], a]
        pacf.append(float(a))
    bound = 1.96 / math.sqrt(n)
    return table_of(series.sparkSession, [
        {"lag": k, "acf": float(rho[k]), "pacf": pacf[k], "bound": bound, "significant": k > 0 and abs(rho[k]) > bound} for k in range(lags + 1)
    ])


# MacKinnon (1994) response surface for the Dickey-Fuller t statistic with a constant.
MACKINNON_LIMITS = {"min": -18.83, "star": -1.61, "max": 2.74}
MACKINNON_SMALL = (2.1659, 1.4412, 0.038269)
MACKINNON_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# KPSS (1992) critical values for a constant with their tail probabilities.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_TAIL = (0.10, 0.05, 0.025, 0.01)


def mackinnon_p(t: float) -> float:
    if t > MACKINNON_LIMITS["max"]:
        return 1.0
    if t < MACKINNON_LIMITS["min"]:
        return 0.0
    coefficients = MACKINNON_SMALL if t <= MACKINNON_LIMITS["star"] else MACKINNON_LARGE
    return special.normal_cdf(sum(c * t**k for k, c in enumerate(coefficients)))


def adf_test(series: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a constant; the lag order minimises AIC.

    One pass sums the cross products with all lags; every candidate order is solved from a part of that matrix.
    """
    n = series.count()
    limit = math.ceil(12 * (n / 100) ** 0.25)
    max_lag = min(limit if max_lag is None else max_lag, n // 2 - 2)
    step = lagged(series, "y", [1]).where("y_lag1 IS NOT NULL").select("t", (F.col("y_lag0") - F.col("y_lag1")).alias("d"), F.col("y_lag1").alias("level"))
    wide = lagged(step, "d", range(1, max_lag + 1)).join(step.select("t", "level"), "t")
    wide = keep(wide)

    def sums(lags: int):
        names = ["level"] + [f"d_lag{k}" for k in range(1, lags + 1)]
        rows = wide.where(F.col(f"d_lag{lags}").isNotNull()) if lags else wide
        m = rows.agg(F.avg("level").alias("m"), F.stddev_pop("level").alias("s")).first()
        scale = m["s"] or 1.0
        rows = rows.select(F.lit(1.0).alias("one"), ((F.col("level") - m["m"]) / scale).alias("level"), *names[1:], F.col("d_lag0").alias("d"))
        g, r, e = weighted_sums(rows, ["one", *names], None, {"d": F.col("d")}, {"dd": F.col("d") * F.col("d"), "n": F.lit(1)})
        return g, r["d"], e["dd"], e["n"], scale

    g, r, dd, m, _ = sums(max_lag)
    best = None
    for k in range(max_lag + 1):
        part = k + 2
        beta, _ = solve(g[:part, :part], r[:part])
        rss = dd - beta @ r[:part]
        aic = m * (math.log(2 * math.pi) + math.log(rss / m) + 1) + 2 * part
        if best is None or aic < best[0]:
            best = (aic, k)
    lag = best[1]
    g, r, dd, m, scale = sums(lag)
    beta, inverse = solve(g, r)
    s2 = (dd - beta @ r) / (m - len(beta))
    t = beta[1] / math.sqrt(s2 * inverse[1, 1])
    p = mackinnon_p(t)
    wide.unpersist()
    return table_of(series.sparkSession, [{"test": "adf", "statistic": float(t), "lags": lag, "p_value": p, "stationary": p < 0.05}])


def kpss_test(series: DataFrame) -> DataFrame:
    """KPSS around a constant with the automatic Newey-West lag choice."""
    n = series.count()
    mean = series.agg(F.avg("y").alias("m")).first()["m"]
    e = series.select("t", (F.col("y") - F.lit(mean)).alias("e"))
    partial = running_totals(e, ["t"], {"e": "s"}).agg(F.sum(F.col("s") * F.col("s")).alias("q")).first()["q"]
    cover = int(n ** (2 / 9))
    # Enough lags for the automatic choice, whatever it turns out to be, in two passes.
    c = autocovariances(e, cover, "e")
    s0 = c[0] / n + sum(c[k] / (n / 2) for k in range(1, cover + 1))
    s1 = sum(k * c[k] / (n / 2) for k in range(1, cover + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    c = autocovariances(e, lags, "e") if lags > cover else c
    long_run = (c[0] + 2 * sum((1 - k / (lags + 1)) * c[k] for k in range(1, lags + 1))) / n
    stat = partial / n**2 / long_run
    p = float(np.interp(stat, KPSS_CRITICAL, KPSS_TAIL))
    return table_of(series.sparkSession, [{"test": "kpss", "statistic": float(stat), "lags": lags, "p_value": p, "stationary": p > 0.05}])


def stationarity(series: DataFrame) -> DataFrame:
    """Joint reading of both tests."""
    a, k = adf_test(series).first(), kpss_test(series).first()
    verdict = {
        (True, True): "stationary", (False, False): "non-stationary",
        (True, False): "difference-stationary", (False, True): "trend-stationary",
    }[(a["stationary"], k["stationary"])]
    return table_of(series.sparkSession, [{
        "adf_statistic": a["statistic"], "adf_p_value": a["p_value"], "kpss_statistic": k["statistic"],
        "kpss_p_value": k["p_value"], "verdict": verdict,
    }])


def ljung_box(residuals: DataFrame, lags: Sequence[int] | None = None, col: str = "e") -> DataFrame:
    """Q statistics at lags 1, 4 and min(12, n/4)."""
    n = residuals.count()
    top = min(12, max(1, n // 4))
    lags = sorted({k for k in (lags or (1, min(4, top), top)) if 1 <= k < n})
    rho = autocovariances(residuals, max(lags), col)
    rho = rho / rho[0]
    out = []
    for m in lags:
        q = n * (n + 2) * sum(rho[k] ** 2 / (n - k) for k in range(1, m + 1))
        p = special.chi2_sf(float(q), m)
        out.append({"lag": m, "q": float(q), "p_value": p, "autocorrelated": p < 0.05})
    return table_of(residuals.sparkSession, out)


def residual_checks(residuals: DataFrame, col: str = "e") -> DataFrame:
    """Durbin-Watson, the largest Ljung-Box lag and Shapiro-Wilk in one table."""
    dw = linear.durbin_watson(residuals, col, "t").first()["durbin_watson"]
    lb = ljung_box(residuals, col=col).orderBy(F.desc("lag")).first()
    sw = shapiro_wilk(residuals, col).first()
    return table_of(residuals.sparkSession, [
        {"check": "durbin_watson", "statistic": dw, "p_value": None, "passed": 1.5 <= dw <= 2.5},
        {"check": "ljung_box", "statistic": lb["q"], "p_value": lb["p_value"], "passed": lb["p_value"] >= 0.05},
        {"check": "shapiro_wilk", "statistic": sw["statistic"], "p_value": sw["p_value"],
         "passed": None if sw["p_value"] is None else sw["p_value"] >= 0.05},
    ])


# ---------------------------------------------------------------- interrupted time series


def nearest_index(series: DataFrame, at: str) -> int:
    """0-based index of the intervention: the time nearest to ``at``."""
    gap = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(at))))
    return series.orderBy(gap, "t").first()["t"] - 1


def its_columns(series: DataFrame, index: int, lag: int = 0, season: int | None = None) -> DataFrame:
    """Time, level flag, time since the effect and (as text) the season of each index."""
    start = index + lag
    on = F.col("t") >= start + 1
    out = series.withColumns({
        "time_index": F.col("t").cast("double"), "level": on.cast("double"),
        "time_after": F.when(on, F.col("t") - start).otherwise(0).cast("double"),
    })
    return out.withColumn("season", F.lpad(((F.col("t") - 1) % season).cast("string"), 4, "0")) if season else out


BASE_TERMS = ["time_index", "level", "time_after"]


def fit_its(series: DataFrame, index: int, lag: int = 0, season: int | None = None, hac_lags: int | None = None):
    """Segmented regression with Newey-West errors (normal tails). Seasonal dummies need two full periods."""
    n = series.count()
    if n < 8:
        raise ValueError("at least 8 observations are needed")
    if season and n < 2 * season:
        season = None
    rows = its_columns(series, index, lag, season)
    fit = linear.fit_ols(rows, "y", BASE_TERMS + (["season"] if season else []), carry={"t": F.col("t")})
    lags = hac_lags if hac_lags is not None else max(1, min(4, index // 2))
    return linear.hac_fit(fit, "t", lags)


def its_coefficients(series: DataFrame, index: int, **options) -> DataFrame:
    return linear.coefficients(series, fit_its(series, index, **options))


def its_counterfactual(series: DataFrame, index: int, lag: int = 0, season: int | None = None) -> DataFrame:
    """Observed, fitted and counterfactual (no level or slope change) values with their difference."""
    fit = fit_its(series, index, lag, season)
    beta = dict(zip(fit.design.names, fit.beta, strict=True))
    start = index + lag
    on = F.col("t") >= start + 1
    effect = F.when(on, F.lit(float(beta["level"])) + F.lit(float(beta["time_after"])) * (F.col("t") - start)).otherwise(0.0)
    return fit.design.frame.select(
        "t", F.col("_y").alias("observed"), fit.fitted().alias("fitted"), (fit.fitted() - effect).alias("counterfactual"), effect.alias("effect")
    )


def its_effect_at_end(series: DataFrame, index: int, lag: int = 0, season: int | None = None) -> DataFrame:
    """Absolute and relative effect at the last index."""
    last = F.struct("t", "effect", "counterfactual")
    out = its_counterfactual(series, index, lag, season).agg(F.max(last).alias("m")).select("m.*")
    return out.withColumn("relative_percent", F.try_divide(F.col("effect") * 100, F.col("counterfactual")))


def controlled_its(treated: DataFrame, control: DataFrame, index: int) -> DataFrame:
    """ITS of treated minus control where both are known, Newey-West with 4 lags; needs more than 10 points.

    ``index`` counts in the difference series.
    """
    d = treated.select("time", "y").join(control.select("time", F.col("y").alias("_c")), "time").select("time", (F.col("y") - F.col("_c")).alias("y"))
    series = series_of(d, "time", "y")
    if series.count() <= 10:
        raise ValueError("more than 10 common points are needed")
    return its_coefficients(series, index, hac_lags=4)


def chow_test(series: DataFrame, index: int) -> DataFrame:
    """Structural break at ``index``: full segmented model against separate lines before and after, with k = 4."""
    n = series.count()
    if min(index, n - index) < 4:
        raise ValueError("at least 4 points on each side are needed")
    full = linear.fit_ols(its_columns(series, index), "y", BASE_TERMS).rss
    before = linear.fit_ols(series.where(F.col("t") <= index), "y", ["t"]).rss
    after = linear.fit_ols(series.where(F.col("t") > index), "y", ["t"]).rss
    k = len(BASE_TERMS) + 1
    dof = n - 2 * k
    f = ((full - before - after) / k) / ((before + after) / dof)
    return table_of(series.sparkSession, [{
        "ssr_full": full, "ssr_before": before, "ssr_after": after, "f": f, "df1": k, "df2": dof, "p_value": special.f_sf(f, k, dof),
    }])


def _level_row(series: DataFrame, fit) -> dict:
    rows = linear.coefficient_rows(fit.design.names, fit.beta, fit.covariance, fit.df_resid, fit.tail)
    by = {r["term"]: r for r in rows}
    return {
        "level_change": by["level"]["coefficient"], "level_p_value": by["level"]["p_value"],
        "slope_change": by["time_after"]["coefficient"], "slope_p_value": by["time_after"]["p_value"], "aic": fit.aic, "bic": fit.bic,
    }


def lag_comparison(series: DataFrame, index: int, max_lag: int = 6, season: int | None = None) -> DataFrame:
    """The segmented model for effect delays 0..max_lag, best AIC marked."""
    n = series.count()
    rows = []
    for lag in range(max_lag + 1):
        if index + lag >= n - 2:
            continue
        fit = fit_its(series, index, lag, season)
        rows.append({"lag": lag, **_level_row(series, fit)})
        fit.design.release()
    best = min(r["aic"] for r in rows)
    return table_of(series.sparkSession, [{**r, "best": r["aic"] == best} for r in rows])


FIRST_PLACEBO, SAFETY_GAP, PLACEBOS = 6, 4, 6


def placebo_test(series: DataFrame, index: int, lag: int = 0, count: int = PLACEBOS) -> DataFrame:
    """Level change at made-up earlier interventions against the real one."""
    last = index - SAFETY_GAP
    step = max(1, (last - FIRST_PLACEBO) // count)
    points = list(range(FIRST_PLACEBO, last, step))[:count]
    if len(points) < 3:
        raise ValueError("not enough points before the intervention")
    rows = []
    for at in [*points, index]:
        fit = fit_its(series, at, lag, hac_lags=4)
        r = _level_row(series, fit)
        fit.design.release()
        rows.append({
            "kind": "real" if at == index else "placebo", "position": at, "level_change": r["level_change"],
            "p_value": r["level_p_value"], "significant": r["level_p_value"] < 0.05,
        })
    return table_of(series.sparkSession, rows)


def its_influence(series: DataFrame, index: int, lag: int = 0) -> DataFrame:
    return linear.influence(fit_its(series, index, lag), ["t"])


def autoregressive_its(series: DataFrame, index: int, lag: int = 0, max_order: int = 3) -> DataFrame:
    """ITS with autoregressive errors: the order minimises AIC, estimates by iterated generalised least squares.

    One pass sums the cross products of the outcome and the segment terms at lags 0..max_order. Every filtered
    regression of every order is then a small matrix product on the driver. All orders use the same rows. Level and
    slope change are reported with normal-tail p-values.
    """
    names = ["one", *BASE_TERMS]
    stats = series.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    mean, spread, length = stats["m"], stats["s"] or 1.0, float(stats["n"])
    rows = its_columns(series, index, lag).select(
        "t", ((F.col("y") - mean) / spread).alias("y"), F.lit(1.0).alias("one"), (F.col("time_index") / length).alias("time_index"),
        "level", (F.col("time_after") / length).alias("time_after"),
    )
    cols, width = ["y", *names], max_order + 1
    sent = rows.select("t", *cols, F.explode(F.sequence(F.lit(0), F.lit(max_order))).alias("_k"))
    wide = sent.groupBy((F.col("t") + F.col("_k")).alias("t")).agg(
        *[F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}_{k}") for k in range(width) for c in cols]
    ).dropna()
    lagcols = [f"{c}_{k}" for k in range(width) for c in cols]
    g, _, extra = weighted_sums(wide, lagcols, None, {}, {"n": F.lit(1)})
    m, n = len(cols), extra["n"]
    best, plain = None, math.nan
    for order in range(max_order + 1):
        phi = np.zeros(order)
        for _ in range(200):
            keepers = np.zeros((m * width, m))
            for k in range(order + 1):
                keepers[k * m : (k + 1) * m] = np.eye(m) * (1.0 if k == 0 else -phi[k - 1])
            f = keepers.T @ g @ keepers
            beta, inverse = solve(f[1:, 1:], f[1:, 0])
            direction = np.r_[1.0, -beta]
            rss = float(direction @ f @ direction)
            if not order:
                break
            resid = np.zeros((m * width, order + 1))
            for k in range(order + 1):
                resid[k * m : (k + 1) * m, k] = direction
            u = resid.T @ g @ resid
            new, _ = solve(u[1:, 1:], u[1:, 0])
            done = np.max(np.abs(new - phi)) < 1e-10
            phi = new
            if done:
                break
        size = len(names) + order + 1
        aic = n * (math.log(2 * math.pi) + math.log(rss * spread**2 / n) + 1) + 2 * size
        plain = aic if not order else plain
        if best is None or aic < best["aic"]:
            best = {"order": order, "aic": aic, "gain": plain - aic, "bic": aic + (math.log(n) - 2) * size, "beta": beta, "cov": inverse * rss / (n - len(names))}
    scale = spread / np.array([1.0, length, 1.0, length])
    beta = best["beta"] * scale
    beta[0] += mean
    table = linear.coefficient_rows(names, beta, best["cov"] * np.outer(scale, scale), math.inf, "normal")
    out = [{"term": r["term"], "coefficient": r["coefficient"], "std_error": r["std_error"], "p_value": r["p_value"], "ci_low": r["ci_low"],
            "ci_high": r["ci_high"], "ar_order": best["order"], "aic": best["aic"], "bic": best["bic"], "aic_gain": best["gain"]} for r in table]
    return table_of(series.sparkSession, out)


def its_method_comparison(series: DataFrame, index: int, lag: int = 0) -> DataFrame:
    """Segmented regression against the model with autoregressive errors, by AIC.

    The second model loses the first rows to its lags, so its gain over order 0 on the same rows is what counts.
    """
    seg = fit_its(series, index, lag)
    s = _level_row(series, seg)
    arr = autoregressive_its(series, index, lag).collect()
    a = {r["term"]: r for r in arr}
    rows = [
        {"method": "segmented", "level_change": s["level_change"], "level_p_value": s["level_p_value"], "slope_change": s["slope_change"], "aic": s["aic"]},
        {"method": "autoregressive", "level_change": a["level"]["coefficient"], "level_p_value": a["level"]["p_value"],
         "slope_change": a["time_after"]["coefficient"], "aic": s["aic"] - a["level"]["aic_gain"]},
    ]
    best = min(r["aic"] for r in rows)
    return table_of(series.sparkSession, [{**r, "preferred": r["aic"] == best} for r in rows])


# ---------------------------------------------------------------- ARIMA for many series


def _per_series_sums(frame: DataFrame, columns: Sequence[str], target: str, by: str) -> DataFrame:
    """Cross products per series as one array per series (upper triangle, right-hand side, target square, count)."""
    p = len(columns)
    parts = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(p) for j in range(i, p)]
    parts += [F.sum(F.col(c) * F.col(target)) for c in columns] + [F.sum(F.col(target) * F.col(target)), F.count("*").cast("double")]
    return frame.groupBy(by).agg(F.array(*parts).alias("_sums"))


def _unpack(flat, p: int):
    k = p * (p + 1) // 2
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = flat[:k]
    g = g + np.triu(g, 1).T
    return g, np.array(flat[k : k + p]), flat[k + p], flat[k + p + 1]


def difference(series: DataFrame, by: str, d: int) -> DataFrame:
    """(by, t, y) after d differences."""
    for _ in range(d):
        series = lagged(series, "y", [1], [by]).where("y_lag1 IS NOT NULL").select(by, "t", (F.col("y_lag0") - F.col("y_lag1")).alias("y"))
    return series


# Shortest long autoregression of the first stage; it grows with the cube root of the shortest series.
LONG_AR = 8


def long_order(shortest: int, p: int, q: int) -> int:
    return max(LONG_AR, p + q, round(shortest ** (1 / 3)))


def fit_arima(df: DataFrame, by: str, time: str, value: str, d: int = 0, max_p: int = 3, max_q: int = 2, order: tuple[int, int] | None = None):
    """ARIMA(p, d, q) with a constant for every series at once; orders by AIC over the grid unless given.

    Estimation is the two-stage regression of Hannan and Rissanen: a long autoregression gives innovations, then the
    series is regressed on its own and the innovations' lags. Both stages are sums per series, so a long or hot series
    is split over tasks. The estimates differ slightly from exact maximum likelihood.
    Returns (models, filtered rows); the latter hold y and the innovations for forecasting.
    """
    rows = df.select(ref(by).cast("string").alias("series"), ref(time).alias("time"), ref(value).cast("double").alias("y")).dropna()
    base = materialise(positions(rows, ["time"], ["series"], name="t").select("series", "t", "y"))
    centre = base.groupBy("series").agg(F.avg("y").alias("_m")) if d == 0 else None
    work = difference(base, "series", d)
    if centre is not None:
        work = work.join(broadcast_if_small(centre), "series").select("series", "t", (F.col("y") - F.col("_m")).alias("y"))
    work = materialise(work)
    shortest = work.groupBy("series").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    far = long_order(shortest, *(order or (max_p, max_q)))
    long_cols = [f"y_lag{k}" for k in range(1, far + 1)]
    wide = lagged(work, "y", range(1, far + 1), ["series"]).dropna().withColumn("one", F.lit(1.0))
    p1 = far + 1

    def first_stage(batches):
        for pdf in batches:
            beta = [solve(*_unpack(np.array(s), p1)[:2])[0] for s in pdf["_sums"]]
            yield pd.DataFrame({"series": pdf["series"], "_b": beta})

    long_ar = _per_series_sums(wide, ["one", *long_cols], "y_lag0", "series").mapInPandas(first_stage, "series string, _b array<double>")
    joined = wide.join(broadcast_if_small(long_ar), "series")
    fitted = F.element_at("_b", 1)
    for k, c in enumerate(long_cols, 2):
        fitted = fitted + F.element_at("_b", k) * F.col(c)
    inno = materialise(joined.select("series", "t", F.col("y_lag0").alias("y"), (F.col("y_lag0") - fitted).alias("e")))
    p, q = order or (max_p, max_q)
    ylags = lagged(work, "y", range(1, p + 1), ["series"]) if p else work.withColumnRenamed("y", "y_lag0")
    elags = lagged(inno, "e", range(1, q + 1), ["series"]) if q else inno.select("series", "t", F.col("e").alias("e_lag0"))
    second = ylags.join(elags, ["series", "t"]).dropna().withColumn("one", F.lit(1.0))
    columns = ["one"] + [f"y_lag{k}" for k in range(1, p + 1)] + [f"e_lag{k}" for k in range(1, q + 1)]
    grid = [order] if order else [(a, b) for a in range(max_p + 1) for b in range(max_q + 1)]
    size, diff = len(columns), d

    def second_stage(batches):
        for pdf in batches:
            out = []
            for name, flat in zip(pdf["series"], pdf["_sums"], strict=True):
                g, r, yy, n = _unpack(np.array(flat), size)
                best = None
                for a, b in grid:
                    use = [0, *range(1, a + 1), *range(p + 1, p + 1 + b)]
                    beta, _ = solve(g[np.ix_(use, use)], r[use])
                    rss = max(yy - beta @ r[use], 1e-300)
                    aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * (len(use) + 1)
                    if best is None or aic < best["aic"]:
                        best = {"series": name, "p": a, "d": diff, "q": b, "n": int(n), "constant": float(beta[0]), "ar": list(beta[1 : a + 1]),
                                "ma": list(beta[a + 1 :]), "sigma2": rss / n, "aic": aic, "bic": aic + (math.log(n) - 2) * (len(use) + 1)}
                out.append(best)
            if out:
                yield pd.DataFrame(out)

    schema = "series string, p int, d int, q int, n bigint, constant double, ar array<double>, ma array<double>, sigma2 double, aic double, bic double"
    models = _per_series_sums(second, columns, "y_lag0", "series").mapInPandas(second_stage, schema)
    if centre is not None:
        models = models.join(broadcast_if_small(centre), "series").withColumnRenamed("_m", "mean")
    else:
        models = models.withColumn("mean", F.lit(0.0))
    return materialise(models), base, inno


def forecast_arima(models: DataFrame, base: DataFrame, inno: DataFrame, steps: int = 12) -> DataFrame:
    """Forecasts with 95 % limits for every series, from as many of its last rows as its lags and differences reach."""
    if steps < 1:
        raise ValueError("at least one step")
    reach = models.agg(F.max(F.greatest(F.size("ar"), F.size("ma")) + F.col("d"))).first()[0] or 0
    last = base.groupBy("series").agg(F.max("t").alias("_last"))
    near = base.join(broadcast_if_small(last), "series").where(F.col("t") > F.col("_last") - F.lit(reach + 1))
    near = near.join(inno.select("series", "t", "e"), ["series", "t"], "left")
    tails = near.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "y", "e"))).alias("_tail"), F.max("t").alias("_last"))
    tails = tails.select(
        "series", "_last", F.transform("_tail", lambda r: r["y"]).alias("_ys"), F.transform("_tail", lambda r: F.coalesce(r["e"], F.lit(0.0))).alias("_es")
    )
    rows = models.join(tails, "series").withColumnsRenamed({"_ys": "ys", "_es": "es", "_last": "last"})

    def run(batches):
        for pdf in batches:
            out = []
            for m in pdf.itertuples():
                ys, es, t = np.array(m.ys, dtype=float), list(m.es), m.last
                heads, work = [], ys
                for _ in range(m.d):
                    heads.append(work[-1])
                    work = np.diff(work)
                values = list(work - m.mean) if m.d == 0 else list(work)
                ar, ma = list(m.ar), list(m.ma)
                ahead = []
                for _ in range(steps):
                    v = m.constant + sum(a * values[-k] for k, a in enumerate(ar, 1)) + sum(b * es[-k] for k, b in enumerate(ma, 1))
                    values.append(v)
                    es.append(0.0)
                    ahead.append(v)
                ahead = np.array(ahead)
                psi = [1.0]
                for j in range(1, steps):
                    psi.append((ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - k] for k, a in enumerate(ar, 1) if k <= j))
                psi = np.array(psi)
                for h in reversed(heads):
                    ahead = h + np.cumsum(ahead)
                    psi = np.cumsum(psi)
                if m.d == 0:
                    ahead = ahead + m.mean
                half = 1.959963984540054 * np.sqrt(m.sigma2 * np.cumsum(psi**2))
                out += [(m.series, int(t + i + 1), float(ahead[i]), float(ahead[i] - half[i]), float(ahead[i] + half[i])) for i in range(steps)]
            if out:
                yield pd.DataFrame(out, columns=["series", "t", "forecast", "low", "high"])

    return rows.mapInPandas(run, "series string, t bigint, forecast double, low double, high double")
