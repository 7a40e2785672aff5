"""Seasonal ARIMA for many series at once: choice of D and d, orders by AIC, multiplied lag polynomials, forecasts.

Everything that touches rows is a sum per series, so long and hot series are split over tasks: seasonal means for D, running
totals for the unit-root statistics of all candidate differences together, and cross products of lagged values and lagged
innovations. Values before the start of a series count as its mean, so no rows are lost to lags and no series depends on the
length of another. The orders are then searched on each series' own small matrix, where the multiplied polynomials are
fitted by Gauss-Newton steps; no candidate reads the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.functions.ordering import positions, running_totals
from colonnade.operators.timeseries import lagged
from colonnade.session import keep, materialise

# Share of the variance of first differences that seasonal means must explain for a seasonal difference.
SEASONAL_SHARE = 0.64
# Fixed value: 5 % point of the KPSS statistic around a constant.
KPSS_FIVE = 0.463
MAX_D = 2
# Shortest long autoregression; it grows with the cube root of the series' own length.
LONG_AR = 8
# Models with a root closer to the unit circle are passed over.
ROOT = 0.999
STEPS = 25


def numbered(df: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """(series, t, y): complete rows of every series, numbered from 1 in time order."""
    rows = df.select(ref(by).cast("string").alias("series"), ref(time).alias("time"), ref(value).cast("double").alias("y")).dropna()
    return materialise(positions(rows, ["time"], ["series"], name="t").select("series", "t", "y"))


def seasonal_share(base: DataFrame, m: int) -> DataFrame:
    """series, share: adjusted share of the variance of first differences explained by the means of the ``m`` seasons."""
    steps = lagged(base, "y", [1], ["series"]).where(F.col("y_lag1").isNotNull())
    steps = steps.select("series", F.pmod("t", F.lit(m)).alias("k"), (F.col("y_lag0") - F.col("y_lag1")).alias("v"))
    seasons = steps.groupBy("series", "k").agg(F.count("*").alias("n"), F.avg("v").alias("mu"), (F.var_pop("v") * F.count("*")).alias("ss"))
    n, weighted = F.col("n"), F.col("n") * F.col("mu")
    sums = seasons.groupBy("series").agg(
        F.sum(n).alias("n"), F.sum("ss").alias("within"), (F.sum(weighted * F.col("mu")) - F.sum(weighted) * F.sum(weighted) / F.sum(n)).alias("between")
    )
    rest = F.try_divide(F.col("within") / (n - m), (F.col("within") + F.col("between")) / (n - 1))
    return sums.select("series", F.when(n > 2 * m, 1 - rest).alias("share"))


def differenced(base: DataFrame, shares: DataFrame, m: int) -> DataFrame:
    """(series, d, t, v): every series after its seasonal difference, if it takes one, and d = 0, 1 and 2 first differences."""
    wide = lagged(base, "y", [m], ["series"]) if m > 1 else base.select("series", "t", F.col("y").alias("y_lag0"), F.lit(None).cast("double").alias(f"y_lag{m}"))
    wide = wide.join(shares, "series", "left")
    u = F.when(F.col("share") > SEASONAL_SHARE, F.col("y_lag0") - F.col(f"y_lag{m}")).otherwise(F.col("y_lag0"))
    level = wide.select("series", "t", u.alias("u")).where(F.col("u").isNotNull())
    steps = lagged(level, "u", [1, 2], ["series"])
    u0, u1, u2 = (F.col(f"u_lag{k}") for k in range(3))
    forms = F.array(*[F.struct(F.lit(d).alias("d"), v.alias("v")) for d, v in enumerate([u0, u0 - u1, u0 - 2 * u1 + u2])])
    return steps.select("series", "t", F.explode(forms).alias("f")).select("series", "f.d", "t", "f.v").where(F.col("v").isNotNull())


def kpss_by_series(levels: DataFrame) -> DataFrame:
    """series, d, kpss: the statistic around a constant, with trunc(3 sqrt(n) / 13) lags.

    The Bartlett sum of autocovariances equals the mean square of moving sums of one lag more, which are differences of
    partial sums; so one running total and one grouping do for any number of lags.
    """
    size = levels.groupBy("series", "d").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    centred = levels.join(size, ["series", "d"]).select("series", "d", "t", "n", (F.col("v") - F.col("mean")).alias("e"))
    run = running_totals(centred, ["t"], {"e": "s"}, ["series", "d"])
    width = F.floor(3 * F.sqrt("n") / 13).cast("long") + 1
    sent = F.array(F.struct(F.col("t").alias("at"), F.col("s").alias("s")), F.struct((F.col("t") + width).alias("at"), (-F.col("s")).alias("s")))
    moving = run.select("series", "d", width.alias("width"), F.explode(sent).alias("p")).groupBy("series", "d", "p.at").agg(
        F.sum("p.s").alias("w"), F.max("width").alias("width")
    )
    long_run = moving.groupBy("series", "d").agg(F.sum(F.col("w") * F.col("w") / F.col("width")).alias("lr"))
    partial = run.groupBy("series", "d").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return partial.join(long_run, ["series", "d"]).select("series", "d", F.try_divide(F.col("q"), F.col("n") * F.col("lr")).alias("kpss"))


def unit_roots(base: DataFrame, m: int = 1) -> tuple[DataFrame, DataFrame]:
    """Per series its seasonal share, D, the KPSS statistics of d = 0, 1, 2 and the smallest d that passes (2 if none does).

    ``base`` is (series, t, y). Also returns the differenced series (series, d, t, v) the choice was made on.
    """
    if m > 1:
        shares = keep(seasonal_share(base, m))
    else:
        shares = base.select("series").distinct().withColumn("share", F.lit(None).cast("double"))
    levels = materialise(differenced(base, shares, m))
    kpss = kpss_by_series(levels).groupBy("series").agg(*[F.max(F.when(F.col("d") == d, F.col("kpss"))).alias(f"kpss_{d}") for d in range(MAX_D + 1)])
    chosen = F.lit(MAX_D)
    for d in reversed(range(MAX_D)):
        chosen = F.when(F.coalesce(F.col(f"kpss_{d}"), F.lit(0.0)) < KPSS_FIVE, d).otherwise(chosen)
    seasonal = F.coalesce(F.col("share") > SEASONAL_SHARE, F.lit(False)).cast("int")
    return kpss.join(shares, "series", "left").select("series", "share", seasonal.alias("sd"), "kpss_0", "kpss_1", "kpss_2", chosen.alias("d")), levels


def product_lags(m: int, short: int, seasons: int) -> list[int]:
    """Lags above zero of a polynomial of degree ``short`` times one of ``seasons`` seasonal lags."""
    return sorted({i + j * m for i in range(short + 1) for j in range(seasons + 1)} - {0})


def padded_lags(frame: DataFrame, col: str, lags: Sequence[int]) -> DataFrame:
    """(series, t, <col>_lag<k>...) with zero for values before the start."""
    out = lagged(frame, col, lags, ["series"])
    return out.select("series", "t", *[F.coalesce(F.col(f"{col}_lag{k}"), F.lit(0.0)).alias(f"{col}_lag{k}") for k in sorted({0, *lags})])


def cross_products(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """series, n and the upper triangle of the cross products of ``columns``."""
    parts = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return frame.groupBy("series").agg(F.count("*").alias("n"), F.array(*parts).alias("g"))


def square(flat, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = flat
    return g + np.triu(g, 1).T


def polynomial(coefficients: Sequence[float], step: int, sign: float) -> np.ndarray:
    """1 plus ``sign`` times the coefficients at every ``step``-th power."""
    out = np.zeros(len(coefficients) * step + 1)
    out[0] = 1.0
    for i, c in enumerate(coefficients, 1):
        out[i * step] = sign * c
    return out


def radius(coefficients: Sequence[float], sign: float) -> float:
    roots = np.roots(np.r_[1.0, sign * np.asarray(coefficients)]) if len(coefficients) else np.empty(0)
    return float(np.abs(roots).max(initial=0.0))


def fit_order(g: np.ndarray, y_lags: Sequence[int], e_lags: Sequence[int], m: int, order: tuple[int, int, int, int]) -> dict:
    """Least squares of one order (p, q, P, Q) on the cross products of the value, its lags and the innovations' lags."""
    p, q, sp, sq = order
    at_y = {0: 0} | {k: 1 + i for i, k in enumerate(y_lags)}
    at_e = {k: 1 + len(y_lags) + i for i, k in enumerate(e_lags)}
    beta = np.zeros(p + q + sp + sq)

    def split(b):
        return b[:p], b[p : p + sp], b[p + sp : p + sp + q], b[p + sp + q :]

    def spread(poly, at, shift, sign, out):
        for k, c in enumerate(poly):
            if c and k + shift:
                out[at[k + shift]] += sign * c
        return out

    def vector(b):
        ar, sar, ma, sma = split(b)
        u = np.zeros(len(g))
        u[0] = 1.0
        spread(np.convolve(polynomial(ar, 1, -1), polynomial(sar, m, -1)), at_y, 0, 1.0, u)
        return spread(np.convolve(polynomial(ma, 1, 1), polynomial(sma, m, 1)), at_e, 0, -1.0, u)

    def jacobian(b):
        ar, sar, ma, sma = split(b)
        j = np.zeros((len(g), len(b)))
        for k in range(p):
            spread(polynomial(sar, m, -1), at_y, k + 1, -1.0, j[:, k])
        for k in range(sp):
            spread(polynomial(ar, 1, -1), at_y, (k + 1) * m, -1.0, j[:, p + k])
        for k in range(q):
            spread(polynomial(sma, m, 1), at_e, k + 1, -1.0, j[:, p + sp + k])
        for k in range(sq):
            spread(polynomial(ma, 1, 1), at_e, (k + 1) * m, -1.0, j[:, p + sp + q + k])
        return j

    u = vector(beta)
    rss, converged = float(u @ g @ u), not len(beta)
    for _ in range(STEPS if len(beta) else 0):
        j = jacobian(beta)
        step = -np.linalg.pinv(j.T @ g @ j, rcond=1e-12, hermitian=True) @ (j.T @ g @ u)
        scale = 1.0
        while scale > 1e-4:
            new = vector(beta + scale * step)
            value = float(new @ g @ new)
            if value <= rss:
                break
            scale /= 2
        if scale <= 1e-4 or rss - value <= 1e-12 * max(rss, 1e-300):
            converged = True
            break
        beta, u, rss = beta + scale * step, new, value
    ar, sar, ma, sma = split(beta)
    steady = all(radius(c, s) < ROOT for c, s in ((ar, -1), (sar, -1), (ma, 1), (sma, 1)))
    return {"ar": ar, "sar": sar, "ma": ma, "sma": sma, "rss": max(rss, 1e-300), "converged": converged, "steady": steady}


def criterion(rss: float, n: float, parameters: int) -> float:
    return n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * parameters


MODEL = (
    "series string, p int, d int, q int, sp int, sd int, sq int, m int, n bigint, mean double, ar array<double>, ma array<double>, "
    "sar array<double>, sma array<double>, sigma2 double, aic double, bic double, converged boolean"
)


def fit_sarima(
    df: DataFrame, by: str, time: str, value: str, m: int = 1, max_p: int = 5, max_q: int = 5, max_sp: int = 2, max_sq: int = 2,
    max_order: int = 5, every_order: bool = False,
):
    """SARIMA(p, d, q)(P, D, Q, m) of every series; D by the seasonal share, d by KPSS, the orders by AIC.

    Innovations come from a long autoregression of each series; then value and innovations are regressed on their lags under
    the multiplied polynomials (conditional least squares in the manner of Hannan and Rissanen, near maximum likelihood).
    Orders go up to ``max_order`` together; those with roots near the unit circle are passed over (not the white-noise
    model). Returns (models, base); with ``every_order`` models has a row for each order tried, else the best of each series.
    """
    if m < 1:
        raise ValueError("a period is at least 1")
    max_sp, max_sq = (max_sp, max_sq) if m > 1 else (0, 0)
    base = numbered(df, by, time, value)
    roots, levels = unit_roots(base, m)
    roots = keep(roots)
    work = levels.join(roots.select("series", "d", "sd"), ["series", "d"])
    centre = work.groupBy("series").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    centre = keep(centre.join(roots.select("series", "d", "sd"), "series").withColumn("mean", F.when(F.col("d") + F.col("sd") < 2, F.col("mean")).otherwise(0.0)))
    work = materialise(work.join(centre.select("series", "mean"), "series").select("series", "t", (F.col("v") - F.col("mean")).alias("v")))
    longest = centre.agg(F.max("n")).first()[0] or 0
    y_lags, e_lags = product_lags(m, max_p, max_sp), product_lags(m, max_q, max_sq)
    short = list(range(1, max(LONG_AR, round(longest ** (1 / 3))) + 1))
    seasonal = [k + j * m for j in (1, 2) for k in (-1, 0, 1)] if m > 1 else []
    far = sorted({*short, *[k for k in seasonal if k > 0]})
    wide = materialise(padded_lags(work, "v", sorted({*far, *y_lags})))

    def long_fit(batches):
        for pdf in batches:
            betas = []
            for flat, n in zip(pdf["g"], pdf["n"], strict=True):
                g = square(flat, len(far) + 1)
                own = max(LONG_AR, round(n ** (1 / 3)))
                # Seasonal lags first, then as many short ones as the series' own length allows.
                use = [i + 1 for i, k in sorted(enumerate(far), key=lambda x: (x[1] not in seasonal, x[1])) if k in seasonal or k <= own]
                use = use[: max(1, int(n) // 4)]
                beta = np.zeros(len(far))
                beta[[i - 1 for i in use]] = np.linalg.pinv(g[np.ix_(use, use)], rcond=1e-12, hermitian=True) @ g[use, 0]
                betas.append(beta)
            yield pd.DataFrame({"series": pdf["series"], "_b": betas})

    long_ar = cross_products(wide, ["v_lag0", *[f"v_lag{k}" for k in far]]).mapInPandas(long_fit, "series string, _b array<double>")
    expected = F.lit(0.0)
    for i, k in enumerate(far, 1):
        expected = expected + F.element_at("_b", i) * F.col(f"v_lag{k}")
    inno = wide.join(long_ar, "series").select("series", "t", (F.col("v_lag0") - expected).alias("e"))
    columns = ["v_lag0", *[f"v_lag{k}" for k in y_lags], *[f"e_lag{k}" for k in e_lags]]
    both = wide.join(padded_lags(materialise(inno), "e", e_lags), ["series", "t"]) if e_lags else wide
    sums = cross_products(both, columns).join(centre.select("series", "mean", "d", "sd"), "series")
    grid = [
        (p, q, sp, sq)
        for p in range(max_p + 1)
        for q in range(max_q + 1)
        for sp in range(max_sp + 1)
        for sq in range(max_sq + 1)
        if p + q + sp + sq <= max_order
    ]

    def search(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                g, best = square(r.g, len(columns)), None
                for order in grid:
                    p, q, sp, sq = order
                    fit = fit_order(g, y_lags, e_lags, m, order)
                    if not fit["steady"]:
                        continue
                    k = sum(order) + 1 + (r.d + r.sd < 2)
                    aic = criterion(fit["rss"], r.n, k)
                    row = {
                        "series": r.series, "p": p, "d": r.d, "q": q, "sp": sp, "sd": r.sd, "sq": sq, "m": m, "n": r.n, "mean": r.mean,
                        "ar": fit["ar"], "ma": fit["ma"], "sar": fit["sar"], "sma": fit["sma"], "sigma2": fit["rss"] / r.n, "aic": aic,
                        "bic": aic + (math.log(r.n) - 2) * k, "converged": fit["converged"],
                    }
                    if every_order:
                        out.append(row)
                    elif best is None or aic < best["aic"]:
                        best = row
                out += [best] if best else []
            if out:
                yield pd.DataFrame(out)

    return materialise(sums.mapInPandas(search, MODEL)), base


def forecast_sarima(models: DataFrame, base: DataFrame, steps: int = 12) -> DataFrame:
    """Forecasts with 95 % limits of every series (models: one row each) from the rows its lags, differences and a run-in reach."""
    if steps < 1:
        raise ValueError("at least one step")
    lags = F.greatest(F.col("p") + F.col("sp") * F.col("m"), F.col("q") + F.col("sq") * F.col("m"))
    reach = models.agg(F.max(8 * lags + F.col("d") + F.col("sd") * F.col("m") + 50)).first()[0] or 0
    last = base.groupBy("series").agg(F.max("t").alias("last"))
    near = base.join(last, "series").where(F.col("t") > F.col("last") - F.lit(reach))
    tails = near.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("tail"), F.max("last").alias("last"))
    rows = models.join(tails.select("series", "last", F.transform("tail", lambda r: r["y"]).alias("ys")), "series")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.convolve(polynomial(r.ar, 1, -1), polynomial(r.sar, r.m, -1))
                b = np.convolve(polynomial(r.ma, 1, 1), polynomial(r.sma, r.m, 1))
                apart = np.array([1.0])
                for lag in [1] * r.d + [r.m] * r.sd:
                    apart = np.convolve(apart, polynomial([1.0], lag, -1))
                ys = list(np.asarray(r.ys, dtype=float))
                v = np.convolve(ys, apart)[len(apart) - 1 : len(ys)] - r.mean
                e: list[float] = []
                for t in range(len(v)):
                    past = sum(a[k] * v[t - k] for k in range(min(t + 1, len(a))))
                    e.append(float(past - sum(b[k] * e[t - k] for k in range(1, min(t + 1, len(b))))))
                full, constant = np.convolve(a, apart), r.mean * a.sum()
                psi = []
                for h in range(steps):
                    moved = sum(b[k] * e[-k] for k in range(1, len(b)) if k <= len(e))
                    ys.append(float(constant - sum(full[k] * ys[-k] for k in range(1, len(full)) if k <= len(ys)) + moved))
                    e.append(0.0)
                    psi.append((b[h] if h < len(b) else 0.0) - sum(full[k] * psi[h - k] for k in range(1, min(h, len(full) - 1) + 1)))
                half = 1.959963984540054 * np.sqrt(r.sigma2 * np.cumsum(np.square(psi)))
                for h, (y, w) in enumerate(zip(ys[-steps:], half, strict=True), 1):
                    out.append((r.series, int(r.last) + h, y, y - w, y + w))
            if out:
                yield pd.DataFrame(out, columns=["series", "t", "forecast", "low", "high"])

    return rows.mapInPandas(run, "series string, t bigint, forecast double, low double, high double")
