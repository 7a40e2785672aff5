"""Survival analysis on times aggregated to distinct values, with running totals split over tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref
from colonnade.functions import special
from colonnade.functions.expressions import percent, ratio
from colonnade.functions.gram import Design, build_design
from colonnade.functions.ordering import average_ranks, positions, running_totals
from colonnade.functions.quantiles import exact_quantiles
from colonnade.functions.results import table_of
from colonnade.functions.risksets import TIE_TERMS, RiskRows
from colonnade.operators.hypothesis import pair_balance
from colonnade.operators.linear import coefficient_rows
from colonnade.session import broadcast_if_small, keep

Z95 = 1.959963984540054
MAX_GROUPS = 10


def event_indicator(df: DataFrame, col: str, code: str) -> Column:
    """1 when the status, read as text, equals the chosen code; missing stays missing."""
    return F.when(ref(col).isNotNull(), (ref(col).cast("string") == F.lit(code)).cast("int"))


def event_coding(df: DataFrame, col: str, code: str) -> DataFrame:
    """How every status value is coded, with its count."""
    return df.groupBy(ref(col).cast("string").alias("value")).agg(F.count("*").alias("count")).withColumn(
        "event", F.when(F.col("value").isNotNull(), (F.col("value") == F.lit(code)).cast("int"))
    )


def survival_frame(df: DataFrame, duration: str, event: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (t, e, carried columns) with a known, non-negative numeric duration and a known event."""
    t = F.expr(f"try_cast(`{duration}` AS double)")
    rows = normalise_missing(df).select(t.alias("t"), event.alias("e"), *[ref(c) for c in carry])
    return rows.where((F.col("t") >= 0) & F.col("e").isNotNull())


def life_table(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events, observations and number at risk at each distinct time, per group."""
    for b in by:
        rows = rows.where(ref(b).isNotNull())
    counts = rows.groupBy(*[ref(b) for b in by], "t").agg(F.sum("e").cast("long").alias("events"), F.count("*").alias("observed"))
    run = running_totals(counts, ["t"], {"observed": "_upto"}, by, grand=True)
    return run.select(
        *by, "t", "events", "observed", (F.col("_upto_all") - F.col("_upto") + F.col("observed")).alias("at_risk")
    )


def kaplan_meier(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Survival with log-log Greenwood limits at each observed time."""
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    table = life_table(rows, by).withColumns({
        "_log": F.when(d == n, F.lit(float("-inf"))).otherwise(F.log1p(-d / n)),
        "_var": F.when(d < n, d / (n * F.nullif(n - d, F.lit(0.0)))).otherwise(0.0),
    })
    run = running_totals(table, ["t"], {"_log": "_logs", "_var": "_vars"}, by)
    s = F.exp("_logs")
    v = F.when((s > 0) & (s < 1), F.col("_logs"))
    shift = Z95 * F.sqrt("_vars") / v
    return run.select(
        *by, "t", "events", "observed", "at_risk", s.alias("survival"),
        F.when(s == 1, 1.0).otherwise(F.exp(-F.exp(F.log(-v) - shift))).alias("ci_low"),
        F.when(s == 1, 1.0).otherwise(F.exp(-F.exp(F.log(-v) + shift))).alias("ci_high"),
    )


def median_survival(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First time with survival of at most one half; missing when the curve stays above."""
    return curve.groupBy(*[ref(b) for b in by]).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_survival"))


def survival_at(curve: DataFrame, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Value of the step curve at given times: the last value at or before each, 1 before the first."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    asked = curve.select(*by, "t", "survival", grid.alias("time"))
    last = F.max_by("survival", F.when(F.col("t") <= F.col("time"), F.col("t")))
    value = F.when(F.count_if(F.col("t") <= F.col("time")) > 0, last).otherwise(1.0)
    return asked.groupBy(*by, "time").agg(value.alias("survival"))


def quantile_times(rows: DataFrame, probs: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> list[float]:
    return sorted({r["value"] for r in exact_quantiles(rows, ["t"], probs).collect()})


def risk_table(rows: DataFrame, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Number still at risk at the grid times, per group, in long form; one pass."""
    cells = F.array(*[F.struct(F.lit(float(t)).alias("time"), F.count_if(F.col("t") >= float(t)).alias("at_risk")) for t in times])
    out = rows.groupBy(*[ref(b) for b in by]).agg(cells.alias("_c"))
    return out.select(*by, F.explode("_c").alias("_c")).select(*by, "_c.*")


def _group_names(rows: DataFrame, group: str, most: int) -> list[str]:
    found = rows.where(ref(group).isNotNull()).select(ref(group).cast("string").alias("g")).distinct().limit(most + 1).collect()
    if not 2 <= len(found) <= most:
        raise ValueError(f"{group} must have 2 to {most} groups")
    return sorted(r["g"] for r in found)


def log_rank(rows: DataFrame, group: str, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Log-rank test of two or more groups; its covariance has a number per pair, which ``max_groups`` bounds."""
    names = _group_names(rows, group, max_groups)
    k = len(names)
    g = ref(group).cast("string")
    counts = rows.where(g.isNotNull()).groupBy("t").agg(
        *[F.count_if(g == v).alias(f"n{i}") for i, v in enumerate(names)],
        *[F.sum(F.when(g == v, F.col("e")).otherwise(0)).cast("long").alias(f"d{i}") for i, v in enumerate(names)],
    )
    risk = running_totals(counts, ["-t"], {f"n{i}": f"r{i}" for i in range(k)})
    n = sum((F.col(f"r{i}") for i in range(k)), F.lit(0)).cast("double")
    d = sum((F.col(f"d{i}") for i in range(k)), F.lit(0)).cast("double")
    at = risk.where(d > 0).withColumns({"_n": n, "_d": d})
    spread = F.col("_d") * (F.col("_n") - F.col("_d")) / F.greatest(F.col("_n") - 1, F.lit(1.0))
    share = [F.col(f"r{i}") / F.col("_n") for i in range(k)]
    aggs = [F.sum(F.col(f"d{i}")).alias(f"o{i}") for i in range(k)]
    aggs += [F.sum(F.col("_d") * share[i]).alias(f"e{i}") for i in range(k)]
    aggs += [
        F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    r = at.agg(*aggs).first()
    diff = np.array([r[f"o{i}"] - r[f"e{i}"] for i in range(k - 1)], dtype=float)
    v = np.array([[r[f"v{min(i, j)}_{max(i, j)}"] for j in range(k - 1)] for i in range(k - 1)], dtype=float)
    chi2 = float(diff @ np.linalg.pinv(v) @ diff)
    return table_of(rows.sparkSession, [{"groups": k, "chi2": chi2, "df": k - 1, "p_value": special.chi2_sf(chi2, k - 1)}])


def _harmonic(m: Column, power: int) -> Column:
    """Sum of 1/j^power for j = 1..m: term by term below 50, asymptotic series above."""
    small = F.aggregate(
        F.when(m > 0, F.sequence(F.lit(1), F.least(m, F.lit(50)).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0), lambda s, j: s + 1 / F.pow(j.cast("double"), power),
    )
    x = F.greatest(m, F.lit(1)).cast("double")
    if power == 1:
        large = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4))
    else:
        large = math.pi**2 / 6 - 1 / x + 1 / (2 * x * x) - 1 / (6 * F.pow(x, 3)) + 1 / (30 * F.pow(x, 5))
    return F.when(m <= 50, small).otherwise(large)


def nelson_aalen(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard; tied events add 1/n + 1/(n-1) + ... as if they came one after another."""
    d, n = F.col("events"), F.col("at_risk")
    table = life_table(rows, by).withColumns({
        "_h": F.when(d <= 50, F.aggregate(
            F.when(d > 0, F.sequence(F.lit(0), F.least(d, F.lit(50)).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0.0), lambda s, j: s + 1 / (n - j).cast("double"))).otherwise(_harmonic(n, 1) - _harmonic(n - d, 1)),
        "_v": F.when(d <= 50, F.aggregate(
            F.when(d > 0, F.sequence(F.lit(0), F.least(d, F.lit(50)).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0.0), lambda s, j: s + 1 / F.pow((n - j).cast("double"), 2))).otherwise(_harmonic(n, 2) - _harmonic(n - d, 2)),
    })
    run = running_totals(table, ["t"], {"_h": "hazard", "_v": "_vars"}, by)
    spread = F.exp(Z95 * F.sqrt("_vars") / F.nullif("hazard", F.lit(0.0)))
    return run.select(
        *by, "t", "events", "at_risk", F.col("hazard").alias("cumulative_hazard"),
        (F.col("hazard") / spread).alias("ci_low"), (F.col("hazard") * spread).alias("ci_high"),
    )


def event_checks(rows: DataFrame, coefficients: int = 1) -> DataFrame:
    """Event rate with its band (below 10 %, below 30 %) and events per coefficient (warned below 10)."""
    out = rows.agg(F.count("*").alias("n"), F.sum("e").cast("long").alias("events"))
    rate = percent(F.col("events"), F.col("n"))
    epv = F.col("events") / F.lit(float(max(coefficients, 1)))
    band = F.when(rate < 10, "low").when(rate < 30, "moderate").otherwise("good")
    return out.select("*", rate.alias("event_percent"), band.alias("rate_band"), epv.alias("events_per_coefficient"), (epv < 10).alias("too_few_events"))


def tied_events(rows: DataFrame) -> DataFrame:
    """Distinct times with more than one event, events at such times and the largest tie."""
    ties = rows.where("e = 1").groupBy("t").agg(F.count("*").alias("d"))
    return ties.agg(
        F.count("*").alias("event_times"), F.count_if(F.col("d") > 1).alias("tied_times"),
        F.coalesce(F.sum(F.when(F.col("d") > 1, F.col("d"))), F.lit(0)).alias("tied_events"), F.max("d").alias("largest_tie"),
    )


# ---------------------------------------------------------------- Cox model


@dataclass
class CoxFit:
    design: Design
    beta_z: np.ndarray
    inverse_z: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    steps: int
    strata: bool
    events: int
    converged: bool

    @property
    def names(self) -> list[str]:
        return self.design.names[1:]

    @property
    def columns(self) -> list[str]:
        return self.design.columns[1:]

    @property
    def beta(self) -> np.ndarray:
        return self.beta_z / self.design.scale[1:]

    @property
    def covariance(self) -> np.ndarray:
        s = self.design.scale[1:]
        return self.inverse_z / np.outer(s, s)

    def risk(self, beta: np.ndarray | None = None) -> Column:
        b = self.beta_z if beta is None else beta
        return F.exp(_linear(self.columns, b))


def _linear(columns: Sequence[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for b, c in zip(beta, columns, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def _tie_sums(a: Column, d: Column) -> tuple[Column, Column, Column]:
    """Sums over l = 0..d-1 of log(a-l), 1/(a-l) and 1/(a-l)^2."""
    m = F.greatest(d - TIE_TERMS, F.lit(0)).cast("double")
    last = F.sequence(F.greatest(d - TIE_TERMS, F.lit(0)).cast("bigint"), (d - 1).cast("bigint"))

    def direct(fn):
        return F.aggregate(last, F.lit(0.0), lambda s, j: s + fn(a - j.cast("double")))

    b = a - m
    logs = a * F.log(a) - b * F.log(b) - m - (F.log(b) - F.log(a)) / 2 + (1 / a - 1 / b) / 12 - (2 / F.pow(a, 3) - 2 / F.pow(b, 3)) / 720
    ones = -F.log1p(-m / a) - (1 / b - 1 / a) / 2 + (1 / (b * b) - 1 / (a * a)) / 12 - (6 / F.pow(b, 4) - 6 / F.pow(a, 4)) / 720
    squares = (1 / b - 1 / a) - (1 / (b * b) - 1 / (a * a)) / 2 + (2 / F.pow(b, 3) - 2 / F.pow(a, 3)) / 12 - (24 / F.pow(b, 5) - 24 / F.pow(a, 5)) / 720
    zero = F.lit(0.0)
    return (
        direct(F.log) + F.when(m > 0, logs).otherwise(zero),
        direct(lambda x: 1 / x) + F.when(m > 0, ones).otherwise(zero),
        direct(lambda x: 1 / (x * x)) + F.when(m > 0, squares).otherwise(zero),
    )


def _risk_sums(design: Design, columns: Sequence[str], beta: np.ndarray, by: Sequence[str], second: bool = True) -> DataFrame:
    """Per (stratum, time): event sums and the sums over everybody still at risk. One shuffle of pre-aggregated rows."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)] if second else []
    w = F.exp(_linear(columns, beta))
    rows = design.frame.select(*by, "t", "e", *columns, w.alias("_w"))
    e, rw = F.col("e"), F.col("_w")
    aggs = [F.sum(rw).alias("s0"), F.sum(e).cast("long").alias("d"), F.sum(e * rw).alias("d0"), F.sum(e * F.log(rw)).alias("el")]
    for i, c in enumerate(columns):
        aggs += [F.sum(rw * F.col(c)).alias(f"s1_{i}"), F.sum(e * rw * F.col(c)).alias(f"d1_{i}"), F.sum(e * F.col(c)).alias(f"z_{i}")]
    for i, j in pairs:
        x = rw * F.col(columns[i]) * F.col(columns[j])
        aggs += [F.sum(x).alias(f"s2_{i}_{j}"), F.sum(e * x).alias(f"d2_{i}_{j}")]
    times = rows.groupBy(*by, "t").agg(*aggs)
    sums = {"s0": "r0"} | {f"s1_{i}": f"r1_{i}" for i in range(p)} | {f"s2_{i}_{j}": f"r2_{i}_{j}" for i, j in pairs}
    return running_totals(times, ["-t"], sums, by)


def cox(rows: DataFrame, predictors: Sequence[str], strata: str | None = None, max_steps: int = 30) -> CoxFit:
    """Proportional hazards with Efron ties; ``rows`` has t, e, the predictors and the optional stratum."""
    by = ["_stratum"] if strata else []
    carry = {"t": F.col("t"), "e": F.col("e").cast("double")}
    if strata:
        carry["_stratum"] = ref(strata)
    design = build_design(rows, predictors, carry)
    columns = design.columns[1:]
    sums = RiskRows(design.frame, columns, by)
    beta = np.zeros(len(columns))
    ll, gradient, info = sums.evaluate(beta)
    null, steps, converged = ll, 0, False
    for steps in range(1, max_steps + 1):
        step = np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ gradient
        scale = 1.0
        while True:
            new_ll, new_gradient, new_info = sums.evaluate(beta + scale * step)
            if new_ll >= ll - 1e-9 * abs(ll) or scale < 1e-3:
                break
            scale /= 2
        beta = beta + scale * step
        ll, gradient, info = new_ll, new_gradient, new_info
        if np.max(np.abs(step)) < 1e-8:
            converged = True
            break
    events = int(design.frame.agg(F.sum("e").alias("s")).first()["s"])
    inverse = np.linalg.pinv(info, rcond=1e-12, hermitian=True)
    return CoxFit(design, beta, inverse, ll, null, steps, bool(strata), events, converged)


def cox_coefficients(rows: DataFrame, fit: CoxFit) -> DataFrame:
    out = coefficient_rows(fit.names, fit.beta, fit.covariance, math.inf, "normal")
    for r in out:
        r["hazard_ratio"], r["hr_low"], r["hr_high"] = (math.exp(r[k]) for k in ("coefficient", "ci_low", "ci_high"))
    return table_of(rows.sparkSession, out)


def cox_statistics(rows: DataFrame, fit: CoxFit) -> DataFrame:
    lr = 2 * (fit.log_likelihood - fit.null_log_likelihood)
    p = len(fit.names)
    c = concordance(fit.design.frame.select("t", "e", fit.risk().alias("score"))).first()["concordance"]
    return table_of(rows.sparkSession, [{
        "n": fit.design.n, "events": fit.events, "log_likelihood": fit.log_likelihood, "partial_aic": -2 * fit.log_likelihood + 2 * p,
        "lr_chi2": lr, "lr_p_value": special.chi2_sf(lr, p), "concordance": c,
        "steps": fit.steps, "converged": fit.converged,
    }])


def concordance(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """Share of comparable pairs where the earlier event has the higher risk ``score`` (ties count half).

    A pair is comparable when the earlier time is an event; at equal times an event comes before a censored row.
    """
    points = keep(
        rows.groupBy("t", (1 - F.col("e")).cast("int").alias("late"), F.col("score").alias("y")).agg(F.count("*").alias("c"))
    )
    slots = positions(points.select("t", "late").distinct(), ["t", "late"], name="x")
    pts = points.join(broadcast_if_small(slots), ["t", "late"]).select(
        F.col("x").cast("double").alias("x"), "y", "c", F.when(F.col("late") == 0, F.col("c")).otherwise(0).alias("w")
    )
    pts = keep(pts)
    by_time = pts.groupBy("x").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    later = running_totals(by_time, ["-x"], {"c": "_after"})
    comparable = later.agg(F.sum(F.col("w").cast("double") * (F.col("_after") - F.col("c"))).alias("pairs"))
    s = pair_balance(pts, buckets)
    return s.join(F.broadcast(comparable)).select(
        "pairs", (0.5 - 0.5 * ratio(F.col("s"), F.col("pairs"))).alias("concordance")
    )


def ph_test(rows: DataFrame, fit: CoxFit) -> DataFrame:
    """Score-type test of proportional hazards: scaled Schoenfeld residuals against the rank of the event time."""
    by = ["_stratum"] if fit.strata else []
    p = len(fit.columns)
    at = _risk_sums(fit.design, fit.columns, fit.beta_z, by, second=False).where("d > 0")
    d = F.col("d").cast("double")
    _, ones, _ = _tie_sums(d * F.col("r0") / F.col("d0"), F.col("d"))
    at = at.withColumn("_k1", ones * d / F.col("d0"))
    res = []
    for i in range(p):
        u = F.col(f"d1_{i}") / F.col("d0")
        res.append((F.col(f"z_{i}") - d * u - (F.col(f"r1_{i}") - u * F.col("r0")) * F.col("_k1")).alias(f"q{i}"))
    at = keep(at.select("t", "d", *res))
    ranks = average_ranks(at.groupBy("t").agg(F.sum("d").alias("_d")), "t", "_d").select("t", "rank")
    joined = at.join(broadcast_if_small(ranks), "t")
    n = fit.events
    g = F.col("rank") - (n + 1) / 2
    r = joined.agg(F.sum(g * g * F.col("d")).alias("gg"), *[F.sum(g * F.col(f"q{i}")).alias(f"x{i}") for i in range(p)]).first()
    x = np.array([r[f"x{i}"] for i in range(p)])
    scaled = n * (fit.inverse_z @ x)
    out = []
    for i, name in enumerate(fit.names):
        stat = scaled[i] ** 2 / (n * fit.inverse_z[i, i] * r["gg"])
        out.append({"term": name, "chi2": float(stat), "p_value": special.chi2_sf(float(stat), 1), "violated": special.chi2_sf(float(stat), 1) < 0.05})
    return table_of(rows.sparkSession, out)


def baseline_hazard(fit: CoxFit) -> DataFrame:
    """Breslow cumulative baseline hazard (at the mean of the predictors) per stratum and event time."""
    by = ["_stratum"] if fit.strata else []
    at = _risk_sums(fit.design, fit.columns, fit.beta_z, by, second=False)
    steps = at.select(*by, "t", (F.col("d") / F.col("r0")).alias("h"))
    return running_totals(steps, ["t"], {"h": "baseline"}, by).select(*by, "t", "baseline")


def martingale_residuals(fit: CoxFit) -> DataFrame:
    """Event minus expected events up to the row's own time."""
    by = ["_stratum"] if fit.strata else []
    base = broadcast_if_small(baseline_hazard(fit))
    rows = fit.design.frame.select(*by, "t", "e", fit.risk().alias("risk"))
    return rows.join(base, [*by, "t"]).select(*by, "t", "e", (F.col("e") - F.col("baseline") * F.col("risk")).alias("martingale"))


def log_log_curves(rows: DataFrame, group: str) -> DataFrame:
    """log(-log S) against log time per category, where defined."""
    curve = kaplan_meier(rows, [group]).where("survival > 0 AND survival < 1 AND t > 0")
    return curve.select(ref(group), "t", F.log("t").alias("log_time"), F.log(-F.log("survival")).alias("log_minus_log"))


# ---------------------------------------------------------------- accelerated failure time


@dataclass
class AftFit:
    family: str
    design: Design
    theta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    steps: int

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * len(self.theta)


def _aft_derivatives(family: str, w: np.ndarray, e: np.ndarray):
    """Log-likelihood kernel and its first two derivatives by the standardised log time."""
    if family == "weibull":
        x = np.exp(np.minimum(w, 700))
        return e * w - x, e - x, -x
    if family == "log_logistic":
        q = 1 / (1 + np.exp(-w))
        return e * w - (1 + e) * np.logaddexp(0, w), e - (1 + e) * q, -(1 + e) * q * (1 - q)
    # Log of the normal upper tail; a continued-fraction form far out, where erfc underflows.
    tail = np.array([math.erfc(v / math.sqrt(2)) / 2 if v < 25 else 0.0 for v in w])
    log_phi = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = w >= 25
        log_tail = np.where(far, log_phi - np.log(np.where(far, w, 1.0)) - 1 / np.where(far, w * w, 1.0), np.log(np.where(far, 1.0, tail)))
        h = np.exp(log_phi - log_tail)
    return np.where(e == 1, log_phi, log_tail), np.where(e == 1, -w, -h), np.where(e == 1, -1.0, -h * (h - w))


def _aft_sums(design: Design, family: str, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian; numpy per Arrow batch, one small row per task."""
    columns, p = list(design.columns), design.p
    derivatives = _aft_derivatives

    def partial(batches):
        k = p + 1
        total = np.zeros(1 + k + k * k)
        for pdf in batches:
            z = pdf[columns].to_numpy(dtype=float)
            e, y = pdf["e"].to_numpy(dtype=float), np.log(pdf["t"].to_numpy(dtype=float))
            sigma = math.exp(theta[-1])
            w = (y - z @ theta[:-1]) / sigma
            base, l1, l2 = derivatives(family, w, e)
            ll = (base - e * (theta[-1] + y)).sum()
            gradient = np.r_[z.T @ (-l1 / sigma), (-l1 * w - e).sum()]
            hessian = np.empty((k, k))
            hessian[:p, :p] = (z * (l2 / sigma**2)[:, None]).T @ z
            hessian[:p, p] = hessian[p, :p] = z.T @ ((l1 + l2 * w) / sigma)
            hessian[p, p] = (l1 * w + l2 * w * w).sum()
            total += np.r_[ll, gradient, hessian.ravel()]
        yield pd.DataFrame({"k": np.arange(len(total), dtype="int32"), "v": total})

    rows = design.frame.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + (p + 1) + (p + 1) ** 2)
    for r in rows:
        flat[r["k"]] = r["v"]
    return flat[0], flat[1 : p + 2], flat[p + 2 :].reshape(p + 1, p + 1)


AFT_FAMILIES = ("weibull", "log_normal", "log_logistic")


def fit_aft(rows: DataFrame, predictors: Sequence[str], family: str = "weibull", max_steps: int = 100) -> AftFit:
    """Accelerated failure time model by Newton steps; times must be positive."""
    if family not in AFT_FAMILIES:
        raise ValueError(f"family is one of {AFT_FAMILIES}")
    design = build_design(rows.where("t > 0"), predictors, {"t": F.col("t"), "e": F.col("e").cast("double")})
    start = design.frame.agg(F.avg(F.log("t")).alias("m"), F.stddev_samp(F.log("t")).alias("s")).first()
    theta = np.zeros(design.p + 1)
    theta[0], theta[-1] = start["m"], math.log(max(start["s"] or 1.0, 1e-3))
    ll, g, h = _aft_sums(design, family, theta)
    steps = 0
    for steps in range(1, max_steps + 1):
        values, vectors = np.linalg.eigh(-h)
        step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-8))
        scale = 1.0
        while True:
            new = theta + scale * step
            new_ll, new_g, new_h = _aft_sums(design, family, new)
            if (math.isfinite(new_ll) and new_ll >= ll - 1e-10 * abs(ll)) or scale < 1e-4:
                break
            scale /= 2
        theta, ll, g, h = new, new_ll, new_g, new_h
        if np.max(np.abs(scale * step)) < 1e-8:
            break
    back = np.eye(design.p + 1)
    back[: design.p, : design.p] = design.back
    cov = back @ np.linalg.pinv(-h, rcond=1e-12, hermitian=True) @ back.T
    return AftFit(family, design, back @ theta, cov, ll, steps)


def aft_coefficients(rows: DataFrame, fit: AftFit) -> DataFrame:
    """Coefficients on log time with time ratios; the last row is the log of the scale."""
    out = coefficient_rows([*fit.design.names, "log_scale"], fit.theta, fit.covariance, math.inf, "normal")
    for r in out:
        r["time_ratio"] = math.exp(min(r["coefficient"], 700.0))
    return table_of(rows.sparkSession, out)


def compare_aft(rows: DataFrame, predictors: Sequence[str]) -> DataFrame:
    fits = [fit_aft(rows, predictors, f) for f in AFT_FAMILIES]
    best = min(f.aic for f in fits)
    return table_of(rows.sparkSession, [
        {"family": f.family, "log_likelihood": f.log_likelihood, "aic": f.aic, "delta_aic": f.aic - best, "best": f.aic == best}
        for f in fits
    ])


def aft_curves(rows: DataFrame, fit: AftFit, profiles: DataFrame, points: int = 100) -> DataFrame:
    """Predicted survival of each profile row at evenly spaced times up to the 95th percentile of the durations."""
    top = exact_quantiles(rows, ["t"], [0.95]).first()["value"]
    times = F.explode(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: i * F.lit(top / points)))
    eta = fit.design.score_expression(fit.theta[:-1])
    sigma = math.exp(fit.theta[-1])
    grid = profiles.select("*", eta.alias("_eta"), times.alias("time"))
    w = (F.log("time") - F.col("_eta")) / sigma
    if fit.family == "weibull":
        s = F.exp(-F.exp(w))
    elif fit.family == "log_logistic":
        s = 1 / (1 + F.exp(w))
    else:
        grid = grid.withColumn("_w", -w)
        s = special.normal_cdf_column("_w")
    return grid.withColumn("survival", s).drop("_eta", "_w")
