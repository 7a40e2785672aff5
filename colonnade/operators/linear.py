"""Ordinary least squares with diagnostics, computed on all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref
from colonnade.functions import special
from colonnade.functions.expressions import ratio
from colonnade.functions.gram import Design, build_design, cluster_meat, hac_meat, solve, weighted_sums
from colonnade.functions.results import table_of
from colonnade.operators.hypothesis import shapiro_wilk
from colonnade.operators.reshape import merge_on


@dataclass
class LinearFit:
    design: Design
    beta_z: np.ndarray
    inverse_z: np.ndarray
    rss: float
    tss: float
    covariance: np.ndarray
    tail: str = "t"

    @property
    def beta(self) -> np.ndarray:
        return self.design.back @ self.beta_z

    @property
    def n(self) -> int:
        return self.design.n

    @property
    def p(self) -> int:
        return self.design.p

    @property
    def df_resid(self) -> int:
        return self.n - self.p

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid

    @property
    def log_likelihood(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.p

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.p * math.log(self.n)

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss else 0.0

    def fitted(self) -> Column:
        return self.design.linear(self.beta_z)

    def residual(self) -> Column:
        return F.col("_y") - self.fitted()

    def leverage(self) -> Column:
        return self.design.quadratic(self.inverse_z)

    def with_covariance(self, meat_z: np.ndarray, factor: float = 1.0, tail: str = "normal") -> LinearFit:
        """The same coefficients with a sandwich covariance."""
        cov = self.design.back @ (self.inverse_z @ meat_z @ self.inverse_z) @ self.design.back.T * factor
        return LinearFit(self.design, self.beta_z, self.inverse_z, self.rss, self.tss, cov, tail)


# Outcome transforms: forward expression, inverse, smallest allowed value test.
def _forward(name: str | None, y: Column) -> Column:
    if name is None:
        return y
    return {"log": F.log(y), "sqrt": F.sqrt(y)}[name]


def inverse_outcome(name: str | None, y: Column) -> Column:
    """Back to the outcome scale: exp for log, square for sqrt (negative fits count as zero)."""
    if name is None:
        return y
    return F.exp(y) if name == "log" else F.pow(F.greatest(y, F.lit(0.0)), 2)


def check_outcome(df: DataFrame, outcome: str, transform: str | None) -> None:
    if transform is None:
        return
    low = df.agg(F.min(ref(outcome).cast("double")).alias("m")).first()["m"]
    if low is not None and (low < 0 or (transform == "log" and low <= 0)):
        raise ValueError(f"{transform} needs {'positive' if transform == 'log' else 'non-negative'} outcomes, found {low}")


def fit_ols(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    squares: Sequence[str] = (),
    interactions: Sequence[tuple[str, str]] = (),
    transform: str | None = None,
    carry: dict[str, Column] | None = None,
    weight: Column | None = None,
) -> LinearFit:
    """Least squares from one pass of cross products. ``carry`` keeps further columns beside the design."""
    df = normalise_missing(df)
    check_outcome(df, outcome, transform)
    extra = {"_y": _forward(transform, ref(outcome).cast("double")), **(carry or {})}
    if weight is not None:
        extra["_pw"] = weight.cast("double")
    design = build_design(df, predictors, extra, squares, interactions)
    return refit(design, F.col("_y"), F.col("_pw") if weight is not None else None)


def refit(design: Design, y: Column, weight: Column | None = None) -> LinearFit:
    """Fit any right-hand side on an existing design."""
    w = weight if weight is not None else F.lit(1.0)
    mean = design.frame.agg((F.sum(w * y) / F.sum(w)).alias("m")).first()["m"]
    centred = y - F.lit(float(mean))
    gram, right, extra = weighted_sums(
        design.frame, design.columns, weight, {"y": w * centred}, {"yy": w * centred * centred}
    )
    beta, inverse = solve(gram, right["y"])
    rss = max(extra["yy"] - float(beta @ right["y"]), 0.0)
    beta = beta.copy()
    beta[0] += mean
    sigma2 = rss / (design.n - design.p) if design.n > design.p else math.nan
    cov = design.back @ inverse @ design.back.T * sigma2
    return LinearFit(design, beta, inverse, rss, float(extra["yy"]), cov)


def coefficient_rows(names, beta, covariance, df_resid: float, tail: str, level: float = 0.95) -> list[dict]:
    crit = special.t_ppf(0.5 + level / 2, df_resid) if tail == "t" else special.normal_ppf(0.5 + level / 2)
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(max(covariance[i, i], 0.0))
        stat = beta[i] / se if se else math.inf
        p = special.t_two_sided(stat, df_resid) if tail == "t" else special.normal_two_sided(stat)
        rows.append({
            "term": name, "coefficient": float(beta[i]), "std_error": se, "statistic": stat, "p_value": p,
            "ci_low": float(beta[i]) - crit * se, "ci_high": float(beta[i]) + crit * se,
        })
    return rows


def coefficients(df: DataFrame, fit: LinearFit) -> DataFrame:
    rows = coefficient_rows(fit.design.names, fit.beta, fit.covariance, fit.df_resid, fit.tail)
    return table_of(df.sparkSession, rows)


def fit_statistics(df: DataFrame, fit: LinearFit) -> DataFrame:
    k = fit.p - 1
    r2 = fit.r_squared
    f = ((fit.tss - fit.rss) / k) / fit.sigma2 if k else None
    return table_of(df.sparkSession, [{
        "n": fit.n, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (fit.n - 1) / fit.df_resid,
        "f_statistic": f, "f_p_value": special.f_sf(f, k, fit.df_resid) if k else None,
        "log_likelihood": fit.log_likelihood, "aic": fit.aic, "bic": fit.bic, "sigma": math.sqrt(fit.sigma2),
    }])


def compare_nested(df: DataFrame, outcome: str, reduced: Sequence[str], full: Sequence[str], **options) -> DataFrame:
    """F test of the added terms and the change in R squared, AIC and BIC, both fitted on the full model's rows."""
    kept = normalise_missing(df).dropna(subset=[outcome, *full])
    a, b = fit_ols(kept, outcome, reduced), fit_ols(kept, outcome, full, **options)
    added = b.p - a.p
    f = ((a.rss - b.rss) / added) / b.sigma2
    return table_of(df.sparkSession, [{
        "df_added": added, "df_resid": b.df_resid, "f": f, "p_value": special.f_sf(f, added, b.df_resid),
        "delta_r_squared": b.r_squared - a.r_squared, "delta_aic": b.aic - a.aic, "delta_bic": b.bic - a.bic,
    }])


def hc_fit(fit: LinearFit, kind: str = "HC3", weight: Column | None = None) -> LinearFit:
    """Heteroscedasticity-consistent covariance. HC3 keeps t tails (as for the plain table), HC1 uses normal ones."""
    w = weight if weight is not None else F.lit(1.0)
    u = w * fit.residual()
    if kind == "HC3":
        u = fit.residual() / (1 - fit.leverage())
    frame = fit.design.frame.select(*fit.design.columns, F.pow(u, 2).alias("_u2"))
    meat, _, _ = weighted_sums(frame, fit.design.columns, F.col("_u2"), {}, {})
    if kind == "HC3":
        return fit.with_covariance(meat, 1.0, "t")
    return fit.with_covariance(meat, fit.n / fit.df_resid if kind == "HC1" else 1.0, "normal")


def hac_fit(fit: LinearFit, time: str, lags: int) -> LinearFit:
    return fit.with_covariance(hac_meat(fit.design, fit.residual(), time, lags), 1.0, "normal")


def cluster_fit(fit: LinearFit, cluster: str) -> LinearFit:
    meat, g = cluster_meat(fit.design, fit.residual(), cluster)
    return fit.with_covariance(meat, g / (g - 1) * (fit.n - 1) / fit.df_resid, "normal")


def robust_comparison(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Plain and HC3 errors side by side, and whether significance at 5 % changes."""
    plain = coefficients(df, fit).select("term", "coefficient", "std_error", "p_value")
    robust = coefficients(df, hc_fit(fit)).select("term", "std_error", "p_value")
    out = merge_on(plain, robust, "term", ("", "_hc3"))
    return out.withColumn("decision_changed", (F.col("p_value") < 0.05) != (F.col("p_value_hc3") < 0.05))


def vif_from_design(design: Design) -> list[dict]:
    gram, _, _ = weighted_sums(design.frame, design.columns[1:], None, {}, {})
    scale = np.sqrt(np.diag(gram))
    corr = gram / np.outer(scale, scale)
    vif = np.diag(np.linalg.pinv(corr, rcond=1e-12, hermitian=True))
    return [
        {"term": n, "vif": float(v), "status": "problem" if v > 10 else "warning" if v > 5 else "ok"}
        for n, v in zip(design.names[1:], vif, strict=True)
    ]


def variance_inflation(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """VIF of each encoded column: diagonal of the inverse correlation matrix."""
    return table_of(df.sparkSession, vif_from_design(build_design(df, predictors)))


def breusch_pagan(df: DataFrame, fit: LinearFit) -> DataFrame:
    """LM test: n times the R squared of the squared residuals on the design."""
    aux = refit(fit.design, F.pow(fit.residual(), 2))
    lm = aux.r_squared * fit.n
    k = fit.p - 1
    return table_of(df.sparkSession, [{"lm": lm, "df": k, "p_value": special.chi2_sf(lm, k)}])


def durbin_watson(frame: DataFrame, residual: str, time: str) -> DataFrame:
    """Sum of squared steps over sum of squares; neighbours meet by an equi-join on the gap-free index ``time``."""
    e = frame.select(ref(time).cast("long").alias("t"), ref(residual).alias("e"))
    before = e.select((F.col("t") + 1).alias("t"), F.col("e").alias("b"))
    steps = e.join(before, "t", "left")
    return steps.agg(ratio(F.sum(F.pow(F.col("e") - F.col("b"), 2)), F.sum(F.pow("e", 2))).alias("durbin_watson"))


def residual_normality(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Shapiro-Wilk of all residuals."""
    return shapiro_wilk(fit.design.frame.select(fit.residual().alias("e")), "e")


def influence(fit: LinearFit, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: fitted, residual, leverage, studentised residuals, Cook's distance, scaled coefficient changes, flags.

    Everything is a row expression over broadcast-free literals of the p-by-p inverse; no shuffle. The coefficient
    change is (X'X)^-1 x e / (s (1-h)), not divided by the root of the diagonal.
    """
    s2, n, p, dof = fit.sigma2, fit.n, fit.p, fit.df_resid
    d = fit.design
    base = d.frame.select(
        *[ref(c) for c in carry], *d.columns, F.col("_y").alias("y"), fit.fitted().alias("fitted"),
        fit.residual().alias("residual"),
        F.least(F.greatest(fit.leverage(), F.lit(0.0)), F.lit(1 - 1e-9)).alias("leverage"),
    )
    h, e = F.col("leverage"), F.col("residual")
    base = base.withColumn("student_internal", e / F.sqrt(F.lit(s2) * (1 - h)))
    t = F.col("student_internal")
    change = d.back @ fit.inverse_z
    deltas = [d.linear(change[j]) * e / (math.sqrt(s2) * (1 - h)) for j in range(p)]
    base = base.withColumns({
        "student_external": t * F.sqrt((dof - 1) / F.greatest(dof - t * t, F.lit(1e-12))),
        "cooks_distance": e * e * h / (p * s2 * F.pow(1 - h, 2)),
        "max_abs_dfbetas": F.greatest(*[F.abs(x) for x in deltas], F.lit(0.0)),
    })
    return base.drop(*d.columns).withColumns({
        "influential": F.col("cooks_distance") > 4.0 / n,
        "high_leverage": F.col("leverage") > 2.0 * p / n,
        "dfbetas_flag": F.col("max_abs_dfbetas") > 2 / math.sqrt(n),
    })


def bonferroni_outliers(fit: LinearFit, carry: Sequence[str] = ()) -> DataFrame:
    """Rows whose external studentised residual stays significant after multiplying its p-value by n.

    The smallest residual that can pass is solved on the driver, so the filter is a plain comparison; p-values are
    then computed for the few rows left.
    """
    limit = special.t_ppf(1 - 0.05 / fit.n / 2, fit.df_resid) * (1 - 1e-9)
    rows = influence(fit, carry).where(F.abs("student_external") >= limit)
    p = special.t_two_sided_column(F.col("student_external"), F.lit(float(fit.df_resid)))
    out = rows.select(*[ref(c) for c in carry], "student_external", "cooks_distance", F.least(p * fit.n, F.lit(1.0)).alias("bonferroni_p"))
    return out.where(F.col("bonferroni_p") < 0.05)


def refit_without_influential(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Coefficients with and without the rows above the Cook cutoff, side by side."""
    fit = fit_ols(df, outcome, predictors)
    d = fit.design
    rows = d.frame.select("*", F.least(fit.leverage(), F.lit(1 - 1e-9)).alias("_h"), fit.residual().alias("_e"))
    cook = F.pow("_e", 2) * F.col("_h") / (fit.p * fit.sigma2 * F.pow(1 - F.col("_h"), 2))
    kept = rows.where(cook <= 4.0 / fit.n).drop("_h", "_e")
    n = kept.count()
    smaller = Design(kept, d.names, d.columns, d.back, n, d.raw)
    a = coefficients(df, fit).select("term", "coefficient", "p_value")
    b = coefficients(df, refit(smaller, F.col("_y"))).select("term", "coefficient", "p_value")
    return merge_on(a, b, "term", ("_all", "_reduced")).withColumn("rows_removed", F.lit(fit.n - n))


def health_checklist(df: DataFrame, fit: LinearFit) -> DataFrame:
    """VIF, Breusch-Pagan and Cook's distance as one table of passed / warning rows."""
    worst = max((r["vif"] for r in vif_from_design(fit.design)), default=1.0) if fit.p > 2 else 1.0
    bp = breusch_pagan(df, fit).first()["p_value"]
    far = influence(fit).agg(F.count_if("influential").alias("n")).first()["n"]
    return table_of(df.sparkSession, [
        {"check": "multicollinearity", "value": worst, "status": "problem" if worst > 10 else "warning" if worst > 5 else "passed"},
        {"check": "homoscedasticity", "value": bp, "status": "problem" if bp < 0.05 else "passed"},
        {"check": "influential rows", "value": float(far), "status": "warning" if far else "passed"},
    ])


def add_split(df: DataFrame, row_id: str, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """Repeatable train/test column from a hash of the row id; no shuffle."""
    bucket = F.pmod(F.xxhash64(ref(row_id), F.lit(seed)), F.lit(1_000_000))
    return df.withColumn("split", F.when(bucket < int(test_share * 1_000_000), "test").otherwise("train"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R squared, MSE, RMSE and MAE per group."""
    e = ref(actual) - ref(predicted)
    a = ref(actual)
    sse = F.sum(e * e)
    return df.groupBy(*[ref(b) for b in by]).agg(
        F.count("*").alias("n"), (1 - ratio(sse, F.var_pop(a) * F.count(a))).alias("r_squared"),
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
    )


def score_rows(new: DataFrame, fit: LinearFit, transform: str | None = None) -> DataFrame:
    """Predictions with a 95 % mean interval and prediction interval; the squares keep the training centres.

    The interval needs x'(X'X)^-1x, written as an expression of the standardised predictors.
    """
    d = fit.design
    zs = [F.lit(1.0)] + [(d.raw[n] - F.lit(float(d.shift[i]))) / F.lit(float(d.scale[i])) for i, n in enumerate(d.names) if i]
    cols = [z.alias(f"_z{i}") for i, z in enumerate(zs)]
    rows = normalise_missing(new).select("*", *cols)
    half = special.t_ppf(0.975, fit.df_resid)
    rows = rows.withColumns({"_eta": fit.fitted(), "_h": fit.leverage()})
    eta, h = F.col("_eta"), F.col("_h")
    se, so = F.sqrt(F.lit(fit.sigma2) * h), F.sqrt(F.lit(fit.sigma2) * (1 + h))
    out = {
        "predicted": eta, "mean_low": eta - half * se, "mean_high": eta + half * se,
        "interval_low": eta - half * so, "interval_high": eta + half * so,
    }
    rows = rows.withColumns({k: inverse_outcome(transform, v) for k, v in out.items()})
    return rows.drop("_eta", "_h", *[f"_z{i}" for i in range(d.p)])


def extrapolation_flags(new: DataFrame, training: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mark rows with any predictor outside the range seen in training (the ranges are one broadcast row)."""
    limits = training.agg(
        *[F.min(ref(c)).alias(f"_lo{i}") for i, c in enumerate(cols)], *[F.max(ref(c)).alias(f"_hi{i}") for i, c in enumerate(cols)]
    )
    test = F.lit(False)
    for i, c in enumerate(cols):
        test = test | F.coalesce((ref(c) < F.col(f"_lo{i}")) | (ref(c) > F.col(f"_hi{i}")), F.lit(False))
    return new.join(F.broadcast(limits)).select(*[ref(c) for c in new.columns], test.alias("extrapolated"))


OVERFIT_GAP = 0.15


def train_test_ols(df: DataFrame, outcome: str, predictors: Sequence[str], row_id: str, transform: str | None = None):
    """Fit on the training part, metrics on both parts and whether the R squared gap exceeds 0.15."""
    kept = add_split(normalise_missing(df).dropna(subset=[outcome, *predictors]), row_id)
    fit = fit_ols(kept.where("split = 'train'"), outcome, predictors, transform=transform)
    scored = score_rows(kept, fit, transform)
    metrics = regression_metrics(scored, outcome, "predicted", ["split"])
    gap = F.max(F.when(F.col("split") == "train", F.col("r_squared"))) - F.max(F.when(F.col("split") == "test", F.col("r_squared")))
    gaps = metrics.agg(gap.alias("r_squared_gap"))
    return fit, scored, metrics.join(F.broadcast(gaps)).withColumn("overfit", F.col("r_squared_gap") > OVERFIT_GAP)


def coefficient_sentences(table: DataFrame, outcome: str) -> DataFrame:
    """Plain-language reading of each coefficient."""
    c = F.col("coefficient")
    direction = F.when(c > 0, "higher").otherwise("lower")
    verdict = F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant")
    text = F.format_string("one unit more of %s goes with %.4f %s " + outcome + " (%s)", F.col("term"), F.abs(c), direction, verdict)
    return table.where(F.col("term") != "Intercept").select("term", text.alias("sentence"))
