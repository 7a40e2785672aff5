"""Logistic, Poisson and negative-binomial regression by Newton steps over distributed sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.context import normalise_missing, numeric_columns, ref
from colonnade.functions import special
from colonnade.functions.expressions import ratio
from colonnade.functions.gram import Design, build_design, cluster_meat, is_categorical, solve, weighted_sums
from colonnade.functions.ordering import average_ranks, running_totals
from colonnade.functions.quantiles import exact_quantiles
from colonnade.functions.results import table_of
from colonnade.operators.linear import add_split, coefficient_rows, vif_from_design

MAX_STEPS = 100
TOLERANCE = 1e-10


@F.pandas_udf(T.DoubleType())
def _log_factorial(y: pd.Series) -> pd.Series:
    return y.map(lambda v: math.lgamma(v + 1))


def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def _mean(family: str, eta: Column) -> Column:
    return logistic(eta) if family == "binomial" else F.exp(eta)


def _variance(family: str, mu: Column) -> Column:
    return {"binomial": mu * (1 - mu), "poisson": mu, "negative_binomial": mu * (1 + mu)}[family]


def _deviance(family: str, y: Column, mu: Column) -> Column:
    ylog = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0)
    if family == "binomial":
        return -2 * (F.when(y > 0, y * F.log(mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0.0))
    if family == "poisson":
        return 2 * (ylog - (y - mu))
    return 2 * (ylog - (y + 1) * F.log((1 + y) / (1 + mu)))


@dataclass
class GlmFit:
    family: str
    design: Design
    beta_z: np.ndarray
    inverse_z: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    deviance: float
    null_deviance: float
    pearson: float
    steps: int
    offset: bool = False
    classes: tuple | None = None

    @property
    def beta(self) -> np.ndarray:
        return self.design.back @ self.beta_z

    @property
    def n(self) -> int:
        return self.design.n

    @property
    def df_resid(self) -> int:
        return self.design.n - self.design.p

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.design.p

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.design.p * math.log(self.n)

    def eta(self) -> Column:
        out = self.design.linear(self.beta_z)
        return out + F.col("_offset") if self.offset else out

    def fitted(self) -> Column:
        return _mean(self.family, self.eta())

    def score_residual(self) -> Column:
        """Derivative of the log-likelihood by the linear predictor."""
        mu = self.fitted()
        r = F.col("_y") - mu
        return r / (1 + mu) if self.family == "negative_binomial" else r

    def with_covariance(self, meat: np.ndarray, factor: float = 1.0) -> GlmFit:
        cov = self.design.back @ (self.inverse_z @ meat @ self.inverse_z) @ self.design.back.T * factor
        return GlmFit(**{**self.__dict__, "covariance": cov})


def fit_design(
    design: Design, family: str, weight: Column | None = None, offset: bool = False, ridge: float = 0.0
) -> GlmFit:
    """Newton (Fisher scoring) on a design whose frame has ``_y`` and, with ``offset``, ``_offset``.

    ``ridge`` penalises half the squared standardised coefficients (the intercept is free)."""
    frame, y = design.frame, F.col("_y")
    w = weight if weight is not None else F.lit(1.0)
    off = F.col("_offset") if offset else F.lit(0.0)
    row = frame.agg((F.sum(w * y) / F.sum(w)).alias("m"), F.sum(w * F.exp(off)).alias("e"), F.sum(w * y).alias("s")).first()
    start = row["s"] / row["e"] if family != "binomial" else row["m"]
    if not 0 < start or (family == "binomial" and start >= 1):
        raise ValueError("the outcome does not vary")
    null = math.log(start / (1 - start)) if family == "binomial" else math.log(start)
    beta = np.zeros(design.p)
    beta[0] = null
    steps = 0
    for steps in range(1, MAX_STEPS + 1):
        mu = _mean(family, design.linear(beta) + off)
        cols = frame.select(*design.columns, "_y", w.alias("_pw"), mu.alias("_mu"))
        m = F.col("_mu")
        if family == "negative_binomial":
            info, score = F.col("_pw") * m / (1 + m), F.col("_pw") * (y - m) / (1 + m)
        else:
            info, score = F.col("_pw") * _variance(family, m), F.col("_pw") * (y - m)
        gram, right, _ = weighted_sums(cols, design.columns, info, {"u": score}, {})
        penalty = np.full(design.p, ridge)
        penalty[0] = 0.0
        step, inverse = solve(gram + np.diag(penalty), right["u"] - penalty * beta)
        # Long steps are cut back so that separated data do not overflow the exponential.
        size = float(np.max(np.abs(step)))
        beta = beta + step * min(1.0, 5.0 / size if size else 1.0)
        if size < TOLERANCE * (1 + float(np.max(np.abs(beta)))):
            break
    mu = _mean(family, design.linear(beta) + off)
    null_mu = _mean(family, F.lit(null) + off)
    cols = frame.select(*design.columns, "_y", w.alias("_pw"), mu.alias("_mu"), null_mu.alias("_mu0"))
    m, pw = F.col("_mu"), F.col("_pw")
    if family == "binomial":
        like = pw * _deviance(family, y, m) / -2
    elif family == "poisson":
        like = pw * (y * F.log(m) - m)
    else:
        like = pw * (y * F.log(m / (1 + m)) - F.log(1 + m))
    sums = {
        "like": like, "dev": pw * _deviance(family, y, m), "null": pw * _deviance(family, y, F.col("_mu0")),
        "pearson": pw * F.pow(y - m, 2) / _variance(family, m),
    }
    info = pw * (m / (1 + m) if family == "negative_binomial" else _variance(family, m))
    gram, _, extra = weighted_sums(cols, design.columns, info, {}, sums)
    _, inverse = solve(gram, np.zeros(design.p))
    log_likelihood = extra["like"]
    if family == "poisson":
        per_value = frame.groupBy("_y").agg(F.sum(w).alias("c"))
        log_likelihood -= per_value.agg(F.sum(F.col("c") * _log_factorial("_y")).alias("s")).first()["s"]
    cov = design.back @ inverse @ design.back.T
    return GlmFit(family, design, beta, inverse, cov, log_likelihood, extra["dev"], extra["null"], extra["pearson"], steps, offset)


def binary_classes(df: DataFrame, outcome: str) -> tuple:
    """The two sorted classes of a binary outcome; the second counts as the event."""
    found = df.where(ref(outcome).isNotNull()).select(ref(outcome).alias("v")).distinct().limit(3).collect()
    if len(found) != 2:
        raise ValueError(f"{outcome} must have exactly two classes")
    return tuple(sorted(r["v"] for r in found))


def fit_glm(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    family: str,
    exposure: str | None = None,
    carry: dict[str, Column] | None = None,
    weight: Column | None = None,
    squares: Sequence[str] = (),
    classes: tuple | None = None,
    ridge: float = 0.0,
) -> GlmFit:
    """Fit ``binomial``, ``poisson`` or ``negative_binomial`` (log link, dispersion 1); ``exposure`` enters as log offset."""
    df = normalise_missing(df)
    if family == "binomial":
        classes = classes or binary_classes(df, outcome)
        y = F.when(ref(outcome).isNotNull(), (ref(outcome) == F.lit(classes[1])).cast("double"))
    else:
        y = ref(outcome).cast("double")
    extra = {"_y": y, **(carry or {})}
    if exposure:
        extra["_offset"] = F.when(ref(exposure) > 0, F.log(ref(exposure).cast("double")))
    if weight is not None:
        extra["_pw"] = weight.cast("double")
    design = build_design(df, predictors, extra, squares)
    fit = fit_design(design, family, F.col("_pw") if weight is not None else None, bool(exposure), ridge)
    fit.classes = classes
    return fit


def coefficients(df: DataFrame, fit: GlmFit) -> DataFrame:
    """Coefficients with normal tails and their exponentials (odds or rate ratios)."""
    rows = coefficient_rows(fit.design.names, fit.beta, fit.covariance, fit.df_resid, "normal")
    for r in rows:
        r["ratio"], r["ratio_low"], r["ratio_high"] = (
            math.exp(min(r[k], 700.0)) for k in ("coefficient", "ci_low", "ci_high")
        )
    return table_of(df.sparkSession, rows)


def dispersion_band(value: float) -> str:
    return "none" if value < 1.2 else "mild" if value < 1.5 else "moderate" if value < 2 else "strong"


def fit_statistics(df: DataFrame, fit: GlmFit) -> DataFrame:
    null_like = fit.log_likelihood - (fit.null_deviance - fit.deviance) / 2
    chi2_df = fit.pearson / fit.df_resid
    return table_of(df.sparkSession, [{
        "n": fit.n, "log_likelihood": fit.log_likelihood, "aic": fit.aic, "bic": fit.bic, "deviance": fit.deviance,
        "null_deviance": fit.null_deviance,
        "deviance_reduction_percent": (1 - fit.deviance / fit.null_deviance) * 100 if fit.null_deviance else 0.0,
        "mcfadden_r2": 1 - fit.log_likelihood / null_like if null_like else 0.0, "pearson_chi2_df": chi2_df,
    }])


def scored(fit: GlmFit, carry: Sequence[str] = ()) -> DataFrame:
    """Outcome and fitted mean of every row of the fit."""
    return fit.design.frame.select(*[ref(c) for c in carry], F.col("_y").alias("y"), fit.fitted().alias("p"))


def score_new(new: DataFrame, fit: GlmFit, exposure: str | None = None) -> DataFrame:
    eta = fit.design.score_expression(fit.beta)
    if exposure:
        eta = eta + F.log(ref(exposure).cast("double"))
    return normalise_missing(new).withColumn("predicted", _mean(fit.family, eta))


# ---------------------------------------------------------------- classification metrics


def auc(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the ROC curve from the rank sum over distinct scores."""
    counts = rows.groupBy(ref(p).alias("v")).agg(F.count("*").alias("c"), F.sum(ref(y)).alias("pos"))
    ranked = average_ranks(counts, "v", "c")
    s = ranked.agg(F.sum("c").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    n0 = F.col("n") - F.col("n1")
    return s.select(ratio(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * n0).alias("auc"))


def probability_metrics(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AUC, Brier score, log loss and the event rate with its guidance."""
    q = F.least(F.greatest(ref(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(ref(y) * F.log(q) + (1 - ref(y)) * F.log(1 - q))
    out = rows.agg(
        F.avg(F.pow(ref(p) - ref(y), 2)).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(ref(y)).alias("event_rate")
    )
    rate = F.col("event_rate")
    return auc(rows, y, p).join(F.broadcast(out)).withColumn("rare_events", (rate < 0.1) | (rate > 0.9))


def confusion(rows: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    hit = ref(p) >= threshold
    pos = ref(y) == 1
    out = rows.agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_points(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """True and false positive rates with precision at every distinct score, highest first."""
    counts = rows.groupBy(ref(p).alias("threshold")).agg(F.sum(ref(y)).cast("double").alias("pos"), F.count("*").alias("c"))
    counts = counts.select("threshold", "pos", (F.col("c") - F.col("pos")).alias("neg"))
    run = running_totals(counts, ["-threshold"], {"pos": "tp", "neg": "fp"}, grand=True)
    return run.select(
        "threshold", "tp", "fp", ratio(F.col("tp"), F.col("tp_all")).alias("tpr"),
        ratio(F.col("fp"), F.col("fp_all")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def average_precision(points: DataFrame) -> DataFrame:
    """Area under the precision-recall steps: each score adds its recall gain times its precision."""
    total = F.max("tp")
    gains = points.groupBy("threshold").agg(F.max("tp").alias("tp"), F.max("precision").alias("precision"))
    before = running_before(gains)
    return before.agg(ratio(F.sum((F.col("tp") - F.col("_before")) * F.col("precision")), total).alias("average_precision"))


def running_before(points: DataFrame) -> DataFrame:
    """Previous cumulative hits: the hits at this score are its own count, so the earlier total is the difference."""
    counts = points.select("threshold", "tp", "precision", F.lit(1).cast("long").alias("_one"))
    numbered = running_totals(counts, ["-threshold"], {"_one": "_k"})
    prev = numbered.select((F.col("_k") + 1).alias("_k"), F.col("tp").alias("_p"))
    return numbered.join(prev, "_k", "left").withColumn("_before", F.coalesce("_p", F.lit(0.0)))


def calibration_bins(rows: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Observed and predicted rate in equal-width bins of the predicted probability."""
    b = F.least(F.floor(ref(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(ref(p)).alias("mean_predicted"), F.avg(ref(y)).alias("observed_rate")
    )


def hosmer_lemeshow(rows: DataFrame, groups: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Chi-square over quantile groups of the predicted probability (equal edges merged)."""
    grid = [i / groups for i in range(groups + 1)]
    edges = sorted({r["value"] for r in exact_quantiles(rows.select(ref(p).alias("p")), ["p"], grid).collect()})
    inner = edges[1:-1]
    code = F.lit(0)
    for e in inner:
        code = code + (ref(p) > F.lit(e)).cast("int")
    table = rows.groupBy(code.alias("g")).agg(
        F.count("*").alias("n"), F.sum(ref(y)).alias("o"), F.sum(ref(p)).alias("e")
    ).collect()
    chi2 = sum((r["o"] - r["e"]) ** 2 / (r["e"] * (1 - r["e"] / r["n"])) for r in table if 0 < r["e"] < r["n"])
    dof = max(len(table) - 2, 1)
    return table_of(rows.sparkSession, [{"chi2": chi2, "groups": len(table), "df": dof, "p_value": special.chi2_sf(chi2, dof)}])


AUC_GAP = 0.10


def train_test_logistic(df: DataFrame, outcome: str, predictors: Sequence[str], row_id: str):
    """Fit on the training part; probability metrics of both parts and the AUC gap (flagged above 0.10)."""
    kept = add_split(normalise_missing(df).dropna(subset=[outcome, *predictors]), row_id)
    fit = fit_glm(kept.where("split = 'train'"), outcome, predictors, "binomial")
    y = (ref(outcome) == F.lit(fit.classes[1])).cast("double")
    rows = score_new(kept, fit).select(row_id, "split", y.alias("y"), F.col("predicted").alias("p"))
    parts = [probability_metrics(rows.where(F.col("split") == s)).withColumn("split", F.lit(s)) for s in ("train", "test")]
    metrics = parts[0].unionByName(parts[1])
    gap = metrics.agg(
        (F.max(F.when(F.col("split") == "train", F.col("auc"))) - F.max(F.when(F.col("split") == "test", F.col("auc")))).alias("auc_gap")
    )
    return fit, rows, metrics.join(F.broadcast(gap)).withColumn("overfit", F.col("auc_gap") > AUC_GAP)


def count_checks(df: DataFrame, fit: GlmFit) -> DataFrame:
    """Overdispersion band and observed against expected zeros exp(-mean); a ratio above 1.5 is an excess."""
    r = fit.design.frame.agg(F.count_if(F.col("_y") == 0).alias("z"), F.sum(F.exp(-fit.fitted())).alias("e"), F.avg("_y").alias("m")).first()
    chi2_df = fit.pearson / fit.df_resid
    expected = fit.n * math.exp(-r["m"])
    return table_of(df.sparkSession, [{
        "pearson_chi2_df": chi2_df, "overdispersion": dispersion_band(chi2_df), "observed_zeros": r["z"],
        "expected_zeros": expected, "zero_ratio": r["z"] / expected if expected else None,
        "excess_zeros": r["z"] / expected > 1.5 if expected else False,
    }])


def train_test_poisson(df: DataFrame, outcome: str, predictors: Sequence[str], row_id: str, exposure: str | None = None):
    """MAE, RMSE and mean Poisson deviance on the training and the test part."""
    kept = add_split(normalise_missing(df).dropna(subset=[outcome, *predictors]), row_id)
    fit = fit_glm(kept.where("split = 'train'"), outcome, predictors, "poisson", exposure)
    rows = score_new(kept, fit, exposure)
    e = ref(outcome) - F.col("predicted")
    return fit, rows.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(_deviance("poisson", ref(outcome).cast("double"), F.col("predicted"))).alias("mean_deviance"),
    )


def compare_count_models(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Poisson against negative binomial by AIC; a difference below 2 counts as a draw."""
    a = fit_glm(df, outcome, predictors, "poisson")
    b = fit_glm(df, outcome, predictors, "negative_binomial")
    gain = a.aic - b.aic
    better = "similar" if abs(gain) < 2 else "negative_binomial" if gain > 0 else "poisson"
    return table_of(df.sparkSession, [
        {"model": f.family, "aic": f.aic, "bic": f.bic, "deviance": f.deviance, "pearson_chi2_df": f.pearson / f.df_resid, "preferred": better}
        for f in (a, b)
    ])


# ---------------------------------------------------------------- predictor transforms and linearity


def transform_column(df: DataFrame, col: str, kind: str) -> tuple[Column, float | None]:
    """Expression of a predictor transform after checking its domain; a centred square also returns its centre."""
    r = df.agg(F.min(ref(col).cast("double")).alias("lo"), F.avg(ref(col)).alias("m")).first()
    x = ref(col).cast("double")
    if kind == "square":
        return F.pow(x - F.lit(r["m"]), 2), r["m"]
    need = {"log": r["lo"] > 0, "log1p": r["lo"] >= 0, "sqrt": r["lo"] >= 0}
    if not need[kind]:
        raise ValueError(f"{kind} is undefined for values down to {r['lo']}")
    return {"log": F.log, "log1p": F.log1p, "sqrt": F.sqrt}[kind](x), None


def transform_predictors(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """Add ``<column>_<kind>`` columns; the returned expressions replay the same transform on new data."""
    df = normalise_missing(df)
    made = {f"{c}_{k}": transform_column(df, c, k)[0] for c, k in kinds.items()}
    return df.withColumns(made), made


def evidence_label(improvement: float) -> str:
    return "none" if improvement < 2 else "weak" if improvement < 5 else "moderate" if improvement < 10 else "strong"


def linearity_search(df: DataFrame, outcome: str, predictors: Sequence[str], family: str, exposure: str | None = None) -> DataFrame:
    """Every numeric predictor refitted in each admissible form, ranked by AIC against the linear model."""
    df = normalise_missing(df).dropna(subset=[outcome, *predictors])
    base = fit_glm(df, outcome, predictors, family, exposure)
    rows = []
    for var in [p for p in predictors if not is_categorical(df, p) and p in numeric_columns(df)]:
        low = df.agg(F.min(ref(var).cast("double")).alias("lo")).first()["lo"]
        forms = ["square"] + (["log"] if low > 0 else ["log1p"] if low >= 0 else []) + (["sqrt"] if low >= 0 else [])
        tried = [("linear", base.aic)]
        for form in forms:
            expr, _ = transform_column(df, var, form)
            made = f"{var}_{form}"
            terms = [*predictors, made] if form == "square" else [made if p == var else p for p in predictors]
            fit = fit_glm(df.withColumn(made, expr), outcome, terms, family, exposure)
            fit.design.release()
            tried.append((form, fit.aic))
        best = min(tried, key=lambda t: t[1])
        bt = box_tidwell(df, outcome, predictors, var).first()["p_value"] if family == "binomial" and low > 0 else None
        evidence = evidence_label(base.aic - best[1])
        if bt is not None and bt < 0.05 and evidence == "none":
            evidence = "inspect"
        rows += [
            {"predictor": var, "form": f, "aic": a, "delta_aic": a - base.aic, "best": f == best[0], "evidence": evidence,
             "box_tidwell_p": bt}
            for f, a in tried
        ]
    return table_of(df.sparkSession, rows)


def box_tidwell(df: DataFrame, outcome: str, predictors: Sequence[str], var: str) -> DataFrame:
    """Significance of an added x*ln(x) term in the logistic model; x must be positive."""
    df = normalise_missing(df)
    name = f"{var}_xlogx"
    x = ref(var).cast("double")
    fit = fit_glm(df.withColumn(name, F.when(x > 0, x * F.log(x))), outcome, [*predictors, name], "binomial")
    rows = coefficient_rows(fit.design.names, fit.beta, fit.covariance, fit.df_resid, "normal")
    r = next(r for r in rows if r["term"] == name)
    return table_of(df.sparkSession, [{"predictor": var, "coefficient": r["coefficient"], "z": r["statistic"], "p_value": r["p_value"]}])


def variance_inflation(df: DataFrame, fit: GlmFit) -> DataFrame:
    return table_of(df.sparkSession, vif_from_design(fit.design))


def cluster_fit(fit: GlmFit, cluster: str) -> GlmFit:
    meat, g = cluster_meat(fit.design, fit.score_residual(), cluster)
    return fit.with_covariance(meat, g / (g - 1) * (fit.n - 1) / fit.df_resid)


def hc1_fit(fit: GlmFit, weight: Column | None = None) -> GlmFit:
    w = weight if weight is not None else F.lit(1.0)
    frame = fit.design.frame.select(*fit.design.columns, F.pow(w * fit.score_residual(), 2).alias("_u2"))
    meat, _, _ = weighted_sums(frame, fit.design.columns, F.col("_u2"), {}, {})
    return fit.with_covariance(meat, fit.n / fit.df_resid)


def ratio_sentences(table: DataFrame, what: str) -> DataFrame:
    """Plain-language reading of odds or rate ratios (``what`` is 'odds' or 'rate')."""
    change = F.abs(F.col("ratio") - 1) * 100
    direction = F.when(F.col("ratio") >= 1, "higher").otherwise("lower")
    verdict = F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant")
    text = F.format_string("one unit more of %s goes with %.2f%% %s " + what + " (%s)", F.col("term"), change, direction, verdict)
    return table.where(F.col("term") != "Intercept").select("term", text.alias("sentence"))
