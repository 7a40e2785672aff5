"""Causal inference: propensity scores, balance, effects after matching and weighting, sensitivity bounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import categorical_columns, normalise_missing, ref
from colonnade.functions import special
from colonnade.functions.expressions import ratio
from colonnade.functions.gram import category_levels, is_categorical
from colonnade.functions.ordering import average_ranks
from colonnade.functions.quantiles import exact_quantiles
from colonnade.functions.results import table_of
from colonnade.operators import glm, linear
from colonnade.operators.clean import impute_numeric
from colonnade.operators.linear import coefficient_rows
from colonnade.operators.reshape import union_tables

MIN_ROWS = 20


def readiness(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Checks before an analysis: two treatment values coded 0/1, at least 20 rows, both arms present, outcome type."""
    df = normalise_missing(df)
    t = ref(treatment).cast("double")
    r = df.agg(
        F.count("*").alias("n"), F.count_if(t == 1).alias("t"), F.count_if(t == 0).alias("c"), F.count_if(~t.isin(0.0, 1.0)).alias("other"),
        F.count_distinct(ref(outcome)).alias("k"),
    ).first()
    kind = "binary" if r["k"] == 2 else "continuous" if outcome not in categorical_columns(df) else "categorical"
    return table_of(df.sparkSession, [
        {"check": "treatment is 0/1", "passed": r["other"] == 0 and r["t"] > 0 and r["c"] > 0, "detail": f"{r['t']} treated, {r['c']} control"},
        {"check": "enough rows", "passed": r["n"] >= MIN_ROWS, "detail": f"{r['n']} rows"},
        {"check": "outcome type", "passed": kind != "categorical" and r["k"] > 1, "detail": kind},
    ])


def fill_covariates(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Median for missing numbers, the first level for missing categories."""
    df = normalise_missing(df)
    numbers = [c for c in covariates if not is_categorical(df, c)]
    if numbers:
        df = impute_numeric(df, "median", numbers)
    for c in covariates:
        if is_categorical(df, c):
            levels = category_levels(df, c)
            df = df.withColumn(c, F.coalesce(ref(c), F.lit(levels[0]))) if levels else df
    return df


def propensity(df: DataFrame, treatment: str, covariates: Sequence[str], method: str = "ridge"):
    """Rows with a ``ps`` column and the fitted model. ``ridge`` penalises standardised coefficients, ``plain`` does not."""
    filled = fill_covariates(df, covariates)
    fit = glm.fit_glm(filled, treatment, covariates, "binomial", classes=(0, 1), ridge=1.0 if method == "ridge" else 0.0)
    return filled.withColumn("ps", glm.logistic(fit.design.score_expression(fit.beta))), fit


SEPARATION_AUC = 0.95


def propensity_quality(scored: DataFrame, treatment: str) -> DataFrame:
    out = glm.auc(scored.select(ref(treatment).cast("double").alias("y"), F.col("ps").alias("p")))
    return out.withColumn("separated", F.col("auc") > SEPARATION_AUC)


def propensity_coefficients(df: DataFrame, fit) -> DataFrame:
    """Standardised coefficients with odds ratios, largest first."""
    rows = [
        {"term": n, "coefficient": float(b), "odds_ratio": math.exp(b)} for n, b in zip(fit.design.names[1:], fit.beta_z[1:], strict=True)
    ]
    return table_of(df.sparkSession, rows).orderBy(F.desc(F.abs("coefficient")))


def support_limits(scored: DataFrame, treatment: str) -> DataFrame:
    t = ref(treatment) == 1
    ps = F.col("ps")
    return scored.agg(
        F.greatest(F.min(F.when(t, ps)), F.min(F.when(~t, ps))).alias("support_low"),
        F.least(F.max(F.when(t, ps)), F.max(F.when(~t, ps))).alias("support_high"),
    )


def trim_support(scored: DataFrame, treatment: str) -> DataFrame:
    """Rows inside the common support of both arms (one broadcast row of limits)."""
    lim = F.broadcast(support_limits(scored, treatment))
    inside = F.col("ps").between(F.col("support_low"), F.col("support_high"))
    return scored.join(lim).where(inside).drop("support_low", "support_high")


def support_summary(scored: DataFrame, treatment: str) -> DataFrame:
    lim = F.broadcast(support_limits(scored, treatment))
    out = scored.join(lim).groupBy("support_low", "support_high").agg(
        F.count("*").alias("rows_before"), F.count_if(~F.col("ps").between(F.col("support_low"), F.col("support_high"))).alias("excluded")
    )
    return out.withColumn("excluded_percent", F.col("excluded") * 100.0 / F.col("rows_before"))


def smart_caliper(scored: DataFrame, multiplier: float = 0.2) -> DataFrame:
    """0.2 standard deviations of the logit score, mapped back to the score scale at the median score."""
    p = F.least(F.greatest(F.col("ps"), F.lit(1e-6)), F.lit(1 - 1e-6))
    clipped = scored.select(p.alias("p"))
    sd = clipped.agg(F.stddev_pop(F.log(F.col("p") / (1 - F.col("p")))).alias("sd_logit"))
    mid = exact_quantiles(clipped, ["p"], [0.5]).select(F.col("value").alias("m"))
    upper = glm.logistic(F.log(F.col("m") / (1 - F.col("m"))) + multiplier * F.col("sd_logit"))
    return sd.join(F.broadcast(mid)).select(F.abs(upper - F.col("m")).alias("caliper"), "sd_logit")


def resolve_caliper(scored: DataFrame, mode: str, value: float | None = None) -> float | None:
    """``auto`` computes it, ``manual`` takes ``value``, ``none`` switches it off."""
    if mode == "none":
        return None
    return float(value) if mode == "manual" else smart_caliper(scored).first()["caliper"]


def _encoded(df: DataFrame, covariates: Sequence[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c in covariates:
        if is_categorical(df, c):
            out |= {f"{c}={v}": (ref(c) == F.lit(v)).cast("double") for v in category_levels(df, c)}
        else:
            out[c] = ref(c).cast("double")
    return out


def standardized_differences(df: DataFrame, treatment: str, columns: dict[str, Column]) -> DataFrame:
    """Absolute mean difference over the root of the mean variance, per encoded covariate; one aggregate."""
    t = ref(treatment) == 1
    rows = []
    for name, c in columns.items():
        a, b = F.when(t, c), F.when(~t, c)
        pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
        smd = F.coalesce(ratio(F.abs(F.avg(a) - F.avg(b)), pooled), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("covariate"), F.avg(a).alias("mean_treated"), F.avg(b).alias("mean_control"), smd.alias("smd")))
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def balance_table(df: DataFrame, matched: DataFrame, treatment: str, covariates: Sequence[str]) -> DataFrame:
    """Standardised differences before and after matching, improvement and balance (below 0.10)."""
    columns = _encoded(df, covariates)
    before = standardized_differences(df, treatment, columns).select("covariate", F.col("smd").alias("smd_before"))
    after = standardized_differences(matched, treatment, columns).select("covariate", F.col("smd").alias("smd_after"))
    return before.join(F.broadcast(after), "covariate").withColumns({
        "improved": F.col("smd_after") < F.col("smd_before"), "balanced": F.col("smd_after") < 0.10,
    })


OUTCOME_FAMILY = {"binary": "binomial", "count": "poisson", "overdispersed": "negative_binomial"}


def _effect(kind: str, names, beta, cov, df_resid, treatment: str) -> dict:
    rows = coefficient_rows(names, beta, cov, df_resid, "normal")
    r = next(r for r in rows if r["term"] == treatment)
    out = {"estimate": r["coefficient"], "std_error": r["std_error"], "p_value": r["p_value"], "ci_low": r["ci_low"], "ci_high": r["ci_high"]}
    exponent = kind != "continuous"
    for k, s in (("ratio", "estimate"), ("ratio_low", "ci_low"), ("ratio_high", "ci_high")):
        out[k] = math.exp(min(out[s], 700.0)) if exponent else None
    return out


def matched_effect(matched: DataFrame, treatment: str, outcome: str, kind: str = "continuous", adjust: Sequence[str] = ()) -> DataFrame:
    """Effect on the treated from the matched rows, errors clustered by ``_pair_id``, with a model check.

    The check is chi2/df (problem above 1.5) for the generalised models and the residual variance for the linear one.
    """
    predictors, carry = [treatment, *adjust], {"_pair_id": F.col("_pair_id")}
    if kind == "continuous":
        fit = linear.cluster_fit(linear.fit_ols(matched, outcome, predictors, carry=carry), "_pair_id")
        check, problem = fit.sigma2, False
    else:
        fit = glm.cluster_fit(glm.fit_glm(matched, outcome, predictors, OUTCOME_FAMILY[kind], carry=carry), "_pair_id")
        check = fit.pearson / fit.df_resid
        problem = check > 1.5
    out = {"estimand": "ATT", "method": "matching", "n": fit.n} | _effect(kind, fit.design.names, fit.beta, fit.covariance, fit.df_resid, treatment)
    return table_of(matched.sparkSession, [out | {"check": check, "problem": problem}])


def outcome_rates(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    return df.groupBy(ref(treatment).cast("int").alias("arm")).agg(F.count(ref(outcome)).alias("n"), F.avg(ref(outcome).cast("double")).alias("outcome_mean"))


WEIGHT_CAP = 0.99


def with_weights(scored: DataFrame, treatment: str, estimand: str = "ATE") -> DataFrame:
    """Inverse-probability weights capped at their 99th percentile, as column ``weight``."""
    t, ps = ref(treatment).cast("double"), F.least(F.greatest(F.col("ps"), F.lit(1e-6)), F.lit(1 - 1e-6))
    w = t / ps + (1 - t) / (1 - ps) if estimand == "ATE" else t + (1 - t) * ps / (1 - ps)
    rows = scored.withColumn("_w", w)
    cap = exact_quantiles(rows, ["_w"], [WEIGHT_CAP]).select(F.col("value").alias("_cap"))
    return rows.join(F.broadcast(cap)).withColumn("weight", F.least("_w", "_cap")).drop("_w", "_cap")


def effective_sample_size(weighted: DataFrame, treatment: str) -> DataFrame:
    w = F.col("weight")
    return weighted.groupBy(ref(treatment).cast("int").alias("arm")).agg(
        F.count("*").alias("n"), F.sum(w).alias("weight_sum"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"), F.max(w).alias("max_weight")
    )


def weighted_effect(
    scored: DataFrame, treatment: str, outcome: str, kind: str = "continuous", estimand: str = "ATE", adjust: Sequence[str] = ()
) -> DataFrame:
    """Weighted outcome model with HC1 errors: mean difference, or odds / rate ratio by outcome type."""
    rows = with_weights(scored, treatment, estimand)
    predictors, w = [treatment, *adjust], F.col("_pw")
    if kind == "continuous":
        fit = linear.hc_fit(linear.fit_ols(rows, outcome, predictors, weight=F.col("weight")), "HC1", w)
    else:
        family = "binomial" if kind == "binary" else "poisson"
        fit = glm.hc1_fit(glm.fit_glm(rows, outcome, predictors, family, weight=F.col("weight")), w)
    out = {"estimand": estimand, "method": "weighting", "n": fit.n} | _effect(kind, fit.design.names, fit.beta, fit.covariance, fit.df_resid, treatment)
    return table_of(scored.sparkSession, [out])


def compare_effects(att: DataFrame, ate: DataFrame) -> DataFrame:
    keep = ["estimand", "method", "n", "estimate", "std_error", "p_value", "ci_low", "ci_high"]
    return union_tables([att.select(*keep), ate.select(*keep)])


def subgroup_effects(matched: DataFrame, treatment: str, outcome: str, subgroup: str, max_levels: int = 10) -> DataFrame:
    """Mean difference per subgroup (at most ``max_levels`` levels, 3 per arm), pooled-variance errors, linear for every outcome type."""
    levels = matched.where(ref(subgroup).isNotNull()).select(ref(subgroup)).distinct().limit(max_levels + 1).count()
    if levels > max_levels:
        raise ValueError(f"at most {max_levels} subgroup levels")
    t, y = ref(treatment) == 1, ref(outcome).cast("double")
    a, b = F.when(t, y), F.when(~t, y)
    rows = matched.where(ref(subgroup).isNotNull()).groupBy(ref(subgroup).cast("string").alias("level")).agg(
        F.count(a).alias("n_treated"), F.count(b).alias("n_control"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.coalesce(F.var_samp(a), F.lit(0.0)).alias("va"), F.coalesce(F.var_samp(b), F.lit(0.0)).alias("vb"),
    ).where("n_treated >= 3 AND n_control >= 3").collect()
    out = []
    for r in sorted(rows, key=lambda r: r["level"]):
        dof = r["n_treated"] + r["n_control"] - 2
        s2 = ((r["n_treated"] - 1) * r["va"] + (r["n_control"] - 1) * r["vb"]) / dof
        se = math.sqrt(s2 * (1 / r["n_treated"] + 1 / r["n_control"]))
        diff = r["ma"] - r["mb"]
        half = special.t_ppf(0.975, dof) * se
        out.append({"level": r["level"], "n_treated": r["n_treated"], "n_control": r["n_control"], "effect": diff, "std_error": se,
                    "p_value": special.t_two_sided(diff / se, dof) if se else 0.0, "ci_low": diff - half, "ci_high": diff + half})
    return table_of(matched.sparkSession, out)


def placebo_outcome(matched: DataFrame, treatment: str, placebo: str) -> DataFrame:
    """Effect on an outcome the treatment cannot have moved; it should not be significant."""
    fit = linear.fit_ols(matched, placebo, [treatment])
    r = next(r for r in coefficient_rows(fit.design.names, fit.beta, fit.covariance, fit.df_resid, "t") if r["term"] == treatment)
    return table_of(matched.sparkSession, [{"placebo": placebo, "estimate": r["coefficient"], "p_value": r["p_value"], "passed": r["p_value"] >= 0.05}])


# Hidden-bias factors reported by the sensitivity analysis.
GAMMAS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)


def _binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k); terms beyond 40 standard deviations vanish in double precision."""
    if k <= 0:
        return 1.0
    sd = math.sqrt(n * p * (1 - p))
    low, high = max(k, int(n * p - 40 * sd)), min(n, int(n * p + 40 * sd) + 1)
    if low > high:
        return 0.0
    base = math.lgamma(n + 1)
    terms = (
        math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(low, high + 1)
    )
    return min(1.0, math.fsum(terms))


def rosenbaum_bounds(pairs: DataFrame, treated: str, control: str, kind: str = "continuous", gammas: Sequence[float] = GAMMAS) -> DataFrame:
    """Bounds on the p-value when hidden bias changes the odds of treatment by at most gamma.

    ``pairs`` holds the two outcomes of each matched pair. Signed ranks for numbers, signs for binary outcomes. The
    critical gamma is the smallest one whose upper bound exceeds 0.05.
    """
    d = pairs.select((ref(treated).cast("double") - ref(control).cast("double")).alias("d")).where("d IS NOT NULL AND d <> 0")
    if kind == "continuous":
        counts = d.groupBy(F.abs("d").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
        r = average_ranks(counts, "v", "c").agg(
            F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(F.col("c") * F.col("rank")).alias("s1"),
            F.sum(F.col("c") * F.col("rank") * F.col("rank")).alias("s2"),
        ).first()
    else:
        r = d.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up")).first()
    if (r["n"] or 0) < 5:
        raise ValueError("at least 5 pairs with a difference are needed")
    out = []
    for g in gammas:
        high, low = g / (1 + g), 1 / (1 + g)
        if kind == "continuous":
            sd = math.sqrt(high * low * r["s2"])
            ps = [special.normal_sf((r["w"] - p * r["s1"]) / sd) for p in (high, low)]
        else:
            ps = [_binomial_sf(r["up"], r["n"], p) for p in (high, low)]
        out.append({"gamma": float(g), "p_low": min(ps), "p_high": max(ps)})
    critical = next((o["gamma"] for o in out if o["p_high"] > 0.05), None)
    return table_of(pairs.sparkSession, [{**o, "critical_gamma": critical} for o in out])


def pair_outcomes(df: DataFrame, unit_id: str, outcome: str, pairs: DataFrame) -> DataFrame:
    """(treated_outcome, control_outcome) of every matched pair."""
    y = df.select(ref(unit_id).cast("long").alias("_id"), ref(outcome).alias("_y"))
    a = pairs.join(y, F.col("treated_id") == F.col("_id")).select("treated_id", "control_id", F.col("_y").alias("treated_outcome"))
    return a.join(y, F.col("control_id") == F.col("_id")).select("treated_id", "control_id", "treated_outcome", F.col("_y").alias("control_outcome"))
