"""Mixed-effects and marginal models from per-group sufficient statistics."""

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
from colonnade.functions.gram import Design, build_design, weighted_sums
from colonnade.functions.results import table_of
from colonnade.operators import glm, linear
from colonnade.operators.linear import coefficient_rows
from colonnade.operators.profile import QUARTILES
from colonnade.operators.hypothesis import shapiro_by_group
from colonnade.session import broadcast_if_small, keep


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups and group sizes, with warnings below 5 groups or below 2 rows in a group."""
    sizes = df.where(ref(group).isNotNull()).groupBy(ref(group)).agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size")
    )
    return out.withColumns({"few_groups": F.col("groups") < 5, "tiny_groups": F.col("smallest") < 2})


@dataclass
class MixedFit:
    design: Design
    beta_z: np.ndarray
    covariance: np.ndarray
    sigma2: float
    tau: np.ndarray
    log_likelihood: float
    reml: bool
    random: tuple[str, ...]

    @property
    def beta(self) -> np.ndarray:
        return self.design.back @ self.beta_z

    @property
    def aic(self) -> float:
        k = len(self.random)
        return -2 * self.log_likelihood + 2 * (self.design.p + k * (k + 1) // 2 + 1)


def _profile(xx, xy, yy, logdet, n, p, reml):
    """Profile log-likelihood for given whitened cross products; returns (ll, beta, sigma2, inverse)."""
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    beta = inverse @ xy
    rss = max(yy - beta @ xy, 1e-300)
    m = n - p if reml else n
    s2 = rss / m
    ll = -m / 2 * (math.log(2 * math.pi * s2) + 1) - logdet / 2
    if reml:
        ll -= np.linalg.slogdet(xx)[1] / 2
    return ll, beta, s2, inverse


def _prepare(df: DataFrame, outcome: str, predictors: Sequence[str], group: str, slope: str | None = None):
    carry = {"_y": ref(outcome).cast("double"), "_g": ref(group)}
    if slope:
        carry["_s"] = ref(slope).cast("double")
    design = build_design(df, predictors, carry)
    mean = design.frame.agg(F.avg("_y").alias("m")).first()["m"]
    return design, F.col("_y") - F.lit(mean), mean


def fit_random_intercept(df: DataFrame, outcome: str, predictors: Sequence[str], group: str, reml: bool = True) -> MixedFit:
    """Random-intercept model by profiling the variance ratio.

    Groups enter through their size and column sums only; groups of one size are added up before the search, and each
    search round evaluates a whole grid of ratios in one job.
    """
    design, y, mean = _prepare(df, outcome, predictors, group)
    cols, p, n = design.columns, design.p, design.n
    xx, right, extra = weighted_sums(design.frame, cols, None, {"y": y}, {"yy": y * y})
    xy, yy = right["y"], extra["yy"]
    sums = design.frame.withColumn("_yc", y).groupBy("_g").agg(
        F.count("*").alias("_n"), F.sum("_yc").alias("_sy"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)]
    )
    names = [f"_s{i}" for i in range(p)] + ["_sy"]
    outer = {f"o{i}_{j}": F.sum(F.col(names[i]) * F.col(names[j])).alias(f"o{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)}
    sizes = keep(sums.groupBy("_n").agg(F.count("*").alias("_k"), *outer.values()))

    def evaluate(ratios: Sequence[float]) -> list:
        grid = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("_r")
        rows = sizes.select("*", grid)
        c = F.col("_r") / (1 + F.col("_n") * F.col("_r"))
        found = rows.groupBy("_r").agg(
            F.sum(F.col("_k") * F.log1p(F.col("_n") * F.col("_r"))).alias("logdet"), *[F.sum(c * F.col(o)).alias(o) for o in outer]
        ).collect()
        out = []
        for r in found:
            cut = np.array([[r[f"o{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
            out.append((r["_r"], *_profile(xx - cut[:p, :p], xy - cut[:p, p], yy - cut[p, p], r["logdet"], n, p, reml)))
        return sorted(out, key=lambda t: t[0])

    logs = np.linspace(math.log(1e-7), math.log(1e3), 41)
    best = max(evaluate([0.0, *np.exp(logs)]), key=lambda t: t[1])
    width = logs[1] - logs[0]
    while best[0] > 0 and width > 1e-7:
        logs = np.linspace(math.log(best[0]) - width, math.log(best[0]) + width, 41)
        best = max(evaluate(list(np.exp(logs))), key=lambda t: t[1])
        width = logs[1] - logs[0]
    lam, ll, beta, s2, inverse = best
    sizes.unpersist()
    beta = beta.copy()
    beta[0] += mean
    cov = design.back @ inverse @ design.back.T * s2
    return MixedFit(design, beta, cov, s2, np.array([[lam * s2]]), ll, reml, ("Intercept",))


def fit_random_slope(df: DataFrame, outcome: str, predictors: Sequence[str], group: str, slope: str, reml: bool = True, rounds: int = 40) -> MixedFit:
    """Random intercept and slope with a free covariance, by Newton steps on the profiled likelihood.

    Each group is reduced to its 2-by-2, 2-by-p and 2-vector cross products once. One job then evaluates all the
    points a step needs (finite differences, or a line search) with numpy over batches of groups.
    """
    start = fit_random_intercept(df, outcome, predictors, group, reml)
    design, y, mean = _prepare(df, outcome, predictors, group, slope)
    cols, p, n = design.columns, design.p, design.n
    st = design.frame.agg(F.avg("_s").alias("m"), F.stddev_pop("_s").alias("s")).first()
    frame = design.frame.withColumns({"_yc": y, "_sz": (F.col("_s") - F.lit(st["m"])) / F.lit(st["s"] or 1.0)})
    xx, right, extra = weighted_sums(frame, cols, None, {"y": F.col("_yc")}, {"yy": F.col("_yc") * F.col("_yc")})
    xy, yy = right["y"], extra["yy"]
    z = {"a": F.lit(1.0), "b": F.col("_sz")}
    parts = [F.sum(F.lit(1.0)).alias("aa"), F.sum(z["b"]).alias("ab"), F.sum(z["b"] * z["b"]).alias("bb")]
    parts += [F.sum(z[k] * F.col(c)).alias(f"{k}{i}") for k in z for i, c in enumerate([*cols, "_yc"])]
    groups = keep(frame.groupBy("_g").agg(*parts))
    names = [f"{k}{i}" for k in z for i in range(p + 1)]

    def evaluate(thetas: Sequence[np.ndarray]) -> list:
        todo = [np.asarray(t, dtype=float) for t in thetas]
        q = p + 1

        def partial(batches):
            total = np.zeros((len(todo), 1 + q * q))
            for pdf in batches:
                w = pdf[names].to_numpy(dtype=float).reshape(len(pdf), 2, q)
                zz = np.empty((len(pdf), 2, 2))
                zz[:, 0, 0], zz[:, 1, 1] = pdf["aa"], pdf["bb"]
                zz[:, 0, 1] = zz[:, 1, 0] = pdf["ab"]
                for i, t in enumerate(todo):
                    low = np.array([[math.exp(t[0]), 0.0], [t[1], math.exp(t[2])]])
                    d = low @ low.T
                    core = np.eye(2) + d @ zz
                    m = np.linalg.solve(core, np.broadcast_to(d, zz.shape))
                    cut = np.einsum("gai,gab,gbj->ij", w, m, w)
                    total[i] += np.r_[np.log(np.linalg.det(core)).sum(), cut.ravel()]
            flat = total.ravel()
            yield pd.DataFrame({"k": np.arange(len(flat), dtype="int32"), "v": flat})

        rows = groups.select("aa", "ab", "bb", *names).mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(len(todo) * (1 + q * q))
        for r in rows:
            flat[r["k"]] = r["v"]
        out = []
        for t, row in zip(todo, flat.reshape(len(todo), -1), strict=True):
            cut = row[1:].reshape(q, q)
            out.append((t, *_profile(xx - cut[:p, :p], xy - cut[:p, p], yy - cut[p, p], row[0], n, p, reml)))
        return out

    lam = max(start.tau[0, 0] / start.sigma2, 1e-6)
    theta = np.array([math.log(lam) / 2, 0.0, math.log(lam) / 2 - 1.5])
    h = 1e-3
    best = evaluate([theta])[0]
    for _ in range(rounds):
        theta = best[0]
        steps = [theta + h * e for e in np.eye(3)] + [theta - h * e for e in np.eye(3)]
        steps += [theta + h * (np.eye(3)[i] + np.eye(3)[j]) for i in range(3) for j in range(i)]
        f = [e[1] for e in evaluate(steps)]
        f0 = best[1]
        g = np.array([(f[i] - f[i + 3]) / (2 * h) for i in range(3)])
        hess = np.zeros((3, 3))
        for i in range(3):
            hess[i, i] = (f[i] - 2 * f0 + f[i + 3]) / h**2
        at = 6
        for i in range(3):
            for j in range(i):
                hess[i, j] = hess[j, i] = (f[at] - f[i] - f[j] + f0) / h**2
                at += 1
        values, vectors = np.linalg.eigh(-hess)
        move = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-2))
        move *= min(1.0, 2.0 / max(np.max(np.abs(move)), 1e-12))
        tried = max(evaluate([theta + s * move for s in (1.0, 0.5, 0.25, 0.1, 0.02)]), key=lambda t: t[1])
        if tried[1] <= f0 + 1e-7:
            break
        best = tried
        if best[0].min() < -12:
            break
    theta, ll, beta, s2, inverse = best
    groups.unpersist()
    low = np.array([[math.exp(theta[0]), 0.0], [theta[1], math.exp(theta[2])]])
    # Back from the standardised slope variable to its own scale.
    scale = st["s"] or 1.0
    back = np.array([[1.0, -st["m"] / scale], [0.0, 1 / scale]])
    tau = back @ (low @ low.T * s2) @ back.T
    beta = beta.copy()
    beta[0] += mean
    return MixedFit(design, beta, design.back @ inverse @ design.back.T * s2, s2, tau, ll, reml, ("Intercept", slope))


def mixed_coefficients(df: DataFrame, fit: MixedFit) -> DataFrame:
    return table_of(df.sparkSession, coefficient_rows(fit.design.names, fit.beta, fit.covariance, math.inf, "normal"))


def variance_components(df: DataFrame, fit: MixedFit) -> DataFrame:
    """Between- and within-group variance, the intraclass correlation and, with slopes, slope variance and correlation."""
    t = fit.tau
    slopes = len(fit.random) > 1
    corr = t[0, 1] / math.sqrt(t[0, 0] * t[1, 1]) if slopes and t[0, 0] > 0 and t[1, 1] > 0 else None
    return table_of(df.sparkSession, [{
        "var_intercept": float(t[0, 0]), "var_residual": fit.sigma2, "icc": float(t[0, 0] / (t[0, 0] + fit.sigma2)),
        "var_slope": float(t[1, 1]) if slopes else None, "covariance": float(t[0, 1]) if slopes else None, "correlation": corr,
        "log_likelihood": fit.log_likelihood, "aic": fit.aic,
    }])


def null_model(df: DataFrame, outcome: str, group: str) -> MixedFit:
    return fit_random_intercept(df, outcome, [], group, reml=False)


def compare_models(df: DataFrame, outcome: str, predictors: Sequence[str], group: str, slope: str | None = None) -> DataFrame:
    """Likelihood-ratio steps OLS -> null random intercept -> random intercept -> random slope.

    The null model has no predictors while OLS has them, so the first step is not nested; the random-intercept step
    counts one degree of freedom whatever the number of predictors.
    """
    df = normalise_missing(df).dropna(subset=[outcome, group, *predictors])
    ols = linear.fit_ols(df, outcome, predictors)
    fits = [("ols", ols.log_likelihood, ols.aic, None), ]
    null = null_model(df, outcome, group)
    fits.append(("null random intercept", null.log_likelihood, null.aic, 1))
    ri = fit_random_intercept(df, outcome, predictors, group, reml=False)
    fits.append(("random intercept", ri.log_likelihood, ri.aic, 1))
    if slope:
        rs = fit_random_slope(df, outcome, predictors, group, slope, reml=False)
        fits.append(("random slope", rs.log_likelihood, rs.aic, 2))
    rows, before = [], None
    for name, ll, aic, dof in fits:
        lr = 2 * (ll - before) if before is not None else None
        p = special.chi2_sf(max(lr, 0.0), dof) if lr is not None else None
        rows.append({"model": name, "log_likelihood": ll, "aic": aic, "lr_chi2": lr, "df": dof, "p_value": p})
        before = ll
    return table_of(df.sparkSession, rows)


def random_intercepts(fit: MixedFit) -> DataFrame:
    """Predicted group intercepts with the approximate interval 1.96 * 0.5 * sigma_u, sorted."""
    lam = float(fit.tau[0, 0]) / fit.sigma2
    e = F.col("_y") - fit.design.linear(fit.beta_z)
    sums = fit.design.frame.groupBy(F.col("_g").alias("group")).agg(F.count("*").alias("n"), F.sum(e).alias("_e"))
    u = F.lit(lam) * F.col("_e") / (1 + F.col("n") * F.lit(lam))
    half = 1.96 * 0.5 * math.sqrt(max(float(fit.tau[0, 0]), 0.0))
    return sums.select("group", "n", u.alias("effect"), (u - half).alias("low"), (u + half).alias("high")).orderBy("effect")


def residuals(fit: MixedFit) -> DataFrame:
    """Conditional residuals (group, fitted, residual)."""
    u = random_intercepts(fit).select(F.col("group").alias("_g"), F.col("effect").alias("_u"))
    rows = fit.design.frame.join(broadcast_if_small(u), "_g")
    fitted = fit.design.linear(fit.beta_z) + F.col("_u")
    return rows.select(F.col("_g").alias("group"), fitted.alias("fitted"), (F.col("_y") - fitted).alias("residual"))


def residuals_by_group(fit: MixedFit) -> DataFrame:
    from colonnade.functions.quantiles import quantile_columns

    return quantile_columns(residuals(fit), ["residual"], QUARTILES, ["group"]).drop("column")


def normality(fit: MixedFit) -> DataFrame:
    """Shapiro-Wilk of the predicted group effects, of all residuals, and of the residuals of every group: part, n, statistic, p_value.

    ``part`` is "group effects", "residuals" or "group " with the group's name. One pass of grouped order statistics.
    """
    errors = residuals(fit)
    effects = random_intercepts(fit).select(F.lit("group effects").alias("part"), F.col("effect").alias("value"))
    own = errors.select(F.concat(F.lit("group "), F.col("group").cast("string")).alias("part"), F.col("residual").alias("value"))
    whole = errors.select(F.lit("residuals").alias("part"), F.col("residual").alias("value"))
    tested = shapiro_by_group(effects.unionAll(whole).unionAll(own), "part", "value")
    return tested.select(F.col("group").alias("part"), "n", "statistic", "p_value", "p_value_fitted")


# ---------------------------------------------------------------- generalised estimating equations


@dataclass
class GeeFit:
    family: str
    design: Design
    beta_z: np.ndarray
    covariance: np.ndarray
    alpha: float
    qic: float
    steps: int

    @property
    def beta(self) -> np.ndarray:
        return self.design.back @ self.beta_z

    def fitted(self) -> Column:
        eta = self.design.linear(self.beta_z)
        return glm.logistic(eta) if self.family == "binomial" else F.exp(eta)


def fit_gee(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str, family: str, max_steps: int = 60) -> GeeFit:
    """Exchangeable working correlation with robust errors; ``binomial`` or ``poisson``.

    The inverse of an exchangeable matrix only needs cluster sums, so a step is one grouping by cluster and one sum.
    """
    df = normalise_missing(df)
    if family == "binomial":
        low, high = glm.binary_classes(df, outcome)
        y = F.when(ref(outcome).isNotNull(), (ref(outcome) == F.lit(high)).cast("double"))
    else:
        y = ref(outcome).cast("double")
    design = build_design(df, predictors, {"_y": y, "_g": ref(cluster)})
    cols, p, n = design.columns, design.p, design.n
    beta, alpha = glm.fit_design(design, family).beta_z, 0.0
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def pass_over(beta: np.ndarray, alpha: float) -> dict:
        eta = design.linear(beta)
        mu = glm.logistic(eta) if family == "binomial" else F.exp(eta)
        v = mu * (1 - mu) if family == "binomial" else mu
        rows = design.frame.select("_g", "_y", mu.alias("_mu"), F.sqrt(v).alias("_r"), *cols)
        rows = rows.withColumn("_e", (F.col("_y") - F.col("_mu")) / F.col("_r"))
        r = F.col("_r")
        q = F.col("_y") * F.log("_mu") + ((1 - F.col("_y")) * F.log(1 - F.col("_mu")) if family == "binomial" else -F.col("_mu"))
        sums = rows.groupBy("_g").agg(
            F.count("*").alias("n"), F.sum("_e").alias("e"), F.sum(F.col("_e") * F.col("_e")).alias("ee"), F.sum(q).alias("q"),
            *[F.sum(r * F.col(c)).alias(f"a{i}") for i, c in enumerate(cols)], *[F.sum(r * F.col("_e") * F.col(c)).alias(f"u{i}") for i, c in enumerate(cols)],
            *[F.sum(r * r * F.col(cols[i]) * F.col(cols[j])).alias(f"h{i}_{j}") for i, j in pairs],
        )
        nn = F.col("n").cast("double")
        c = F.lit(alpha) / (1 + (nn - 1) * F.lit(alpha))
        k = 1 / (1 - alpha)
        s = [(k * (F.col(f"u{i}") - c * F.col(f"a{i}") * F.col("e"))) for i in range(p)]
        sums = sums.withColumns({f"s{i}": s[i] for i in range(p)})
        return sums.agg(
            F.sum("ee").alias("ee"), F.sum((F.col("e") * F.col("e") - F.col("ee")) / 2).alias("cross"), F.sum(nn * (nn - 1) / 2).alias("pairs"), F.sum("q").alias("q"),
            *[F.sum(f"s{i}").alias(f"g{i}") for i in range(p)],
            *[F.sum(k * (F.col(f"h{i}_{j}") - c * F.col(f"a{i}") * F.col(f"a{j}"))).alias(f"H{i}_{j}") for i, j in pairs],
            *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"B{i}_{j}") for i, j in pairs],
            *[F.sum(f"h{i}_{j}").alias(f"I{i}_{j}") for i, j in pairs],
        ).first().asDict()

    def matrix(r: dict, name: str) -> np.ndarray:
        return np.array([[r[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])

    steps = 0
    for steps in range(1, max_steps + 1):
        r = pass_over(beta, alpha)
        scale = r["ee"] / (n - p)
        new_alpha = r["cross"] / (scale * (r["pairs"] - p)) if r["pairs"] > p else 0.0
        new_alpha = min(max(new_alpha, -0.99), 0.99)
        step = np.linalg.solve(matrix(r, "H"), np.array([r[f"g{i}"] for i in range(p)]))
        beta = beta + step
        done = np.max(np.abs(step)) < 1e-9 and abs(new_alpha - alpha) < 1e-9
        alpha = new_alpha
        if done:
            break
    r = pass_over(beta, alpha)
    bread = np.linalg.inv(matrix(r, "H"))
    robust = bread @ matrix(r, "B") @ bread
    qic = -2 * r["q"] + 2 * float(np.trace(matrix(r, "I") @ robust))
    return GeeFit(family, design, beta, design.back @ robust @ design.back.T, alpha, qic, steps)


def gee_coefficients(df: DataFrame, fit: GeeFit) -> DataFrame:
    rows = coefficient_rows(fit.design.names, fit.beta, fit.covariance, math.inf, "normal")
    for r in rows:
        r["ratio"], r["ratio_low"], r["ratio_high"] = (math.exp(min(r[k], 700.0)) for k in ("coefficient", "ci_low", "ci_high"))
    return table_of(df.sparkSession, rows)


def vpc_from_alpha(alpha: float) -> float:
    """Variance partition of a binary outcome on the latent scale, with level-one variance pi^2/3."""
    u = alpha * (math.pi**2 / 3) / max(1 - alpha, 1e-9)
    return u / (u + math.pi**2 / 3)


def gee_summary(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str, family: str) -> DataFrame:
    """Correlation, variance partition and QIC of the full model against the null one; AUC for a binary outcome."""
    full, null = fit_gee(df, outcome, predictors, cluster, family), fit_gee(df, outcome, [], cluster, family)
    area = None
    if family == "binomial":
        area = glm.auc(full.design.frame.select(F.col("_y").alias("y"), full.fitted().alias("p"))).first()["auc"]
    return table_of(df.sparkSession, [{
        "alpha": full.alpha, "alpha_null": null.alpha, "vpc": vpc_from_alpha(full.alpha) if family == "binomial" else None,
        "qic": full.qic, "delta_qic": full.qic - null.qic, "auc": area,
    }])


def gee_residuals(fit: GeeFit) -> DataFrame:
    mu = fit.fitted()
    v = mu * (1 - mu) if fit.family == "binomial" else mu
    return fit.design.frame.select(F.col("_g").alias("cluster"), mu.alias("fitted"), ((F.col("_y") - mu) / F.sqrt(v)).alias("pearson"))
