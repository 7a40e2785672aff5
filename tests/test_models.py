"""Models and tests against direct numpy computations on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from colonnade.functions import partial_neighbors, risksets, special
from colonnade.functions.cells import near_cells
from colonnade.functions.gram import build_design, weighted_sums
from colonnade.operators import absorb, causal, glm, hypothesis, impute, learning, linear, matching, mixed, survival, timeseries


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    x, z = rng.normal(5, 2, n), rng.normal(size=n)
    return pd.DataFrame({
        "id": np.arange(n), "x": x, "z": z, "c": rng.choice(["a", "b", "d"], n), "y": 3 + 2 * x - z + rng.normal(size=n),
        "b": (rng.random(n) < 1 / (1 + np.exp(1 - 0.3 * x))).astype(int), "k": rng.poisson(np.exp(0.1 * x)), "g": rng.integers(0, 25, n),
    })


def _x(pdf, cols=("x", "z")):
    return np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in cols]])


def test_ols_matches_numpy(spark, data):
    df = spark.createDataFrame(data)
    fit = linear.fit_ols(df, "y", ["x", "z"])
    a, y = _x(data), data.y.to_numpy()
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ beta
    cov = np.linalg.inv(a.T @ a) * (e @ e) / (len(y) - 3)
    assert fit.beta == pytest.approx(beta, rel=1e-9)
    assert fit.covariance == pytest.approx(cov, rel=1e-7, abs=1e-12)
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    meat = (a * (e / (1 - h))[:, None] ** 2).T @ a
    hc3 = np.linalg.inv(a.T @ a) @ meat @ np.linalg.inv(a.T @ a)
    assert linear.hc_fit(fit).covariance == pytest.approx(hc3, rel=1e-7, abs=1e-12)
    scored = linear.score_rows(df, fit).orderBy("id").toPandas()
    assert scored.predicted.to_numpy() == pytest.approx(a @ beta, rel=1e-9)


def test_hac_matches_numpy(spark, data):
    df = spark.createDataFrame(data)
    fit = linear.hac_fit(linear.fit_ols(df, "y", ["x"], carry={"t": F.col("id")}), "t", 3)
    a, y = _x(data, ("x",)), data.y.to_numpy()
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    u = a * (y - a @ beta)[:, None]
    meat = u.T @ u
    for k in (1, 2, 3):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / 4) * (g + g.T)
    bread = np.linalg.inv(a.T @ a)
    assert fit.covariance == pytest.approx(bread @ meat @ bread, rel=1e-8, abs=1e-12)


@pytest.mark.parametrize(("family", "target"), [("binomial", "b"), ("poisson", "k")])
def test_glm_matches_spark_ml(spark, data, family, target):
    df = spark.createDataFrame(data)
    fit = glm.fit_glm(df, target, ["x", "z"], family)
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(df)
    model = GeneralizedLinearRegression(family=family, featuresCol="f", labelCol=target, tol=1e-12, maxIter=50).fit(rows)
    assert fit.beta == pytest.approx([model.intercept, *model.coefficients], rel=1e-6)
    assert np.sqrt(np.diag(fit.covariance))[1:] == pytest.approx(model.summary.coefficientStandardErrors[:2], rel=1e-5)
    assert fit.aic == pytest.approx(model.summary.aic, rel=1e-8)
    assert fit.deviance == pytest.approx(model.summary.deviance, rel=1e-8)


def test_wide_design_sums_agree(spark, data):
    df = spark.createDataFrame(data)
    design = build_design(df, ["x", "z", "c"], {"_y": F.col("y")})
    from colonnade.functions.gram import _wide_sums

    a = weighted_sums(design.frame, design.columns, F.lit(2.0), {"y": F.col("_y")}, {"n": F.lit(1)})
    b = _wide_sums(design.frame, design.columns, F.lit(2.0), {"y": F.col("_y")}, {"n": F.lit(1)})
    assert a[0] == pytest.approx(b[0]) and a[1]["y"] == pytest.approx(b[1]["y"]) and a[2] == pytest.approx(b[2])


def _cox_brute(t, e, x):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        g, h = np.zeros_like(beta), np.zeros((len(beta),) * 2)
        w = np.exp(x @ beta)
        for s in np.unique(t[e == 1]):
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            for k in range(d):
                f = k / d
                s0 = w[risk].sum() - f * w[dead].sum()
                s1 = w[risk] @ x[risk] - f * (w[dead] @ x[dead])
                s2 = (x[risk] * w[risk][:, None]).T @ x[risk] - f * (x[dead] * w[dead][:, None]).T @ x[dead]
                h += s2 / s0 - np.outer(s1, s1) / s0**2
                g -= s1 / s0
            g += x[dead].sum(0)
        step = np.linalg.solve(h, g)
        beta = beta + step
    return beta, np.linalg.inv(h)


def test_cox_matches_brute_force_with_large_ties(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(np.exp(-0.5 * x[:, 0])) * 3)
    e = (rng.random(n) < 0.8).astype(int)
    pdf = pd.DataFrame({"t": t, "e": e, "p": x[:, 0], "q": x[:, 1]})
    assert pdf[pdf.e == 1].groupby("t").size().max() > survival.TIE_TERMS
    fit = survival.cox(spark.createDataFrame(pdf), ["p", "q"])
    beta, cov = _cox_brute(t, e, x)
    assert fit.beta == pytest.approx(beta, rel=1e-6)
    assert fit.covariance == pytest.approx(cov, rel=1e-5)
    res = survival.martingale_residuals(fit).agg(F.sum("martingale").alias("s")).first()["s"]
    assert abs(res) < 1e-6 * n + 5  # Breslow baseline under Efron estimates: near zero


@pytest.mark.parametrize("parts, strata, times", [(1, 1, 5), (7, 1, 3), (40, 4, 6), (60, 30, 50), (25, 2, 1)])
def test_risk_sums_do_not_depend_on_the_ranges(spark, parts, strata, times):
    rng = np.random.default_rng(parts)
    n = 300
    pdf = pd.DataFrame({"s": rng.integers(0, strata, n), "t": rng.integers(1, times + 1, n).astype(float), "e": rng.integers(0, 2, n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    beta = np.array([0.3, -0.2])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (str(parts), "false", "7"), strict=True):
            spark.conf.set(k, v)
        ll, gradient, info = risksets.RiskRows(spark.createDataFrame(pdf), ["a", "b"], ["s"]).evaluate(beta)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = np.zeros(1), np.zeros(2), np.zeros((2, 2))
    for _, g in pdf.groupby("s"):
        x, w = g[["a", "b"]].to_numpy(), np.exp(g[["a", "b"]].to_numpy() @ beta)
        for t in g.t[g.e == 1].unique():
            risk, dead = (g.t >= t).to_numpy(), ((g.t == t) & (g.e == 1)).to_numpy()
            want[0][0] += np.log(w[dead]).sum()
            want[1][:] += x[dead].sum(0)
            for k in range(dead.sum()):
                v = w * (risk - k / dead.sum() * dead)
                m = v @ x / v.sum()
                want[0][0] -= np.log(v.sum())
                want[1][:] -= m
                want[2][:] += (x.T * v) @ x / v.sum() - np.outer(m, m)
    assert ll == pytest.approx(want[0][0]) and gradient == pytest.approx(want[1]) and info == pytest.approx(want[2])


def test_kaplan_meier_without_censoring_is_the_ecdf(spark):
    t = [1.0, 2.0, 2.0, 5.0, 7.0]
    curve = survival.kaplan_meier(spark.createDataFrame([(v, 1) for v in t], "t double, e int")).orderBy("t").toPandas()
    assert curve.survival.tolist() == pytest.approx([0.8, 0.4, 0.2, 0.0])


@pytest.mark.parametrize("family", survival.AFT_FAMILIES)
def test_aft_gradient_is_zero_and_hessian_matches(spark, family):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.normal(size=200)})
    pdf["t"] = np.exp(1 + 0.5 * pdf.x + 0.7 * rng.normal(size=200))
    pdf["e"] = (rng.random(200) < 0.7).astype(int)
    fit = survival.fit_aft(spark.createDataFrame(pdf), ["x"], family)

    def ll(theta):
        w = (np.log(pdf.t) - theta[0] - theta[1] * pdf.x) / math.exp(theta[2])
        base, _, _ = survival._aft_derivatives(family, w.to_numpy(), pdf.e.to_numpy())
        return (base - pdf.e * (theta[2] + np.log(pdf.t))).sum()

    assert ll(fit.theta) == pytest.approx(fit.log_likelihood, rel=1e-9)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert abs((ll(fit.theta + step) - ll(fit.theta - step)) / 2e-5) < 1e-3


def test_random_effects_match_dense_likelihood(spark, data):
    df = spark.createDataFrame(data.assign(y=data.y + np.random.default_rng(9).normal(size=25)[data.g]))
    pdf = df.toPandas()
    a, y = _x(pdf, ("x",)), pdf.y.to_numpy()

    def dense(tau, s2, reml, zcols):
        z, groups = np.column_stack(zcols), pdf.g.to_numpy()
        blocks = []
        for g in np.unique(groups):
            m = groups == g
            v = np.eye(m.sum()) * s2 + z[m] @ tau @ z[m].T
            blocks.append((a[m], y[m], np.linalg.inv(v), np.linalg.slogdet(v)[1]))
        xx = sum(p.T @ vi @ p for p, _, vi, _ in blocks)
        b = np.linalg.solve(xx, sum(p.T @ vi @ q for p, q, vi, _ in blocks))
        m = len(y) - 2 if reml else len(y)
        out = -m / 2 * math.log(2 * math.pi) - sum(ld / 2 + (q - p @ b) @ vi @ (q - p @ b) / 2 for p, q, vi, ld in blocks)
        return out - (np.linalg.slogdet(xx)[1] / 2 if reml else 0.0)

    ri = mixed.fit_random_intercept(df, "y", ["x"], "g", reml=False)
    best = dense(ri.tau, ri.sigma2, False, [np.ones(len(y))])
    assert ri.log_likelihood == pytest.approx(best, abs=1e-5)
    for f in (0.95, 1.05):
        assert dense(ri.tau * f, ri.sigma2, False, [np.ones(len(y))]) <= best + 1e-9
    rs = mixed.fit_random_slope(df, "y", ["x"], "g", "x", reml=False)
    assert rs.log_likelihood == pytest.approx(dense(rs.tau, rs.sigma2, False, [np.ones(len(y)), pdf.x]), abs=1e-4)
    assert rs.log_likelihood >= ri.log_likelihood - 1e-6


def test_gee_solves_its_estimating_equations(spark, data):
    fit = mixed.fit_gee(spark.createDataFrame(data), "b", ["x"], "g", "binomial")
    a = _x(data, ("x",))
    mu = 1 / (1 + np.exp(-a @ fit.beta))
    score = np.zeros(2)
    for g in range(25):
        m = data.g == g
        v = np.sqrt(mu[m] * (1 - mu[m]))
        r = np.full((m.sum(), m.sum()), fit.alpha)
        np.fill_diagonal(r, 1.0)
        score += (a[m] * v[:, None]).T @ np.linalg.inv(r) @ ((data.b[m] - mu[m]) / v)
    assert np.abs(score).max() < 1e-6


@pytest.mark.parametrize(("k", "caliper", "ranges"), [(1, None, 30), (2, 0.05, 25), (1, 0.02, 1000)])
def test_greedy_matching_equals_sequential(spark, k, caliper, ranges):
    rng = np.random.default_rng(k + ranges)
    ps = np.round(rng.random(150), 2 if ranges == 25 else 6)
    pdf = pd.DataFrame({"id": np.arange(150), "treated": (rng.random(150) < 0.35).astype(int), "ps": ps, "stratum": rng.choice(["a", "b"], 150)})
    units = spark.createDataFrame(pdf).selectExpr("CAST(id AS BIGINT) id", "CAST(treated AS INT) treated", "ps", "stratum")
    got = {(r.treated_id, r.control_id) for r in matching.match_without_replacement(units, k, caliper, ranges).collect()}
    want = set()
    for _, g in pdf.groupby("stratum"):
        free = {r.id: r.ps for r in g[g.treated == 0].itertuples()}
        for r in g[g.treated == 1].sort_values(["ps", "id"], ascending=[False, True]).itertuples():
            near = sorted((abs(p - r.ps), -p, i) for i, p in free.items() if caliper is None or abs(p - r.ps) <= caliper)[:k]
            for _, _, i in near:
                want.add((r.id, i))
                del free[i]
    assert got == want


def test_mahalanobis_without_replacement_equals_sequential(spark):
    rng = np.random.default_rng(8)
    x, t = rng.normal(size=(90, 2)), (np.arange(90) % 3 == 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "t": t, "a": x[:, 0], "b": x[:, 1]}))
    got = {(r.treated_id, r.control_id) for r in matching.match_mahalanobis(df, "id", "t", ["a", "b"], 1.0, False).collect()}
    inv, used, want = np.linalg.inv(np.cov(x, rowvar=False)), set(), set()
    for i in np.flatnonzero(t):
        near = min((float(np.sqrt((x[i] - x[j]) @ inv @ (x[i] - x[j]))), j) for j in range(90) if not t[j] and j not in used)
        if near[0] <= 1.0:
            want.add((i, near[1]))
            used.add(near[1])
    assert got == want


def _sequential_pairs(df, cols, caliper):
    """Treated units in id order, each with the nearest control still free, ties by the smaller id; every pair compared."""
    root = matching.whiten(df, cols)[1]
    rows = sorted((r["id"], r["t"], tuple(r[c] for c in cols)) for r in df.collect())
    at = {i: np.array([sum((root[a, b] * v[b] for b in range(len(v))), 0.0) for a in range(len(v))]) for i, _, v in rows}
    free, out = [i for i, t, _ in rows if not t], []
    for i, t, _ in rows:
        if t and free:
            d, j = min((float(np.sqrt(((at[j] - at[i]) ** 2).sum())), j) for j in free)
            if caliper is None or d <= caliper:
                out.append((i, j))
                free.remove(j)
    return sorted(out)


@pytest.mark.parametrize("caliper", [None, 0.4])
def test_mahalanobis_once_in_many_regions(spark, monkeypatch, caliper):
    rng = np.random.default_rng(61)
    x = np.round(rng.normal(size=(420, 2)) * 3) + 0.0  # a lattice: shared points and equal distances
    x[200:300] = x[7]  # a crowded point
    t = (rng.random(420) < 0.45).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": rng.permutation(420), "t": t, "a": x[:, 0], "b": x[:, 1]}))
    monkeypatch.setattr(matching, "REGION_UNITS", 30)
    monkeypatch.setattr(matching, "FIRST_CANDIDATES", 2)
    got = matching.match_mahalanobis(df, "id", "t", ["a", "b"], caliper, False).collect()
    assert sorted((r.treated_id, r.control_id) for r in got) == _sequential_pairs(df, ["a", "b"], caliper)


def test_mahalanobis_once_jobs_do_not_grow_with_repeats(spark):
    """Units at one point went one place down their common list a round."""
    jobs = []
    for n in (4, 40):
        rows = [(i, int(i % 3 == 0), float(i // (6 * n)), float((i // (6 * n)) ** 2 % 5)) for i in range(6 * n * 6)]
        group = f"mahalanobis-{n}"
        spark.sparkContext.setJobGroup(group, group)
        out = matching.match_mahalanobis(spark.createDataFrame(rows, "id long, t int, a double, b double"), "id", "t", ["a", "b"], 1.0, False)
        assert out.count() == 12 * n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[1] <= jobs[0] + 4


def test_kendall_in_many_ranges(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=150), np.zeros(80)]
    y = np.round(rng.normal(size=230), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(230) for j in range(i))
    for buckets in (1, 4, 9):
        assert hypothesis.kendall(df, "x", "y", buckets).first()["s"] == s


def test_concordance_in_many_ranges(spark):
    rng = np.random.default_rng(7)
    t, e, s = np.ceil(rng.exponential(4, 150)), (rng.random(150) < 0.6).astype(int), np.round(rng.normal(size=150), 1)
    good = pairs = 0.0
    for i in range(150):
        for j in range(150):
            if e[i] and (t[i] < t[j] or (t[i] == t[j] and not e[j] and i != j)):
                pairs += 1
                good += 1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "score": s}))
    for buckets in (1, 5):
        assert survival.concordance(df, buckets).first()["concordance"] == pytest.approx(good / pairs)


def test_shapiro_published_example(spark):
    # Weights of eleven men, Shapiro and Wilk (1965): W = 0.79.
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = hypothesis.shapiro_wilk(spark.createDataFrame([(float(v),) for v in men], "x double"), "x").first()
    assert r["statistic"] == pytest.approx(0.79, abs=0.005) and 0.005 < r["p_value"] < 0.01


def test_shapiro_has_no_upper_size(spark):
    rng = np.random.default_rng(21)
    x = np.round(rng.exponential(size=7000), 2)  # many ties
    r = hypothesis.shapiro_wilk(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    s = np.sort(x) - x.mean()
    n = len(s)
    m = np.array([special.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    near = (m @ s) ** 2 / ((m @ m) * (s @ s))  # W without the refined end weights, which hardly matter at this size
    assert r["n"] == n and not r["p_value_fitted"] and r["statistic"] == pytest.approx(near, rel=5e-3) and r["p_value"] < 1e-6
    assert hypothesis.shapiro_wilk(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double"), "x").first()["statistic"] is None


def test_logistic_score_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0.8).astype(float)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    rows = learning.with_class_weights(rows, "label")
    fit = learning.classifier("logistic", rows=400, c=0.05).fit(rows)
    beta, w = fit.coefficients.toArray(), np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ beta + fit.intercept)))
    assert np.allclose(0.05 * x.T @ (w * (p - y)) + beta, 0, atol=1e-3)


def test_elastic_net_minimises_its_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 3, 0.5]
    y = x @ [2.0, 0.0, -4.0] + 5 + rng.normal(size=200)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])

    def loss(w, b):
        return ((y - x @ w - b) ** 2).mean() / 2 + 0.3 * (0.5 * np.abs(w).sum() + 0.25 * (w @ w))

    fit = learning.regressor("elastic_net", scale=learning.label_scale(rows), alpha=0.3).fit(rows)
    w, b = fit.coefficients.toArray(), fit.intercept
    best = loss(w, b)
    for i in range(3):
        for step in (-0.01, 0.01):
            assert loss(w + step * np.eye(3)[i], b) >= best - 1e-6


def test_adf_matches_numpy(spark):
    rng = np.random.default_rng(12)
    y = np.cumsum(rng.normal(size=60))
    series = timeseries.series_of(spark.createDataFrame(pd.DataFrame({"k": np.arange(60), "y": y})), "k", "y")
    r = timeseries.adf_test(series).first()
    d, best = np.diff(y), None
    top = min(math.ceil(12 * 0.6**0.25), 28)

    def fit(lag, start):
        rows = np.arange(start, len(d))
        a = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, lag + 1)]])
        b, *_ = np.linalg.lstsq(a, d[rows], rcond=None)
        e = d[rows] - a @ b
        s2 = e @ e / (len(rows) - a.shape[1])
        aic = len(rows) * (math.log(2 * math.pi) + math.log(e @ e / len(rows)) + 1) + 2 * a.shape[1]
        return aic, b[1] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1])

    best = min(range(top + 1), key=lambda k: fit(k, top)[0])
    assert r["lags"] == best and r["statistic"] == pytest.approx(fit(best, best)[1], rel=1e-6)


def test_near_cells_against_all_pairs(spark):
    rng = np.random.default_rng(31)
    for d, radius in [(1, 1), (2, 2), (5, 5), (3, 7)]:
        cells = np.unique(rng.integers(-6, 7, (150, d)), axis=0)
        got = near_cells(spark.createDataFrame([(c.tolist(),) for c in cells], "cell array<bigint>"), d, radius).collect()
        gap = (np.maximum(np.abs(cells[:, None] - cells[None]) - 1, 0) ** 2).sum(2) <= radius
        np.fill_diagonal(gap, False)
        want = [(tuple(cells[i]), tuple(cells[j])) for i, j in np.argwhere(gap)]
        assert sorted((tuple(r.cell), tuple(r.other)) for r in got) == sorted(want)


def test_dbscan_in_ten_columns(spark):
    rng = np.random.default_rng(14)
    x = np.r_[rng.normal(0, 0.1, (90, 10)), rng.normal(1, 0.1, (90, 10)), rng.uniform(-1, 2, (40, 10))]
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(220)))
    got = learning.dbscan(df, "id", names, 0.45, 5).toPandas().sort_values("id")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.45
    core = near.sum(1) >= 5
    assert 20 < core.sum() < 200 and (got.core.to_numpy() == core).all()
    assert ((got.cluster.to_numpy() < 0) == ~(near & core[None]).any(1)).all()
    mine = got.cluster.to_numpy()
    reached = near & core[None] & core[:, None]
    while True:
        more = (reached.astype(int) @ reached.astype(int)) > 0
        if (more == reached).all():
            break
        reached = more
    c = np.flatnonzero(core)
    assert ((mine[c][:, None] == mine[c][None]) == reached[np.ix_(c, c)]).all()


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(0, 0.3, (80, 2)), rng.normal(3, 0.3, (80, 2)), rng.uniform(-2, 5, (40, 2))]
    x[:10] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "a": x[:, 0], "b": x[:, 1]}))
    got = learning.dbscan(df, "id", ["a", "b"], 0.3, 5).toPandas().sort_values("id")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    core = near.sum(1) >= 5
    assert (got.core.to_numpy() == core).all()
    label = np.full(200, -1)
    for seed in np.flatnonzero(core):
        if label[seed] < 0:
            todo = [seed]
            while todo:
                i = todo.pop()
                if label[i] < 0:
                    label[i] = seed
                    todo += [j for j in np.flatnonzero(near[i] & core) if label[j] < 0]
    mine = got.cluster.to_numpy()
    for i in np.flatnonzero(core):
        assert set(np.flatnonzero(core & (label == label[i]))) == set(np.flatnonzero(core & (mine == mine[i])))
    assert ((mine == -1) == ~(core | (near & core[None]).any(1))).all()


def test_knn_imputation_with_gaps_in_donors(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 3))
    x[rng.random((60, 3)) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(60))
    got = impute.impute_knn(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 3).toPandas().sort_values("id")
    for i in range(60):
        for c in range(3):
            if np.isnan(x[i, c]):
                near = []
                for j in range(60):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if not np.isnan(x[j, c]) and both.any():
                        near.append((math.sqrt(3 / both.sum() * ((x[i] - x[j])[both] ** 2).sum()), j))
                want = np.mean([x[j, c] for _, j in sorted(near)[:3]]) if near else np.nanmean(x[:, c])
                assert got.iloc[i]["abc"[c]] == pytest.approx(want, rel=1e-9)


def brute_donor_means(x, k):
    """Mean of the k nearest donors of every gap, computed pair by pair."""
    out = x.copy()
    for i, c in zip(*np.nonzero(np.isnan(x)), strict=True):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        d = np.sqrt(np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0.0).sum(1) * x.shape[1] / np.maximum(both.sum(1), 1))
        donors = [j for j in np.argsort(d, kind="stable") if both[j].any() and not np.isnan(x[j, c])]
        out[i, c] = x[donors[:k], c].mean() if donors else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("leaf_rows", [7, 100_000])
def test_donors_of_partly_known_rows_against_brute_force(spark, monkeypatch, leaf_rows):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(700, 5)) * [1, 1, 5, 1, 1]
    x[:, 4] = x[:, 4].round()
    x[rng.random(x.shape) < [0.05, 0.3, 0.2, 0.1, 0.97]] = np.nan  # the last column has few donors
    x[200:400] = x[0]  # a hot row
    x[400] = np.nan
    monkeypatch.setattr(partial_neighbors, "DONORS_PER_TASK", 50)
    monkeypatch.setattr(partial_neighbors, "QUERIES_PER_TASK", 30)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries, found = partial_neighbors.nearest_donors(rows, 5, 4, leaf_rows)
    got = {(r["qid"], r["target"]): r["v"] for r in found.groupBy("qid", "target").agg({"value": "avg"}).withColumnRenamed("avg(value)", "v").collect()}
    number = {tuple(np.nan_to_num(r["vec"], nan=99.0)): r["qid"] for r in queries.collect()}
    want = brute_donor_means(x, 4)
    for i, c in zip(*np.nonzero(np.isnan(x)), strict=True):
        if i != 400:
            assert got[number[tuple(np.nan_to_num(x[i], nan=99.0))], c] == pytest.approx(want[i, c], rel=1e-9)
    assert not any(q == number[(99.0,) * 5] for q, _ in got)  # nothing known, nothing shared


def test_donors_in_the_columns_shared_with_the_query(spark, monkeypatch):
    """The cut took the widest column, so a query that lacks it was dealt to nearly every leaf."""
    rng = np.random.default_rng(33)
    x = np.column_stack([rng.normal(size=900).round(2), rng.integers(0, 6, 900), np.sqrt(np.arange(900)) * 40])
    x[rng.random(x.shape) < [0.3, 0.2, 0.3]] = np.nan
    x[100:160], x[500] = x[0], np.nan
    monkeypatch.setattr(partial_neighbors, "QUERIES_PER_TASK", 30)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    monkeypatch.setattr(partial_neighbors, "PartialCut", None)  # few patterns need no tree over partly known rows
    queries, found = partial_neighbors.nearest_donors(rows, 3, 5, 20)
    got = {(r["qid"], r["target"]): r["v"] for r in found.groupBy("qid", "target").agg({"value": "avg"}).withColumnRenamed("avg(value)", "v").collect()}
    number = {tuple(np.nan_to_num(r["vec"], nan=-99.0)): r["qid"] for r in queries.collect()}
    want = brute_donor_means(x, 5)
    assert {q for q, _ in got} == set(number.values()) - {number[(-99.0,) * 3]}
    for i, c in zip(*np.nonzero(np.isnan(x)), strict=True):
        if not np.isnan(x[i]).all():
            assert got[number[tuple(np.nan_to_num(x[i], nan=-99.0))], c] == pytest.approx(want[i, c], rel=1e-9)


def test_knn_imputation_jobs_do_not_grow_with_patterns(spark):
    rng = np.random.default_rng(32)
    jobs = []
    for share in ([0, 0, 0, 0.3], [0.3, 0.3, 0.3, 0.3]):
        x = rng.normal(size=(200, 4))
        x[rng.random(x.shape) < share] = np.nan
        frame = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(200)))
        group = f"knn-{share[0]}"
        spark.sparkContext.setJobGroup(group, group)
        assert impute.impute_knn(frame, "id", list("abcd"), 3).toPandas().notna().all().all()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[1] <= jobs[0] + 4  # plans adapt to sizes, not to patterns


def test_knn_imputation_of_odd_tables(spark):
    schema = "id long, a double, b double, vec string, g0 string, c double"
    assert impute.impute_knn(spark.createDataFrame([], schema), "id", ["a", "b"]).count() == 0
    rows = [(1, 1.0, 1.0, "x", "y", None), (1, 1.0, 1.0, "x", "y", None), (2, None, 1.0, None, None, None), (None, None, 1.0, "z", None, None), (None, 9.0, 1.0, "z", None, None), (3, None, None, "", "", None)]
    out = impute.impute_knn(spark.createDataFrame(rows, schema), "id", ["a", "b", "c"], 2)
    assert out.columns == ["id", "a", "b", "vec", "g0", "c"]
    got = sorted(((r["id"], r["a"], r["b"], r["c"]) for r in out.collect()), key=str)
    mean = 11 / 3
    assert got == sorted([(1, 1.0, 1.0, None), (1, 1.0, 1.0, None), (2, 1.0, 1.0, None), (None, 1.0, 1.0, None), (None, 9.0, 1.0, None), (3, mean, 1.0, None)], key=str)


def test_iterative_imputation_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(15)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "a": a, "b": 2 * a + 1 + rng.normal(0, 0.01, 300)})
    pdf.loc[::5, "b"] = np.nan
    out = impute.impute_iterative(spark.createDataFrame(pdf), ["a", "b"]).toPandas().sort_values("id")
    assert np.abs(out.b - 2 * out.a - 1).max() < 0.1
    two = impute.multiple_imputation(spark.createDataFrame(pdf), "id", ["a", "b"], 2, 2).toPandas()
    assert two.b.notna().all() and set(two._imputation) == {1, 2}


def gappy(n=400):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + np.array([100, 5, -3, 0])
    x[:, 3] = x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d"])
    for k, col in enumerate("bcd"):
        pdf.loc[rng.random(n) < 0.1 + 0.1 * k, col] = np.nan
    pdf["id"], pdf["_pattern"], pdf["_y0"] = np.arange(n), "text", "more"
    return pdf


def test_pattern_matrices_give_the_rounds_of_single_regressions(spark, monkeypatch):
    pdf = gappy()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, id long, _pattern string, _y0 string")
    one = impute.impute_iterative(df, list("abcd")).toPandas().sort_values("id")
    monkeypatch.setattr(impute, "PATTERN_NUMBERS", 1)
    other = impute.impute_iterative(df, list("abcd")).toPandas().sort_values("id")
    assert list(one.columns) == list(pdf.columns)
    assert np.allclose(one[list("abcd")], other[list("abcd")], rtol=1e-8)
    known = pdf.notna()
    assert (one[list("abcd")].to_numpy()[known[list("abcd")].to_numpy()] == pdf[list("abcd")].to_numpy()[known[list("abcd")].to_numpy()]).all()
    with pytest.raises(ValueError):
        impute.multiple_imputation(df, "id", list("abcd"))


def test_drawn_copies(spark):
    pdf = gappy(2000)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, id long, _pattern string, _y0 string")
    out = impute.multiple_imputation(df, "id", list("abcd"), 3, 5)
    got, again = (o.toPandas().sort_values(["_imputation", "id"]).reset_index(drop=True) for o in (out, impute.multiple_imputation(df, "id", list("abcd"), 3, 5)))
    assert got.equals(again) and len(got) == 6000 and got[list("abcd")].notna().all().all()
    gap = pdf["d"].isna().to_numpy()
    copies = [got[got._imputation == k].reset_index(drop=True) for k in (1, 2, 3)]
    assert (copies[0].d[~gap] == pdf.d[~gap]).all() and (copies[0].d[gap] != copies[1].d[gap]).all()
    both = gap & pdf["b"].notna().to_numpy() & pdf["c"].notna().to_numpy()
    for c in copies:  # the drawn error has the size of the error of the relation
        assert np.std((c.d - c.a + 2 * c.b)[both]) == pytest.approx(0.5, rel=0.2)


def test_absorbed_levels_equal_a_column_for_each(spark):
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({"k": rng.integers(0, 60, n).astype(str), "a": rng.normal(1000, 1, n), "b": rng.normal(size=n)})
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + pdf.k.astype(int) ** 2 + rng.normal(size=n)
    pdf.loc[::50, "b"] = np.nan
    pdf.loc[1, "k"] = None
    full = pdf.dropna()
    d = pd.get_dummies(full.k).to_numpy(float)
    x = np.hstack([full[["a", "b"]].to_numpy(), d])
    beta, rss, *_ = np.linalg.lstsq(x, full.y.to_numpy(), rcond=None)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, a double, b double, y double")
    fit = absorb.fit_absorbed(df, "y", ["a", "b"], "k")
    assert fit.beta == pytest.approx(beta[:2], rel=1e-6) and fit.levels == d.shape[1] and fit.n == len(full)
    s2 = ((full.y.to_numpy() - x @ beta) ** 2).sum() / (len(full) - x.shape[1])
    assert fit.covariance == pytest.approx(s2 * np.linalg.inv(x.T @ x)[:2, :2], rel=1e-4, abs=1e-9)
    effects = {r["level"]: r["effect"] for r in fit.effects().collect()}
    assert [effects[k] for k in sorted(effects)] == pytest.approx(beta[2:], rel=1e-4)
    codes = absorb.sparse_coding(df.withColumn("id", F.monotonically_increasing_id()), "id", ["k"]).collect()
    assert len(codes) == (pdf.k.notna() & (pdf.k != min(pdf.k.dropna()))).sum() and {r["code"] for r in codes} == set(range(1, d.shape[1]))


def test_grouped_shapiro_is_the_single_test_of_each_group(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 2, "b": 3, "c": 5, "d": 9, "e": 12, "f": 300, "flat": 6}
    pdf = pd.DataFrame([(k, 4.0 if k == "flat" else float(np.round(rng.exponential(), 1 if k == "f" else 6))) for k, n in sizes.items() for _ in range(n)], columns=["g", "v"])
    got = {r["group"]: r for r in hypothesis.shapiro_by_group(spark.createDataFrame(pdf), "g", "v").collect()}
    assert got.keys() == sizes.keys() and got["a"]["statistic"] is None and got["flat"]["statistic"] is None
    for k in "bcdef":
        one = hypothesis.shapiro_wilk(spark.createDataFrame(pdf[pdf.g == k]), "v").first()
        assert got[k]["statistic"] == pytest.approx(one["statistic"]) and got[k]["p_value"] == pytest.approx(one["p_value"])
    p = np.r_[np.linspace(1e-12, 1 - 1e-12, 400), 1e-30, 1e-200]
    assert np.allclose(special.normal_ppf_array(p), [special.normal_ppf(v) for v in p], rtol=1e-9, atol=1e-12)


def test_exact_matching_balances_keys(spark):
    pdf = pd.DataFrame({"id": range(40), "t": [i % 4 == 0 for i in range(40)], "k": [i % 3 for i in range(40)]})
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("int")).withColumn("k", F.col("k").cast("string"))
    pairs = matching.match_exact(matching.units_of(df, "id", "t", None, ["k"]))
    rows = matching.matched_rows(df, "id", pairs)
    assert causal.standardized_differences(rows, "t", {"k": F.col("k").cast("double")}).first()["smd"] == pytest.approx(0.0)
