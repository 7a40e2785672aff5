"""Distributed primitives against plain numpy and pandas, and distribution functions against published values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.functions import dominance, special
from colonnade.functions.neighbors import knn_join
from colonnade.functions.ordering import average_ranks, positions, running_totals
from colonnade.functions.quantiles import exact_quantiles


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=40_000), np.full(20_000, 0.25)]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": rng.integers(0, 3, len(x))}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.937, 1.0]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-12)
    pdf = df.toPandas()
    for r in exact_quantiles(df, ["x"], [0.3, 0.9], ["g"]).collect():
        assert r["value"] == pytest.approx(pdf[pdf.g == r["g"]].x.quantile(r["p"]), abs=1e-12)


def test_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 7.0), ("b", None), (None, 3.0)], "g string, x double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["x"], [0.5, 0.95], ["g"]).collect()}
    assert got == {("a", 0.5): 2.5, ("a", 0.95): pytest.approx(3.85), ("b", 0.5): 7.0, ("b", 0.95): 7.0}


def test_running_totals_and_ranks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500), "k": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    got = running_totals(spark.createDataFrame(pdf), ["-k"], {"v": "run"}, ["g"], grand=True).toPandas()
    want = pdf.sort_values("k", ascending=False).assign(run=lambda d: d.groupby("g").v.cumsum())
    merged = got.merge(want, on=["g", "k"])
    assert (merged.run_x == merged.run_y).all()
    assert (got.groupby("g").run_all.first() == pdf.groupby("g").v.sum()).all()
    counts = spark.createDataFrame(pdf).groupBy("v").agg(F.count("*").alias("c"))
    ranks = {r["v"]: r["rank"] for r in average_ranks(counts, "v", "c").collect()}
    expected = pdf.v.rank()
    assert all(ranks[v] == r for v, r in zip(pdf.v, expected, strict=True))
    assert sorted(r["position"] for r in positions(spark.createDataFrame(pdf), ["k"]).collect()) == list(range(1, 501))


def test_neighbour_join_is_exact(spark):
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(80, 3)), rng.normal(size=(600, 3))
    r[:200] = r[0]
    queries = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(q)], "qid long, vec array<double>")
    refs = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(r)], "rid long, vec array<double>")
    got = {(x["qid"], x["rank"]): x["rid"] for x in knn_join(queries, refs, 5, leaf_rows=60).collect()}
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(1))
        for j, best in enumerate(np.lexsort((np.arange(len(r)), d))[:5]):
            assert got[(i, j + 1)] == best


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (special.normal_two_sided(1.959963984540054), 0.05),
        (special.t_two_sided(2.228138852, 10), 0.05),
        (special.chi2_sf(3.841458821, 1), 0.05),
        (special.chi2_sf(18.30703805, 10), 0.05),
        (special.f_sf(3.885293835, 2, 12), 0.05),
        (special.t_ppf(0.975, 5), 2.570581836),
        # Two groups: the range over s is sqrt(2) times |t|.
        (special.studentized_range_sf(3.151064, 2, 10), special.t_two_sided(3.151064 / 2**0.5, 10)),
        (special.studentized_range_sf(3.314493, 3, 1e9), 0.05),
    ],
)
def test_distribution_functions(value, expected):
    assert value == pytest.approx(expected, rel=2e-4)


def test_studentized_range_against_the_printed_table():
    # Upper 5 % points for three groups, printed with two decimals.
    for df, q in ((5, 4.60), (10, 3.88), (20, 3.58), (60, 3.40)):
        assert special.studentized_range_sf(q, 3, df) == pytest.approx(0.05, rel=0.01)


def test_running_totals_keep_rows_without_a_group(spark):
    rows = [("a", 1, 5), (None, 1, 7), (None, 2, 1), ("a", 2, 2)]
    got = running_totals(spark.createDataFrame(rows, "g string, k int, v int"), ["k"], {"v": "run"}, ["g"], grand=True).collect()
    assert {(r["g"], r["k"], r["run"], r["run_all"]) for r in got} == {("a", 1, 5, 7), ("a", 2, 7, 7), (None, 1, 7, 8), (None, 2, 8, 8)}


def test_many_probabilities_and_large_brackets(spark, monkeypatch):
    from colonnade.functions import quantiles

    x = np.random.default_rng(11).normal(size=30_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [i / 100 for i in range(101)]
    want = np.quantile(x, probs)
    for limit in (quantiles.WINDOW_VALUES, 0):  # a window inside the brackets, then distributed running totals
        monkeypatch.setattr(quantiles, "WINDOW_VALUES", limit)
        got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs).collect()}
        assert np.allclose([got[p] for p in probs], want, atol=1e-12)


def test_broadcast_is_bounded_by_bytes(spark):
    from colonnade.session import broadcast_if_small

    small = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    assert "hint" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(small, size=5000)._jdf.queryExecution().logical().toString().lower()


def test_running_totals_beside_columns_of_the_same_names(spark):
    names = ["_at", "_range", "_run0", "_tot0", "_off0", "_by0", "_one", "_upto"]
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k, 1.0, *[f"{n}{k}" for n in names]) for k in range(60)], f"g long, k long, v double, {', '.join(f'{n} string' for n in names)}")
    got = running_totals(df, ["k"], {"v": "upto"}, ["g"], grand=True)
    assert got.columns == [*df.columns, "upto", "upto_all"]
    groups = {}
    for r in sorted(got.collect(), key=lambda r: r["k"]):
        groups[r["g"]] = groups.get(r["g"], 0) + 1
        assert r["upto"] == groups[r["g"]] and r["_at"] == f"_at{r['k']}"
    assert {r["g"]: r["upto_all"] for r in got.collect()} == groups
    assert sorted(r["position"] for r in positions(df, ["k"]).collect()) == list(range(1, 61))


def plain_balance(x, y, c, w):
    return sum(w[i] * c[j] * np.sign(y[j] - y[i]) for i in range(len(x)) for j in range(len(x)) if x[i] < x[j])


@pytest.mark.parametrize("range_points", [1, 3, 40, 1000])
def test_signed_pairs_against_all_pairs(spark, range_points):
    rng = np.random.default_rng(range_points)
    pts = pd.DataFrame({"x": rng.integers(0, 12, 150), "y": np.where(rng.random(150) < 0.4, 5, rng.integers(0, 30, 150))}).drop_duplicates()
    pts["c"], pts["w"] = rng.integers(1, 5, len(pts)), rng.integers(0, 4, len(pts))
    got = dominance.signed_pairs(spark.createDataFrame(pts), range_points).first()["s"]
    args = [pts[k].to_numpy() for k in ("x", "y", "c", "w")]
    assert got == plain_balance(*args) == dominance.balance(*args)


def test_signed_pairs_of_a_million_points_in_small_tasks(spark):
    rows = spark.range(1_000_000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST((id * 48271) % 2147483647 AS DOUBLE) AS y", "1 AS c", "1 AS w")
    got = dominance.signed_pairs(rows, 5_000).first()["s"]
    x = np.arange(1_000_000)
    y = x * 48271 % 2147483647
    assert got == dominance.balance(x, y, np.ones(len(x)), np.ones(len(x)))
    assert dominance.signed_pairs(rows.limit(0)).first()["s"] == 0
