"""Steps that must not grow faster than their rows: size estimates in loops, rows per task, rows moved."""

import os

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from __spark_entry__ import queries
from colonnade.catalog.learning import prepared
from colonnade.functions import cells
from colonnade.functions.cells import near_cells
from colonnade.functions.neighbors import Cut
from colonnade.llm import mixing
from colonnade.operators import impute, learning
from colonnade.session import shared_folder, spread


def test_components_keep_a_finite_size_estimate(spark):
    """A chain needs many rounds; the estimate of the state must not square with each of them."""
    n = 120
    cells = spark.range(n).select(F.array(F.col("id")).alias("cell"), F.xxhash64("id").alias("id"))
    links = spark.range(n - 1).select(F.array(F.col("id")).alias("a"), F.array(F.col("id") + 1).alias("b"))
    labels = learning.components(cells, links)
    assert int(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**7
    assert labels.select("label").distinct().count() == 1 and labels.count() == n


def written(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_dbscan_writes_no_pairs(spark, monkeypatch):
    """Points of ten columns nearly all of which are near each other: a million pairs of cells."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.06, (700, 10)), rng.normal(2, 0.06, (500, 10)), rng.uniform(-9, 9, (40, 10)), np.full((2, 10), np.inf)])
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(len(x))))
    folder = shared_folder(spark)
    before = written(folder)
    got = learning.dbscan(df, "id", names, 0.6, 5)
    assert written(folder) - before < 20_000_000
    got = got.toPandas().sort_values("id")
    with np.errstate(invalid="ignore"):
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.6
    core = near.sum(1) >= 5
    assert (got["core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() >= 0).tolist() == (near & core[None]).any(1).tolist()
    inside = got["cluster"].to_numpy()
    assert len(set(inside[:700][core[:700]])) == len(set(inside[700:1200][core[700:1200]])) == 1 and inside[:700].max() != inside[700:1200].max()


def test_close_pairs_against_all_pairs():
    rng = np.random.default_rng(6)
    for d, spread_, reach in ((2, 20.0, 0.3), (7, 1.0, 0.9), (1, 0.0, 0.0)):
        p, q = rng.normal(1e3, spread_, (1500, d)), rng.normal(1e3, spread_, (700, d))
        got = [(int(a), int(b)) for i, j in cells.within(p, q, reach) for a, b in zip(i, j)]
        want = np.argwhere(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)) <= reach)
        assert sorted(got) == [tuple(w) for w in want.tolist()] and len(got) == len(set(got)) > 0


def test_cut_parts_rows_that_share_the_largest_value():
    rows = np.minimum(np.arange(1000.0), 300.0)[:, None]
    assert np.bincount(Cut(rows, 2).leaf(rows)).max() <= 701 and len(set(Cut(rows, 2).leaf(rows).tolist())) > 1


def test_silhouette_sends_rows_to_a_settled_number_of_blocks():
    assert [learning.silhouette_blocks(n) for n in (0, 1, 800, 801)] == [1, 1, 1, 2]
    assert learning.silhouette_blocks(10_256) == learning.silhouette_blocks(102_564) == learning.silhouette_blocks(384_000) == 12
    assert learning.silhouette_blocks(640_000) == 20


def test_spread_bounds_rows_of_a_partition(spark):
    small = spark.range(5_000).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == 1
    large = spread(spark.range(1_200_000).coalesce(1))
    sizes = [r["count"] for r in large.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1_200_000 and len(sizes) >= 8 and max(sizes) <= 160_000


def test_regressor_rows_are_dealt_out(spark, tmp_path):
    """One compressed file of parts must not leave all rows to one task."""
    n = 30_000
    part = spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "concat('Brand#', id % 5) AS p_brand", "id % 97 / 3.0D AS p_retailprice")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.catalog.clearCache()
    out = {r["split"]: r for r in queries()["regressor_linear"](spark, str(tmp_path)).collect()}
    assert set(out) == {"train", "test"}
    kept = [r.numPartitions() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo() if r.numPartitions() > 1]
    assert kept and max(kept) >= 3


def test_tokens_are_counted_without_an_array_of_words(spark):
    texts = [None, "", " ", "a", " a  b\t\n c\x0b\x0cd\r", "é ü  x", "😀 😀😀", "x" * 50 + " y" * 500, "a\x00b c$1 \\d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(mixing.tokens().alias("n"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("want"))
    assert all(r["n"] == r["want"] for r in got.collect())
    assert "regexp_extract_all" not in got.select("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in str(mixing.tokens())


def test_mix_by_flatness_moves_a_large_source(spark):
    """A limit of 1.05 epochs moved a tenth of what equal weights would; halfway in entropy moves a good part of it."""
    df = spark.range(4_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'big', concat('s', id % 19)) AS source", "'a b c d' AS text")
    made = mixing.plan(df, flatness=0.5).toPandas()
    own = made["t"] / made["t"].sum()
    moved, flat = (made["weight"] - own).abs().sum() / 2, (own - 1 / len(made)).abs().sum() / 2
    assert 0.3 * flat < moved < 0.8 * flat and 0.05 < made["exponent"].iloc[0] < 0.95
    entropy = -(made["weight"] * np.log(made["weight"])).sum()
    assert abs(entropy - (-(own * np.log(own)).sum() + np.log(len(made))) / 2) < 1e-6
    assert mixing.plan(df.limit(0), flatness=0.5).count() == 0


def test_preprocessing_reads_a_kept_split(spark, tmp_path, monkeypatch):
    """The split ranks all rows: done again for every statistic of the preprocessing, it would be most of the work."""
    made = learning.stratified_split
    seen = []
    monkeypatch.setattr(learning, "stratified_split", lambda *a, **k: seen.append(made(*a, **k)) or seen[-1])
    spark.range(400).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "IF(id % 3 = 0, 'R', 'A') AS l_returnflag", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "id * 1.5D AS l_extendedprice", "id % 11 / 100.0D AS l_discount", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    train, test = prepared(spark, str(tmp_path))
    assert len(seen) == 1 and seen[0].storageLevel.useDisk
    assert (train.count(), test.count()) == (400 - 80, 80)


def test_quality_reports_group_the_cells_once(spark, monkeypatch):
    from colonnade.operators import profile
    from colonnade.plans import quality

    calls = []
    for name in ("dtype_report", "core_metrics", "outliers_iqr"):
        made = getattr(profile, name)
        monkeypatch.setattr(profile, name, lambda *a, made=made, name=name, **k: calls.append(name) or made(*a, **k))
    df = spark.range(300).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "concat('2024-01-0', 1 + id % 9) AS day")
    reports = quality.quality_reports(df)
    assert sorted(calls) == ["core_metrics", "dtype_report", "outliers_iqr"]
    assert {r["column"]: r["unique_values"] for r in reports["unique"].collect()} == {"id": 300, "x": 7, "day": 9}
    assert reports["recommendations"].where("area = 'date columns'").count() == 1


def test_dates_are_tried_once_a_text(spark):
    from colonnade.operators import profile

    pad = " " * 80
    df = spark.createDataFrame([("2024-01-01", f"2024-01-01{pad}", None)] * 8 + [("x", "y" * 90, None), (None, None, None)], "a string, b string, c string")
    out = profile.date_like_columns(df)
    assert {r["column"]: (r["parsed_share"], r["date_like"]) for r in out.collect()} == {"a": (8 / 9, True), "b": (8 / 9, True), "c": (None, False)}
    assert profile.date_like_columns(df.limit(0)).count() == 3
    # Grouped by text, summed by column, turned to one row; a single sum over all rows before.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3


def test_grouped_normality_does_not_join_rows_on_the_group(spark, monkeypatch):
    """A group that holds most rows would meet its size and mean in one task."""
    from colonnade.operators import hypothesis

    seen = []
    made = hypothesis.running_totals
    monkeypatch.setattr(hypothesis, "running_totals", lambda df, *a, **k: seen.append(df) or made(df, *a, **k))
    df = spark.range(400).selectExpr("IF(id % 10 = 0, 'b', 'a') AS g", "CAST(id * id % 97 AS DOUBLE) AS v")
    out = {r["group"]: r for r in hypothesis.shapiro_by_group(df, "g", "v").collect()}
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    for g in "ab":
        alone = hypothesis.shapiro_wilk(df.where(F.col("g") == g), "v").first()
        assert out[g]["n"] == alone["n"] and abs(out[g]["statistic"] - alone["statistic"]) < 1e-9


def test_forests_keep_the_nodes_that_rows_have_reached(spark):
    """Without that, every level walks each row down every tree from its root; the trees themselves are the same."""
    rows = spark.range(600).selectExpr("array(id % 30, id * 7 % 25) AS a", "IF(id * 13 % 11 < 4, 1.0D, 0.0D) AS label", "1.0D AS weight")
    rows = rows.select(array_to_vector(F.col("a").cast("array<double>")).alias("features"), "label", "weight").cache()
    for made in (learning.classifier("random_forest", depth=8), learning.regressor("random_forest", depth=8)):
        assert made.getOrDefault("cacheNodeIds")
        made.setNumTrees(5)
        plain = made.copy({made.cacheNodeIds: False, made.maxMemoryInMB: 256})
        assert made.fit(rows).toDebugString.split("\n")[1:] == plain.fit(rows).toDebugString.split("\n")[1:]


def test_rounds_of_multiple_imputation_carry_rows_with_gaps_only(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "IF(id % 10 = 0, NULL, id % 37 * 1.0D) AS a", "id % 23 * 1.0D AS b")
    sizes, cut = [], impute.materialise
    monkeypatch.setattr(impute, "materialise", lambda d: sizes.append((out := cut(d)).count()) or out)
    out = impute.multiple_imputation(df, "id", ["a", "b"], 3, 2).toPandas()
    assert sizes == [90, 90, 90]
    assert len(out) == 900 and out["a"].notna().all() and (out.groupby("_imputation")["id"].nunique() == 300).all()
    known = out[out["id"] % 10 != 0]
    assert (known["a"] == known["id"] % 37).all()


def test_near_cells_pair_points_not_their_cells(spark):
    """Thirty points in ten columns, one to a cell, all cells next to each other: only close points make a pair."""
    x = np.random.default_rng(5).uniform(0.0, 1.999, (30, 10))
    cells = np.floor(x)
    rows = [(c.astype(int).tolist(), p.tolist(), p.tolist()) for c, p in zip(cells, x)]
    df = spark.createDataFrame(rows, "cell array<bigint>, low array<double>, high array<double>")
    got = {(tuple(r.cell), tuple(r.other)) for r in near_cells(df, 10, 1.5**2).collect()}
    names = [tuple(c.astype(int)) for c in cells]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(names[i], names[j]) for i in range(30) for j in range(30) if i != j and far[i, j] <= 1.5}
    assert len(set(names)) == 30 and got == want and 0 < len(want) < 30 * 29 / 2
    assert near_cells(df.select("cell"), 10, 10.0).count() == 30 * 29


def test_elbow_moves_all_starts_in_one_pass(spark):
    rng = np.random.default_rng(21)
    rows = spark.createDataFrame([(r.tolist(),) for r in rng.uniform(0, 1, (400, 3))], "v array<double>").select(array_to_vector("v").alias("features")).persist()
    rows.count()
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    ks, at = (2, 4, 6), jobs()
    want = []
    for k in ks:
        model, cost = learning.kmeans(rows, k, 4)
        want.append((k, cost, learning.silhouette_squared(model.transform(rows), "prediction").first()["silhouette"]))
    one_by_one, at = jobs() - at, jobs()
    got = learning.elbow(rows, ks, 4).collect()
    assert jobs() - at < 0.8 * one_by_one
    for r, (k, cost, score) in zip(sorted(got, key=lambda r: r["k"]), want, strict=True):
        assert r["k"] == k and np.isclose(r["inertia"], cost, rtol=1e-9) and np.isclose(r["silhouette"], score, rtol=1e-9), (r, k, cost, score)
    exact = learning.elbow(rows, (4,), 2, exact=True).first()["silhouette"]
    assert -1 < exact < 1
