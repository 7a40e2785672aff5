"""Sources, sinks, cleaning, quality and the query registry."""

import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from colonnade.context import DatasetContext, normalise_missing
from colonnade.operators import clean, profile, rows
from colonnade.plans.cleaning import CleaningPlan
from colonnade.plans.quality import html_report, quality_reports
from colonnade.sources import readers, writers
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tiny(spark):
    data = [("a", 1.0, 5.0, "u"), ("a", None, 7.0, "u"), (None, 3.0, 1.0, None), ("b", 4.0, float("nan"), "v"), ("b", 4.0, float("nan"), "v")]
    return spark.createDataFrame(data, "g string, x double, y double, c string").withColumn("k", F.lit(1))


def test_missing_counts_nan_and_null(tiny):
    got = {r["column"]: r["missing_count"] for r in profile.missing_report(tiny).collect()}
    assert got == {"g": 1, "x": 1, "y": 2, "c": 1, "k": 0}
    m = profile.core_metrics(tiny).first()
    assert (m["row_count"], m["missing_cells"], m["duplicate_rows"]) == (5, 5, 1)
    assert DatasetContext.of(tiny).numeric == ("x", "y", "k")


def test_large_table_keeps_every_row(spark, tmp_path):
    df = spark.range(500_000).selectExpr("id AS row_id", "CAST(id % 101 AS DOUBLE) AS value")
    stored = writers.write_store(df, str(tmp_path / "store"))
    m = profile.core_metrics(stored).first()
    assert (m["row_count"], m["missing_cells"], m["duplicate_rows"]) == (500_000, 0, 0)
    assert {r["column"]: r["unique_values"] for r in profile.unique_report(stored).collect()} == {"row_id": 500_000, "value": 101}
    writers.write_store(df.limit(1), str(tmp_path / "store"))
    assert readers.read_parquet(spark, str(tmp_path / "store"), ["value"]).count() == 500_000


def test_row_policy(tiny):
    with pytest.raises(rows.RowsExcluded):
        rows.model_frame(tiny, ["x", "y"])
    frame, audit = rows.model_frame(tiny, ["x", "y"], "exclude")
    assert frame.count() == audit["eligible_rows"] == 2 and audit["warning"]


def test_condition_rules(tiny):
    assert rows.remove_rows(tiny, "x", "!=", 4).count() == 2
    assert rows.remove_rows(tiny, "x", ">", 3).count() == 3
    assert rows.remove_rows(tiny, "g", "contains", "^a").count() == 3
    assert rows.remove_rows(tiny, "y", "is missing").count() == 3


def test_sequential_outlier_removal_depends_on_order(spark):
    pdf = pd.DataFrame({"x": [float(i) for i in range(1, 21)] + [1000.0], "z": [float(i % 3) for i in range(20)] + [50.0]})
    df = spark.createDataFrame(pdf)
    assert clean.remove_outliers_iqr(df, ["x", "z"]).count() == 20
    assert clean.cap_outliers_iqr(df, ["x"]).agg(F.max("x").alias("m")).first()["m"] == pytest.approx(31.0)


def test_group_mode_keeps_rows_without_a_group(tiny):
    got = clean.impute_group_mode(tiny, "g", ["c"]).where("g IS NULL").first()["c"]
    assert got == "u"


def test_date_threshold(spark):
    df = spark.createDataFrame([("2024-01-0%d" % (i % 9 + 1) if i < 75 else "x", "2024-02-01" if i < 65 else "y") for i in range(100)], "a string, b string")
    got = {r["column"]: r["date_like"] for r in profile.date_like_columns(df).collect()}
    assert got == {"a": True, "b": False}


def test_cleaning_plan_runs_every_step(tiny):
    plan = CleaningPlan(drop_duplicates=True, drop_constant=True, max_missing_percent=60, numeric="group_mean", categorical="group_mode", group="g", outliers="cap_zscore")
    out = plan.apply(tiny)
    assert "k" not in out.columns and out.count() == 4
    assert out.where("x IS NULL OR y IS NULL OR c IS NULL").count() == 0


def test_uploads_are_checked(spark, tmp_path):
    for name, content in [("empty.csv", b""), ("model.pkl", b"unsafe"), ("fake.parquet", b"not parquet"), ("good.csv", b"x,g\n1,a\n2,b\n"), ("odd.exe", b"1")]:
        (tmp_path / name).write_bytes(content)
    files = readers.load_files(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): r["reason"] for r in readers.validate_files(files).collect()}
    assert got == {"empty.csv": "empty file", "model.pkl": "refused extension", "fake.parquet": "content does not match extension", "good.csv": None, "odd.exe": "unknown extension"}
    assert readers.read_csv(spark, str(tmp_path / "good.csv")).count() == 2


def test_json_array_and_binary_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2
    pdf = pd.DataFrame({"x": [1, 2], "s": ["p", "q"]})
    (tmp_path / "f").mkdir()
    (tmp_path / "s").mkdir()
    for i in range(2):
        pdf.to_feather(tmp_path / "f" / f"{i}.feather")
        pdf.to_stata(tmp_path / "s" / f"{i}.dta", write_index=False)
    assert readers.read_feather(spark, str(tmp_path / "f"), "x bigint, s string").agg(F.sum("x")).first()[0] == 6
    assert readers.read_stata(spark, str(tmp_path / "s"), "x bigint, s string").count() == 4


def test_html_tables():
    page = "<p>a</p><table><tr><th>h<td>x &amp; y</tr><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>"
    assert readers.html_tables(page)[0][0] == ["h", "x & y"]


def test_reports(tiny):
    assert {"missing", "outliers", "recommendations"} <= set(quality_reports(tiny))
    text = html_report(tiny, "<T>")
    assert "&lt;T&gt;" in text and "recommendations" in text


def test_normalise_leaves_text_alone(spark):
    df = spark.createDataFrame([("NaN", float("nan"))], "s string, x double")
    assert tuple(normalise_missing(df).first()) == ("NaN", None)


def test_no_sampling_and_no_local_checkpoint_in_models():
    base = os.path.join(os.path.dirname(__file__), "..", "colonnade")
    for folder, _, names in os.walk(base):
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "localCheckpoint" not in text
                if "operators" in folder:
                    assert not re.search(r"\.sample\(", text), name


QUICK = ["core_metrics", "profile_numeric", "outliers_iqr", "value_counts", "impute_group_median", "duplicate_preview", "ecdf_quantiles", "histogram_2d",
         "kruskal_wallis", "ols_influence", "logistic_coefficients", "kaplan_meier_by_group", "decompose_additive", "matched_effect", "knn_classify", "html_tables",
         "series_preparation", "series_preparation_unparsable", "correlation_test_kendall", "cox_one_predictor", "imputed_known_cells",
         "impute_iterative_one_column", "ols_absorbed_levels", "dummy_coding", "dbscan_labels", "sarima_unit_roots", "normality_shapiro_by_group"]


@pytest.mark.parametrize("name", entry_module.queries() if os.environ.get("ALL_QUERIES") else QUICK)
def test_queries_agree_with_sql(spark, name):
    df = entry_module.queries()[name](spark, SF)
    got = df.collect()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, result.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_delimiter_looks_at_the_head_only(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1;2\n" * 201 + "a,b,c,d,e,f,g,h\n" * 400)
    assert readers.detect_delimiter(spark, str(tmp_path / "a.txt")) == ","
    (tmp_path / "b.txt").write_text("1;2\n" * 1300 + "a,b,c,d,e,f,g,h\n" * 400)
    assert readers.detect_delimiter(spark, str(tmp_path / "b.txt")) == ";"


def test_json_folder_of_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3, "y": "k"}\n{"x": 4}\n')
    got = {(r["x"], r["y"]) for r in readers.read_json(spark, str(tmp_path)).collect()}
    assert got == {(1, None), (2, None), (3, "k"), (4, None)}


def test_html_pages_show_every_row(spark):
    page = writers.render_html("t", {"rows": spark.range(2500).toDF("n")})
    assert page.count("<tr>") == 2501 and "2499" in page
    assert "first 5 rows shown" in writers.render_html("t", {"rows": spark.range(9).toDF("n")}, rows=5)
