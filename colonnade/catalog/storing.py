"""Imputation, cleaning plans, quality bundles, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from colonnade.catalog.base import DIRTY_LINEITEM, DIRTY_SQL, DUPED_SQL, TAILED_SQL, dirty_lineitem, duped_orders, query, table, tailed_orders
from colonnade.catalog.profiling import rounded, union_sql
from colonnade.operators import impute, linear, reshape
from colonnade.plans.cleaning import CleaningPlan
from colonnade.plans.quality import html_report, quality_overview, quality_reports, recommendation_counts, recommendations
from colonnade.session import shared_folder
from colonnade.sources import readers, writers


def folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint area; on a cluster without one this raises."""
    return f"{shared_folder(spark)}/colonnade-{name}-{uuid.uuid4().hex}"


KNN_ROWS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 1000 END AS a, CAST(c_nationkey AS DOUBLE) AS b, sqrt(c_custkey) AS c FROM customer"


def knn_rows(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 1000 END AS a", "CAST(c_nationkey AS DOUBLE) AS b", "sqrt(c_custkey) AS c")


@query("impute_knn", f"""WITH d AS ({KNN_ROWS}), n AS (SELECT q.id, r.a FROM d q JOIN d r ON q.a IS NULL AND r.a IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sqrt(1.5) * sqrt((q.b - r.b) ** 2 + (q.c - r.c) ** 2), r.id) <= 5), f AS (SELECT id, avg(a) AS g FROM n GROUP BY 1)
    SELECT id, round(coalesce(a, g), 5) AS a FROM d LEFT JOIN f USING (id)""")
def _(spark, sf):
    return rounded(impute.impute_knn(knn_rows(spark, sf), "id", ["a", "b", "c"], 5).select("id", "a"), "a", digits=5)


GAPPED = "SELECT id, CASE WHEN id % 7 <> 0 THEN a END AS a, CASE WHEN id % 5 <> 0 THEN b END AS b, CASE WHEN id % 3 <> 0 THEN c END AS c FROM rows"
SHARED = "((q.a IS NOT NULL AND r.a IS NOT NULL)::INT + (q.b IS NOT NULL AND r.b IS NOT NULL)::INT + (q.c IS NOT NULL AND r.c IS NOT NULL)::INT)"
APART = "(coalesce((q.a - r.a) * (q.a - r.a), 0) + coalesce((q.b - r.b) * (q.b - r.b), 0) + coalesce((q.c - r.c) * (q.c - r.c), 0))"


def donor_sql(x: str) -> str:
    """Mean of the five nearest donors of column ``x``, every pair compared."""
    return f"""SELECT id, avg(v) AS g FROM (SELECT q.id, r.{x} AS v FROM d q JOIN d r ON q.{x} IS NULL AND r.{x} IS NOT NULL AND {SHARED} > 0
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sqrt({APART} * 3.0 / {SHARED}), r.id) <= 5) GROUP BY 1"""


@query("impute_knn_many_gaps", f"""WITH rows AS ({KNN_ROWS}), d AS ({GAPPED}), fa AS ({donor_sql("a")}), fb AS ({donor_sql("b")}), fc AS ({donor_sql("c")}), m AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d)
    SELECT d.id, round(coalesce(d.a, fa.g, m.a), 5) AS a, round(coalesce(d.b, fb.g, m.b), 5) AS b, round(coalesce(d.c, fc.g, m.c), 5) AS c
    FROM d CROSS JOIN m LEFT JOIN fa ON fa.id = d.id LEFT JOIN fb ON fb.id = d.id LEFT JOIN fc ON fc.id = d.id""")
def _(spark, sf):
    """All three columns have gaps, in every combination."""
    gaps = [f"CASE WHEN id % {m} <> 0 THEN {c} END AS {c}" for m, c in ((7, "a"), (5, "b"), (3, "c"))]
    out = impute.impute_knn(knn_rows(spark, sf).selectExpr("id", *gaps), "id", ["a", "b", "c"], 5)
    return rounded(rounded(rounded(out, "a", digits=5), "b", digits=5), "c", digits=5)


@query("impute_iterative")
def _(spark, sf):
    return impute.impute_iterative(dirty_lineitem(spark, sf), ["quantity", "price", "tax", "discount"]).select("quantity", "price", "tax", "discount")


@query("imputed_known_cells", f"""SELECT count(*) AS n, CAST(0 AS BIGINT) AS gaps, count(quantity) AS quantity_known, count(tax) AS tax_known, round(sum(quantity), 3) AS quantity_total,
    round(sum(price), 2) AS price_total, round(sum(tax), 4) AS tax_total FROM ({DIRTY_SQL})""")
def _(spark, sf):
    """Chained equations leave every known cell as it is and no cell empty."""
    source = dirty_lineitem(spark, sf)
    keyed = source.withColumn("was", F.struct("quantity", "price", "tax"))
    out = impute.impute_iterative(keyed, ["quantity", "price", "tax", "discount"])
    same = {c: F.when(F.col(f"was.{c}").isNotNull(), F.col(c)) for c in ("quantity", "price", "tax")}
    return rounded(rounded(rounded(out.agg(
        F.count("*").alias("n"), F.count_if(F.col("quantity").isNull() | F.col("price").isNull() | F.col("tax").isNull()).alias("gaps"),
        F.count(same["quantity"]).alias("quantity_known"), F.count(same["tax"]).alias("tax_known"), F.sum(same["quantity"]).alias("quantity_total"),
        F.sum(same["price"]).alias("price_total"), F.sum(same["tax"]).alias("tax_total"),
    ), "quantity_total", digits=3), "price_total", digits=2), "tax_total", digits=4)


# Two columns, one with gaps: a ridge with evidence maximisation, whose fixed point is reached by iterating in SQL.
RIDGE_STEPS = 60
RIDGE = f"""WITH d AS (SELECT * FROM ({DIRTY_SQL}) WHERE quantity IS NOT NULL AND price IS NOT NULL), m AS (SELECT avg(quantity) AS mx, avg(price) AS my, count(*) AS n FROM d),
    s AS (SELECT sum((quantity - mx) * (quantity - mx)) AS xx, sum((quantity - mx) * (price - my)) AS xy, sum((price - my) * (price - my)) AS yy, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my FROM d, m),
    i0 AS (SELECT *, n / yy AS alpha, 1.0::DOUBLE AS lam, 0.0::DOUBLE AS b FROM s)""" + "".join(f""",
    i{k + 1} AS (SELECT xx, xy, yy, n, mx, my, (n - gamma + 2e-6) / (yy - 2 * c * xy + c * c * xx + 2e-6) AS alpha, (gamma + 2e-6) / (c * c + 2e-6) AS lam, c AS b
        FROM (SELECT *, xy / (xx + lam / alpha) AS c, alpha * xx / (lam + alpha * xx) AS gamma FROM i{k}))""" for k in range(RIDGE_STEPS))


@query("impute_iterative_one_column", RIDGE + f""" SELECT l_orderkey, l_suppkey, quantity, round(coalesce(price, my + b * (quantity - mx)), 3) AS price
    FROM ({DIRTY_SQL}), i{RIDGE_STEPS} WHERE quantity IS NOT NULL""")
def _(spark, sf):
    df = dirty_lineitem(spark, sf).where("quantity IS NOT NULL").select("l_orderkey", "l_suppkey", "quantity", "price")
    return rounded(impute.impute_iterative(df, ["quantity", "price"]), "price", digits=3)


@query("multiple_imputation")
def _(spark, sf):
    return impute.multiple_imputation(tailed_orders(spark, sf), "o_orderkey", ["total", "wave"]).groupBy("_imputation").agg(
        F.count("*").alias("n"), F.avg("total").alias("mean_total"))


@query("cleaning_plan", f"""WITH d AS (SELECT * FROM ({TAILED_SQL})), m AS (SELECT o_orderkey, priority, coalesce(total, (SELECT median(total) FROM d)) AS total, wave, coalesce(status, 'Unknown') AS status FROM d),
    q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b, quantile_cont(wave, 0.25) AS c, quantile_cont(wave, 0.75) AS e FROM m)
    SELECT o_orderkey, priority, status, round(least(greatest(total, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS total, round(least(greatest(wave, c - 1.5 * (e - c)), e + 1.5 * (e - c)), 4) AS wave FROM m, q""")
def _(spark, sf):
    df = tailed_orders(spark, sf).withColumn("fixed", F.lit(1))
    plan = CleaningPlan(drop_duplicates=True, drop_constant=True, max_missing_percent=50, numeric="median", categorical="unknown", outliers="cap_iqr", row_id="o_orderkey")
    return rounded(plan.apply(df), "total", "wave", digits=4)


ADVICE_NUMERIC, ADVICE_TEXT = ("l_orderkey", "l_suppkey", "quantity", "price", "discount", "tax"), ("returnflag", "linestatus", "fixed")
ADVICE_SQL = f"WITH d AS ({DIRTY_SQL}), s AS (" + union_sql(
    """SELECT '{c}' AS c, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, count(TRY_CAST(CAST({c} AS VARCHAR) AS DATE)) AS dates FROM d""", ADVICE_NUMERIC + ADVICE_TEXT
) + "), q AS (" + union_sql("SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d", ADVICE_NUMERIC) + "), o AS (" + union_sql(
    """SELECT '{c}' AS c, count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS far, count({c}) AS k FROM d, q WHERE c = '{c}'""", ADVICE_NUMERIC
) + f"""), f AS (SELECT c, (n - k) * 100.0 / n AS missing, c IN {ADVICE_TEXT} AS text, u <= 1 AS constant, dates > 0.7 * k AS dated, u > 0.9 * n OR regexp_matches(c, 'id|code|number') AS named,
    u > 50 AS many FROM s), r AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS same FROM d), advice AS (
    SELECT 'dataset size' AS area, CASE WHEN n < 100 THEN 'Medium' ELSE 'Low' END AS priority, CASE WHEN n < 100 THEN 'fewer than 100 rows: conclude with care' ELSE 'enough rows to explore' END AS recommendation FROM r
    UNION ALL SELECT 'duplicates', CASE WHEN same > 0 THEN 'Medium' ELSE 'Low' END, CASE WHEN same > 0 THEN same || ' duplicate rows: remove them first' ELSE 'no duplicate rows' END FROM r
    UNION ALL SELECT 'missing values', CASE WHEN missing < 5 THEN 'Low' WHEN missing <= 30 THEN 'Medium' ELSE 'High' END, c || ' ' || CAST(round_even(missing, 2) AS DOUBLE) || ' % missing; ' ||
        CASE WHEN missing < 5 THEN 'low: remove the rows or impute' WHEN missing <= 30 THEN 'moderate: impute before modelling' ELSE 'high: decide whether to keep, impute or drop' END || '; ' ||
        CASE WHEN text THEN 'use the mode or an Unknown category' ELSE 'the median is safer than the mean' END FROM f WHERE missing > 0
    UNION ALL SELECT 'missing values', 'Low', 'no missing values' FROM f HAVING sum(missing) = 0
    UNION ALL SELECT 'constant columns', 'High', 'one value only: ' || string_agg(c, ', ' ORDER BY c) FROM f WHERE constant HAVING count(*) > 0
    UNION ALL SELECT 'id columns', 'Medium', 'identifiers, leave out of models: ' || string_agg(c, ', ' ORDER BY c) FROM f WHERE named HAVING count(*) > 0
    UNION ALL SELECT 'high cardinality', 'Medium', 'many categories, group or encode: ' || string_agg(c, ', ' ORDER BY c) FROM f WHERE text AND many HAVING count(*) > 0
    UNION ALL SELECT 'date columns', 'Low', 'dates held as text: ' || string_agg(c, ', ' ORDER BY c) FROM f WHERE text AND dated HAVING count(*) > 0
    UNION ALL SELECT 'outliers', 'Medium', c || ' ' || CAST(round_even(far * 100.0 / k, 2) AS DOUBLE) || ' % outside the fences: check them' FROM o WHERE far > 0
    UNION ALL SELECT 'outliers', 'Low', 'no outliers' FROM o HAVING sum(far) = 0) """


@query("quality_recommendations", ADVICE_SQL + "SELECT * FROM advice")
def _(spark, sf):
    return recommendations(dirty_lineitem(spark, sf))


@query("recommendation_counts", ADVICE_SQL + """SELECT priority, count(*) AS "count" FROM advice GROUP BY 1""")
def _(spark, sf):
    return recommendation_counts(recommendations(dirty_lineitem(spark, sf)))


@query("quality_overview", f"""WITH d AS ({DUPED_SQL}) SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, 4 AS column_count,
    CAST(0 AS DOUBLE) AS missing_percent, CAST(0 AS DOUBLE) AS max_missing_percent, 'Good' AS status,
    CAST(0 AS BIGINT) + CASE WHEN count(DISTINCT o_totalprice) > 0.9 * count(*) THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT o_custkey) > 0.9 * count(*) THEN 1 ELSE 0 END AS id_columns,
    CAST(0 AS BIGINT) AS constant_columns, CAST(0 AS BIGINT) AS high_cardinality_columns FROM d""")
def _(spark, sf):
    return quality_overview(duped_orders(spark, sf))


@query("parquet_column_read", "SELECT l_orderkey, l_tax FROM lineitem")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_tax"])


@query("parquet_rows_without_columns", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet", []).agg(F.count("*").alias("n"))


@query("csv_round_trip", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    path = folder(spark, "csv")
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return readers.read_csv(spark, path)


for _sep, _label in ((";", "semicolon"), ("\t", "tab"), ("|", "bar")):

    @query(f"delimited_{_label}", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
    def _(spark, sf, sep=_sep):
        path = folder(spark, "txt")
        table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).option("sep", sep).csv(path)
        return readers.read_delimited(spark, path) if sep != "\t" else readers.read_tsv(spark, path)


@query("json_lines", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    path = folder(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return readers.read_json(spark, path)


@query("parquet_store", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    stored = writers.write_store(table(spark, sf, "orders"), folder(spark, "store"))
    return stored.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("report_set", f"""SELECT 'missing' AS report, 9 AS "rows" UNION ALL SELECT 'column_types', 9 UNION ALL SELECT 'unique', 9 UNION ALL SELECT 'flags', 9 UNION ALL SELECT 'summary', 1""")
def _(spark, sf):
    path = folder(spark, "reports")
    reports = quality_reports(dirty_lineitem(spark, sf))
    names = ["missing", "column_types", "unique", "flags", "summary"]
    writers.write_reports({n: reports[n] for n in names}, path)
    return reshape.union_tables([writers.read_report(spark, path, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("report"), "rows") for n in names])


# The pages hold no table, so each gets two at its end, made of its own address and size.
WITH_TABLES = ("concat(html, '<table><tr><th>address</th><th>size</th></tr><tr><td> ', url, '</td><td>', CAST(length(html) AS STRING), "
               "'<br></td></tr></table><p>x</p><TABLE><tr><td>', CAST(page_id AS STRING), '</TABLE>') AS html")


@query("html_tables", """SELECT page_id, 0 AS table_no, 0 AS row_no, ['address', 'size'] AS cells FROM pages UNION ALL SELECT page_id, 0, 1, [replace(url, '&amp;', '&'), CAST(length(html) AS VARCHAR)] FROM pages
    UNION ALL SELECT page_id, 1, 0, [CAST(page_id AS VARCHAR)] FROM pages""")
def _(spark, sf):
    return readers.extract_tables(table(spark, sf, "pages").selectExpr("page_id", WITH_TABLES), "page_id", "html")


@query("html_first_table_rows", "SELECT page_id, count(*) AS n FROM (SELECT page_id FROM pages UNION ALL SELECT page_id FROM pages) GROUP BY 1")
def _(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", WITH_TABLES)
    return readers.extract_tables(pages, "page_id", "html", first_only=True).groupBy("page_id").agg(F.count("*").alias("n"))


# Uploads made of the pages: names with good, refused, unknown and missing extensions, empty, oversized and mislabelled ones.
UPLOAD_NAMES = ["a.csv", "b.pkl", "c.parquet", "d.exe", "plain", "e.html", "f.xlsx", "g..csv", "h.txt"]
UPLOAD_BYTES = 4000
UPLOADS_SQL = f"""SELECT page_id, concat('up/', page_id, '/', {UPLOAD_NAMES}[page_id % 9 + 1]) AS path, page_id % 9 AS k,
    CASE WHEN page_id % 10 = 3 THEN '' WHEN page_id % 9 = 2 AND page_id % 4 < 2 THEN concat('PAR1', html) ELSE html END AS body FROM pages"""


@query("file_validation", f"""WITH u AS ({UPLOADS_SQL}), r AS (SELECT *, octet_length(encode(body)) AS n FROM u)
    SELECT page_id, CAST(n AS BIGINT) AS length, CASE WHEN k = 7 THEN 'unsafe name' WHEN k = 1 THEN 'refused extension' WHEN k IN (3, 4) THEN 'unknown extension' WHEN n = 0 THEN 'empty file'
    WHEN n > {UPLOAD_BYTES} THEN 'file too large' WHEN k = 6 OR k = 2 AND NOT starts_with(body, 'PAR1') THEN 'content does not match extension' END AS reason FROM r""")
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in UPLOAD_NAMES])
    k = F.col("page_id") % 9
    body = F.when(F.col("page_id") % 10 == 3, "").when((k == 2) & (F.col("page_id") % 4 < 2), F.concat(F.lit("PAR1"), "html")).otherwise(F.col("html"))
    path = F.concat(F.lit("up/"), F.col("page_id"), F.lit("/"), F.element_at(names, (k + 1).cast("int")))
    files = table(spark, sf, "pages").select(path.alias("path"), F.encode(body, "UTF-8").alias("content"))
    files = files.select("path", F.octet_length("content").cast("long").alias("length"), "content")
    out = readers.validate_files(files, UPLOAD_BYTES)
    return out.select(F.split("path", "/")[1].cast("long").alias("page_id"), "length", "reason")


@query("content_fingerprints", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.fingerprints(docs).withColumnRenamed("path", "doc_id")


@query("model_artefact_export", "SELECT count(*) AS terms FROM (VALUES ('Intercept'), ('l_quantity'), ('l_discount')) t(x)")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    path = folder(spark, "model")
    writers.write_csv(linear.coefficients(df, linear.fit_ols(df, "l_extendedprice", ["l_quantity", "l_discount"])), path)
    return readers.read_csv(spark, path).agg(F.count("*").alias("terms"))


@query("imputed_copies", f"""WITH d AS ({TAILED_SQL}) SELECT i AS _imputation, count(*) AS n, count(*) FILTER (total IS NOT NULL) AS known, round(sum(total), 2) AS known_total
    FROM d, (SELECT unnest(range(1, 6)) AS i) GROUP BY 1""")
def _(spark, sf):
    """Five imputed copies, written side by side and read back: complete, with every known value as it was."""
    source = tailed_orders(spark, sf)
    path = folder(spark, "imputed")
    writers.write_imputations(impute.multiple_imputation(source, "o_orderkey", ["total", "wave"]), path)
    stored = spark.read.parquet(path).where("total IS NOT NULL AND wave IS NOT NULL")
    both = stored.join(source.select("o_orderkey", F.col("total").alias("was")), "o_orderkey")
    kept = F.col("was").isNotNull() & (F.col("was") == F.col("total"))
    return both.groupBy(F.col("_imputation").cast("long").alias("_imputation")).agg(
        F.count("*").alias("n"), F.count_if(kept).alias("known"), F.round(F.sum(F.when(kept, F.col("total"))), 2).alias("known_total"))


@query("quality_page", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) AS missing_count FROM ({DIRTY_SQL})" for _, c in DIRTY_LINEITEM))
def _(spark, sf):
    """The HTML page of a quality analysis, written, read back and its missing-values table taken out of it again."""
    path = folder(spark, "page")
    page = html_report(dirty_lineitem(spark, sf), "Quality")
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(path)
    back = spark.read.text(path, wholetext=True).select(F.lit(0).alias("page_id"), F.col("value").alias("html"))
    cells = readers.extract_tables(back, "page_id", "html").persist()
    mine = cells.where("row_no = 0 AND cells = array('column', 'missing_count', 'missing_percent')").select("table_no")
    rows = cells.join(mine, "table_no").where("row_no > 0")
    return rows.select(F.col("cells")[0].alias("column"), F.col("cells")[1].alias("missing_count"))
