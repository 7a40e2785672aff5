"""Machine-learning queries on orders, documents with labels, and embeddings."""

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from colonnade.catalog.base import query, table
from colonnade.catalog.profiling import rounded
from colonnade.operators import learning as ml
from colonnade.session import keep, spread


def task_rows(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id", "IF(l_returnflag = 'R', 1.0D, 0.0D) AS label",
                                                 "IF(l_orderkey % 9 = 0, NULL, l_quantity) AS l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
    return ml.stratified_split(df, "row_id", "label")


def prepared(spark, sf, **options):
    # Kept while narrow: the preprocessing reads the split, a shuffle of all rows, seven times before the features exist.
    rows = keep(task_rows(spark, sf))
    train = rows.where("split = 'train'")
    model = ml.preprocessing(train, ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"], **options).fit(train)
    out = ml.with_class_weights(model.transform(rows), "label").select("row_id", "label", "weight", "features", "split").persist()
    return out.where("split = 'train'"), out.where("split = 'test'")


@query("infer_task", "SELECT count(DISTINCT l_linenumber) AS distinct_values, 'classification' AS task FROM lineitem")
def _(spark, sf):
    return ml.infer_task(table(spark, sf, "lineitem"), "l_linenumber")


@query("known_targets_audit", """SELECT count(*) AS source_rows, count(CASE WHEN o_orderkey % 17 <> 0 THEN 1 END) AS eligible_rows, count(CASE WHEN o_orderkey % 17 = 0 THEN 1 END) AS excluded_rows,
    round(count(CASE WHEN o_orderkey % 17 = 0 THEN 1 END) * 100.0 / count(*), 6) AS excluded_percent, 'complete cases: y' AS rule FROM orders""")
def _(spark, sf):
    return rounded(ml.known_targets(table(spark, sf, "orders").selectExpr("IF(o_orderkey % 17 = 0, NULL, o_totalprice) AS y"), "y")[1], "excluded_percent")


@query("text_column_detection", "SELECT * FROM (VALUES ('text', true), ('lang', false), ('source', false)) v(\"column\", free_text)")
def _(spark, sf):
    return ml.text_columns(table(spark, sf, "documents")).select("column", "free_text")


@query("stratified_split_counts", """SELECT l_returnflag, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test_rows, count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS train_rows FROM lineitem GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return ml.stratified_split(df, "row_id", "l_returnflag").groupBy("l_returnflag").agg(
        F.count_if(F.col("split") == "test").alias("test_rows"), F.count_if(F.col("split") == "train").alias("train_rows"))


@query("class_balance", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT count(*) AS classes, round(min(n) / sum(n), 8) AS smallest_share, min(n) / sum(n) < 0.2 AS imbalanced,
    CASE WHEN count(*) = 2 AND min(n) / sum(n) < 0.2 THEN 'pr_auc' WHEN count(*) = 2 THEN 'roc_auc' ELSE 'f1' END AS metric FROM c""")
def _(spark, sf):
    return rounded(ml.class_balance(table(spark, sf, "labels"), "toxic"), "smallest_share", digits=8)


@query("text_features_logistic")
def _(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    rows = ml.preprocessing(df, ["n_chars"], ["lang"], ["text"]).fit(df).transform(df)
    rows = ml.with_class_weights(rows, "label").persist()
    return ml.classification_metrics(ml.predictions(ml.classifier("logistic").fit(rows), rows, "doc_id"))


def customer_task(spark, sf):
    """Customers with a two-class label: the table of the models whose full settings take long."""
    df = table(spark, sf, "customer").selectExpr("c_custkey AS row_id", "IF(c_mktsegment = 'BUILDING', 1.0D, 0.0D) AS label", "c_acctbal", "CAST(c_nationkey AS DOUBLE) AS c_nationkey")
    rows = spread(ml.stratified_split(df, "row_id", "label"))
    train = rows.where("split = 'train'")
    model = ml.preprocessing(train, ["c_acctbal", "c_nationkey"], []).fit(train)
    out = ml.with_class_weights(model.transform(rows), "label").select("row_id", "label", "weight", "features", "split").persist()
    return out.where("split = 'train'"), out.where("split = 'test'")


for _name in ("logistic", "decision_tree", "random_forest", "gradient_boosting", "naive_bayes", "mlp", "linear_svm"):

    @query(f"classifier_{_name}")
    def _(spark, sf, name=_name):
        train, test = (customer_task if name in ("random_forest", "gradient_boosting", "mlp") else prepared)(spark, sf)
        size = train.select("features").first()["features"].size
        est = ml.classifier(name, 2, size, rows=train.count())
        return ml.classification_metrics(ml.predictions(est.fit(train), test, "row_id"))


for _name in ("linear", "ridge", "lasso", "elastic_net", "decision_tree", "random_forest", "gradient_boosting"):

    @query(f"regressor_{_name}")
    def _(spark, sf, name=_name):
        df = ml.stratified_split(table(spark, sf, "part").withColumn("label", F.col("p_retailprice")), "p_partkey")
        # The rows are dealt out while narrow; the table kept for training holds what the models read.
        df = spread(df.select("p_size", "p_partkey", "p_brand", "label", "split"))
        rows = ml.preprocessing(df, ["p_size", "p_partkey"], ["p_brand"]).fit(df).transform(df).select("label", "features", "split").persist()
        train = rows.where("split = 'train'")
        scored = ml.regressor(name, scale=ml.label_scale(train)).fit(train).transform(rows)
        return ml.regression_metrics(scored, "label", "prediction", ["split"])


CLOSED_FORM = """WITH c AS (SELECT CAST(p_size AS DOUBLE) AS x, p_partkey / 100.0 AS z, p_retailprice AS y FROM part),
    m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM c),
    s AS (SELECT sum((x - mx) * (x - mx)) + {alpha} AS a, sum((x - mx) * (z - mz)) AS b, sum((z - mz) * (z - mz)) + {alpha} AS d, sum((x - mx) * (y - my)) AS u, sum((z - mz) * (y - my)) AS v FROM c, m),
    k AS (SELECT (d * u - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2 FROM s)
    SELECT round(w1, 5) AS w1, round(w2, 5) AS w2, round(my - w1 * mx - w2 * mz, 3) AS intercept FROM k, m"""


def closed_form(spark, sf, name, alpha):
    df = table(spark, sf, "part").select(array_to_vector(F.array(F.col("p_size").cast("double"), F.col("p_partkey") / 100.0)).alias("features"), F.col("p_retailprice").alias("label"))
    fit = ml.regressor(name, scale=ml.label_scale(df), alpha=alpha).fit(df)
    w = fit.coefficients.toArray()
    return spark.range(1).select(F.round(F.lit(float(w[0])), 5).alias("w1"), F.round(F.lit(float(w[1])), 5).alias("w2"), F.round(F.lit(float(fit.intercept)), 3).alias("intercept"))


@query("regressor_linear_coefficients", CLOSED_FORM.format(alpha=0))
def _(spark, sf):
    return closed_form(spark, sf, "linear", 0.0)


@query("regressor_ridge_coefficients", CLOSED_FORM.format(alpha=1000))
def _(spark, sf):
    return closed_form(spark, sf, "ridge", 1000.0)


@query("knn_classify", """WITH t AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 5 <> 0),
    n AS (SELECT qid, label FROM t, r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_distance(t.v, r.v), vec_id) <= 5), c AS (SELECT qid, label, count(*) AS c FROM n GROUP BY 1, 2)
    SELECT qid, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) = 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return ml.knn_predict(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "label", 5)


@query("knn_regress", """WITH s AS (SELECT o_orderkey AS id, [o_totalprice / 1000, CAST(o_custkey AS DOUBLE)]::DOUBLE[2] AS v, o_totalprice AS y FROM orders), n AS (SELECT q.id AS qid, r.y FROM s q JOIN s r ON q.id % 50 = 0 AND r.id % 50 <> 0
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v::DOUBLE[], r.v::DOUBLE[]), r.id) <= 5) SELECT qid, round(avg(y), 4) AS predicted FROM n GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "array(o_totalprice / 1000, CAST(o_custkey AS DOUBLE)) AS v", "o_totalprice AS y")
    out = ml.knn_predict(df.where("id % 50 <> 0"), df.where("id % 50 = 0"), "id", "v", "y", 5, "regression")
    return rounded(out, "predicted", digits=4)


@query("grid_search")
def _(spark, sf):
    train, _ = prepared(spark, sf)
    n = train.count()
    return ml.grid_search(ml.classifier("logistic", rows=n), ml.tuning_grid("logistic", n), train, "row_id", 3, stratify="label")


@query("grid_search_tree")
def _(spark, sf):
    train, _ = customer_task(spark, sf)
    return ml.grid_search(ml.classifier("decision_tree"), ml.tuning_grid("decision_tree", train.count()), train, "row_id", 3, stratify="label")


@query("grid_search_grouped")
def _(spark, sf):
    df = table(spark, sf, "part").withColumn("label", F.col("p_retailprice"))
    rows = ml.preprocessing(df, ["p_size", "p_partkey"], []).fit(df).transform(df)
    scale = ml.label_scale(rows)
    return ml.grid_search(ml.regressor("ridge", scale=scale), ml.tuning_grid("ridge", scale[0], scale), rows, "p_partkey", 3, "rmse", "regression", group="p_brand")


PRED = "WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS a, CASE WHEN (l_quantity * 7 + l_discount * 100) % 50 / 50.0 >= 0.5 THEN 1 ELSE 0 END AS b FROM lineitem)"


def made_predictions(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("IF(l_returnflag = 'R', 1.0D, 0.0D) AS actual", "CAST((l_quantity * 7 + l_discount * 100) % 50 / 50.0 AS DOUBLE) AS probability").withColumn(
        "predicted", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))


@query("classification_metrics", PRED + """, k AS (SELECT v AS k, sum(CASE WHEN a = v AND b = v THEN 1 ELSE 0 END) * 1.0 AS tp, sum(CASE WHEN a = v THEN 1 ELSE 0 END) AS s, sum(CASE WHEN b = v THEN 1 ELSE 0 END) AS c FROM x, (VALUES (0), (1)) t(v) GROUP BY 1)
    SELECT round(sum(tp) / sum(s), 8) AS accuracy, round(avg(tp / s), 8) AS balanced_accuracy, round(sum(tp / c * s) / sum(s), 8) AS precision, round(sum(tp) / sum(s), 8) AS recall, round(sum(2 * tp / (s + c) * s) / sum(s), 8) AS f1 FROM k""")
def _(spark, sf):
    return rounded(ml.classification_metrics(made_predictions(spark, sf)), "accuracy", "balanced_accuracy", "precision", "recall", "f1", digits=8)


@query("probability_scores", """WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST((l_quantity * 7 + l_discount * 100) % 50 / 50.0 AS DOUBLE) AS p FROM lineitem),
    g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM x GROUP BY 1), c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g)
    SELECT round(sum(neg * (ap - tp + pos / 2)) / max(ap * an), 6) AS roc_inverse, round(sum(pos / ap * tp / (tp + fp)), 6) AS pr_auc, round((SELECT avg((p - y) ** 2) FROM x), 6) AS brier FROM c""")
def _(spark, sf):
    out = ml.probability_scores(made_predictions(spark, sf)).select((1 - F.col("roc_auc")).alias("roc_inverse"), "pr_auc", "brier")
    return rounded(out, "roc_inverse", "pr_auc", "brier")


@query("threshold_table", """WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST((l_quantity * 7 + l_discount * 100) % 50 / 50.0 AS DOUBLE) AS p FROM lineitem), t AS (SELECT range / 20.0 AS t FROM range(1, 20)),
    c AS (SELECT t, sum(y * (p >= t)::INT) AS tp, sum((1 - y) * (p >= t)::INT) AS fp, sum(y * (p < t)::INT) AS fn, sum((1 - y) * (p < t)::INT) AS tn FROM x, t GROUP BY 1)
    SELECT round(t, 4) AS threshold, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def _(spark, sf):
    return rounded(rounded(ml.threshold_table(made_predictions(spark, sf)), "precision", "recall", "specificity", "f1"), "threshold", digits=4)


@query("multiclass_auc")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features")).persist()
    return ml.multiclass_auc(ml.classifier("logistic", 10).fit(rows), rows)


@query("feature_importance")
def _(spark, sf):
    train, _ = prepared(spark, sf)
    return ml.feature_importance(ml.classifier("decision_tree").fit(train), train)


@query("permutation_importance")
def _(spark, sf):
    train, test = prepared(spark, sf)
    model = ml.classifier("decision_tree").fit(train)
    return ml.permutation_importance(model, test, "row_id", MulticlassClassificationEvaluator(metricName="accuracy"))


@query("linear_contributions")
def _(spark, sf):
    train, _ = prepared(spark, sf)
    return ml.linear_contributions(ml.classifier("logistic").fit(train), train)


@query("prediction_table")
def _(spark, sf):
    train, test = prepared(spark, sf)
    tables = {n: ml.predictions(ml.classifier(n).fit(train), test, "row_id") for n in ("logistic", "decision_tree")}
    return ml.prediction_table(tables, "row_id")


def vectors(spark, sf):
    rows = spread(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    return rows.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features")).persist()


@query("kmeans_clusters")
def _(spark, sf):
    rows = vectors(spark, sf)
    model, _ = ml.kmeans(rows, 10)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("silhouette", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label AS l, count(*) AS n FROM e GROUP BY 1), d AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.v, b.v)) AS s FROM e a, e b GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, max(CASE WHEN own = c THEN s / (n - 1) END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM d JOIN s ON l = c GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""")
def _(spark, sf):
    return rounded(ml.silhouette(vectors(spark, sf), "label"), "silhouette")


@query("silhouette_squared", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label AS l, count(*) AS n FROM e GROUP BY 1), d AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.v, b.v) ** 2) AS s FROM e a, e b GROUP BY ALL),
    m AS (SELECT vec_id, max(CASE WHEN own = c THEN s / (n - 1) END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM d JOIN s ON l = c GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM m""")
def _(spark, sf):
    return rounded(ml.silhouette_squared(vectors(spark, sf).withColumn("k", F.col("label").cast("int")), "k"), "silhouette", digits=5)


@query("elbow")
def _(spark, sf):
    return ml.elbow(vectors(spark, sf))


@query("bisecting_kmeans")
def _(spark, sf):
    return ml.bisecting(vectors(spark, sf), 6).select("vec_id", F.col("prediction").alias("cluster"))


@query("pca_projection")
def _(spark, sf):
    return ml.pca_projection(vectors(spark, sf))[0].select("vec_id", "pc1", "pc2")


@query("pca_variance")
def _(spark, sf):
    return ml.pca_projection(vectors(spark, sf))[1]


@query("cluster_profile", """SELECT l_returnflag AS cluster, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1""")
def _(spark, sf):
    out = ml.cluster_profile(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return rounded(rounded(out, "percent"), "l_quantity", "l_extendedprice", digits=4)


@query("dbscan_labels", """WITH RECURSIVE p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.y = b.y AND abs(a.x - b.x) <= 0.15), k AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 4),
    l AS (SELECT e.a, e.b FROM e SEMI JOIN k ON e.a = k.id SEMI JOIN k k2 ON e.b = k2.id), r AS (SELECT id, id AS low FROM k UNION SELECT l.b, r.low FROM r JOIN l ON r.id = l.a WHERE r.low < l.b),
    c AS (SELECT id, min(low) AS low FROM r GROUP BY 1), n AS (SELECT p.id, k.id IS NOT NULL AS core, c.low FROM p LEFT JOIN k USING (id) LEFT JOIN c USING (id)),
    b AS (SELECT DISTINCT e.a AS id FROM e SEMI JOIN k ON e.b = k.id)
    SELECT n.id AS c_custkey, core, core AND low IS NOT NULL AS in_cluster, NOT core AND b.id IS NULL AS noise, CASE WHEN core THEN low END AS first_of_cluster FROM n LEFT JOIN b USING (id)""")
def _(spark, sf):
    """Noise, core points, and of every core point the first core point of its cluster."""
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 1000 AS x", "CAST(c_nationkey AS DOUBLE) AS y")
    out = ml.dbscan(df, "c_custkey", ["x", "y"], 0.15, 4)
    first = out.where("core").groupBy("cluster").agg(F.min("c_custkey").alias("first"))
    out = out.join(first, "cluster", "left")
    return out.select("c_custkey", "core", (F.col("core") & (F.col("cluster") >= 0)).alias("in_cluster"), (F.col("cluster") < 0).alias("noise"), F.when(F.col("core"), F.col("first")).alias("first_of_cluster"))


@query("dbscan_ten_columns", """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
      ON sqrt(list_sum(list_transform(range(1, 11), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) <= 0.25),
    k AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 4),
    l AS (SELECT e.a, e.b FROM e SEMI JOIN k ON e.a = k.id SEMI JOIN k k2 ON e.b = k2.id), r AS (SELECT id, id AS low FROM k UNION SELECT l.b, r.low FROM r JOIN l ON r.id = l.a WHERE r.low < l.b),
    c AS (SELECT id, min(low) AS low FROM r GROUP BY 1), b AS (SELECT DISTINCT e.a AS id FROM e SEMI JOIN k ON e.b = k.id)
    SELECT vec_id, k.id IS NOT NULL AS core, b.id IS NULL AS noise, c.low AS first_of_cluster FROM embeddings LEFT JOIN k ON vec_id = k.id LEFT JOIN c ON vec_id = c.id LEFT JOIN b ON vec_id = b.id""")
def _(spark, sf):
    """Ten columns: an offset grid would have nine values a column, 9^10 cells around each."""
    names = [f"e{i}" for i in range(10)]
    df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    out = ml.dbscan(df, "vec_id", names, 0.25, 4)
    first = out.where("core").groupBy("cluster").agg(F.min("vec_id").alias("first"))
    out = out.join(first, "cluster", "left")
    return out.select("vec_id", "core", (F.col("cluster") < 0).alias("noise"), F.when(F.col("core"), F.col("first")).alias("first_of_cluster"))


@query("dbscan_core_points", """WITH p AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), n AS (SELECT a.c_custkey, count(*) AS c FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.15 GROUP BY 1)
    SELECT c_custkey FROM n WHERE c >= 4""")
def _(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 1000 AS x", "CAST(c_nationkey AS DOUBLE) AS y")
    return ml.dbscan(df, "c_custkey", ["x", "y"], 0.15, 4).where("core").select("c_custkey")
