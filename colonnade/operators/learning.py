"""Machine learning on Spark ML: preprocessing, models, tuning, metrics, importance and clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as FE
from pyspark.ml import regression as R
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.context import normalise_missing, numeric_columns, ref
from colonnade.functions.cells import Cells, block_pairs, in_blocks, linked_cells, matrix, meet, within
from colonnade.functions.expressions import ratio
from colonnade.functions.neighbors import knn_join
from colonnade.functions.results import table_of
from colonnade.operators import glm
from colonnade.operators.linear import regression_metrics
from colonnade.operators.rows import case_audit
from colonnade.session import broadcast_if_small, keep, materialise, reread

CLASS_LIMIT = 10


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """``classification`` for text or at most 10 distinct values, else ``regression``; one value or none is ``invalid``."""
    numeric = target in numeric_columns(df)
    k = F.count_distinct(ref(target))
    few = k <= CLASS_LIMIT if numeric else F.lit(True)
    return df.agg(k.alias("distinct_values"), F.when(k <= 1, "invalid").when(few, "classification").otherwise("regression").alias("task"))


def known_targets(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known target, and the audit of the ones left out."""
    return normalise_missing(df).where(ref(target).isNotNull()), case_audit(df, [target])


def text_columns(df: DataFrame) -> DataFrame:
    """Free-text columns: on average 3 words or 25 characters, or more than 70 % distinct values."""
    cols = [c for c, t in df.dtypes if t == "string"]
    rows = []
    for c in cols:
        words, size = F.avg(F.size(F.split(F.trim(ref(c)), r"\s+"))), F.avg(F.length(ref(c)))
        share = ratio(F.count_distinct(F.xxhash64(ref(c), F.lit(1)), F.xxhash64(ref(c), F.lit(2))), F.count(ref(c)))
        rows.append(F.struct(F.lit(c).alias("column"), words.alias("mean_words"), size.alias("mean_length"),
                             ((words >= 3) | (size >= 25) | (share > 0.70)).alias("free_text")))
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def preprocessing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], texts: Sequence[str] = (), scale: bool = True, one_hot: bool = True, text_features: int = 500) -> Pipeline:
    """Median and most-frequent imputation, scaling, one-hot (or ordinal) codes and TF-IDF, assembled to ``features``."""
    stages, parts = [], []
    if numeric:
        filled = [f"{c}__num" for c in numeric]
        # The exact median comes from the quantile operator; it is a literal of the statement below.
        from colonnade.functions.quantiles import quantile_columns

        medians = {r["column"]: r["median"] for r in quantile_columns(df, numeric, {"median": 0.5}).collect()}
        cols = ", ".join(f"coalesce(cast(`{c}` as double), {medians.get(c, 0.0)!r}D) AS `{f}`" for c, f in zip(numeric, filled, strict=True))
        stages.append(FE.SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"))
        stages.append(FE.VectorAssembler(inputCols=filled, outputCol="__num"))
        if scale:
            stages.append(FE.StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True))
        parts.append("__scaled" if scale else "__num")
    if categorical:
        from colonnade.operators.profile import column_modes

        modes = {r["column"]: r["top"] for r in column_modes(df, categorical).collect()}

        def quoted(v: str) -> str:
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

        cols = ", ".join(f"coalesce(cast(`{c}` as string), {quoted(modes.get(c) or 'missing')}) AS `{c}__cat`" for c in categorical)
        stages.append(FE.SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"))
        stages.append(FE.StringIndexer(inputCols=[f"{c}__cat" for c in categorical], outputCols=[f"{c}__ix" for c in categorical],
                                       handleInvalid="keep", stringOrderType="alphabetAsc"))
        if one_hot:
            stages.append(FE.OneHotEncoder(inputCols=[f"{c}__ix" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=False, handleInvalid="keep"))
        parts += [f"{c}__hot" if one_hot else f"{c}__ix" for c in categorical]
    for c in texts:
        stages.append(FE.SQLTransformer(statement=f"SELECT *, coalesce(`{c}`, '') AS `{c}__txt` FROM __THIS__"))
        stages.append(FE.RegexTokenizer(inputCol=f"{c}__txt", outputCol=f"{c}__tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False))
        stages.append(FE.CountVectorizer(inputCol=f"{c}__tok", outputCol=f"{c}__tf", vocabSize=text_features))
        stages.append(FE.IDF(inputCol=f"{c}__tf", outputCol=f"{c}__idf"))
        stages.append(FE.Normalizer(inputCol=f"{c}__idf", outputCol=f"{c}__vec"))
        parts.append(f"{c}__vec")
    stages.append(FE.VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


SPLIT_ROWS = 100_000  # rows of a class that one hash range holds, about


def split_ranges(df: DataFrame) -> int:
    """Hash ranges per class so that even a single class leaves about SPLIT_ROWS rows to each."""
    return max(1, -(-df.count() // SPLIT_ROWS))


def _hash_range(h: Column, ranges: int) -> Column:
    return F.least(F.floor((h / F.lit(2.0**64) + F.lit(0.5)) * ranges), F.lit(ranges - 1)).cast("int")


def stratified_split(df: DataFrame, row_id: str, target: str | None = None, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Train/test column. With a target the test share is exact per class (rounded), ranked by a hash of the row id.

    The ranking runs inside hash ranges whose sizes are added up first, so one large class is spread over tasks.
    """
    h = F.xxhash64(ref(row_id), F.lit(seed))
    if target is None:
        cut = int(test_share * 1_000_000)
        return df.withColumn("split", F.when(F.pmod(h, F.lit(1_000_000)) < cut, "test").otherwise("train"))
    rows = df.withColumns({"_y": ref(target).cast("string"), "_h": h, "_b": _hash_range(h, split_ranges(df))})
    sizes = rows.groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_y").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_y")
    sizes = sizes.select(F.col("_y").alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                         F.bround(F.sum("_n").over(whole) * test_share).alias("_take"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_y", "_b").orderBy("_h", ref(row_id))))
    joined = ranked.join(broadcast_if_small(sizes), F.col("_y").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    split = F.when(F.col("_r") + F.col("_off") <= F.col("_take"), "test").otherwise("train")
    return joined.withColumn("split", split).drop("_y", "_h", "_b", "_k", "_kb", "_off", "_take", "_r")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Smallest class share (imbalanced below 20 %), number of classes and the metric models are compared by."""
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target)).agg(F.count("*").alias("n"))
    out = counts.agg(F.count("*").alias("classes"), (F.min("n") / F.sum("n")).alias("smallest_share"))
    low = F.col("smallest_share") < 0.2
    metric = F.when((F.col("classes") == 2) & low, "pr_auc").when(F.col("classes") == 2, "roc_auc").otherwise("f1")
    return out.select("*", low.alias("imbalanced"), metric.alias("metric"))


def with_class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights n / (classes * class size)."""
    sizes = keep(df.groupBy(ref(target).alias("_k")).agg(F.count("*").alias("_n")))  # one row per class
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_c"))
    weights = sizes.join(F.broadcast(total)).select("_k", (F.col("_all") / (F.col("_c") * F.col("_n"))).alias("weight"))
    return df.join(broadcast_if_small(weights), ref(target) == F.col("_k")).drop("_k")


# The deepest tree Spark grows; the models being matched set no limit of their own.
TREE_DEPTH = 30
# How a forest is grown, not what it is: a row keeps the node it has reached in every tree instead of walking down all trees
# from the root at each level.
GROWN = {"cacheNodeIds": True, "maxMemoryInMB": 512}


def classifier(name: str, classes: int = 2, features: int | None = None, seed: int = 42, rows: int | None = None, depth: int = TREE_DEPTH, c: float = 1.0):
    """An unfitted Spark ML classifier on (features, label, weight), classes balanced by the weight where the model takes one.

    Logistic regression and the linear SVM are penalised by 1 / (c * rows): Spark averages the loss over the weights
    (which sum to the number of rows) where the penalty 1/2 |w|^2 stands against c times its sum. ``rows=None`` leaves
    the penalty out.
    """
    penalty = 1.0 / (c * rows) if rows else 0.0
    made = {
        "logistic": lambda: C.LogisticRegression(weightCol="weight", maxIter=1500, regParam=penalty, standardization=False),
        "decision_tree": lambda: C.DecisionTreeClassifier(seed=seed, maxDepth=depth, weightCol="weight"),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=300, seed=seed, maxDepth=depth, weightCol="weight", **GROWN),
        "gradient_boosting": lambda: C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "naive_bayes": lambda: C.NaiveBayes(modelType="gaussian"),
        "mlp": lambda: C.MultilayerPerceptronClassifier(layers=[features, 100, classes], maxIter=200, seed=seed),
        "linear_svm": lambda: C.LinearSVC(maxIter=100, weightCol="weight", regParam=penalty, standardization=False),
    }[name]()
    if classes > 2 and name in ("gradient_boosting", "linear_svm"):
        return C.OneVsRest(classifier=made, weightCol="weight") if name == "linear_svm" else C.OneVsRest(classifier=made)
    return made


def label_scale(rows: DataFrame, label: str = "label") -> tuple[int, float]:
    """Number of rows and standard deviation of the label, as ``regressor`` takes them."""
    r = rows.agg(F.count(ref(label)).alias("n"), F.stddev_pop(ref(label)).alias("s")).first()
    return r["n"], r["s"] or 1.0


def regressor(name: str, seed: int = 42, scale: tuple[int, float] | None = None, alpha: float = 1.0, l1_ratio: float = 0.5, depth: int = TREE_DEPTH):
    """An unfitted Spark ML regressor on (features, label).

    The penalties are those of the usual definitions: ridge |y - Xw|^2 + alpha |w|^2, lasso and elastic net
    |y - Xw|^2 / 2n + alpha (r |w|_1 + (1 - r) / 2 |w|^2). Spark divides the quadratic part by the deviation of the
    label, so ridge and elastic net need ``scale`` (see ``label_scale``).
    """
    if name in ("ridge", "elastic_net") and scale is None:
        raise ValueError("ridge and elastic net need the rows and deviation of the label")
    n, sd = scale or (1, 1.0)
    linear, square = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd
    return {
        "linear": lambda: R.LinearRegression(regParam=0.0, standardization=False),
        "ridge": lambda: R.LinearRegression(regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False),
        "lasso": lambda: R.LinearRegression(regParam=alpha, elasticNetParam=1.0, maxIter=5000, standardization=False),
        "elastic_net": lambda: R.LinearRegression(regParam=linear + square, elasticNetParam=linear / (linear + square), maxIter=5000, standardization=False),
        "decision_tree": lambda: R.DecisionTreeRegressor(seed=seed, maxDepth=depth),
        "random_forest": lambda: R.RandomForestRegressor(numTrees=300, seed=seed, maxDepth=depth, **GROWN),
        "gradient_boosting": lambda: R.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
    }[name]()


def tuning_grid(name: str, rows: int, scale: tuple[int, float] | None = None, task: str = "classification") -> dict[str, list]:
    """Fixed values tried for a model, in Spark's parameters (those that Spark's models have)."""
    n, sd = scale or (rows, 1.0)
    trees = {"maxDepth": [TREE_DEPTH, 3, 5, 10], "minInstancesPerNode": [1, 5, 10]}
    grids = {
        "logistic": {"regParam": [1.0 / (c * rows) for c in (0.1, 1.0, 10.0)]},
        "linear_svm": {"regParam": [1.0 / (c * rows) for c in (0.5, 1.0, 2.0)]},
        "ridge": {"regParam": [a * sd / n for a in (0.1, 1.0, 10.0)]},
        "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
        "decision_tree": trees | ({"impurity": ["gini", "entropy"]} if task == "classification" else {}),
        "random_forest": {"numTrees": [200, 400], "maxDepth": [TREE_DEPTH, 5, 10], "minInstancesPerNode": [1, 5]},
        "gradient_boosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [2, 3]},
    }
    return grids[name]


def predictions(model, rows: DataFrame, row_id: str, label: str = "label") -> DataFrame:
    """(row id, actual, predicted, probability of class 1 where the model gives one)."""
    out = model.transform(rows)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(ref(row_id), ref(label).cast("double").alias("actual"), F.col("prediction").alias("predicted"), p.alias("probability"))


def prediction_table(tables: dict[str, DataFrame], row_id: str) -> DataFrame:
    """Predictions of several models side by side."""
    out = None
    for name, t in tables.items():
        part = t.select(row_id, *([] if out is not None else ["actual"]), F.col("predicted").alias(f"{name}_predicted"), F.col("probability").alias(f"{name}_probability"))
        out = part if out is None else out.join(part, row_id)
    return out


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and support-weighted precision, recall and F1 from the confusion counts."""
    cells = keep(pred.groupBy("actual", "predicted").agg(F.count("*").alias("n")))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = cells.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = cells.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("called"))
    per = rows.join(broadcast_if_small(cols), "k", "left").withColumns({
        "precision": F.coalesce(ratio(F.col("tp"), F.col("called")), F.lit(0.0)), "recall": ratio(F.col("tp"), F.col("support")),
    })
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    n, s = F.sum("support"), F.col("support")
    return per.agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), (F.sum(F.col("precision") * s) / n).alias("precision"),
        (F.sum(F.col("recall") * s) / n).alias("recall"), (F.sum(F.col("f1") * s) / n).alias("f1"),
    )


def probability_scores(pred: DataFrame) -> DataFrame:
    """ROC-AUC, PR-AUC and Brier score of a binary model."""
    rows = pred.select(F.col("actual").alias("y"), F.col("probability").alias("p"))
    a = glm.auc(rows).select(F.col("auc").alias("roc_auc"))
    b = glm.average_precision(glm.roc_points(rows)).select(F.col("average_precision").alias("pr_auc"))
    brier = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return a.join(F.broadcast(b)).join(F.broadcast(brier))


def multiclass_auc(model, rows: DataFrame, label: str = "label") -> DataFrame:
    """One-versus-rest ROC-AUC weighted by class size."""
    out = model.transform(rows).select(ref(label).cast("double").alias("y"), vector_to_array("probability").alias("p"))
    long = out.select("y", F.posexplode("p").alias("k", "q"))
    k = long.agg(F.max("k").alias("m")).first()["m"] + 1
    total, weight = 0.0, 0
    for i in range(k):
        part = long.where(F.col("k") == i).select((F.col("y") == i).cast("double").alias("y"), F.col("q").alias("p"))
        a, n = glm.auc(part).first()["auc"], part.agg(F.sum("y").alias("n")).first()["n"]
        if a is not None:
            total, weight = total + a * n, weight + n
    return table_of(rows.sparkSession, [{"roc_auc": total / weight if weight else None}])


def threshold_table(pred: DataFrame, thresholds: Sequence[float] = tuple(i / 20 for i in range(1, 20))) -> DataFrame:
    """Precision, recall, specificity and F1 at each threshold; one pass over the rows."""
    rows = pred.select(F.col("actual").alias("y"), F.col("probability").alias("p"))
    cells = []
    for t in thresholds:
        hit, pos = F.col("p") >= t, F.col("y") == 1
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
                              F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn")))
    out = rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def grid_search(estimator, grid: dict[str, Sequence], rows: DataFrame, row_id: str, folds: int = 3, metric: str = "f1", task: str = "classification",
                stratify: str | None = None, group: str | None = None, parallelism: int = 4) -> DataFrame:
    """Cross-validated grid with fixed folds: by row hash, per class when stratified, by whole groups when grouped."""
    if group:
        fold = F.pmod(F.xxhash64(ref(group), F.lit(42)), F.lit(folds))
        rows = rows.withColumn("fold", fold.cast("int"))
    elif stratify:
        # Ranks by row hash inside (class, hash range): every range deals its rows out to the folds in turn.
        h = F.xxhash64(ref(row_id), F.lit(42))
        part = _hash_range(h, split_ranges(rows))
        order = W.partitionBy(ref(stratify), part).orderBy(h)
        rows = rows.withColumn("fold", F.pmod(F.row_number().over(order) + part, F.lit(folds)).cast("int"))
    else:
        rows = rows.withColumn("fold", F.pmod(F.xxhash64(ref(row_id), F.lit(42)), F.lit(folds)).cast("int"))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    evaluator = RegressionEvaluator(metricName=metric) if task == "regression" else MulticlassClassificationEvaluator(metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism)
    model = cv.fit(keep(rows))
    best = max(model.avgMetrics) if evaluator.isLargerBetter() else min(model.avgMetrics)
    out = [{**{p.name: v if isinstance(v, str) else float(v) for p, v in m.items()}, "mean_score": float(s), "best": bool(s == best)} for m, s in zip(maps, model.avgMetrics, strict=True)]
    return table_of(rows.sparkSession, out)


def feature_names(rows: DataFrame, col: str = "features") -> list[str]:
    """Names from the vector column's metadata, in order."""
    meta = rows.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    attrs = sorted((a for kind in meta.values() for a in kind), key=lambda a: a["idx"])
    return [a.get("name", f"f{a['idx']}") for a in attrs]


def feature_importance(model, rows: DataFrame, top: int = 25) -> DataFrame:
    """Impurity importance, or absolute coefficients (mean over classes), largest first."""
    if hasattr(model, "featureImportances"):
        values = np.asarray(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(0)
    else:
        values = np.abs(np.asarray(model.coefficients.toArray()))
    names = feature_names(rows)
    if len(names) != len(values):
        names = [f"f{i}" for i in range(len(values))]
    out = table_of(rows.sparkSession, [{"feature": n, "importance": float(v)} for n, v in zip(names, values, strict=True)])
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(model, rows: DataFrame, row_id: str, evaluator, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Drop of the score when one feature is shuffled.

    Row i takes the feature of row perm(i): both orders number the rows by a hash inside the same hash ranges, so the
    shuffle is two equi-joins on numbers and no task sees all rows.
    """
    from colonnade.functions.ordering import positions

    names = feature_names(rows)
    base = evaluator.evaluate(model.transform(rows))
    sign = 1 if evaluator.isLargerBetter() else -1
    wide = keep(rows.withColumn("_f", vector_to_array("features")))
    out = []
    for r in range(repeats):
        a = positions(wide.select(ref(row_id).alias("_id"), F.xxhash64(ref(row_id), F.lit(seed + r)).alias("_h")), ["_h", "_id"], name="_n").select("_id", "_n")
        b = positions(wide.select(ref(row_id).alias("_id"), F.xxhash64(ref(row_id), F.lit(seed + 7919 + r)).alias("_h"), "_f"), ["_h", "_id"], name="_n").select("_n", F.col("_f").alias("_o"))
        mixed = keep(wide.join(a, ref(row_id) == F.col("_id")).join(b, "_n").drop("features", "_id"))
        for i in range(len(names)):
            swapped = _swap(i)
            out.append({"feature": names[i], "drop": sign * (base - evaluator.evaluate(model.transform(mixed.withColumn("features", array_to_vector(swapped)))))})
        mixed.unpersist()
    table = table_of(rows.sparkSession, out)
    return table.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).orderBy(F.desc("importance_mean"))


def _swap(i: int) -> Column:
    return F.transform("_f", lambda v, k: F.when(k == i, F.col("_o")[i]).otherwise(v))


def linear_contributions(model, rows: DataFrame) -> DataFrame:
    """Mean absolute contribution |coefficient * (x - mean)| of each feature of a linear model."""
    coefficients = model.coefficients.toArray() if hasattr(model, "coefficients") else model.coefficientMatrix.toArray()[0]
    names = feature_names(rows) or [f"f{i}" for i in range(len(coefficients))]
    long = rows.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    means = F.broadcast(long.groupBy("i").agg(F.avg("x").alias("m")))  # one row per feature
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    label = F.array(*[F.lit(n) for n in names])
    part = F.abs(weights[F.col("i")] * (F.col("x") - F.col("m")))
    return long.join(means, "i").groupBy("i").agg(F.avg(part).alias("mean_abs_contribution")).select(label[F.col("i")].alias("feature"), "mean_abs_contribution")


# ---------------------------------------------------------------- nearest neighbours


def _vectors(rows: DataFrame, row_id: str, features: str, name: str) -> DataFrame:
    kind = rows.schema[features].dataType
    vec = F.transform(ref(features), lambda v: v.cast("double")) if isinstance(kind, T.ArrayType) else vector_to_array(features)
    return rows.select(ref(row_id).cast("long").alias(name), vec.alias("vec"))


def knn_predict(train: DataFrame, test: DataFrame, row_id: str, features: str, target: str, k: int = 5, task: str = "classification") -> DataFrame:
    """Vote (smallest class wins ties) or mean of the k nearest training rows."""
    near = knn_join(_vectors(test, row_id, features, "qid"), _vectors(train, row_id, features, "rid"), k)
    labels = train.select(ref(row_id).cast("long").alias("rid"), ref(target).alias("_y"))
    votes = near.join(labels, "rid")
    if task == "regression":
        return votes.groupBy("qid").agg(F.avg("_y").alias("predicted"))
    counts = votes.groupBy("qid", "_y").agg(F.count("*").alias("n"))
    return counts.groupBy("qid").agg(F.min(F.struct(-F.col("n"), F.col("_y").alias("y")))["y"].alias("predicted"))


# ---------------------------------------------------------------- clustering


# Starts of k-means fitted at a time: one start is a long row of short jobs, which leave most cores idle.
STARTS_AT_ONCE = 8


def kmeans(rows: DataFrame, k: int, restarts: int = 10, features: str = "features"):
    """Best of several seeded starts by within-cluster sum of squares (the first of equals); returns (model, inertia)."""

    def fit(seed: int):
        model = K.KMeans(k=k, seed=seed, featuresCol=features, maxIter=100, tol=1e-6).fit(rows)
        return model, model.summary.trainingCost

    with ThreadPool(min(STARTS_AT_ONCE, restarts)) as pool:
        fits = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(42, 42 + restarts))
    return min(fits, key=lambda f: f[1])


# Rows of a packed block, and numbers in the largest matrix made of one.
PACK_ROWS, PACK_CELLS = 4096, 4_000_000


def packed(rows: DataFrame, features: str) -> DataFrame:
    """The feature vectors as blocks of rows (binary, columns), kept: passes in numpy then have no cost per row."""

    def pack(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), PACK_ROWS):
                x = np.stack(pdf["v"].iloc[lo : lo + PACK_ROWS].to_numpy())
                yield pd.DataFrame({"block": [x.astype(np.float64).tobytes()], "d": [x.shape[1]]})

    vec = F.transform(ref(features), lambda v: v.cast("double")) if isinstance(rows.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    return keep(rows.select(vec.alias("v")).mapInPandas(pack, "block binary, d int"))


def nearest_centers(x: np.ndarray, centers: Sequence[np.ndarray]):
    """Per slice of ``x``: the slice, and for every set of centres the nearest (first of equals) and its squared distance."""
    every = np.concatenate(centers)
    ends = np.cumsum([len(c) for c in centers])
    size = max(1, PACK_CELLS // len(every))
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        d2 = (every * every).sum(1) - 2 * (part @ every.T)
        own = (part * part).sum(1)
        found = []
        for end, c in zip(ends, centers):
            label = d2[:, end - len(c) : end].argmin(1)
            found.append((label, np.maximum(d2[np.arange(len(part)), end - len(c) + label] + own, 0.0)))
        yield part, found


def lloyd(blocks: DataFrame, centers: list[np.ndarray], max_iter: int = 100, tol: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of every start after Lloyd's iterations, as ``KMeans`` does them; one pass moves all starts at once.

    A start rests once none of its centres moves by more than ``tol``; its cost is that of the last assignment. A centre
    without rows stays. The driver gets sums per centre.
    """
    context = blocks.sparkSession.sparkContext
    centers, costs, going = list(centers), [0.0] * len(centers), list(range(len(centers)))
    for _ in range(max_iter):
        if not going:
            break
        shared = context.broadcast([centers[s] for s in going])

        def sums(part):
            sets = shared.value
            first = np.cumsum([0] + [len(c) for c in sets])
            width = sets[0].shape[1]
            total, cost = np.zeros((first[-1], width + 1)), np.zeros(len(sets))
            for row in part:
                for x, found in nearest_centers(np.frombuffer(row["block"], dtype=np.float64).reshape(-1, row["d"]), sets):
                    member = np.zeros((len(x), first[-1]))
                    for s, (label, gap) in enumerate(found):
                        member[np.arange(len(x)), first[s] + label] = 1.0
                        cost[s] += gap.sum()
                    total[:, :width] += member.T @ x
                    total[:, width] += member.sum(0)
            yield total, cost

        total, cost = blocks.rdd.mapPartitions(sums).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        shared.unpersist()
        at, still = 0, []
        for s, spent in zip(going, cost):
            old, mine = centers[s], total[at : at + len(centers[s])]
            at += len(old)
            filled = mine[:, -1] > 0
            new = old.copy()
            new[filled] = mine[filled, :-1] / mine[filled, -1:]
            centers[s], costs[s] = new, float(spent)
            if (((new - old) ** 2).sum(1) > tol * tol).any():
                still.append(s)
        going = still
    return list(zip(centers, costs))


def kmeans_all(rows: DataFrame, ks: Sequence[int], restarts: int = 10, features: str = "features") -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) of the best start per number of clusters: the starts of ``kmeans``, moved together."""
    starts = [(k, seed) for k in ks for seed in range(42, 42 + restarts)]

    def begin(start: tuple[int, int]) -> np.ndarray:
        k, seed = start
        return np.array(K.KMeans(k=k, seed=seed, featuresCol=features, maxIter=0).fit(rows).clusterCenters())

    with ThreadPool(min(STARTS_AT_ONCE, len(starts))) as pool:
        centers = pool.map(inheritable_thread_target(rows.sparkSession)(begin), starts)
    blocks = packed(rows, features)
    fits = lloyd(blocks, centers)
    blocks.unpersist()
    return [min(fits[i : i + restarts], key=lambda f: f[1]) for i in range(0, len(fits), restarts)]


# Rows of a block at most, blocks that keep the cores busy, rows below which a block is not cut, cells of one slice of distances.
SILHOUETTE_ROWS, SILHOUETTE_BLOCKS, SILHOUETTE_LEAST, SLICE_CELLS = 32_000, 12, 800, 4_000_000


def silhouette_blocks(n: int) -> int:
    return max(1, -(-n // SILHOUETTE_ROWS), min(SILHOUETTE_BLOCKS, -(-n // SILHOUETTE_LEAST)))


def silhouette(rows: DataFrame, cluster: str, features: str = "features") -> DataFrame:
    """Mean Euclidean silhouette over all rows; quadratic work by definition, see ``silhouette_squared``.

    Distances are summed block against block: rows are dealt into blocks of bounded size, each pair of blocks is one
    task that computes bounded slices of their matrix with numpy, and only sums per row and cluster leave it. A row is sent
    to as many tasks as there are blocks, so the blocks are as large as a task may hold once there are enough of them.
    """
    blocks = silhouette_blocks(rows.count())
    vec = vector_to_array(features) if not isinstance(rows.schema[features].dataType, T.ArrayType) else F.transform(ref(features), lambda v: v.cast("double"))
    base = keep(rows.select(F.monotonically_increasing_id().alias("i"), ref(cluster).cast("int").alias("c"), vec.alias("v")))
    base = materialise(base.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")))
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = SLICE_CELLS
    left = base.select("i", "c", "v", F.col("b").alias("x"), spread.alias("y"))
    right = base.select("c", "v", F.col("b").alias("y"), spread.alias("x"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"i": [], "own": [], "c": [], "s": []}
        if len(a) and len(b):
            p, q = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            labels = b["c"].to_numpy()
            names = np.unique(labels)
            own = (q * q).sum(1)[None, :]
            groups = [labels == k for k in names]
            total = np.empty((len(names), len(p)))
            size = max(1, cells // len(q))
            for i in range(0, len(p), size):
                part = p[i : i + size]
                d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + own - 2 * part @ q.T, 0.0))
                for j, mine in enumerate(groups):
                    total[j, i : i + size] = d[:, mine].sum(1)
            for j, k in enumerate(names):
                out["i"] += a["i"].tolist()
                out["own"] += a["c"].tolist()
                out["c"] += [int(k)] * len(a)
                out["s"] += total[j].tolist()
        return pd.DataFrame(out)

    parts = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(sums, "i bigint, own int, c int, s double")
    sizes = F.broadcast(base.groupBy("c").agg(F.count("*").alias("n")))  # one row per cluster
    per = parts.groupBy("i", "own", "c").agg(F.sum("s").alias("s")).join(sizes, "c")
    mean = F.when(F.col("c") == F.col("own"), ratio(F.col("s"), F.col("n") - 1)).otherwise(F.col("s") / F.col("n"))
    rows_ = per.withColumn("m", mean).groupBy("i").agg(
        F.max(F.when(F.col("c") == F.col("own"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("m"))).alias("b"),
        F.max(F.when(F.col("c") == F.col("own"), F.col("n"))).alias("size"),
    )
    s = F.when(F.col("size") == 1, 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return rows_.agg(F.avg(s).alias("silhouette"))


def silhouette_squared(rows: DataFrame, cluster: str, features: str = "features") -> DataFrame:
    """Silhouette on squared distances: linear in the rows, for tables where the exact one is out of reach."""
    score = ClusteringEvaluator(predictionCol=cluster, featuresCol=features).evaluate(rows)
    return table_of(rows.sparkSession, [{"silhouette": float(score)}])


def elbow(
    rows: DataFrame, ks: Sequence[int] = tuple(range(2, 13)), restarts: int = 10, features: str = "features", exact: bool = False
) -> DataFrame:
    """Inertia and silhouette per number of clusters.

    The silhouette is the linear-time one on squared distances; ``exact=True`` takes the Euclidean one, whose work is
    quadratic in the rows. All starts of all numbers of clusters go through the rows together.
    """
    best = kmeans_all(rows, ks, restarts, features)
    centers = [c for c, _ in best]

    @F.pandas_udf("array<int>")
    def clusters(v: pd.Series) -> pd.Series:
        found = [np.stack([label for label, _ in f], 1) for _, f in nearest_centers(np.stack(v.to_numpy()), centers)] if len(v) else []
        return pd.Series([x for part in found for x in part.astype(np.int32)], dtype=object)

    vec = F.transform(ref(features), lambda v: v.cast("double")) if isinstance(rows.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    labelled = keep(rows.select(ref(features), clusters(vec).alias("_clusters")))
    measure = silhouette if exact else silhouette_squared

    def score(i: int) -> float:
        return measure(labelled.select(features, F.col("_clusters")[i].alias("prediction")), "prediction", features).first()["silhouette"]

    out = [{"k": k, "inertia": float(cost), "silhouette": score(i)} for i, (k, (_, cost)) in enumerate(zip(ks, best, strict=True))]
    labelled.unpersist()
    return table_of(rows.sparkSession, out)


def bisecting(rows: DataFrame, k: int, features: str = "features", seed: int = 42) -> DataFrame:
    """Divisive hierarchical grouping."""
    return K.BisectingKMeans(k=k, seed=seed, featuresCol=features).fit(rows).transform(rows)


def pca_projection(rows: DataFrame, features: str = "features", k: int = 2):
    """Scores on the first components of the centred features, and their explained variance."""
    centred = FE.StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False).fit(rows).transform(rows)
    model = FE.PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred)
    scores = model.transform(centred).withColumn("_a", vector_to_array("_pc"))
    out = scores.select(*[ref(c) for c in rows.columns], *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])
    variance = table_of(rows.sparkSession, [{"component": i + 1, "explained_variance": float(v)} for i, v in enumerate(model.explainedVariance.toArray())])
    return out, variance


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    whole = df.agg(F.count("*").alias("_n"))
    out = df.groupBy(ref(cluster).alias("cluster")).agg(F.count("*").alias("size"), *[F.avg(ref(c)).alias(c) for c in cols])
    return out.join(F.broadcast(whole)).select("cluster", "size", (F.col("size") * 100.0 / F.col("_n")).alias("percent"), *[ref(c) for c in cols])


def dbscan(rows: DataFrame, row_id: str, cols: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """Density clustering: (row id, cluster, core), noise as -1.

    Equal points are folded with their counts. Space is cut into cells of side eps/sqrt(d), so points of one cell are
    neighbours of each other: a cell holding min_samples is core as a whole. Points are dealt into blocks that lie
    together; every pair of blocks within eps is one task, which counts neighbours, links core cells and labels border
    points. Only counts, spanning forests of the links and labels are written, never the pairs, so many columns, where
    nearly every cell holds one point, are no obstacle; clusters are the connected components of the core cells.
    """
    d = len(cols)
    side = eps / math.sqrt(d)
    data = normalise_missing(rows).dropna(subset=list(cols))
    coords = [f"x{i}" for i in range(d)]
    pts = data.groupBy(*[ref(c).cast("double").alias(x) for c, x in zip(cols, coords, strict=True)]).agg(F.count("*").alias("n"))
    pts = pts.select("n", F.array(*coords).alias("vec"), F.xxhash64(F.array(*[F.floor(F.col(x) / side).cast("long") for x in coords])).alias("cell"))
    # The numbers of the points are fixed by the checkpoint.
    pts = materialise(pts.withColumn("id", F.monotonically_increasing_id()))
    keys = data.select(ref(row_id), *[ref(c).cast("double").alias(x) for c, x in zip(cols, coords, strict=True)])
    n = pts.count()
    if not n:
        return keys.select(row_id, F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("core"))
    sizes = pts.groupBy("cell").agg(F.sum("n").alias("size"))
    sized = materialise(in_blocks(pts, n).join(broadcast_if_small(sizes), "cell"))
    pairs = block_pairs(sized, d, eps)

    def asked(found):
        """``found`` for the asked points of each block and the points of the other."""

        def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
            out = [found(a[a["ask"]], b)] + ([] if same else [found(b[b["ask"]], a)])
            return pd.concat(out, ignore_index=True)

        return run

    def neighbours(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        more, cells, others, weight = np.zeros(len(p)), p["cell"].to_numpy(), q["cell"].to_numpy(), q["n"].to_numpy()
        for i, j in within(matrix(p["vec"]), matrix(q["vec"]), eps) if len(p) else ():
            more += np.bincount(i, weights=weight[j] * (cells[i] != others[j]), minlength=len(p))
        return pd.DataFrame({"id": p["id"].to_numpy()[more > 0], "more": more[more > 0].astype(np.int64)})

    # Points of sparse cells (fewer than min_samples each) count their neighbours across cells.
    counted = sized.select("leaf", "id", "cell", "n", "vec", (F.col("size") < min_samples).alias("ask"))
    more = meet(counted, pairs, asked(neighbours), "id long, more long").groupBy("id").agg(F.sum("more").alias("_more"))
    marked = sized.join(more, "id", "left").withColumn("core", F.col("size") + F.coalesce("_more", F.lit(0)) >= min_samples)
    marked = materialise(marked.select("leaf", "id", "cell", "vec", "core"))

    # Two core cells are linked when any two of their core points are within eps.
    def links(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            left = Cells(a["cell"].to_numpy(), matrix(a["vec"]))
            found = linked_cells(left, left if same else Cells(b["cell"].to_numpy(), matrix(b["vec"])), eps)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    cores = marked.where("core")
    linked = meet(cores.select("leaf", "cell", "vec"), pairs, links, "a long, b long").distinct()
    labels = components(cores.select("cell").distinct().withColumn("id", F.col("cell")), linked)

    # Border points join the cluster of a core point in their own cell or within eps in another; the smallest label wins.
    def lowest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        top = np.iinfo(np.int64).max
        q = q[~q["ask"]]
        best, label = np.full(len(p), top), q["label"].to_numpy(dtype=np.int64)
        for i, j in within(matrix(p["vec"]), matrix(q["vec"]), eps) if len(p) and len(q) else ():
            np.minimum.at(best, i, label[j])
        return pd.DataFrame({"id": p["id"].to_numpy()[best < top], "label": best[best < top]})

    labelled = materialise(marked.join(labels, "cell", "left"))
    border = labelled.select("leaf", "id", "vec", (~F.col("core")).alias("ask"), F.when(F.col("core"), F.col("label")).otherwise(0).alias("label"))
    across = meet(border, pairs, asked(lowest), "id long, label long").groupBy("id").agg(F.min("label").alias("_across"))
    out = labelled.join(across, "id", "left").select("vec", F.least("label", "_across").alias("cluster"), "core")
    out = materialise(out.select(*[F.col("vec")[i].alias(x) for i, x in enumerate(coords)], "cluster", "core"))
    from colonnade.functions.ordering import positions

    numbers = positions(out.where("cluster IS NOT NULL").select("cluster").distinct(), ["cluster"], name="no")
    numbers = numbers.withColumn("no", F.col("no") - 1)
    final = out.join(broadcast_if_small(numbers), "cluster", "left").select(*coords, F.coalesce("no", F.lit(-1)).alias("cluster"), "core")
    return keys.join(final, coords).select(row_id, "cluster", "core")


def components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, label), of cells by name and id: connected components by alternating neighbour minimum and label jumping, written and read again each round."""
    state = reread(cells.select("cell", F.col("id").alias("label")))
    both = links.select(F.col("a").alias("cell"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cell"), F.col("a").alias("other")))
    both = reread(both)
    ids = reread(cells.select("cell", F.col("id").alias("own")))
    while True:
        seen = both.join(state.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(F.min("label").alias("_m"))
        step = state.join(seen, "cell", "left").withColumn("_new", F.least("label", F.coalesce("_m", F.col("label"))))
        # Jump: take the label of the cell whose id is the current label.
        roots = ids.join(step.select("cell", F.col("_new").alias("_up")), "cell").select(F.col("own").alias("_new"), "_up")
        step = step.join(roots, "_new", "left").withColumn("_new", F.least("_new", F.coalesce("_up", F.col("_new"))))
        step = reread(step.select("cell", "label", F.col("_new")))
        moved = step.where(F.col("_new") < F.col("label")).limit(1).count()
        state = step.select("cell", F.col("_new").alias("label"))
        if not moved:
            return state
