"""Exact quantiles without collecting a column into one task.

A mergeable sketch first brackets every requested quantile; a second pass puts each row into one segment between the
sorted bracket edges, counts the segments and keeps single values only inside brackets, so no row is repeated per
quantile and the shuffle carries a small share of the rows. A rank that no bracket covers raises an error; no approximate
value is ever returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.functions.ordering import running_totals
from colonnade.session import broadcast_if_small, keep

SKETCH_ACCURACY = 10_000


def melt(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., column, value double) of the non-missing cells; rows with a missing group are dropped."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("double").alias("value")) for c in cols])
    )
    long = df.select(*[ref(b) for b in by], cells.alias("_cell"))
    long = long.select(*[ref(b) for b in by], "_cell.column", "_cell.value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    for b in by:
        long = long.where(ref(b).isNotNull())
    return long


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles: one row per (by..., column, p) with ``value`` and the non-missing count ``n``."""
    return quantiles_of_long(melt(df, cols, by), probs, [*by, "column"], bounded_groups=not by)


# Values inside the brackets of a column that a single window orders; beyond, the running totals are spread over tasks.
WINDOW_VALUES = 500_000
# Edges compared in generated code; longer lists are counted by a higher-order function.
FEW_EDGES = 16


def quantiles_of_long(
    long: DataFrame, probs: Sequence[float], keys: Sequence[str], bounded_groups: bool = False
) -> DataFrame:
    """As ``exact_quantiles`` on a frame that already has the columns (keys..., value)."""
    keys = list(keys)
    slack = 2.0 / SKETCH_ACCURACY
    low = [max(p - slack, 0.0) for p in probs]
    high = [min(p + slack, 1.0) for p in probs]
    grid = F.array(*[F.lit(float(q)) for q in low + high])
    k = len(probs)
    sketch = long.groupBy(*keys).agg(
        F.percentile_approx("value", grid, SKETCH_ACCURACY).alias("_q"), F.count("value").alias("n")
    )
    brackets = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(
        F.element_at("_q", i).alias("lo"), F.element_at("_q", i + k).alias("hi")))
    sketch = sketch.select(*keys, "n", brackets.alias("_b"), F.array_sort(F.array_distinct("_q")).alias("_edges"))
    # Between two edges lies either the inside of some bracket, whose values are needed, or nothing of interest.
    inside = F.transform(F.sequence(F.lit(0), F.size("_edges")), lambda i: F.exists("_b", lambda x: (
        (x["lo"] <= F.get("_edges", i - 1)) & (x["hi"] >= F.get("_edges", i)))))
    ranks = F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.array(
        F.struct(p.alias("p"), F.lit(0).alias("side"), F.floor(p * (F.col("n") - 1)).alias("at")),
        F.struct(p.alias("p"), F.lit(1).alias("side"), F.least(F.floor(p * (F.col("n") - 1)) + 1, F.col("n") - 1).alias("at")))))
    # One row per requested column when ungrouped; otherwise the number of groups is measured first.
    sketch = keep(sketch.select(*keys, "n", "_edges", inside.alias("_inside"), ranks.alias("_ranks")))
    side = F.broadcast(sketch) if bounded_groups else broadcast_if_small(sketch)
    cells = long.join(side.select(*keys, "_edges", "_inside"), keys)
    if 2 * k <= FEW_EDGES:
        below = sum((F.coalesce((F.get("_edges", F.lit(i)) < F.col("value")).cast("int"), F.lit(0)) for i in range(2 * k)), F.lit(0))
    else:
        below = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    cells = cells.select(*keys, "value", below.alias("_i"), F.array_contains("_edges", F.col("value")).alias("_on"), "_inside")
    # A row belongs to one segment: on an edge, or between two. Only values inside brackets are told apart.
    wanted = ~F.col("_on") & F.coalesce(F.get("_inside", F.col("_i")), F.lit(False))
    blocks = (
        cells.select(*keys, (2 * F.col("_i") + F.col("_on").cast("int")).alias("_seg"), F.when(wanted, F.col("value")).alias("_v"), "value")
        .groupBy(*keys, "_seg", "_v")
        .agg(F.count("*").alias("_c"), F.max("value").alias("_max"), F.min("value").alias("_min"))
    )
    # A bracket spans about twice the slack on either side of its rank.
    largest = sketch.agg(F.max("n")).first()[0] or 0
    if 4 * slack * k * largest > WINDOW_VALUES:
        placed = running_totals(blocks, ["_seg", "_v"], {"_c": "_end"}, keys)
    else:
        order = W.partitionBy(*keys).orderBy("_seg", "_v").rowsBetween(W.unboundedPreceding, 0)
        placed = blocks.withColumn("_end", F.sum("_c").over(order))
    first = F.col("_end") - F.col("_c")
    hits = placed.join(side.select(*keys, "n", "_ranks"), keys).select(
        *keys, "n", "_v", "_min", "_max", first.alias("_first"), "_end", F.explode(
            F.filter("_ranks", lambda r: (r["at"] >= F.col("_end") - F.col("_c")) & (r["at"] < F.col("_end")))).alias("_r"))
    at = F.col("_r.at")
    value = (
        F.when(F.col("_v").isNotNull() | (F.col("_min") == F.col("_max")), F.col("_min"))
        .when(at == F.col("_end") - 1, F.col("_max")).when(at == F.col("_first"), F.col("_min"))
        .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
    )
    picked = hits.select(*keys, "n", F.col("_r.p").alias("p"), F.col("_r.side").alias("_s"), value.alias("_x")).groupBy(*keys, "n", "p").agg(
        F.max(F.when(F.col("_s") == 0, F.col("_x"))).alias("_x0"), F.max(F.when(F.col("_s") == 1, F.col("_x"))).alias("_x1"))
    weight = F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))
    between = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * weight
    return picked.select(*keys, "p", "n", F.when(weight == 0, F.col("_x0")).otherwise(between).alias("value"))


def quantile_columns(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Wide form: one row per (by..., column) with ``n`` and one named column per probability."""
    long = exact_quantiles(df, cols, sorted(set(probs.values())), by)
    return long.groupBy(*by, "column", "n").agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()]
    )
