"""Signed counts over all pairs of points, without comparing pairs and without a group that grows with the data.

The second coordinate is cut into ranges of a bounded number of points; a value with more points than that is a range of its
own, inside which every pair is a tie. Pairs inside one range are counted by that range's task. Pairs of different ranges
are decided by the highest digit in which the range numbers differ: for each digit, the points that share the higher digits
are put in order of the first coordinate, and one distributed running total per value of the digit says how much lies before
each of them on either side. So there are as many passes as the range numbers have digits, whatever the data look like.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.ordering import running_totals
from colonnade.session import broadcast_if_small, materialise

# Points of a range, about: at most twice as many meet in one task.
RANGE_POINTS = 20_000
# Values of a digit, and running totals carried side by side.
BASE = 16


def balance(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of w (smaller x) times c (larger x) times the sign of (dx * dy); ties count zero."""
    if not len(x):
        return 0.0
    order = np.argsort(x, kind="stable")
    x, c, w = x[order], c[order].astype(float), w[order].astype(float)
    y = np.unique(y[order], return_inverse=True)[1].ravel()
    total = 0.0
    for bit in range(int(y.max()).bit_length()):
        group = np.argsort(y >> (bit + 1), kind="stable")  # keeps the order of x
        head, xs, up = (y >> (bit + 1))[group], x[group], ((y >> bit) & 1)[group].astype(bool)
        cs, ws = c[group], w[group]
        new_head = np.r_[True, head[1:] != head[:-1]]
        new_run = new_head | np.r_[True, xs[1:] != xs[:-1]]
        run_start, head_start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1], np.flatnonzero(new_head)[np.cumsum(new_head) - 1]

        def before(weight: np.ndarray, first=run_start, start=head_start) -> np.ndarray:
            """Weight of the points of the same head with smaller x."""
            seen = np.r_[0.0, np.cumsum(weight)]
            return seen[first] - seen[start]

        total += float((cs * np.where(up, before(np.where(up, 0.0, ws)), -before(np.where(up, ws, 0.0)))).sum())
    return total


def signed_pairs(points: DataFrame, range_points: int = RANGE_POINTS) -> DataFrame:
    """One row ``s``: over all pairs, w of the one with smaller x times c of the other, signed by dy.

    ``points`` holds unique (x, y), both numbers, with the weights c and w.
    """
    values = points.groupBy("y").agg(F.count("*").alias("k"))
    heavy = F.col("k") >= range_points
    values = values.withColumns({"_heavy": heavy.cast("long"), "_light": F.when(heavy, 0).otherwise(F.col("k"))})
    run = running_totals(values, ["y"], {"_light": "_lights", "_heavy": "_heavies"})
    # Ranges are numbered in the order of y: light values by the points before them, a heavy value between its neighbours.
    light_code = F.floor((F.col("_lights") - F.col("k")) / range_points) + 2 * F.col("_heavies")
    heavy_code = F.floor(F.col("_lights") / range_points) + 2 * F.col("_heavies") - 1
    codes = run.select("y", F.when(heavy, heavy_code).otherwise(light_code).alias("code"), heavy.alias("heavy"))
    coded = points.select("x", "y", F.col("c").cast("double").alias("c"), F.col("w").cast("double").alias("w"))
    coded = materialise(coded.join(broadcast_if_small(codes), "y"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [balance(*[pdf[k].to_numpy() for k in ("x", "y", "c", "w")])]})

    parts = [coded.where(~F.col("heavy")).groupBy("code").applyInPandas(count, "s double")]
    last = coded.agg(F.max("code")).first()[0] or 0
    unit = 1
    while unit <= last:
        width = min(BASE, last // unit + 1)
        digit = F.floor(F.col("code") / unit) % BASE
        rows = coded.groupBy(F.floor(F.col("code") / (unit * BASE)).alias("head"), "x").agg(
            *[F.sum(F.when(digit == d, F.col(v)).otherwise(0.0)).alias(f"{v}{d}") for v in ("w", "c") for d in range(width)]
        )
        run = running_totals(rows, ["x"], {f"w{d}": f"r{d}" for d in range(width)}, ["head"])
        ahead = [F.col(f"r{d}") - F.col(f"w{d}") for d in range(width)]
        gain = [
            F.col(f"c{d}") * (reduce(lambda a, b: a + b, ahead[:d], F.lit(0.0)) - reduce(lambda a, b: a + b, ahead[d + 1 :], F.lit(0.0)))
            for d in range(width)
        ]
        parts.append(run.agg(F.sum(reduce(lambda a, b: a + b, gain)).alias("s")))
        unit *= BASE
    return reduce(DataFrame.unionAll, parts).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
