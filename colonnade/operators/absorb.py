"""Regression with a category of any number of levels, and its coding.

A category with thousands of levels would make as many columns. Its effects are projected out instead: the cross products
within levels are the cross products of all rows less those of the level means, and the means come from one grouping whose
result is as long as the number of levels. No row is joined to its level, so a level that holds a third of the rows costs
no more than another. Coding is a table of (row, level number) pairs, never a wide matrix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import normalise_missing, ref
from colonnade.functions.gram import solve
from colonnade.functions.ordering import positions
from colonnade.functions.results import table_of
from colonnade.operators.linear import coefficient_rows
from colonnade.session import keep


def level_codes(df: DataFrame, col: str) -> DataFrame:
    """level, code, n of every known level in order; code 0 is the reference. Any number of levels."""
    levels = normalise_missing(df).where(ref(col).isNotNull()).groupBy(ref(col).alias("level")).agg(F.count("*").alias("n"))
    return positions(levels, ["level"], name="code").select("level", (F.col("code") - 1).alias("code"), "n")


def sparse_coding(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Treatment coding as a table: row_id, column, code of every cell that is not at the reference level or missing."""
    out = None
    for c in cols:
        codes = level_codes(df, c).where("code > 0").select(F.col("level").alias("_level"), "code")
        rows = normalise_missing(df).select(ref(row_id).alias("row_id"), ref(c).alias("_level"))
        one = rows.join(codes, "_level").select("row_id", F.lit(c).alias("column"), "code")
        out = one if out is None else out.unionAll(one)
    return out


@dataclass
class AbsorbedFit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    sigma2: float
    n: int
    levels: int
    within_r_squared: float
    sums: DataFrame
    shift: np.ndarray

    @property
    def df_resid(self) -> int:
        return self.n - self.levels - len(self.names)

    def effects(self) -> DataFrame:
        """level, n, effect (what the level adds beside the predictors) of every level."""
        effect = F.col("m0") + F.lit(float(self.shift[0]))
        for i, b in enumerate(self.beta, 1):
            effect = effect - F.lit(float(b)) * (F.col(f"m{i}") + F.lit(float(self.shift[i])))
        return self.sums.select("level", "n", effect.alias("effect"))


def fit_absorbed(df: DataFrame, outcome: str, predictors: Sequence[str], absorb: str) -> AbsorbedFit:
    """Least squares of ``outcome`` on numeric predictors and all levels of ``absorb``; equals the fit with one column a level."""
    cols = [outcome, *predictors]
    rows = normalise_missing(df).select(ref(absorb).alias("level"), *[ref(c).cast("double").alias(f"r{i}") for i, c in enumerate(cols)]).dropna()
    rows = keep(rows)
    ids = range(len(cols))
    means = rows.agg(F.count("*").alias("n"), *[F.avg(f"r{i}").alias(f"m{i}") for i in ids]).first()
    n = means["n"]
    if not n:
        raise ValueError("no complete cases")
    shift = np.array([means[f"m{i}"] for i in ids])
    x = [F.col(f"r{i}") - F.lit(float(shift[i])) for i in ids]  # near the mean, sums of squares do not cancel
    pairs = [(i, j) for i in ids for j in ids if i <= j]
    total = rows.agg(*[F.sum(x[i] * x[j]).alias(f"t{i}_{j}") for i, j in pairs]).first()
    sums = keep(rows.groupBy("level").agg(F.count("*").alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in ids]))
    between = sums.agg(F.count("*").alias("levels"), *[F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{j}")).alias(f"t{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        g[i, j] = g[j, i] = total[f"t{i}_{j}"] - between[f"t{i}_{j}"]
    scale = np.sqrt(np.maximum(np.diag(g), 0))
    scale[scale == 0] = 1.0
    z = g / np.outer(scale, scale)
    beta, inverse = solve(z[1:, 1:], z[1:, 0])
    rss = max(float(z[0, 0] - beta @ z[1:, 0]), 0.0) * scale[0] ** 2
    dof = n - between["levels"] - len(predictors)
    sigma2 = rss / dof if dof > 0 else math.nan
    back = scale[0] / scale[1:]
    fit = AbsorbedFit(
        list(predictors), beta * back, inverse / np.outer(scale[1:], scale[1:]) * sigma2, sigma2, n, between["levels"], 1 - rss / g[0, 0] if g[0, 0] else math.nan, sums, shift,
    )
    rows.unpersist()
    return fit


def absorbed_coefficients(df: DataFrame, fit: AbsorbedFit) -> DataFrame:
    """Coefficients with t tails, and how many rows and levels stand behind them."""
    rows = coefficient_rows(fit.names, fit.beta, fit.covariance, fit.df_resid, "t")
    return table_of(df.sparkSession, [{**r, "n": fit.n, "levels": fit.levels, "within_r_squared": fit.within_r_squared} for r in rows])
