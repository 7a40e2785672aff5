"""Design matrices and the distributed sums that every regression here is solved from.

A design is a DataFrame of standardised predictor columns. Each fitting step is one aggregate over it (cross products,
scores, log-likelihood); only p-by-p numbers reach the driver. Results are transformed back to the original scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.context import normalise_missing, ref
from colonnade.session import keep

MAX_LEVELS = 200
# Above this many columns the cross products are summed with numpy per Arrow batch instead of one expression each.
WIDE_DESIGN = 30


@dataclass
class Design:
    frame: DataFrame
    names: list[str]
    columns: list[str]
    back: np.ndarray
    n: int
    raw: dict[str, Column] = field(default_factory=dict)
    centres: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None

    @property
    def p(self) -> int:
        return len(self.names)

    def linear(self, weights: Sequence[float]) -> Column:
        """Sum of weight * standardised column; columns[0] is the constant."""
        out = F.lit(float(weights[0]))
        for w, c in zip(weights[1:], self.columns[1:], strict=True):
            out = out + F.lit(float(w)) * F.col(c)
        return out

    def quadratic(self, matrix: np.ndarray) -> Column:
        """z' M z for each row."""
        out = F.lit(0.0)
        for i in range(self.p):
            out = out + F.col(self.columns[i]) * self.linear(matrix[i])
        return out

    def score_expression(self, weights: Sequence[float]) -> Column:
        """Linear predictor on ORIGINAL-scale coefficients for rows that carry the raw predictor columns."""
        out = F.lit(float(weights[0]))
        for w, name in zip(weights[1:], self.names[1:], strict=True):
            out = out + F.lit(float(w)) * self.raw[name]
        return out

    def release(self) -> None:
        self.frame.unpersist()


def category_levels(df: DataFrame, col: str) -> list:
    """Sorted levels of a categorical predictor; their number is checked since each becomes a column."""
    rows = df.where(ref(col).isNotNull()).select(ref(col).alias("v")).distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels")
    return sorted(r["v"] for r in rows)


def is_categorical(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.StringType, T.BooleanType))


def dummy_columns(df: DataFrame, col: str, levels: list | None = None) -> dict[str, Column]:
    """Treatment coding: one 0/1 column per sorted level but the first."""
    levels = category_levels(df, col) if levels is None else levels
    return {f"{col}[T.{v}]": (ref(col) == F.lit(v)).cast("double") for v in levels[1:]}


def build_design(
    df: DataFrame,
    predictors: Sequence[str],
    carry: dict[str, Column] | None = None,
    squares: Sequence[str] = (),
    interactions: Sequence[tuple[str, str]] = (),
    centres: dict[str, float] | None = None,
) -> Design:
    """Complete-case design with an intercept: numbers as they are, categories treatment-coded, centred squares and
    products on request. ``carry`` adds named columns (outcome, weights, keys) that must be known as well."""
    carry = carry or {}
    df = normalise_missing(df)
    kept = df.withColumns(carry) if carry else df
    for name in [*predictors, *carry]:
        kept = kept.where(ref(name).isNotNull())
    terms: dict[str, Column] = {}
    parts: dict[str, list[str]] = {}
    levels: dict[str, list] = {}
    for p in predictors:
        if is_categorical(df, p):
            levels[p] = category_levels(kept, p)
            made = dummy_columns(kept, p, levels[p])
        else:
            made = {p: ref(p).cast("double")}
        terms.update(made)
        parts[p] = list(made)
    centres = dict(centres or {})
    if squares and not centres:
        row = kept.agg(*[F.avg(ref(s)).alias(f"m{i}") for i, s in enumerate(squares)]).first()
        centres = {s: row[f"m{i}"] for i, s in enumerate(squares)}
    for s in squares:
        terms[f"{s}^2"] = F.pow(ref(s).cast("double") - F.lit(centres[s]), 2)
    for a, b in interactions:
        for x in parts[a]:
            for y in parts[b]:
                terms[f"{x}:{y}"] = terms[x] * terms[y]
    names = ["Intercept", *terms]
    raw = keep(kept.select(*[c.alias(f"_r{i}") for i, c in enumerate(terms.values(), 1)], *[ref(n) for n in carry]))
    ids = range(1, len(names))
    row = raw.agg(
        F.count("*").alias("n"), *[F.avg(f"_r{i}").alias(f"m{i}") for i in ids], *[F.stddev_pop(f"_r{i}").alias(f"s{i}") for i in ids]
    ).first()
    if not row["n"]:
        raise ValueError("no complete cases")
    shift = np.array([0.0] + [row[f"m{i}"] for i in ids])
    scale = np.array([1.0] + [row[f"s{i}"] or 1.0 for i in ids])
    columns = ["_z0"] + [f"_z{i}" for i in ids]
    frame = keep(raw.select(
        F.lit(1.0).alias("_z0"),
        *[((F.col(f"_r{i}") - F.lit(float(shift[i]))) / F.lit(float(scale[i]))).alias(f"_z{i}") for i in ids],
        *[ref(n) for n in carry],
    ))
    frame.count()
    raw.unpersist()
    back = np.diag(1 / scale)
    back[0, 1:] = -shift[1:] / scale[1:]
    return Design(frame, names, columns, back, row["n"], dict(terms), centres, levels, shift, scale)


def weighted_sums(
    frame: DataFrame, columns: Sequence[str], weight: Column | None, rights: dict[str, Column], extras: dict[str, Column]
) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, float]]:
    """One pass: X'WX, X'r for each right-hand side (weights not applied to it), and further sums."""
    p = len(columns)
    if p > WIDE_DESIGN:
        return _wide_sums(frame, columns, weight, rights, extras)
    base = frame.select(
        *columns,
        (weight if weight is not None else F.lit(1.0)).alias("_w"),
        *[c.alias(f"_rhs_{n}") for n, c in rights.items()],
        *[c.alias(f"_add_{n}") for n, c in extras.items()],
    )
    aggs = [
        F.sum(F.col("_w") * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}")
        for i in range(p)
        for j in range(i, p)
    ]
    aggs += [F.sum(F.col(f"_rhs_{n}") * F.col(c)).alias(f"r{n}_{i}") for n in rights for i, c in enumerate(columns)]
    aggs += [F.sum(f"_add_{n}").alias(f"e{n}") for n in extras]
    row = base.agg(*aggs).first()
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    right = {n: np.array([row[f"r{n}_{i}"] or 0.0 for i in range(p)]) for n in rights}
    return gram, right, {n: row[f"e{n}"] for n in extras}


def _wide_sums(frame, columns, weight, rights, extras):
    p = len(columns)
    rn, en = list(rights), list(extras)
    base = frame.select(
        *columns,
        (weight if weight is not None else F.lit(1.0)).alias("_w"),
        *[c.alias(f"_rhs_{n}") for n, c in rights.items()],
        *[c.alias(f"_add_{n}") for n, c in extras.items()],
    )
    cols = list(columns)

    def partial(batches):
        total = None
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            g = (x * pdf["_w"].to_numpy(dtype=float)[:, None]).T @ x
            flat = [g.ravel()]
            flat += [x.T @ pdf[f"_rhs_{n}"].to_numpy(dtype=float) for n in rn]
            flat += [np.array([pdf[f"_add_{n}"].to_numpy(dtype=float).sum()]) for n in en]
            flat = np.concatenate(flat)
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total), dtype="int32"), "v": total})

    rows = base.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(p * p + len(rn) * p + len(en))
    for r in rows:
        flat[r["k"]] = r["v"]
    gram = flat[: p * p].reshape(p, p)
    right = {n: flat[p * p + i * p : p * p + (i + 1) * p] for i, n in enumerate(rn)}
    return gram, right, {n: float(flat[p * p + len(rn) * p + i]) for i, n in enumerate(en)}


def solve(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and (pseudo-)inverse of the cross-product matrix."""
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    return inverse @ right, inverse


def cluster_meat(design: Design, residual: Column, cluster: str) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of the summed scores, and the number of clusters."""
    scores = design.frame.select(ref(cluster).alias("_g"), residual.alias("_u"), *design.columns)
    summed = scores.groupBy("_g").agg(*[F.sum(F.col("_u") * F.col(c)).alias(c) for c in design.columns])
    gram, _, extra = weighted_sums(summed, design.columns, None, {}, {"g": F.lit(1)})
    return gram, int(extra["g"])


def hac_meat(design: Design, residual: Column, time: str, lags: int) -> np.ndarray:
    """Newey-West sum of lagged score products with Bartlett weights; ``time`` is a gap-free integer index.

    Lagged rows meet through an equi-join on the shifted index, so no window over the whole series is needed.
    """
    scores = design.frame.select(
        ref(time).cast("long").alias("_t"), *[(residual * F.col(c)).alias(c) for c in design.columns]
    )
    meat, _, _ = weighted_sums(scores, design.columns, None, {}, {})
    p = design.p
    shifted = scores.select(
        F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("_lag"), "_t", *[F.col(c).alias(f"_l{c}") for c in design.columns]
    ).withColumn("_t", F.col("_t") + F.col("_lag"))
    joined = scores.join(shifted, "_t")
    weight = 1 - F.col("_lag") / (lags + 1)
    row = joined.agg(
        *[
            F.sum(weight * F.col(a) * F.col(f"_l{b}")).alias(f"m{i}_{j}")
            for i, a in enumerate(design.columns)
            for j, b in enumerate(design.columns)
        ]
    ).first()
    cross = np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])
    return meat + cross + cross.T
