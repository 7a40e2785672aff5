"""Model-based imputation: nearest neighbours, chained equations, multiple imputation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import free_names, normalise_missing, numeric_columns, ref
from colonnade.functions.gram import weighted_sums
from colonnade.functions.partial_neighbors import nearest_donors
from colonnade.session import broadcast_if_small, keep, materialise


def _usable(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"n{i}"]]


def impute_knn(df: DataFrame, row_id: str, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Mean of the k nearest donors that know the value; distance over the shared known columns, scaled up for gaps.

    One search serves all patterns of gaps and all columns (``functions/partial_neighbors.py``); equal rows ask once. A value
    without any donor gets the column mean. Ties go to the smaller row id; rows without an id are filled but give nothing.
    Complete rows pass through without a shuffle.
    """
    df = normalise_missing(df)
    cols = _usable(df, list(cols or [c for c in numeric_columns(df) if c != row_id]))
    if not cols:
        return df
    p = len(cols)
    vec_name, *guesses = free_names(df.columns, "vec", *[f"g{i}" for i in range(p)])
    vec = F.array(*[F.coalesce(ref(c).cast("double"), F.lit(float("nan"))) for c in cols])
    rows = keep(df.select(ref(row_id).cast("long").alias("id"), vec.alias("vec")))
    queries, found = nearest_donors(rows, p, k)
    means = df.agg(*[F.avg(ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    wide = found.groupBy("qid").agg(*[F.avg(F.when(F.col("target") == i, F.col("value"))).alias(f"g{i}") for i in range(p)])
    named = queries.join(wide, "qid", "left").select(
        F.col("vec").alias(vec_name), *[F.coalesce(f"g{i}", F.lit(means[f"m{i}"])).alias(guesses[i]) for i in range(p)])
    gap = F.lit(False)
    for c in cols:
        gap = gap | ref(c).isNull()
    filled = df.where(gap).withColumn(vec_name, vec).join(named, vec_name, "left")

    def shown(guess: Sequence[str | None]) -> list[Column]:
        value = {c: F.coalesce(ref(c).cast("double"), *([ref(g)] if g else [])).alias(c) for c, g in zip(cols, guess, strict=True)}
        return [value.get(c, ref(c)) for c in df.columns]

    return df.where(~gap).select(*shown([None] * p)).unionByName(filled.select(*shown(guesses)))


def bayesian_ridge(gram: np.ndarray, right: np.ndarray, yy: float, n: float, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """Evidence maximisation on centred cross products; returns (coefficients, noise precision, posterior covariance)."""
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    proj = vectors.T @ right
    alpha, lam = 1.0 / max(yy / n, 1e-300), 1.0
    # Weak Gamma priors on both precisions.
    prior = 1e-6
    coef = np.zeros(len(right))
    for _ in range(rounds):
        old = coef
        coef = vectors @ (proj / (values + lam / alpha))
        rss = max(yy - 2 * coef @ right + coef @ gram @ coef, 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * prior) / (float(coef @ coef) + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if np.sum(np.abs(old - coef)) < 1e-3 * 1e-3:
            break
    cov = vectors @ np.diag(1 / (lam + alpha * values)) @ vectors.T
    return coef, alpha, cov


# Cross products of all occurring gap patterns that may come to the driver, in numbers; beyond it patterns are dealt with
# column by column.
PATTERN_NUMBERS = 4_000_000


class GapPatterns:
    """Cross products per gap pattern, and for every pattern the current cells as affine functions of what was summed.

    Within a pattern (which columns a row lacks) every filled cell is the same affine function of the row's other numbers,
    so a round of regressions changes small matrices only: the cross products of the filled rows follow from those summed.
    ``inputs`` counts the numbers a function may use: the constant, the columns, and draws if there are any.
    """

    def __init__(self, missing: dict[str, list[int]], grams: dict[str, np.ndarray], columns: int, inputs: int):
        self.missing, self.grams, self.columns = missing, grams, columns
        start = np.zeros((columns + 1, inputs))
        start[:, : columns + 1] = np.eye(columns + 1)
        self.maps = {k: start.copy() for k in missing}
        self.current = {k: start @ grams[k] @ start.T for k in missing}

    def regress(self, i: int):
        """Ridge of column ``i`` on the others over the rows that know it: means, coefficients, precision, covariance, others."""
        total = sum(g for k, g in self.current.items() if i not in self.missing[k])
        n, means = total[0, 0], total[0, 1:] / total[0, 0]
        centred = total[1:, 1:] - n * np.outer(means, means)
        others = [j for j in range(self.columns) if j != i]
        coef, alpha, cov = bayesian_ridge(centred[np.ix_(others, others)], centred[others, i], centred[i, i], n)
        return means, coef, alpha, cov, others

    def fill(self, i: int, means: np.ndarray, coef: np.ndarray, others: list[int], draw: tuple[int, float] | None = None) -> None:
        """Replace column ``i`` where it is missing; ``draw`` adds a multiple of an input."""
        for k, gaps in self.missing.items():
            if i not in gaps:
                continue
            a = self.maps[k]
            line = coef @ a[[j + 1 for j in others]]
            line[0] += means[i] - coef @ means[others]
            if draw:
                line[draw[0]] += draw[1]
            a[i + 1] = line
            self.current[k] = a @ self.grams[k] @ a.T


def _patterns(df: DataFrame, cols: Sequence[str], row_id: str | None = None):
    """Centred values (zero where missing) under free names, the pattern of each row, and what describes the columns."""
    p = len(cols)
    stats = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[F.count_if(ref(c).isNull()).alias(f"g{i}") for i, c in enumerate(cols)],
                   *[F.max(F.abs(ref(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    todo = sorted((i for i in range(p) if stats[f"g{i}"]), key=lambda i: stats[f"g{i}"])
    names = free_names(df.columns, *[f"_y{i}" for i in range(p)], "_pattern", "_maps", "_chain")
    values = {names[i]: F.coalesce(ref(c).cast("double") - F.lit(float(stats[f"m{i}"])), F.lit(0.0)) for i, c in enumerate(cols)}
    pattern = F.concat(*[F.when(ref(cols[i]).isNull(), "1").otherwise("0") for i in todo]) if todo else F.lit("")
    return stats, todo, names, df.withColumns(values | {names[p]: pattern})


def _gram_rows(rows: DataFrame, by: Sequence[str], inputs: Sequence[Column]) -> DataFrame:
    pairs = [F.sum(inputs[i] * inputs[j]) for i in range(len(inputs)) for j in range(i, len(inputs))]
    return rows.groupBy(*by).agg(F.array(*pairs).alias("_g"))


def _square(flat, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = flat
    return g + np.triu(g, 1).T


def _many_patterns(rows: DataFrame, pattern: str, size: int) -> bool:
    most = PATTERN_NUMBERS // (size * size)
    return rows.select(pattern).distinct().limit(most + 1).count() > most


def _applied(maps: str, line: int, width: int, inputs: Sequence[Column]) -> Column:
    """Row ``line`` of the flattened matrix in column ``maps`` times the inputs."""
    out = F.lit(0.0)
    for k, x in enumerate(inputs):
        out = out + F.element_at(maps, line * width + k + 1) * x
    return out


def impute_iterative(df: DataFrame, cols: Sequence[str] | None = None, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained equations: every incomplete column is regressed on the others, round after round, until no cell moves much.

    One pass sums the cross products per gap pattern; the rounds then run on those matrices (``GapPatterns``), each with one
    light pass over the incomplete rows for the largest move. Columns go from the fewest gaps to the most. Tables with so
    many patterns that their matrices would not fit the driver take one regression at a time instead, with equal results.
    """
    df = normalise_missing(df)
    cols = _usable(df, list(cols or numeric_columns(df)))
    p = len(cols)
    stats, todo, names, rows = _patterns(df, cols)
    if not todo or p < 2:
        return df
    pattern, maps = names[p], names[p + 1]
    rows = keep(rows)
    limit = tol * max(stats[f"a{i}"] for i in range(p))
    if _many_patterns(rows, pattern, p + 1):
        return _column_by_column(df, cols, todo, stats, max_iter, limit)
    inputs = [F.lit(1.0), *[F.col(names[i]) for i in range(p)]]
    found = _gram_rows(rows, [pattern], inputs).collect()
    missing = {r[pattern]: [i for i, c in zip(todo, r[pattern], strict=True) if c == "1"] for r in found}
    state = GapPatterns(missing, {r[pattern]: _square(r["_g"], p + 1) for r in found}, p, p + 1)

    def joined(matrices: dict[str, np.ndarray]) -> DataFrame:
        spark = df.sparkSession
        table = spark.createDataFrame([(k, m[1:].ravel().tolist()) for k, m in matrices.items()], f"{pattern} string, {maps} array<double>")
        return rows.join(broadcast_if_small(table), pattern, "left")

    for _ in range(max_iter):
        before = {k: m.copy() for k, m in state.maps.items()}
        for i in todo:
            means, coef, _, _, others = state.regress(i)
            state.fill(i, means, coef, others)
        steps = joined({k: state.maps[k] - before[k] for k in missing if missing[k]}).where(F.col(maps).isNotNull())
        moves = [F.max(F.abs(_applied(maps, i, p + 1, inputs))) for i in todo]
        moved = steps.agg(F.greatest(*moves, F.lit(0.0)).alias("d")).first()["d"]
        if moved < limit:
            break
    out = joined({k: m for k, m in state.maps.items() if missing[k]})
    filled = {cols[i]: F.coalesce(ref(cols[i]).cast("double"), F.lit(float(stats[f"m{i}"])) + _applied(maps, i, p + 1, inputs)) for i in range(p)}
    return out.select(*[filled[c].alias(c) if c in filled else ref(c) for c in df.columns])


def _column_by_column(df: DataFrame, cols: list[str], todo: list[int], stats, max_iter: int, limit: float) -> DataFrame:
    """The same rounds with one aggregate per column, for tables of very many gap patterns."""
    p = len(cols)
    work = materialise(df.select(
        "*", *[F.coalesce(ref(c).cast("double"), F.lit(float(stats[f"m{i}"]))).alias(f"_v{i}") for i, c in enumerate(cols)],
        *[ref(c).isNull().alias(f"_g{i}") for i, c in enumerate(cols)],
    ))
    for _ in range(max_iter):
        before = [f"_b{i}" for i in todo]
        work = work.withColumns({f"_b{i}": F.col(f"_v{i}") for i in todo})
        for i in todo:
            others = [j for j in range(p) if j != i]
            known = work.where(~F.col(f"_g{i}"))
            m = known.agg(F.count("*").alias("n"), *[F.avg(f"_v{j}").alias(f"m{j}") for j in range(p)]).first()
            centred = known.select(*[(F.col(f"_v{j}") - F.lit(m[f"m{j}"])).alias(f"c{j}") for j in range(p)])
            g, r, e = weighted_sums(centred, [f"c{j}" for j in others], None, {"y": F.col(f"c{i}")}, {"yy": F.col(f"c{i}") * F.col(f"c{i}")})
            coef, _, _ = bayesian_ridge(g, r["y"], e["yy"], m["n"])
            guess = F.lit(float(m[f"m{i}"]))
            for b, j in zip(coef, others, strict=True):
                guess = guess + F.lit(float(b)) * (F.col(f"_v{j}") - F.lit(m[f"m{j}"]))
            work = work.withColumn(f"_v{i}", F.when(F.col(f"_g{i}"), guess).otherwise(F.col(f"_v{i}")))
        work = materialise(work)
        moved = work.agg(F.greatest(*[F.max(F.abs(F.col(f"_v{i}") - F.col(b))) for i, b in zip(todo, before, strict=True)], F.lit(0.0)).alias("d")).first()["d"]
        if moved < limit:
            break
    return work.select(*[F.col(f"_v{cols.index(c)}").alias(c) if c in cols else ref(c) for c in df.columns])


def multiple_imputation(df: DataFrame, row_id: str, cols: Sequence[str] | None = None, m: int = 5, max_iter: int = 10, seed: int = 42) -> DataFrame:
    """``m`` completed copies with drawn values, told apart by ``_imputation``.

    Every regression draws its coefficients from their posterior and every cell a normal error, which depends on row id,
    seed, copy, round and column only, so a recomputed task repeats it. One pass a round over the rows with gaps sums, for all
    copies together and per gap pattern, the cross products of cells and errors; the round's regressions run on these and on
    those of the complete rows, summed once, and one checkpoint keeps the new cells of all copies. Complete rows are copied at
    the end only. Tables of more gap patterns than the driver can hold are refused.
    """
    df = normalise_missing(df)
    cols = _usable(df, list(cols or [c for c in numeric_columns(df) if c != row_id]))
    p = len(cols)
    stats, todo, names, rows = _patterns(df, cols)
    pattern, maps, chain = names[p:]
    copies = F.explode(F.sequence(F.lit(1), F.lit(m)))
    if not todo or p < 2:
        return df.withColumn("_imputation", copies)
    size = 1 + p + len(todo)
    if _many_patterns(rows, pattern, size * m):
        raise ValueError("too many patterns of gaps for multiple imputation; choose fewer columns")
    # A complete row is the same in every copy and every round: its cross products are summed once, without errors.
    gaps = F.lit(False)
    for i in todo:
        gaps = gaps | ref(cols[i]).isNull()
    rows = keep(rows)
    whole = rows.where(~gaps)
    fixed = {}
    for r in _gram_rows(whole, [pattern], [F.lit(1.0), *[F.col(names[i]) for i in range(p)]]).collect():
        fixed[r[pattern]] = np.zeros((size, size))
        fixed[r[pattern]][: p + 1, : p + 1] = _square(r["_g"], p + 1)
    work = materialise(rows.where(gaps).withColumn(chain, copies))
    for step in range(max_iter):
        draws = []
        for i in todo:
            u = [(F.pmod(F.xxhash64(ref(row_id), F.lit(seed), F.col(chain), F.lit(step), F.lit(i), F.lit(s)), F.lit(2**52)) + 0.5) / float(2**52) for s in (0, 1)]
            normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
            draws.append(F.when(ref(cols[i]).isNull(), normal).otherwise(0.0))
        drawn = free_names(work.columns, *[f"_z{i}" for i in todo])
        with_draws = work.withColumns(dict(zip(drawn, draws, strict=True)))
        inputs = [F.lit(1.0), *[F.col(names[i]) for i in range(p)], *[F.col(z) for z in drawn]]
        found = _gram_rows(with_draws, [chain, pattern], inputs).collect()
        table = []
        for copy in range(1, m + 1):
            mine = fixed | {r[pattern]: _square(r["_g"], size) for r in found if r[chain] == copy}
            missing = {k: [i for i, c in zip(todo, k, strict=True) if c == "1"] for k in mine}
            state = GapPatterns(missing, mine, p, size)
            rng = np.random.default_rng([seed, copy, step])
            for at, i in enumerate(todo):
                means, coef, alpha, cov, others = state.regress(i)
                state.fill(i, means, rng.multivariate_normal(coef, cov, method="svd"), others, (1 + p + at, 1 / math.sqrt(alpha)))
            table += [(copy, k, a[1:].ravel().tolist()) for k, a in state.maps.items() if missing[k]]
        moves = df.sparkSession.createDataFrame(table, f"{chain} int, {pattern} string, {maps} array<double>")
        moved = with_draws.join(broadcast_if_small(moves), [chain, pattern], "left")
        new = [F.when(ref(cols[i]).isNull(), _applied(maps, i, size, inputs)).otherwise(F.col(names[i])).alias(names[i]) if i in todo else F.col(names[i]) for i in range(p)]
        work = materialise(moved.select(*[ref(c) for c in df.columns], *new, pattern, chain))
    work = work.unionByName(whole.withColumn(chain, copies).select(*work.columns))
    filled = {c: F.coalesce(ref(c).cast("double"), F.lit(float(stats[f"m{i}"])) + F.col(names[i])) for i, c in enumerate(cols)}
    return work.select(*[filled[c].alias(c) if c in filled else ref(c) for c in df.columns], F.col(chain).alias("_imputation"))
