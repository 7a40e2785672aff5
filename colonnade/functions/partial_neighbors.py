"""Nearest donors of partly known vectors, found in one search whatever patterns of gaps occur.

A tree built from a small sample cuts space into leaves: an inner node parts the known values of one column and sends
rows that lack the column to a third child (the sample only shapes the cut). Each leaf states the bounds of its known
values and how many of its rows know each column, which bounds the distance of any of its rows to a partly known vector
from below. A query first searches one promising leaf per column it lacks; the k-th distances found there select the other
leaves that could hold a nearer donor. Two rounds of search serve all patterns and all columns together.

Where few patterns of gaps occur, a query and the donors that share the same columns with it lie in a common space of just
these columns. All spaces are searched together, each with a cut of its own, so a column that a query lacks never decides
which leaves it has to visit, and vectors that are equal in a space are folded.

Distance is taken over the columns that both rows know, scaled up to the number of columns. Unknown coordinates are NaN.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.neighbors import BLOCK_CELLS, LEAF_ROWS, MAX_DEPTH, QUERIES_PER_TASK, SALTS, SAMPLE_ROWS, Cut, nearest_in_block, smallest_ids
from colonnade.session import keep, materialise

# Leaves times columns; the bounds of all leaves travel with the tasks.
LEAF_NUMBERS = 500_000
DONORS_PER_TASK = 50_000


class PartialCut:
    """Flat tree over partly known rows: children of a node are (at most the value, above it, unknown); leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.value, self.child, self.depth = [0], [0.0], [[0, 0, 0]], 0
        queue = [(-len(sample), 0, 0)]
        rows = {0: sample}
        count = 1
        while queue and count < leaves:
            _, node, depth = heapq.heappop(queue)
            split = self._split(rows[node])
            if split is None:
                continue
            dim, value = split
            here = rows.pop(node)
            side = np.where(np.isnan(here[:, dim]), 2, here[:, dim] > value)
            self.dim[node], self.value[node] = dim, value
            for s in range(3):
                new = len(self.dim)
                self.child[node][s] = new
                self.dim.append(0)
                self.value.append(0.0)
                self.child.append([new] * 3)
                rows[new] = here[side == s]
                heapq.heappush(queue, (-len(rows[new]), new, depth + 1))
            self.depth = max(self.depth, depth + 1)
            count += 2
        self.dim, self.value, self.child = np.array(self.dim), np.array(self.value), np.array(self.child)

    @staticmethod
    def _split(rows: np.ndarray) -> tuple[int, float] | None:
        """Column of the widest spread and a value that leaves rows on both sides, or a column that only some rows know."""
        known = ~np.isnan(rows)
        if len(rows) < 2 or not known.any():
            return None
        high, low = np.where(known, rows, -np.inf).max(0), np.where(known, rows, np.inf).min(0)
        spread = np.where(known.any(0), high, 0.0) - np.where(known.any(0), low, 0.0)
        dim = int(np.argmax(spread))
        if spread[dim] > 0:
            values = rows[known[:, dim], dim]
            middle = float(np.median(values))
            return dim, middle if middle < high[dim] else float(values[values < high[dim]].max())
        mixed = np.flatnonzero(known.any(0) & ~known.all(0))
        return (int(mixed[0]), np.inf) if len(mixed) else None

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(x), dtype=int), np.arange(len(x))
        for _ in range(self.depth):
            value = x[at, self.dim[node]]
            node = self.child[node, np.where(np.isnan(value), 2, value > self.value[node])]
        return node


class Leaves:
    """What is known of the donors of each leaf, and the bound it gives on their distance to partly known vectors."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.names, self.known, self.columns = names, known, known.shape[1]
        self.whole, self.some = known == rows[:, None], known > 0
        self.low, self.high = np.where(self.whole, low, -np.inf), np.where(self.whole, high, np.inf)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least possible distance, columns surely shared) of every vector to every leaf; infinite if nothing can be shared.

        Only columns that all rows of the leaf know add to the distance, and the most columns any row can share scale it.
        """
        has = ~np.isnan(x)
        at = np.where(has, x, 0.0)[:, None, :]
        gap = np.where(has[:, None, :], np.maximum(np.maximum(self.low[None] - at, at - self.high[None]), 0.0), 0.0)
        most = has.astype(float) @ self.some.T.astype(float)
        bound = np.sqrt((gap * gap).sum(2) * self.columns / np.maximum(most, 1.0))
        return np.where(most > 0, bound, np.inf), has.astype(float) @ self.whole.T.astype(float)

    def blocks(self, x: np.ndarray):
        size = max(1, BLOCK_CELLS // max(1, self.low.size))
        for lo in range(0, len(x), size):
            yield lo, x[lo : lo + size], *self.bounds(x[lo : lo + size])


def _place(cut: PartialCut):
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(cut.leaf(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    return F.pandas_udf(place, T.IntegerType())


def _first_leaves(leaves: Leaves, k: int):
    def first(v: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        if not len(v):
            return pd.Series(out, dtype=object)
        for _, x, bound, sure in leaves.blocks(np.stack(v.to_numpy())):
            chosen = np.full(x.shape, -1)
            for i in range(x.shape[1]):
                possible = (leaves.known[:, i] > 0)[None] & np.isfinite(bound)
                good = possible & (leaves.known[:, i] >= k)[None] & (sure > 0)
                good = np.where(good.any(axis=1)[:, None], good, possible)
                near = np.where(good, bound, np.inf)
                tied = good & (near <= near.min(axis=1)[:, None])
                pick = np.where(tied, sure, -1.0).argmax(axis=1)
                chosen[:, i] = np.where(np.isnan(x[:, i]) & good.any(axis=1), leaves.names[pick], -1)
            out += [np.unique(row[row >= 0]).astype("int32") for row in chosen]
        return pd.Series(out)

    return F.pandas_udf(first, T.ArrayType(T.IntegerType()))


def _other_leaves(leaves: Leaves):
    def others(v: pd.Series, seen: pd.Series, limits: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        if not len(v):
            return pd.Series(out, dtype=object)
        reach = np.stack(limits.to_numpy()) * (1 + 1e-12) + 1e-300
        for lo, x, bound, _ in leaves.blocks(np.stack(v.to_numpy())):
            near = np.zeros(bound.shape, dtype=bool)
            for i in range(x.shape[1]):
                near |= np.isnan(x[:, i])[:, None] & (leaves.known[:, i] > 0)[None] & (bound <= reach[lo : lo + len(x), i][:, None]) & np.isfinite(bound)
            for row, old in zip(near, seen.iloc[lo : lo + len(x)], strict=True):
                out.append(np.setdiff1d(leaves.names[row], old).astype("int32"))
        return pd.Series(out)

    return F.pandas_udf(others, T.ArrayType(T.IntegerType()))


def nearest_partial(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, donor row, distance) of the k nearest donors of each query, ties by the smaller id.

    Matrix products shortlist every donor that is, within rounding, among the k nearest; the distances of the shortlist
    come from the differences. Pairs that share no column are no pairs.
    """
    p = q.shape[1]
    has_q, has_r = ~np.isnan(q), ~np.isnan(r)
    mq, mr = has_q.astype(float), has_r.astype(float)
    q0, r0 = np.where(has_q, q, 0.0), np.where(has_r, r, 0.0)
    shared = mq @ mr.T
    close = shared > 0
    if len(r) > k:
        squares = (q0 * q0) @ mr.T + mq @ (r0 * r0).T
        d2 = np.where(close, (squares - 2 * q0 @ r0.T) * p / np.maximum(shared, 1.0), np.inf)
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * p * ((q0 * q0).sum(1) + (r0 * r0).sum(1).max()) + 1e-300
        close &= d2 <= (limit + slack)[:, None]
    qi, ri = np.nonzero(close)
    gap = np.where(has_q[qi] & has_r[ri], r0[ri] - q0[qi], 0.0)
    d = np.sqrt((gap * gap).sum(1) * p / shared[qi, ri])
    order = np.lexsort((ids[ri], d, qi))
    qi, ri, d = qi[order], ri[order], d[order]
    top = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[top], ri[top], d[top]


FOUND = "qid bigint, target int, rid bigint, distance double, value double"


def _search(k: int):
    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "target": [], "rid": [], "distance": [], "value": []})]
        if len(queries) and len(refs):
            q, r = np.stack(queries["asked"].to_numpy()), np.stack(refs["vec"].to_numpy())
            qids, ids = queries["qid"].to_numpy(), refs["rid"].to_numpy()
            for i in range(q.shape[1]):
                have, want = np.flatnonzero(~np.isnan(r[:, i])), np.flatnonzero(np.isnan(q[:, i]))
                size = max(1, BLOCK_CELLS // max(1, len(have)))
                for lo in range(0, len(want) if len(have) else 0, size):
                    part = want[lo : lo + size]
                    qi, ri, d = nearest_partial(q[part], r[have], ids[have], k)
                    out.append(pd.DataFrame({"qid": qids[part[qi]], "target": i, "rid": ids[have[ri]], "distance": d, "value": r[have[ri], i]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return run


# Patterns of gaps, and spaces of shared columns, up to which the spaces are searched one by one in the same jobs.
PATTERNS = 16
MASK_COLUMNS = 30
SPACES = 100


def _spaces(masks: list[int], columns: int) -> list[tuple[int, int, int]]:
    """Every (known to the query, shared, wanted column) that two of the patterns ``masks`` give, columns as bits."""
    return sorted({(q, q & d, t) for q in masks for d in masks if q & d for t in range(columns) if d >> t & 1 and not q >> t & 1})


def _by_space(run):
    """Apply ``run(space, positions)`` to the rows of each space of a batch."""
    def each(space: pd.Series, out: list) -> list:
        at = space.to_numpy()
        for s in np.unique(at):
            rows = np.flatnonzero(at == s)
            for i, x in zip(rows, run(int(s), rows), strict=True):
                out[i] = x
        return out

    return each


def _donors_by_space(queries: DataFrame, refs: DataFrame, masks: list[int], columns: int, k: int, leaf_rows: int) -> DataFrame:
    """The donors of ``nearest_donors``, searched in the spaces that queries and donors share."""
    spark = queries.sparkSession
    spaces = _spaces(masks, columns)
    asking = spark.createDataFrame([(q, i, s, t) for i, (q, s, t) in enumerate(spaces)], "mask long, space int, shared long, target int")
    giving = spark.createDataFrame([(d, i, s, t) for i, (q, s, t) in enumerate(spaces) for d in masks if d & q == s and d >> t & 1], "mask long, space int, shared long, target int")
    shown = F.array(*[F.when(F.col("shared").bitwiseAND(1 << i) != 0, F.col("vec")[i]).otherwise(0.0) for i in range(columns)])
    asks = queries.withColumn("mask", _mask(columns)).join(F.broadcast(asking), "mask")
    asks = keep(asks.select("qid", "space", "target", shown.alias("point"), F.pmod(F.xxhash64("qid"), F.lit(SALTS)).alias("_salt")))
    donors = refs.withColumn("mask", _mask(columns)).join(F.broadcast(giving), "mask")
    donors = donors.select("space", shown.alias("point"), "rid", F.element_at("vec", F.col("target") + 1).alias("value"))
    donors = keep(smallest_ids(donors, k, ("space", "point")))
    sizes = {r["space"]: r["n"] for r in donors.groupBy("space").agg(F.count("*").alias("n")).collect()}
    n = max(1, sum(sizes.values()))
    seen = donors.sample(min(1.0, 4 * SAMPLE_ROWS / n), seed=7).select("space", "point").limit(8 * SAMPLE_ROWS).toPandas()
    seen = {s: np.stack(part.to_numpy()) for s, part in seen.groupby("space")["point"]}
    cuts, offsets, total = {}, {}, 0
    for s in sizes:
        depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(sizes[s] / leaf_rows, 1)))))) if s in seen else 0
        cuts[s], offsets[s] = Cut(seen.get(s, np.zeros((1, columns))), depth), total
        total += 2**depth
    wide = {s: columns / bin(shared).count("1") for s, (_, shared, _) in enumerate(spaces)}

    def leaf(space: pd.Series, v: pd.Series) -> pd.Series:
        run = _by_space(lambda s, rows: cuts[s].leaf(np.stack(v.iloc[rows].to_numpy())) + offsets[s])
        return pd.Series(run(space, [0] * len(v)), dtype="int32")

    def touch(space: pd.Series, v: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
        def near(s: int, rows: np.ndarray):
            reach = bound.iloc[rows].to_numpy(dtype=float) / np.sqrt(wide[s])
            found = cuts[s].touched(np.stack(v.iloc[rows].to_numpy()), own.iloc[rows].to_numpy() - offsets[s], reach)
            return [x + np.int32(offsets[s]) for x in found]

        return pd.Series(_by_space(near)(space, [None] * len(v)), dtype=object)

    leaf, touch = F.pandas_udf(leaf, T.IntegerType()), F.pandas_udf(touch, T.ArrayType(T.IntegerType()))

    def search(points: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({n: pd.Series([], dtype=object) for n in ("space", "point", "rid", "distance", "value")})]
        if len(points) and len(refs):
            s, asked = int(refs["space"].iloc[0]), points["point"].to_numpy()
            q, r, ids, values = np.stack(asked), np.stack(refs["point"].to_numpy()), refs["rid"].to_numpy(), refs["value"].to_numpy()
            size = max(1, BLOCK_CELLS // len(r))
            for i in range(0, len(q), size):
                qi, ri, d = nearest_in_block(q[i : i + size], r, ids, k, columns, bin(spaces[s][1]).count("1"))
                out.append(pd.DataFrame({"space": s, "point": asked[qi + i], "rid": ids[ri], "distance": d, "value": values[ri]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    donors = keep(donors.withColumn("leaf", leaf("space", "point")))
    points = asks.select("space", "point").distinct().where(F.col("space").isin(list(sizes)))
    points = keep(points.withColumn("own", leaf("space", "point")))

    def visit(asked: DataFrame) -> DataFrame:
        # As in ``knn_join``: crowded leaves are split by a hash of the point.
        parts = F.broadcast(keep(asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("_parts"))))  # one row a leaf
        left = asked.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("point"), F.col("_parts")).cast("int"))
        right = donors.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        return (
            left.select("leaf", "part", "point").groupBy("leaf", "part")
            .cogroup(right.select("leaf", "part", "space", "point", "rid", "value").groupBy("leaf", "part"))
            .applyInPandas(search, "space int, point array<double>, rid bigint, distance double, value double")
        )

    first = keep(visit(points.select(F.col("own").alias("leaf"), "point")))
    bounds = first.groupBy("space", "point").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_b"))
    others = points.join(bounds, ["space", "point"], "left").select("point", F.explode(touch("space", "point", "own", "_b")).alias("leaf"))
    best = F.row_number().over(W.partitionBy("space", "point").orderBy("distance", "rid"))
    top = first.unionByName(visit(keep(others))).withColumn("_r", best).where(F.col("_r") <= k).drop("_r")
    # A point that many queries share meets them in parts.
    top = top.join(asks.select("space", "point", "_salt").distinct(), ["space", "point"])
    return asks.join(top, ["space", "point", "_salt"]).select("qid", "target", "rid", "distance", "value")


def _mask(columns: int):
    """The known columns of ``vec`` as bits."""
    bits = [F.when(~F.isnan(F.col("vec")[i]), 1 << i).otherwise(0) for i in range(columns)]
    return sum(bits, F.lit(0)).cast("long")


def nearest_donors(rows: DataFrame, columns: int, k: int, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, vec) and their donors (qid, target, rid, distance, value).

    ``rows`` has (id bigint, vec array<double> of ``columns`` numbers, NaN where unknown). Each distinct vector with a gap is
    a query; for every column it lacks, its donors are the k nearest rows that know the column and share another one, ties
    by the smaller id. Rows without an id, or without any known value, are no donors.
    """
    unknown = F.exists("vec", lambda x: F.isnan(x))
    queries = materialise(rows.where(unknown).select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()))
    refs = rows.where(F.col("id").isNotNull() & F.exists("vec", lambda x: ~F.isnan(x)))
    refs = keep(smallest_ids(refs.select(F.col("id").alias("rid"), "vec"), k))
    n = refs.count()
    if not n:
        return queries, queries.sparkSession.createDataFrame([], FOUND)
    ranked = F.row_number().over(W.partitionBy("qid", "target").orderBy("distance", "rid"))  # few times k rows a task
    if columns <= MASK_COLUMNS:
        masks = [r["mask"] for r in rows.select(_mask(columns).alias("mask")).distinct().limit(PATTERNS + 1).collect()]
        if len(masks) <= PATTERNS and 0 < len(_spaces(masks, columns)) <= SPACES:
            found = _donors_by_space(queries, refs, masks, columns, k, leaf_rows)
            return queries, found.withColumn("_r", ranked).where(F.col("_r") <= k).drop("_r")
    share = min(1.0, SAMPLE_ROWS / n)
    sample = refs if share == 1.0 else refs.sample(share, seed=7)
    shown = np.stack(sample.select("vec").limit(2 * SAMPLE_ROWS).toPandas()["vec"].to_numpy())
    cut = PartialCut(shown, int(max(1, min(n / leaf_rows, LEAF_NUMBERS / columns))))
    refs = keep(refs.withColumn("leaf", _place(cut)("vec")))
    known = [F.when(~F.isnan(F.col("vec")[i]), F.col("vec")[i]) for i in range(columns)]
    facts = [f(x).alias(f"{name}{i}") for i, x in enumerate(known) for name, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    stats = refs.groupBy("leaf").agg(F.count("*").alias("rows"), *facts).toPandas()  # one row a leaf
    of = {c: stats[[f"{c}{i}" for i in range(columns)]].to_numpy(dtype=float) for c in "nab"}
    leaves = Leaves(stats["leaf"].to_numpy(), stats["rows"].to_numpy(), of["n"], of["a"], of["b"])
    chunks = keep(refs.groupBy("leaf").agg(F.ceil(F.count("*") / DONORS_PER_TASK).cast("int").alias("_chunks")))

    def visit(asked: DataFrame) -> DataFrame:
        # Crowded leaves: their donors are dealt to chunks, their queries to parts; a part meets every chunk.
        parts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("_parts"))
        parts = F.broadcast(keep(parts.join(F.broadcast(chunks), "leaf")))  # one row a leaf
        left = asked.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int"))
        left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        right = refs.join(parts, "leaf").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("_chunks")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        keys = ["leaf", "part", "chunk"]
        return (
            left.select(*keys, "qid", F.col("vec").alias("asked")).groupBy(*keys)
            .cogroup(right.select(*keys, "rid", "vec").groupBy(*keys)).applyInPandas(_search(k), FOUND)
        )

    queries_at = keep(queries.withColumn("home", _first_leaves(leaves, k)("vec")))
    first = keep(visit(queries_at.select("qid", "vec", F.explode("home").alias("leaf"))).withColumn("_r", ranked).where(F.col("_r") <= k).drop("_r"))
    limits = first.groupBy("qid", "target").agg(F.when(F.count("*") >= k, F.max("distance")).alias("b")).groupBy("qid").agg(*[
        F.max(F.when(F.col("target") == i, F.col("b"))).alias(f"b{i}") for i in range(columns)])
    reach = F.array(*[F.coalesce(F.col(f"b{i}"), F.lit(float("inf"))) for i in range(columns)])
    asked = queries_at.join(limits, "qid", "left").select("qid", "vec", F.explode(_other_leaves(leaves)("vec", "home", reach)).alias("leaf"))
    found = first.unionByName(visit(keep(asked)))
    return queries, found.withColumn("_r", ranked).where(F.col("_r") <= k).drop("_r")
