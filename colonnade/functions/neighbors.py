"""Exact k-nearest-neighbour join without comparing all pairs.

Space is cut into the leaves of a k-d tree built from a small sample (the sample only shapes the cut). A query first
searches its own leaf; the k-th distance found there bounds a ball, and only leaves that touch the ball are searched
next. Equal vectors are folded before the search, so a hot value costs no more than one row, and crowded leaves are
shared by several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.session import keep

LEAF_ROWS = 2000
MAX_DEPTH = 16
SAMPLE_ROWS = 50_000
QUERIES_PER_TASK = 20_000
SALTS = 32


class Cut:
    """A complete k-d tree as flat arrays: node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        nodes = 2**depth - 1
        self.dim = np.zeros(nodes, dtype=int)
        self.value = np.zeros(nodes)
        width = sample.shape[1]
        self.low = np.full((2**depth, width), -np.inf)
        self.high = np.full((2**depth, width), np.inf)
        self._grow(sample, 0, 0, np.full(width, -np.inf), np.full(width, np.inf))

    def _grow(self, rows: np.ndarray, node: int, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            leaf = node - (2**self.depth - 1)
            self.low[leaf], self.high[leaf] = low, high
            return
        dim = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) else 0
        value = float(np.median(rows[:, dim])) if len(rows) else 0.0
        below = rows[rows[:, dim] < value, dim] if len(rows) else rows
        if len(below) and value == rows[:, dim].max():
            value = float(below.max())  # a value that half the rows share and none exceeds would part nothing
        self.dim[node], self.value[node] = dim, value
        left = rows[:, dim] <= value
        top, bottom = high.copy(), low.copy()
        top[dim], bottom[dim] = min(top[dim], value), max(bottom[dim], value)
        self._grow(rows[left], 2 * node + 1, level + 1, low, top)
        self._grow(rows[~left], 2 * node + 2, level + 1, bottom, high)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] > self.value[node])
        return node - (2**self.depth - 1)

    def touched(self, x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """The leaves besides ``home`` that a ball of radius ``bound`` (NaN: without end) touches, for every vector."""
        out: list[np.ndarray] = []
        reach = np.where(np.isnan(bound), np.inf, bound * (1 + 1e-12) + 1e-300)
        size = max(1, BLOCK_CELLS // self.low.size)
        for i in range(0, len(x), size):
            part = x[i : i + size, None, :]
            gap = np.maximum(np.maximum(self.low[None] - part, part - self.high[None]), 0.0)
            near = np.sqrt((gap * gap).sum(2)) <= reach[i : i + size, None]
            near[np.arange(len(near)), home[i : i + size]] = False
            out += [np.flatnonzero(row).astype("int32") for row in near]
        return out


def cut_of(rows: DataFrame, n: int, leaf_rows: int) -> Cut:
    """Cut of the ``n`` vectors ``vec`` into leaves of about ``leaf_rows``, shaped by a sample of them."""
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(n / leaf_rows, 1))))))
    share = min(1.0, SAMPLE_ROWS / n)
    sample = rows if share == 1.0 else rows.sample(share, seed=7)
    return Cut(np.stack(sample.select("vec").limit(2 * SAMPLE_ROWS).toPandas()["vec"].to_numpy()), depth)


def leaf_of(cut: Cut):
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(cut.leaf(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    return F.pandas_udf(leaf, T.IntegerType())


def _touch_udf(cut: Cut):
    def touch(v: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series(cut.touched(np.stack(v.to_numpy()), own.to_numpy(), bound.to_numpy(dtype=float)) if len(v) else [], dtype=object)

    return F.pandas_udf(touch, T.ArrayType(T.IntegerType()))


# Cells of the largest matrix a block of queries makes.
BLOCK_CELLS = 4_000_000


def nearest_in_block(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, columns: int = 1, shared: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, distance) of the k nearest references of each query, ties by the smaller id.

    Squared distances are scaled by ``columns`` / ``shared``.

    One matrix product shortlists every reference whose squared distance is, within rounding, among the k smallest;
    the distances of the shortlist are then computed from the differences.
    """
    squares = (r * r).sum(1)
    own = (q * q).sum(1)
    d2 = own[:, None] + squares[None, :] - 2 * q @ r.T
    if len(r) > k:
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (own + squares.max()) + 1e-300
        qi, ri = np.nonzero(d2 <= (limit + slack)[:, None])
    else:
        qi, ri = np.repeat(np.arange(len(q)), len(r)), np.tile(np.arange(len(r)), len(q))
    gap = r[ri] - q[qi]
    d = np.sqrt((gap * gap).sum(1) * columns / shared)
    order = np.lexsort((ids[ri], d, qi))
    qi, ri, d = qi[order], ri[order], d[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
    top = place < k
    return qi[top], ri[top], d[top]


def _search(k: int):
    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        names = ["qvec", "rid", "distance"]
        if not len(queries) or not len(refs):
            return pd.DataFrame({n: [] for n in names})
        r, ids = np.stack(refs["vec"].to_numpy()), refs["rid"].to_numpy()
        asked = queries["qvec"].to_numpy()
        q = np.stack(asked)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = max(1, BLOCK_CELLS // len(r))
        for i in range(0, len(q), size):
            qi, ri, d = nearest_in_block(q[i : i + size], r, ids, k)
            out.append((qi + i, ri, d))
        qi, ri, d = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"qvec": asked[qi], "rid": ids[ri], "distance": d})

    return run


def smallest_ids(refs: DataFrame, k: int, point: tuple[str, ...] = ("vec",)) -> DataFrame:
    """At most the k smallest ids of every distinct vector (or ``point``): no other can be among the k nearest."""
    salted = refs.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    part = W.partitionBy(*point, "_salt").orderBy("rid")
    few = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    whole = W.partitionBy(*point).orderBy("rid")
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k).select(*refs.columns)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(qid, rid, distance, rank): the k nearest references of every query, ties by the smaller rid.

    ``queries`` has (qid, vec), ``refs`` has (rid bigint, vec), both with equally long double arrays.
    """
    refs = keep(smallest_ids(refs.select("rid", "vec"), k))
    n = refs.count()
    if not n:
        return queries.select("qid", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("double").alias("distance"), F.lit(0).alias("rank")).limit(0)
    cut = cut_of(refs, n, leaf_rows)
    leaf, touch, depth = leaf_of(cut), _touch_udf(cut), cut.depth
    refs = keep(refs.withColumn("leaf", leaf("vec")))
    vectors = keep(queries.select(F.col("vec").alias("qvec")).distinct().withColumn("own", leaf("qvec")))

    def visit(asked: DataFrame) -> DataFrame:
        # Crowded leaves are split by a hash of the query; their references go to every part.
        parts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("_parts"))
        parts = F.broadcast(parts)  # at most 2^16 leaves
        left = asked.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("qvec"), F.col("_parts")).cast("int"))
        right = refs.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        return (
            left.select("leaf", "part", "qvec").groupBy("leaf", "part")
            .cogroup(right.select("leaf", "part", "rid", "vec").groupBy("leaf", "part"))
            .applyInPandas(_search(k), "qvec array<double>, rid bigint, distance double")
        )

    first = keep(visit(vectors.select(F.col("own").alias("leaf"), "qvec")))
    found = first
    if depth:
        bounds = first.groupBy("qvec").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_b"))
        asked = vectors.join(bounds, "qvec", "left")
        asked = asked.select("qvec", F.explode(touch("qvec", "own", "_b")).alias("leaf"))
        found = first.unionByName(visit(asked))
    best = W.partitionBy("qvec").orderBy("distance", "rid")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return queries.select("qid", F.col("vec").alias("qvec")).join(top, "qvec").select("qid", "rid", "distance", "rank")
