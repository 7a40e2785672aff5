"""Pairs of occupied cells of a grid that may hold points within a radius, without listing the empty neighbours.

The cells form a prefix tree, one coordinate a level. Pairs of prefixes go down the tree together: a pair is extended
by coordinates that occur below both prefixes, and dropped once the gap between the boxes of the points below them exceeds
the radius. So work follows the occupied pairs; the (2r+1)^d offsets around a cell are never built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.neighbors import cut_of, leaf_of
from colonnade.session import materialise

# Points of a block at most, blocks that keep the cores busy, points below which a block is not cut, points compared at once.
BLOCK_ROWS, BLOCKS, BLOCK_LEAST, LEAF_POINTS = 32_000, 12, 800, 512


def near_cells(cells: DataFrame, d: int, radius_squared: float, side: float = 1.0) -> DataFrame:
    """(cell, other): both directions of every pair of different cells whose boxes are at most the radius apart.

    ``cells`` has ``cell``, an array of ``d`` whole coordinates, and may have ``low`` and ``high``, the least and largest
    coordinates of the points in it; without them the box is the whole cell. ``radius_squared`` and the boxes are in the
    unit of ``side``. In many columns nearly every cell holds one point: its box is then the point, and of the many cells
    that lie next to each other only those with close points make a pair.
    """
    if "low" not in cells.columns:
        cells = cells.select("cell", F.transform("cell", lambda v: v * F.lit(side)).alias("low"), F.transform("cell", lambda v: (v + 1) * F.lit(side)).alias("high"))
    cells = cells.groupBy("cell").agg(*[f(F.col(c)[i]).alias(f"{c}{i}") for i in range(d) for c, f in (("low", F.min), ("high", F.max))])
    cells = materialise(cells)
    seen = cells.agg(*[F.approx_count_distinct(F.col("cell")[i]).alias(f"n{i}") for i in range(d)]).first()
    # The coordinate with most values first: it parts the most pairs.
    order = sorted(range(d), key=lambda i: (-seen[f"n{i}"], i))
    turned = F.array(*[F.col("cell")[i] for i in order])
    tree = materialise(cells.select(turned.alias("c"), *[F.col(f"{c}{i}").alias(f"{c[0]}{j}") for j, i in enumerate(order) for c in ("low", "high")]))
    limit = F.lit(radius_squared * (1 + 1e-9))
    pairs = None
    for level in range(d):
        # The box of a prefix covers the points below it, in the coordinates so far.
        boxes = [f(F.col(f"{c}{j}")).alias(f"{c}{j}") for j in range(level + 1) for c, f in (("l", F.min), ("h", F.max))]
        kids = tree.groupBy(F.slice("c", 1, level).alias("p"), F.col("c")[level].alias("v")).agg(*boxes)
        if pairs is None:
            left = kids.withColumnsRenamed({"p": "a"}).withColumns({"b": F.col("a"), "gap": F.lit(0.0), "same": F.lit(True)})
        else:
            left = pairs.join(kids.withColumnRenamed("p", "a"), "a")
        reach = F.sqrt(F.greatest(limit - F.col("gap"), F.lit(0.0)))
        first = F.floor((F.col(f"l{level}") - reach) / F.lit(side) - 1e-6).cast("long")
        last = F.floor((F.col(f"h{level}") + reach) / F.lit(side) + 1e-6).cast("long")
        # Each unordered pair once: equal prefixes part upwards only.
        left = left.withColumn("w", F.explode(F.sequence(F.when(F.col("same"), F.col("v")).otherwise(F.least(first, F.col("v"))), F.greatest(last, F.col("v")))))
        right = kids.select(F.col("p").alias("b"), F.col("v").alias("w"), *[F.col(f"{c}{j}").alias(f"{c}{c}{j}") for j in range(level + 1) for c in "lh"])
        found = left.drop("gap").join(right, ["b", "w"]).withColumn("same", F.col("same") & (F.col("v") == F.col("w")))
        gap = F.lit(0.0)
        for j in range(level + 1):
            apart = F.greatest(F.col(f"l{j}") - F.col(f"hh{j}"), F.col(f"ll{j}") - F.col(f"h{j}"), F.lit(0.0))
            gap = gap + apart * apart
        pairs = materialise(found.withColumn("gap", gap).where(F.col("gap") <= limit).select(
            F.concat("a", F.array("v")).alias("a"), F.concat("b", F.array("w")).alias("b"), "gap", "same"))
    back = [order.index(i) for i in range(d)]
    cell, other = (F.array(*[F.col(c)[j] for j in back]) for c in "ab")
    half = pairs.where("NOT same").select(cell.alias("cell"), other.alias("other"))
    return half.unionByName(half.select(F.col("other").alias("cell"), F.col("cell").alias("other")))


# ---------------------------------------------------------------- blocks of points that meet in a task


def in_blocks(points: DataFrame, n: int) -> DataFrame:
    """``points`` (with ``vec``, ``n`` of them, at least one) and the ``leaf`` of each: blocks of points that lie together."""
    return points.withColumn("leaf", leaf_of(cut_of(points, n, min(BLOCK_ROWS, max(BLOCK_LEAST, -(-n // BLOCKS)))))("vec"))


def block_pairs(points: DataFrame, d: int, reach: float) -> DataFrame:
    """(a, b), a at most b: blocks whose boxes lie within ``reach``, every block with itself; a broadcast table."""
    vec = F.col("vec")
    boxes = points.groupBy("leaf").agg(F.array(*[F.min(vec[i]) for i in range(d)]).alias("low"), F.array(*[F.max(vec[i]) for i in range(d)]).alias("high"))
    boxes = boxes.orderBy("leaf").toPandas()  # one row per block
    low, high, name = np.stack(boxes["low"].to_numpy()), np.stack(boxes["high"].to_numpy()), boxes["leaf"].to_numpy()
    pairs = []
    with np.errstate(invalid="ignore"):
        for i in range(len(name)):
            gap = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0.0)
            near = np.nan_to_num(np.sqrt((gap * gap).sum(1))) <= reach * (1 + 1e-9)
            near[0] = True
            pairs += [(int(name[i]), int(b)) for b in name[i:][near]]
    return F.broadcast(points.sparkSession.createDataFrame(pairs, "a int, b int"))


def meet(points: DataFrame, pairs: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """``run(points of a, points of b, whether they are one block)`` for every pair of blocks.

    Only what ``run`` returns is written; a point is sent to as many tasks as its block has pairs.
    """
    cols = [c for c in points.columns if c != "leaf"]
    # Every column of the two sides under a name of its own.
    left = points.select("leaf", *[F.col(c).alias(f"p_{c}") for c in cols]).join(pairs, F.col("leaf") == F.col("a")).drop("leaf")
    right = points.select(F.col("leaf").alias("leaf2"), *[F.col(c).alias(f"q_{c}") for c in cols])
    right = right.join(pairs.select(F.col("a").alias("a2"), F.col("b").alias("b2")), F.col("leaf2") == F.col("b2")).drop("leaf2")

    def task(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = p[[f"p_{c}" for c in cols]], q[[f"q_{c}" for c in cols]]
        return run(p.set_axis(cols, axis=1), q.set_axis(cols, axis=1), key[0] == key[1])

    return left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInPandas(task, schema)


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as the rows of a matrix whose columns lie together."""
    return np.asfortranarray(np.stack(vectors.to_numpy())) if len(vectors) else np.zeros((0, 1))


class Halves:
    """Points halved along their widest column down to LEAF_POINTS: nodes (start, end, first child or -1), boxes, the order of the points."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes, self.low, self.high = [], [], []
        self._add(x, 0, len(x))
        k = 0
        while k < len(self.nodes):
            start, end, _ = self.nodes[k]
            if end - start > LEAF_POINTS:
                mine = self.order[start:end]
                column = x[mine, np.argmax(np.nan_to_num(self.high[k] - self.low[k]))]
                half = (end - start) // 2
                self.order[start:end] = mine[np.argpartition(column, half)]
                self.nodes[k] = (start, end, len(self.nodes))
                self._add(x, start, start + half)
                self._add(x, start + half, end)
            k += 1

    def _add(self, x: np.ndarray, start: int, end: int) -> None:
        part = x[self.order[start:end]]
        self.nodes.append((start, end, -1))
        self.low.append(part.min(0))
        self.high.append(part.max(0))


def close_pairs(p: np.ndarray, q: np.ndarray, reach: float, rp: np.ndarray | None = None, rq: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of p, j of q) whose distance may be at most ``reach`` and their radii, in slices; the caller compares them exactly."""
    if not len(p) or not len(q):
        return
    rp, rq = (np.zeros(len(x)) if r is None else r for x, r in ((p, rp), (q, rq)))
    with np.errstate(invalid="ignore", over="ignore"):
        fine = np.isfinite(p).all(1)
        middle = p[fine].mean(0) if fine.any() else np.zeros(p.shape[1])
        x, y = p - middle, q - middle
        xs, ys = (x * x).sum(1), (y * y).sum(1)
        slack = 1e-9 * sum(s[np.isfinite(s)].max(initial=0.0) for s in (xs, ys))
        widest = (reach + rp.max() + rq.max()) * (1 + 1e-9) + np.sqrt(slack)
        one, two = Halves(x), Halves(y)
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            gap = np.nan_to_num(np.maximum(np.maximum(one.low[a] - two.high[b], two.low[b] - one.high[a]), 0.0), posinf=np.inf)
            if np.sqrt((gap * gap).sum()) > widest:
                continue
            (s, e, kid), (t, f, other) = one.nodes[a], two.nodes[b]
            if kid >= 0 and (other < 0 or e - s >= f - t):
                todo += [(kid, b), (kid + 1, b)]
            elif other >= 0:
                todo += [(a, other), (a, other + 1)]
            else:
                i, j = one.order[s:e], two.order[t:f]
                limit = reach + rp[i][:, None] + rq[j][None, :]
                k, m = np.nonzero(xs[i][:, None] + ys[j][None, :] - 2 * (x[i] @ y[j].T) <= limit * limit * (1 + 1e-9) + slack)
                if len(k):
                    yield i[k], j[m]


def distances(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = np.zeros(len(i))
    for k in range(p.shape[1]):
        gap = p[i, k] - q[j, k]
        total += gap * gap
    return np.sqrt(total)


def within(p: np.ndarray, q: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of p, j of q) at a distance of at most ``eps``, in slices."""
    with np.errstate(invalid="ignore"):
        for i, j in close_pairs(p, q, eps):
            good = distances(p, q, i, j) <= eps
            yield i[good], j[good]


class Cells:
    """The points of one block by their cells: box, middle and radius of each."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.start, self.count = np.unique(ids[order], return_index=True, return_counts=True)
        self.points = np.asfortranarray(points[order])
        self.low = np.asfortranarray(np.minimum.reduceat(self.points, self.start, axis=0))
        self.high = np.asfortranarray(np.maximum.reduceat(self.points, self.start, axis=0))
        self.middle = (self.low + self.high) / 2
        self.radius = np.sqrt(((self.high - self.low) ** 2).sum(1)) / 2

    def of(self, k: int) -> np.ndarray:
        return self.points[self.start[k] : self.start[k] + self.count[k]]


def _to_box(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - x, x - high), 0.0)
    return np.sqrt((gap * gap).sum(1))


def _touch(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    """Whether two points lie within eps; only points near the box of the others are compared, up to the first hit."""
    p = p[_to_box(p, q.min(0), q.max(0)) <= eps * (1 + 1e-9)]
    if len(p):
        q = q[_to_box(q, p.min(0), p.max(0)) <= eps * (1 + 1e-9)]
    return any(len(i) for i, _ in within(p, q, eps))


def linked_cells(left: Cells, right: Cells, eps: float) -> list[tuple[int, int]]:
    """Spanning forest, by cell ids, of the links between cells with points within eps of each other."""
    ids = np.unique(np.concatenate([left.ids, right.ids]))
    at, to = np.searchsorted(ids, left.ids), np.searchsorted(ids, right.ids)
    parent = np.arange(len(ids))
    forest: list[tuple[int, int]] = []

    def roots() -> np.ndarray:
        nonlocal parent
        while (parent != (up := parent[parent])).any():
            parent = up
        return parent

    def unite(a: int, b: int) -> None:
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((int(ids[a]), int(ids[b])))

    with np.errstate(invalid="ignore"):
        for i, j in close_pairs(left.middle, right.middle, eps, left.radius, right.radius):
            top = roots()
            apart = top[at[i]] != top[to[j]]
            i, j = i[apart], j[apart]
            total = np.zeros(len(i))
            for k in range(left.low.shape[1]):
                gap = np.maximum(np.maximum(left.low[i, k] - right.high[j, k], right.low[j, k] - left.high[i, k]), 0.0)
                total += gap * gap
            near = np.sqrt(total) <= eps * (1 + 1e-9)
            i, j = i[near], j[near]
            # A box of one point is the point.
            single = (left.count[i] == 1) & (right.count[j] == 1)
            a, b = i[single], j[single]
            hit = distances(left.low, right.low, a, b) <= eps
            a, b = a[hit], b[hit]
            top = roots()
            # One link of every pair of components is enough.
            _, first = np.unique(top[at[a]] * np.int64(len(ids)) + top[to[b]], return_index=True)
            for k in first:
                unite(at[a[k]], to[b[k]])
            for a, b in zip(i[~single], j[~single]):
                x, y = at[a], to[b]
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y and _touch(left.of(a), right.of(b), eps):
                    unite(at[a], to[b])
    return forest
