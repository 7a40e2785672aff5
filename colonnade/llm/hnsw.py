"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard searched for every vector.

Equal vectors are one node. Nodes are dealt to shards by hash; each shard builds its own layered graph (bounded by
``SHARD_NODES``), so shards are independent tasks. Every node then searches every shard, in blocks of queries. A beam that
is full of links is widened until it also holds something that is no link; past a width, the query is compared with its
whole shard, so no number of links is cut off. Each block audits itself: for queries drawn at random, whatever was found
for them, the links to other nodes are also computed by brute force, until a stated number of true links or a quarter of
the block is reached; beams of the whole block are doubled until the audited recall reaches the target, at last up to the
comparison with the whole shard. The audits of all blocks are added up as well: where links are too sparse for a block to
judge, their sum decides whether the search runs again with beams twice as wide. Every link is verified by the cosine in
double precision. Tasks return link counts and a spanning forest of their links; components are united over the forests.
Links are verified and counted slice by slice, and a shard travels in pieces, so the memory of a task follows the nodes of a
shard and not their links.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing; vectors of
different length do not link; equal vectors link with each other; a null vec_id takes part but names no component;
repeated rows count as other vectors of equal value; an empty table gives an empty result; other columns are not read,
whatever their names; ``audited_recall`` is null where the audits met no true link.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.context import ref
from colonnade.llm.common import components, settle
from colonnade.session import materialise

# A shard holds no more nodes than this, and no more bytes of vectors (in double precision); a task holds a whole one.
SHARD_NODES = 100_000
SHARD_BYTES = 100_000_000
LEAST_SHARDS = 4
# Bytes of a shard that travel in one row.
PIECE_BYTES = 4_000_000
QUERY_BLOCK = 16_384  # least queries in a block; blocks are as large as a shard once there are SEARCH_TASKS of them
SEARCH_TASKS = 48  # pairs of shard and block that keep the cores busy: every further block copies all shards once more
DEGREE = 16
BUILD_BEAM = 48
SEARCH_BEAM = 48
# A query whose links would need a wider beam than this is compared with every vector of the shard instead.
WIDEST_BEAM = 1024
TARGET_RECALL = 0.98
# A block's audit ends at so many true links, or with this share of its queries.
AUDIT_LINKS = 200
AUDIT_SHARE = 0.25
BATCH = 256
# Numbers in the largest array that a step over candidates or links makes.
SLICE_CELLS = 8_000_000


def select(base: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """For each row of candidates (-1 for none) the ``keep`` to link to: those not nearer to a chosen one, then the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    among = np.einsum("acd,abd->acb", base[ids], base[ids])
    rows, width = ids.shape
    chosen = np.zeros((rows, width), dtype=bool)
    for c in range(width):
        near = np.where(chosen, among[:, c, :], -2.0).max(axis=1)
        chosen[:, c] = (ids[:, c] >= 0) & (near < sims[:, c]) & (chosen.sum(axis=1) < keep)
    rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, rank, 1)


class Lists:
    """Neighbour lists of the members of a layer, asked for by node; those of other nodes are empty."""

    def __init__(self, members: np.ndarray, rows: np.ndarray, nodes: int):
        self.rows = np.concatenate([rows, np.full((1, rows.shape[1]), -1, dtype=rows.dtype)])
        self.at = np.full(nodes, len(rows), dtype=np.int32)
        self.at[members] = np.arange(len(rows), dtype=np.int32)

    def __getitem__(self, nodes: np.ndarray) -> np.ndarray:
        return self.rows[self.at[nodes]]


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds every node."""

    def __init__(self, base: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.base, self.layers = base, layers

    @classmethod
    def build(cls, base: np.ndarray, seed: int = 5) -> Graph:
        n = len(base)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-18) / math.log(DEGREE)).astype(int)
        order = np.argsort(-level, kind="stable")
        graph = cls(base, [])
        for layer in range(int(level.max()) if n else 0, -1, -1):
            members = order[level[order] >= layer]
            links = np.full((n, 2 * DEGREE), -1, dtype=np.int32)
            done = 0
            while done < len(members):
                size = min(max(BATCH // 4, min(done, BATCH)), len(members) - done)
                graph.insert(links, members[:done], members[done : done + size])
                done += size
            graph.layers.insert(0, (members, links))
        return graph

    def insert(self, links: np.ndarray, present: np.ndarray, new: np.ndarray) -> None:
        base = self.base
        inner = base[new] @ base[new].T
        np.fill_diagonal(inner, -2.0)
        top = np.argsort(-inner, axis=1)[:, :DEGREE]
        ids, sims = new[top], np.take_along_axis(inner, top, 1)
        ids = np.where(sims > -1.5, ids, -1)
        if len(present):
            entry = self.descend(base[new], present[0])
            found, near, _ = self.search_layer(base[new], links, entry, BUILD_BEAM)
            ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, near], axis=1)
        mine = select(base, ids, np.where(ids < 0, -3.0, sims), DEGREE)
        links[new, : mine.shape[1]] = mine
        # Links go both ways; a list that overflows is chosen anew.
        target, source = mine.ravel(), np.repeat(new, mine.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)] = source
        if not extra.size:
            return
        old = links[nodes].astype(np.int64)
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        every = np.concatenate([old, extra], axis=1)
        every = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        size = (every >= 0).sum(axis=1)
        every = every[:, : int(size.max())]
        width = min(2 * DEGREE, every.shape[1])
        fits = size <= 2 * DEGREE
        links[nodes[fits], :width] = every[fits][:, :width]
        at_once = max(1, min(512, SLICE_CELLS // (every.shape[1] * max(every.shape[1], base.shape[1]))))
        for lo in range(0, int((~fits).sum()), at_once):
            crowd, who = every[~fits][lo : lo + at_once], nodes[~fits][lo : lo + at_once]
            near = np.where(crowd < 0, -3.0, np.einsum("acd,ad->ac", base[crowd], base[who]))
            links[who] = select(base, crowd, near, 2 * DEGREE)

    def descend(self, queries: np.ndarray, entry: int) -> np.ndarray:
        """Nearest node found on the layers already built, from the top down."""
        at = np.full((len(queries), 1), self.layers[-1][0][0] if self.layers else entry)
        for _, links in reversed(self.layers):
            at, _, _ = self.search_layer(queries, links, at, 4)
            at = at[:, :1]
        return at

    def search_layer(self, queries: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, step: int = 4):
        """(ids, similarities, expanded) of the ``beam`` best nodes per query, best first; all queries advance together."""
        base, b = self.base, len(queries)
        seen = np.zeros((b, len(base) + 1), dtype=bool)
        row = np.arange(b)[:, None]
        ids = np.full((b, beam), -1)
        sims = np.full((b, beam), -3.0, dtype=np.float32)
        open_ = np.zeros((b, beam), dtype=bool)
        k = entry.shape[1]
        ids[:, :k], sims[:, :k], open_[:, :k] = entry, np.einsum("bcd,bd->bc", base[entry], queries), entry >= 0
        seen[row, entry] = True
        live = np.arange(b)
        while len(live):
            value = np.where(open_[live], sims[live], -3.0)
            pick = np.argsort(-value, axis=1)[:, :step]
            ready = np.take_along_axis(open_[live], pick, 1)
            going = ready.any(axis=1)
            live, pick, ready = live[going], pick[going], ready[going]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            heads = np.where(ready, ids[live[:, None], pick], -1)
            near = np.where(heads[:, :, None] >= 0, links[heads], -1).reshape(len(live), -1)
            known = seen[live[:, None], near] | (near < 0)
            seen[live[:, None], np.where(near < 0, len(base), near)] = True
            near = np.where(known, -1, near)
            # A node met twice in one step counts once.
            order = np.argsort(near, axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            close = np.where(near >= 0, np.einsum("bcd,bd->bc", base[near], queries[live]), -3.0).astype(np.float32)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], close], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
        return ids, sims, open_

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.descend(queries, 0)
        ids, sims, _ = self.search_layer(queries, self.layers[0][1], entry, beam)
        return ids, sims

    def dump(self) -> bytes:
        """The layers as bytes, of each the neighbour lists of its members only."""
        out = io.BytesIO()
        np.savez(out, count=len(self.layers), **{f"m{i}": m for i, (m, _) in enumerate(self.layers)}, **{f"l{i}": x[m] for i, (m, x) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, base: np.ndarray) -> Graph:
        got = np.load(io.BytesIO(raw))
        layers = []
        for i in range(int(got["count"])):
            layers.append((got[f"m{i}"], Lists(got[f"m{i}"], got[f"l{i}"], len(base))))
        return cls(base, layers)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths in double precision, without a copy of all rows."""
    size = max(1, SLICE_CELLS // max(1, rows.shape[1]))
    parts = [np.linalg.norm(rows[lo : lo + size].astype(np.float64), axis=1) for lo in range(0, len(rows), size)]
    return np.concatenate(parts) if parts else np.zeros(0)


def unit(rows: np.ndarray) -> np.ndarray:
    out = np.empty(rows.shape, dtype=np.float32)
    size = max(1, SLICE_CELLS // max(1, rows.shape[1]))
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size].astype(np.float64)
        out[lo : lo + size] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return out


class Pairs:
    """Takes links (query, node) in slices and keeps them all."""

    def __init__(self):
        self.q, self.v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def add(self, q: np.ndarray, v: np.ndarray) -> None:
        self.q.append(q)
        self.v.append(v)


def audited_links(
    graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, target: float = TARGET_RECALL, beam: int = SEARCH_BEAM
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Verified links (query, node) with cosine at least ``threshold``, true links of the last audit, and those found."""
    got, true, have = audited_search(graph, vectors, queries, threshold, Pairs, target, beam)
    return np.concatenate(got.q), np.concatenate(got.v), true, have


def audited_search(
    graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, sink, target: float = TARGET_RECALL, beam: int = SEARCH_BEAM
) -> tuple:
    """What a ``sink()`` made of the verified links, handed to its ``add`` in slices; true links of the last audit, and those found.

    A query that equals a node is that node; the pair is handed on but is no link to the audit.
    """
    slack = 1e-4  # float32 search, double verification
    length, own, small = lengths(vectors), lengths(queries), unit(queries)
    dim = max(1, vectors.shape[1])
    block = max(1, 8_000_000 // len(vectors))
    some = max(1, SLICE_CELLS // 4 // dim)

    def verified(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(q), some):
            a, b = q[lo : lo + some], v[lo : lo + some]
            cosine = np.einsum("ed,ed->e", queries[a].astype(np.float64), vectors[b].astype(np.float64)) / (own[a] * length[b])
            good = cosine >= threshold
            yield a[good], b[good]

    def compared(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = max(1, block // 4)  # every pair may be a link, and takes more room than its similarity
        for lo in range(0, len(part), size):
            r, c = np.nonzero(small[part[lo : lo + size]] @ graph.base.T >= threshold - slack)
            yield from verified(part[lo + r], c)

    def others(q: np.ndarray, v: np.ndarray) -> int:
        return sum(int((queries[q[lo : lo + some]] != vectors[v[lo : lo + some]]).any(axis=1).sum()) for lo in range(0, len(q), some))

    drawn = np.random.default_rng(len(queries)).permutation(len(queries))
    audited, true = np.zeros(len(queries), dtype=bool), 0
    for lo in range(0, math.ceil(AUDIT_SHARE * len(queries)), block):
        part = drawn[lo : min(lo + block, max(1, math.ceil(AUDIT_SHARE * len(queries))))]
        audited[part] = True
        true += sum(others(*found) for found in compared(part))
        if true >= AUDIT_LINKS:
            break
    while True:
        got, have = sink(), 0
        todo, width = np.arange(len(queries)), min(beam, len(vectors))

        def take(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
            seen = 0
            for q, v in found:
                got.add(q, v)
                seen += others(q[audited[q]], v[audited[q]])
            return seen

        # Beams as wide as the shard that still lose links leave only the comparison with the whole shard.
        whole = beam > max(WIDEST_BEAM, len(vectors)) or beam >= 2 * len(vectors)
        while len(todo):
            if whole or width > WIDEST_BEAM:
                have += take(compared(todo))
                break
            again = []
            size = max(1, min(512, 32_000_000 // (len(vectors) + 1), SLICE_CELLS // (8 * DEGREE * dim)))
            for lo in range(0, len(todo), size):
                part = todo[lo : lo + size]
                ids, sims = graph.search(small[part], width)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= threshold - slack) & (width < len(vectors))
                again.append(part[full])
                near = (sims >= threshold - slack) & (ids >= 0) & ~full[:, None]
                r, c = np.nonzero(near)
                have += take(verified(part[r], ids[r, c]))
            todo, width = np.concatenate(again), min(2 * width, len(vectors))
        if have >= target * true or whole:
            return got, true, have
        beam *= 2


def links_of(graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, target: float = TARGET_RECALL) -> tuple[np.ndarray, np.ndarray, float]:
    """Verified links (query, node) with cosine at least ``threshold``, and the recall audited last."""
    q, v, true, have = audited_links(graph, vectors, queries, threshold, target)
    return q, v, have / true if true else 1.0


class Tally:
    """Takes links (query, node) in slices; keeps the rows linked to every query and a spanning forest of the links."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.own, self.ids, self.counts = own, ids, counts
        self.total = np.zeros(len(own), dtype=np.int64)
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, q: np.ndarray, v: np.ndarray) -> None:
        other = self.own[q] != self.ids[v]
        q, v = q[other], v[other]
        np.add.at(self.total, q, self.counts[v])
        for a, b in zip(self.own[q].tolist(), self.ids[v].tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[x] = y
                self.kept.append((a, b))


def as_matrix(cells: pd.Series) -> np.ndarray:
    """The vectors of a column, in single precision where they have no other digits."""
    return np.array(cells.tolist(), dtype=getattr(cells.iloc[0], "dtype", np.float64))


def block_count(n: int, shards: int, most: int) -> int:
    """Blocks of queries: no larger than a shard, no smaller than QUERY_BLOCK once there are SEARCH_TASKS pairs with shards."""
    return max(1, math.ceil(n / most), min(math.ceil(n / min(most, QUERY_BLOCK)), math.ceil(SEARCH_TASKS / shards)))


def search_shards(nodes: DataFrame, threshold: float, degree_seed: int = 5) -> tuple[DataFrame, float | None]:
    """Rows (a, b, n) and the audited recall, null where the audits met no true link.

    A row is a link of a task's forest when n is null, else n rows linked to node a as one task counted them.
    """
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n, most = size["n"], max(1, min(SHARD_NODES, SHARD_BYTES // (8 * (size["dim"] or 1))))
    shards = max(LEAST_SHARDS, math.ceil(n / most))
    blocks = block_count(n, shards, most)
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = as_matrix(pdf["vector"])
        out = io.BytesIO()
        graph = np.frombuffer(Graph.build(unit(vectors), degree_seed).dump(), dtype=np.uint8)
        np.savez(out, graph=graph, vectors=vectors, ids=pdf["node"].to_numpy(np.int64), counts=pdf["copies"].to_numpy(np.int64))
        raw = out.getvalue()
        pieces = [raw[lo : lo + PIECE_BYTES] for lo in range(0, len(raw), PIECE_BYTES)]
        return pd.DataFrame({"dim": key[0], "shard": key[1], "part": range(len(pieces)), "piece": pieces})

    index = placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, part int, piece binary")
    index = materialise(index)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    # A stated query set (all nodes, in blocks) against every shard of its dimension.
    left = index.select("*", every_block)
    right = nodes.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(blocks)).cast("int")).select("*", every_shard)
    keys = ["dim", "shard", "block"]

    def query(beam: int):
        def run(index_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(index_rows) or not len(queries):
                return pd.DataFrame({"a": [], "b": [], "n": [], "hits": []})
            shard = np.load(io.BytesIO(b"".join(index_rows.sort_values("part")["piece"])))
            vectors, own = shard["vectors"], queries["node"].to_numpy(np.int64)
            graph = Graph.load(shard["graph"].tobytes(), unit(vectors))
            asked, ids, counts = as_matrix(queries["vector"]), shard["ids"], shard["counts"]
            got, true, have = audited_search(graph, vectors, asked, threshold, lambda: Tally(own, ids, counts), beam=beam)
            total, links = got.total, np.array(got.kept, dtype=np.int64).reshape(-1, 2)
            some = np.flatnonzero(total)
            parts = [
                pd.DataFrame({"a": own[some], "n": total[some]}),
                pd.DataFrame({"a": links[:, 0], "b": links[:, 1]}),
                pd.DataFrame({"n": [true], "hits": [have]}),
            ]
            return pd.concat([p.astype("Int64").reindex(columns=["a", "b", "n", "hits"]) for p in parts], ignore_index=True).astype("Int64")

        return run

    beam = SEARCH_BEAM
    while True:
        found = materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(query(beam), "a long, b long, n long, hits long"))
        audit = found.where(F.col("a").isNull()).agg(F.sum("n").alias("true"), F.sum("hits").alias("hits")).first()
        recall = audit["hits"] / audit["true"] if audit["true"] else None
        # Single blocks stop at the comparison with the whole shard, which loses nothing; so does this.
        if recall is None or recall >= TARGET_RECALL or beam > WIDEST_BEAM:
            return found.where(F.col("a").isNotNull()).drop("hits"), recall
        beam *= 2


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and the recall audited over the whole search."""
    # Vectors of single precision stay as they are: they take half the room, and every sum over them is in double precision.
    single = isinstance(getattr(vectors.select(ref(vector_col)).schema[0].dataType, "elementType", None), T.FloatType)
    rows = vectors.select(ref(id_col).alias("vec_id"), ref(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    good = F.coalesce(finite & (length > 0), F.lit(False))
    equal = rows.where(good).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # The numbers of the nodes are fixed by the checkpoint.
    nodes = materialise(equal.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))
    found, recall = search_shards(nodes.select("node", "dim", "vector", "copies"), threshold)
    labels = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = nodes.join(labels, "node", "left").join(counts, "node", "left")
    named = named.select("vector", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(named.join(least, "component").select("vector", "n_links", "component_id"))
    linked = rows.where(good).join(named, "vector").select("vec_id", "n_links", "component_id")
    # The others have no key to be joined by and would all meet in one task.
    alone = rows.where(~good).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("audited_recall", F.lit(recall).cast("double"))
