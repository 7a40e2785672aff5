"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, one per bit position of the 64-bit hashes of a text's word shingles. Two fingerprints link
when they differ in at most ``max_bits`` bits. The bits are cut into blocks. Of a linked pair that differs at all, some
block holds a differing bit; with that block left out, at most ``max_bits - 1`` bits differ, so balls of half that
radius around both sides meet in a common variant. Each distinct fingerprint therefore emits, for each left-out block,
every variant within half the radius; the shuffle on (block, variant) brings partners together and each colliding pair
is verified on all 64 bits. Nothing is missed and nothing is capped: more blocks (longer variants) only thin out chance
collisions, and their number follows from the number of distinct fingerprints.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; equal
fingerprints are one node, however many rows carry them; rows without an id cannot name a component (its id is null
when no row of it has one); repeated rows share their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import components, keep_keys, row_key, settle
from colonnade.session import materialise

HASH_SEED = 42
# Shingle hashes are summed in blocks of this many, so a very long text needs no more memory than a short one.
SUM_BLOCK = 65_536
# Runs of a variant up to this length compare all their members; longer ones only grow trees of links.
SMALL_RUN = 8


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), SUM_BLOCK):
        part = shingles[start : start + SUM_BLOCK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(HASH_SEED)), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, key_a, key_b (row key) and the fingerprint as a signed 64-bit number."""
    a, b = row_key(id_col, text_col)
    narrow = docs.select(ref(id_col).alias("doc_id"), a.alias("key_a"), b.alias("key_b"), ref(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["text"]]
            yield pdf[["doc_id", "key_a", "key_b"]].assign(fp=np.array(values, dtype=np.int64))

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, key_a long, key_b long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Bit masks of ``blocks`` contiguous blocks that cover 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def blocks_for(nodes: int, radius: int) -> int:
    """Fewest blocks whose variants are long enough that chance collisions stay below one per variant."""
    for blocks in range(2, 9):
        width = 64 - -(-64 // blocks)
        if nodes * width**radius <= 2**width:
            return blocks
    return 8


def ball(width_mask: int, radius: int) -> np.ndarray:
    """Every change of at most ``radius`` of the bits in ``width_mask``, as XOR masks."""
    bits = [1 << b for b in range(64) if width_mask >> b & 1]
    masks = [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]
    return np.array(masks, dtype=np.uint64)


def run_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect the members of one variant as all their pairs within ``max_bits`` would."""
    if len(fps) <= SMALL_RUN:
        i, j = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        return list(zip(fps[i][near], fps[j][near], strict=True))
    links, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            near = np.bitwise_count(rest ^ seed) <= max_bits
            found, rest = rest[near], rest[~near]
            links.extend(zip(repeat(seed), found))
            queue.extend(found)
    return links


def fingerprint_links(nodes: DataFrame, max_bits: int = 3, blocks: int | None = None) -> DataFrame:
    """Links (a, b) over distinct fingerprints (column fp) that connect exactly the pairs within ``max_bits`` bits."""
    radius = max_bits // 2  # half of max_bits - 1, rounded up
    blocks = blocks or blocks_for(nodes.count(), max(radius, 1))
    whole = (1 << 64) - 1
    parts = [(k, whole & ~m, ball(whole & ~m, radius)) for k, m in enumerate(block_masks(blocks))]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2_000):
                fps = pdf["fp"].to_numpy(np.int64)[lo : lo + 2_000]
                for k, kept, masks in parts:
                    keys = ((fps.view(np.uint64) & np.uint64(kept))[:, None] ^ masks[None, :]).ravel()
                    yield pd.DataFrame(
                        {"block": np.full(len(keys), k, np.int8), "variant": keys.view(np.int64), "fp": np.repeat(fps, len(masks))}
                    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            cur = pdf.to_numpy(np.int64)
            cur = cur if left is None else np.concatenate([left, cur])
            edge = np.flatnonzero((np.diff(cur[:, :2], axis=0) != 0).any(axis=1)) + 1
            cut = edge[-1] if len(edge) else 0  # the last run may go on in the next batch
            left = cur[cut:]
            out = runs(cur[:cut])
            if len(out):
                yield out
        if left is not None:
            out = runs(left)
            if len(out):
                yield out

    def runs(rows: np.ndarray) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(rows) > 1:
            same = (np.diff(rows[:, :2], axis=0) == 0).all(axis=1)
            starts = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]))
            ends = np.flatnonzero(same & ~np.concatenate([same[1:], [False]])) + 2
            fps = rows[:, 2].copy().view(np.uint64)
            pairs = ends - starts == 2
            i = starts[pairs]
            near = np.bitwise_count(fps[i] ^ fps[i + 1]) <= max_bits
            links.extend(zip(fps[i][near], fps[i + 1][near]))
            for lo, hi in zip(starts[~pairs], ends[~pairs]):
                links.extend(run_links(fps[lo:hi], max_bits))
        ends_of = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ends_of.min(axis=1), "b": ends_of.max(axis=1)}) if len(ends_of) else pd.DataFrame({"a": [], "b": []})

    variants = nodes.select("fp").mapInPandas(emit, "block byte, variant long, fp long")
    met = variants.repartition("block", "variant").sortWithinPartitions("block", "variant")
    return met.mapInPandas(meet, "a long, b long").distinct()


def fingerprint_components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, component, component_id): component names the linked fingerprints, component_id their smallest doc_id."""
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(fingerprint_links(nodes, max_bits))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return settle(named.drop("least").join(settle(least), "component"))


def simhash_groups(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per input row: doc_id, key_a, key_b, fp, component, component_id."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col))
    return prints.join(fingerprint_components(prints, max_bits), "fp")


def deduplicate(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group stays: that with the smallest id, among several of that id the one with the smallest key.

    Of rows that agree in id and text one stays, whichever it is.
    """
    groups = simhash_groups(docs, shingle, max_bits, id_col, text_col)
    lead = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    lead = lead.groupBy("component").agg(F.min("key_a").alias("key_a"))
    chosen = groups.join(settle(lead), ["component", "key_a"], "left_semi").select("key_a", "key_b")
    return keep_keys(docs, chosen.distinct(), id_col, text_col, once=True)


def simhash_report(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return simhash_groups(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
