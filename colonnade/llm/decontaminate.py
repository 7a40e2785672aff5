"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items become sequences of word hashes (runs of letters and digits, lower case; in scripts written without spaces
every character is a word). Items of fewer than ``SHORT`` words allow no edit and are looked up as whole sequences. Longer
items of 3L/2 to 3L-1 words (L
a power of two from 4 to ``WIDEST_BASE``, where the class has no upper end) are looked for in document windows of 3L/4
words at every multiple of L/4; an item offers its window at every offset, so several document windows line up with some
of them wherever a copy begins. Windows do not widen with long items: a key survives few edits, so its chance falls with
the edits of its window, while a long copy has many windows and a fair share of them hold few. The CGK random walk writes out a
window's words, staying at or leaving a word by a random bit of (step, word), which turns few edits into few Hamming
differences. Each of ``ROUNDS`` repetitions walks anew and hashes ``SAMPLED`` sampled places of the walk into a key;
equal keys make a candidate. Every candidate is verified by the exact edit distance of the whole item to the best
stretch of the document around the window: a leak has similarity 1 - edits / words of at least ``min_similarity``.

Before walking, windows that share too few word pairs with all items together are put aside. An edit spoils at most two
pairs, so this loses no window with edits in less than a quarter of its words (``PAIR_SHARE``).

Work stays in one pass over the documents per block of items, without a shuffle. The benchmark is read in blocks of
about ``BLOCK_WORDS`` words; a block is what a task holds, whatever the size of the benchmark.

Defined cases: null or empty texts hold nothing; null items or items under ``min_words`` words (a single word is no
passage) are not looked for; a similarity below 0.8 is refused, as the gate and the repetitions are made for 0.8 and more;
repeated items each report; repeated rows each report; rows without an id report with a null id; texts of any length are
searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import text_blocks
from colonnade.llm.langid import Letters, code_points

ROUNDS = 16
SAMPLED = 5
WIDEST_BASE = 32
PAIR_SHARE = 0.45
MIN_WORDS = 2
# Items shorter than this lie below one whole edit at a similarity of 0.8.
SHORT = 5
# Unicode ranges of scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana, Han).
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
MIN_SIMILARITY = 0.8
BLOCK_WORDS = 1_000_000
SEED = 7
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words of each text."""
    letter, lower, _ = Letters.tables()
    points = code_points(" " + " ".join(texts) + " ")
    mask = letter[points] | ((points >= 48) & (points <= 57))
    alone = np.zeros(len(points), dtype=bool)
    if points.max() >= UNSPACED[0][0]:
        for lo, hi in UNSPACED:
            alone |= (points >= lo) & (points <= hi)
        alone &= mask
    # A word begins where letters begin, at a character that is a word by itself and behind one; and ends likewise.
    border = (mask[1:] != mask[:-1]) | (mask[1:] & (alone[1:] | alone[:-1]))
    at = np.flatnonzero(border) + 1
    starts, ends = at[mask[at]], at[mask[at - 1]]
    breaks = np.cumsum([1] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, breaks))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((ends - starts).max()), ODD, dtype=np.uint64))
        inside = np.flatnonzero(mask)
        place = inside - np.repeat(starts, ends - starts)
        low = lower[points[inside]].astype(np.uint64) + np.uint64(1)
        first = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
        h = np.add.reduceat(low * power[place], first)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), counts


def pair_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (words[:-1] * ODD + words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ words[k : k + len(out)]) * ODD
            out ^= out >> np.uint64(31)
    return out


def walk_keys(words: np.ndarray, starts: np.ndarray, width: int, repetition: int) -> np.ndarray:
    """LSH key of one repetition for the windows of ``width`` words at ``starts``."""
    steps = 2 * width
    rng = np.random.default_rng([SEED, width, repetition])
    sampled = set(rng.choice(steps, size=min(SAMPLED, steps), replace=False).tolist())
    odd = rng.integers(0, 2**63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place, key = starts.copy(), np.zeros(len(starts), dtype=np.uint64)
    end = starts + width
    padded = np.append(words, np.uint64(0))
    with np.errstate(over="ignore"):
        for j in range(max(sampled) + 1):
            word = np.where(place < end, padded[np.minimum(place, len(words))], np.uint64(0))
            if j in sampled:
                key = (key ^ word) * ODD
                key ^= key >> np.uint64(30)
            place += ((word * odd[j]) >> np.uint64(63)).astype(np.int64)
    return key


def window_base(n: int) -> int:
    """L of the windows for an item of n words: a copy holds three windows or more wherever it begins, from six words on."""
    largest = lambda x: 1 << x.bit_length() - 1
    return min(largest(n), WIDEST_BASE, max(4, largest(max(2 * n // 3, 1))))


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str], min_words: int = MIN_WORDS):
        words, counts = word_hashes(texts)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        self.ids, self.words, self.cuts = ids, words, cuts
        lengths = np.diff(cuts)
        self.classes = []
        bases = np.array([window_base(int(n)) if n >= max(SHORT, min_words) else 0 for n in lengths])
        self.short = {}  # by length: sorted hashes of whole items, and the items
        for n in range(min_words, SHORT):
            chosen = np.flatnonzero(lengths == n)
            if len(chosen):
                keys = np.array([sequence_hashes(words[cuts[i] : cuts[i + 1]], n)[0] for i in chosen])
                order = np.argsort(keys, kind="stable")
                self.short[n] = (keys[order], chosen[order])
        for base in sorted({int(b) for b in bases if b}):
            chosen = np.flatnonzero(bases == base)
            stride = max(base // 4, 1)
            width = max(base - stride, 1)
            item = np.concatenate([np.full(lengths[i] - width + 1, i) for i in chosen])
            offset = np.concatenate([np.arange(lengths[i] - width + 1) for i in chosen])
            tables = []
            for r in range(ROUNDS):
                keys = walk_keys(words, cuts[item] + offset, width, r)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], item[order], offset[order]))
            self.classes.append((width, stride, tables))
        pairs = np.concatenate([pair_hashes(words[a:b]) for a, b in zip(cuts, cuts[1:])]) if len(texts) else np.zeros(0, np.uint64)
        self.pair_cuts = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))])
        self.pairs = pairs
        self.bits = max(16, int(16 * max(len(pairs), 1)).bit_length())
        self.gate = np.zeros(1 << self.bits, dtype=bool)
        self.gate[(pairs >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def item(self, i: int) -> np.ndarray:
        return self.words[self.cuts[i] : self.cuts[i + 1]]

    def item_pairs(self, i: int) -> np.ndarray:
        return self.pairs[self.pair_cuts[i] : self.pair_cuts[i + 1]]

    def candidates(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (text number, item, first word of the presumed copy within the text)."""
        cuts = np.concatenate([[0], np.cumsum(counts)])
        if len(words) < 2:
            shared = np.zeros(len(words) + 1, dtype=np.int64)
        else:
            hit = self.gate[(pair_hashes(words) >> np.uint64(64 - self.bits)).astype(np.int64)]
            shared = np.concatenate([[0], np.cumsum(hit), [hit.sum()]])
        found = []
        for n, (keys, item) in self.short.items():
            own = sequence_hashes(words, n)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            start = np.flatnonzero(hi > lo)
            text = np.searchsorted(cuts, start, side="right") - 1
            whole = start + n <= cuts[text + 1]
            start, text = start[whole], text[whole]
            many = (hi - lo)[start]
            who = np.repeat(np.arange(len(start)), many)
            at = np.repeat(lo[start], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.stack([text[who], item[at], start[who] - cuts[text[who]]], axis=1))
        for width, stride, tables in self.classes:
            number = np.maximum((counts - width) // stride + 1, 0) * (counts >= width)
            text = np.repeat(np.arange(len(counts)), number)
            nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            starts = cuts[text] + nth * stride
            enough = shared[starts + width - 1] - shared[starts] >= PAIR_SHARE * (width - 1)
            text, starts = text[enough], starts[enough]
            if not len(starts):
                continue
            for r, (keys, item, offset) in enumerate(tables):
                own = walk_keys(words, starts, width, r)
                lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = np.repeat(np.arange(len(starts)), n)
                found.append(np.stack([text[who], item[at], starts[who] - cuts[text[who]] - offset[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def edits_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edits that turn the item into some stretch of the region, and where that stretch ends."""
    column = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        change = np.concatenate([[i], np.minimum(row[:-1] + (region != word), row[1:] + 1)])
        row = np.minimum.accumulate(change - column) + column
    end = int(row.argmin())
    return int(row[end]), end


def leaks_of(texts: list[str], items: Items, min_similarity: float, first_only: bool = False) -> list[tuple[int, int, int, int]]:
    """(text number, item, word at which the copy ends, edits): the best copy of each leaked item in each text."""
    words, counts = word_hashes(texts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    doc_pairs = pair_hashes(words)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    done: set[int] = set()
    for text, item, first in items.candidates(words, counts).tolist():
        if first_only and text in done:
            continue
        target = items.item(item)
        slack = len(target) // 2 + 1
        if (text, item, first // slack) in tried:  # the region below reaches a whole slack to either side
            continue
        tried.add((text, item, first // slack))
        lo = max((first // slack - 1) * slack, 0)
        begin, stop = cuts[text] + lo, min(cuts[text] + (first // slack + 2) * slack + len(target), cuts[text + 1])
        allowed = (1 - min_similarity) * len(target) + 1e-9
        # An edit spoils at most two of the item's word pairs; a region that lacks more holds no copy.
        held = doc_pairs[begin : max(stop - 1, begin)]
        own = items.item_pairs(item)
        here = (own[:, None] == held).any(axis=1) if own.size * held.size < 20_000 else np.isin(own, held)
        if len(own) - np.count_nonzero(here) > 2 * allowed:
            continue
        edits, end = edits_within(target, words[begin:stop])
        close = edits <= allowed
        if close and ((text, item) not in best or edits < best[text, item][0]):
            best[text, item] = (edits, lo + end)
            done.add(text)
    return [(text, item, end, edits) for (text, item), (edits, end) in best.items()]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, list, list[str]]]:
    """The benchmark in blocks of about BLOCK_WORDS words, each brought to the driver by itself."""
    rows = benchmark.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where(F.col("text").isNotNull())
    # About the number of words; the exact one decides in the task.
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]|[\p{L}0-9]+")))
    rows = rows.where(F.col("n") >= 1)
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toPandas()
        yield benchmark.schema[id_col].dataType.simpleString(), part["id"].tolist(), part["text"].tolist()


def accept(min_similarity: float) -> None:
    if not MIN_SIMILARITY <= min_similarity <= 1:
        raise ValueError(f"similarity must lie between {MIN_SIMILARITY} and 1")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, end_word, n_words, edits, similarity (of the best copy)."""
    accept(min_similarity)
    slim = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text")).where(F.col("text").isNotNull())
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    out = None
    for item_kind, ids, texts in item_blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = Items(*shared.value, min_words)
            for pdf in batches:
                texts, doc_ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
                for lo, hi in text_blocks(texts):
                    rows = leaks_of(texts[lo:hi], items, min_similarity)
                    if rows:
                        n = [len(items.item(i)) for _, i, _, _ in rows]
                        yield pd.DataFrame(
                            {
                                "doc_id": [doc_ids[lo + t] for t, *_ in rows],
                                "item_id": [items.ids[i] for _, i, _, _ in rows],
                                "end_word": [e for _, _, e, _ in rows],
                                "n_words": n,
                                "edits": [d for *_, d in rows],
                                "similarity": [1 - d / k for (*_, d), k in zip(rows, n)],
                            }
                        )

        part = slim.mapInPandas(run, f"doc_id {kind}, item_id {item_kind}, end_word long, n_words long, edits long, similarity double")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    min_words: int = MIN_WORDS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows of ``docs`` that hold no copy of a benchmark item. Each block of items is one more condition on the row."""
    accept(min_similarity)
    for _, ids, texts in item_blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
        docs = docs.where(_clean(shared, min_similarity, min_words)(ref(text_col)))
    return docs


def _clean(shared, min_similarity: float, min_words: int):
    """Condition on a text: it holds none of the shared block of items."""
    ready: list[Items] = []  # built once per task

    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Items(*shared.value, min_words))
        texts = [t if isinstance(t, str) else "" for t in column]
        keep = np.ones(len(texts), dtype=bool)
        for lo, hi in text_blocks(texts):
            for t, *_ in leaks_of(texts[lo:hi], ready[0], min_similarity, first_only=True):
                keep[lo + t] = False
        return pd.Series(keep)

    return clean
