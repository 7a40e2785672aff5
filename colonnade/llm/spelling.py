"""Spelling variants: words one edit apart, found by search schemes over bidirectional FM-indexes.

The vocabulary is counted over all texts. Two words are near when one inserted, deleted or replaced code point turns one
into the other; that edit lies in one half of the word, so the other half stands unchanged at its end of both words. Each
word is therefore looked up twice, by its first half read forwards and by its last half read backwards. Words that share
the shortest possible half (three code points of six) form a key; keys are dealt into shards of bounded size, and each
shard holds a bidirectional FM-index over its words between delimiters. A search matches the exact half from the middle
outwards to the delimiter, keeping the suffix-rank intervals of both directions in step, and then extends across the other
half up to the far delimiter with one error. A key too large for one shard is cut into parts, and every pair of parts (words
indexed, words asked) becomes a shard, so that no link is lost and none is found twice.

A word's form is its near word of largest count when that count is large enough against its own; forms are followed to the
last by pointer doubling between checkpointed tables.

Defined cases: a null text holds no words; a null id counts as the empty string in the planted deletions; ties of count go
to the word first in code-point order; repeated rows count as often as they occur; a word of any length is searched whole;
without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import settle
from colonnade.session import broadcast_if_small, materialise

MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
# Symbols (code points and delimiters) of a shard, about; a key beyond it is cut into parts.
SHARD_SYMBOLS = 64_000
# Words searched at once; bounds the number of open search states.
QUERY_BLOCK = 4096
# Every so many positions the symbol counts are stored; the rest of a rank is counted in the block.
SAMPLE = 16
SENTINEL, DELIMITER = 0, 1


def vocabulary(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, n of every frequent run of Latin letters, lower-cased in A-Z.

    With ``drop_every``, runs whose crc32 of ``<id>:<run>`` it divides lose one code point: planted misspellings.
    """
    text = F.translate(F.coalesce(ref(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    # Greedy from the left, so exactly the maximal runs that are long enough match.
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.coalesce(ref(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if drop_every:
        code = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        words = words.withColumn("_code", code).withColumn("_at", (F.col("_code") % F.length("word")).cast("int"))
        cut = F.concat(F.expr("substring(word, 1, _at)"), F.expr("substring(word, _at + 2)"))
        words = words.withColumn("word", F.when(F.col("_code") % drop_every == 0, cut).otherwise(F.col("word")))
        words = words.where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order, by prefix doubling; the last symbol is unique and smallest."""
    rank, width = text.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == len(order) - 1:
            return order
        width *= 2


def points_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the length of each."""
    points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for w in words]
    return np.concatenate([*points, np.empty(0, dtype=np.uint32)]), np.array([len(p) for p in points], dtype=np.int64)


class Side:
    """Ranks over the Burrows-Wheeler transform of one reading direction."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int):
        self.order = suffix_order(text)
        self.bwt, self.sample = text[self.order - 1], sample
        blocks = len(text) // sample + 1
        padded = np.full(blocks * sample, symbols, dtype=self.bwt.dtype)
        padded[: len(text)] = self.bwt
        self.blocks = padded.reshape(blocks, sample)
        counts = np.zeros((blocks + 1, symbols + 2), dtype=np.int32)
        np.add.at(counts, (np.arange(len(padded)) // sample + 1, padded.astype(np.int64) + 1), 1)
        # below[b, c]: symbols smaller than c before block b
        self.below = counts.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before position ``at`` are smaller than ``symbol``, and how many equal it."""
        block, rest = np.divmod(at, self.sample)
        held = self.blocks[block]
        inside = np.arange(self.sample) < rest[:, None]
        less = self.below[block, symbol] + ((held < symbol[:, None]) & inside).sum(axis=1)
        same = self.below[block, symbol + 1] - self.below[block, symbol] + ((held == symbol[:, None]) & inside).sum(axis=1)
        return less, same

    def equal(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = np.divmod(at, self.sample)
        inside = np.arange(self.sample) < rest[:, None]
        return self.below[block, symbol + 1] - self.below[block, symbol] + ((self.blocks[block] == symbol[:, None]) & inside).sum(axis=1)


class Index:
    """A bidirectional FM-index over distinct words, each between two delimiters."""

    def __init__(self, words: list[str]):
        flat, length = points_of(words)
        self.alphabet = np.unique(flat)
        self.symbols = len(self.alphabet) + 2
        begin = np.cumsum(length + 1) - length  # after a delimiter each
        text = np.full(int(length.sum()) + len(words) + 2, DELIMITER, dtype=np.int32)
        text[np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(flat))] = self.encode(flat)
        text[-1] = SENTINEL
        self.ends = begin + length
        self.size = len(text)
        sample = max(SAMPLE, self.symbols // 8)
        self.forward = Side(text, self.symbols, sample)
        self.backward = Side(np.concatenate([text[-2::-1], text[-1:]]), self.symbols, sample)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])

    def encode(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of code points; unknown ones get the number of symbols, which occurs nowhere."""
        at = np.searchsorted(self.alphabet, flat)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == flat[known]
        return np.where(known, at + 2, self.symbols).astype(np.int64)

    def extend_left(self, symbol: np.ndarray, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        """Prepend ``symbol``: the interval among forward suffixes, and in step the one among backward suffixes."""
        less, same = self.forward.rank(symbol, low)
        less_end, same_end = self.forward.rank(symbol, low + size)
        return self.first[symbol] + same, back + (less_end - less), same_end - same

    def extend_right(self, symbol: np.ndarray, back: np.ndarray, size: np.ndarray):
        """Append ``symbol`` to the interval among backward suffixes; the forward one is not needed any more."""
        both = self.backward.equal(np.concatenate([symbol, symbol]), np.concatenate([back, back + size]))
        start, end = both[: len(back)], both[len(back) :]
        return self.first[symbol] + start, end - start

    def branches(self, back: np.ndarray, size: np.ndarray):
        """All letters that can follow each interval: (interval number, symbol, new interval, new size), by interval."""
        nth = np.repeat(np.arange(len(back)), size)
        at = np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size) + back[nth]
        seen, count = np.unique(nth * self.symbols + self.backward.bwt[at], return_counts=True)
        nth, symbol = np.divmod(seen, self.symbols)
        keep = symbol > DELIMITER
        nth, symbol, count = nth[keep], symbol[keep], count[keep]
        return nth, symbol, self.first[symbol] + self.backward.equal(symbol, back[nth]), count

    def located(self, back: np.ndarray) -> np.ndarray:
        """Number of the word whose closing delimiter stands at these ranks of the backward suffixes."""
        return np.searchsorted(self.ends, self.size - 2 - self.backward.order[back])

    def near(self, words: list[str], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the word asked, number of the word indexed) exactly one edit apart, the edit behind the first
        ``half`` code points. Edits inside a run of one letter count at its end, so each pair is met once."""
        flat, length = points_of(words)
        begin = np.cumsum(length + 1) - length - 1
        pattern = np.full(len(flat) + len(words), DELIMITER, dtype=np.int64)  # each word and its closing delimiter
        pattern[np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]])[: len(words)], length) + np.arange(len(flat))] = self.encode(flat)
        asked = np.arange(len(words))
        low, back, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.full(len(words), self.size)
        for step in range(int(half.max(initial=0)) + 1):
            live = np.flatnonzero((half >= step) & (size > 0))
            symbol = np.where(half[live] > step, pattern[begin[live] + np.maximum(half[live] - 1 - step, 0)], DELIMITER)
            size[live[symbol == self.symbols]] = 0
            live, symbol = live[symbol < self.symbols], symbol[symbol < self.symbols]
            low[live], back[live], size[live] = self.extend_left(symbol, low[live], back[live], size[live])
        q, back, size = asked[size > 0], back[size > 0], size[size > 0]
        j = half[q]
        none = np.empty(0, dtype=np.int64)
        pool = (none, none, none, none)  # word, place reached, interval, size: one error made
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q) or len(pool[0]):
            if len(q):
                nth, inverse = np.unique(back * (self.size + 1) + size, return_inverse=True)
                one_back, one_size = np.divmod(nth, self.size + 1)
                at, symbol, to, count = self.branches(one_back, one_size)
                begins, many = np.searchsorted(at, np.arange(len(nth))), np.bincount(at, minlength=len(nth))
                copies = many[inverse]
                child = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(begins[inverse], copies)
                cq, cj = np.repeat(q, copies), np.repeat(j, copies)
                other = symbol[child] != pattern[begin[cq] + cj]
                cq, cj, child = cq[other], cj[other], child[other]
                inner = cj < length[cq]
                gone = (j < length[q]) & (pattern[begin[q] + j] != pattern[np.minimum(begin[q] + j + 1, len(pattern) - 1)])
                pool = tuple(
                    np.concatenate(parts)
                    for parts in zip(
                        pool,
                        (cq[inner], cj[inner] + 1, to[child[inner]], count[child[inner]]),  # replaced
                        (cq, cj, to[child], count[child]),  # inserted
                        (q[gone], j[gone] + 1, back[gone], size[gone]),  # deleted
                        strict=True,
                    )
                )
                go = j < length[q]
                q, j, back, size = self._matched(pattern, begin, q[go], j[go], back[go], size[go])
            pq, pj, pback, psize = self._matched(pattern, begin, *pool)
            ended = pj > length[pq]
            found.append((pq[ended], self.located(pback[ended])))
            pool = (pq[~ended], pj[~ended], pback[~ended], psize[~ended])
        if not found:
            return none, none
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _matched(self, pattern, begin, q, j, back, size):
        """The states whose next symbol occurs, moved behind it."""
        symbol = pattern[begin[q] + j]
        known = symbol < self.symbols
        q, j, back, size, symbol = q[known], j[known], back[known], size[known], symbol[known]
        back, size = self.extend_right(symbol, back, size)
        left = size > 0
        return q[left], j[left] + 1, back[left], size[left]


def shared_start(a: np.ndarray, b: np.ndarray, words: list[str], others: list[str], cut: np.ndarray) -> np.ndarray:
    """For pairs of word numbers: do the words agree in their last ``cut`` code points (of the word asked)?"""
    return np.fromiter((others[y].endswith(words[x][len(words[x]) - c :]) for x, y, c in zip(a, b, cut, strict=True)), bool, len(a))


def search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words within one shard (columns side, text, n, indexed, asked; text is reversed on side 1).

    One row per word asked: word, n, n_near, best_n and best (near word of largest n, first in order among ties).
    """
    side = int(pdf["side"].iloc[0])
    inside, asking = pdf[pdf["indexed"]], pdf[pdf["asked"]]
    others, other_n = inside["text"].tolist(), inside["n"].to_numpy()
    words, own_n = asking["text"].tolist(), asking["n"].to_numpy()
    n_near, best_n = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    best: list[str | None] = [None] * len(words)
    index = Index(others) if others else None
    for lo in range(0, len(words) if index else 0, QUERY_BLOCK):
        part = words[lo : lo + QUERY_BLOCK]
        length = np.array([len(w) for w in part])
        # The exact half: the first half of the word, or on the other side its last half, which the reversal puts first.
        half = length // 2 if side == 0 else length - length // 2
        a, b = index.near(part, half)
        if side:  # words that also share the first half were found on side 0
            new = ~shared_start(a, b, part, others, (length // 2)[a])
            a, b = a[new], b[new]
        n_near[lo : lo + len(part)] = np.bincount(a, minlength=len(part))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            word = others[y][::-1] if side else others[y]
            if best[lo + x] is None or (-other_n[y], word) < (-best_n[lo + x], best[lo + x]):
                best[lo + x], best_n[lo + x] = word, other_n[y]
    shown = [w[::-1] for w in words] if side else words
    return pd.DataFrame({"word": shown, "n": own_n, "n_near": n_near, "best_n": best_n, "best": pd.Series(best, dtype=object)})


def shards(words: DataFrame, min_length: int, shard_symbols: int) -> DataFrame:
    """Rows of ``words`` (word, n) dealt to shards: side, a, b, c name the shard; indexed and asked say what the row does there."""
    head = max(1, min_length // 2)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("text")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text")))
    rows = words.select("n", F.explode(sides).alias("s")).select("n", "s.*").withColumn("key", F.substring("text", 1, head))
    sized = rows.groupBy("side", "key").agg(F.sum(F.length("text").cast("long") + 1).alias("size"))
    total = words.agg(F.sum(F.length("word").cast("long") + 1).alias("size")).first()["size"] or 0
    many = max(1, -(-total // shard_symbols))
    large = sized.where(F.col("size") > shard_symbols)
    large = large.select("side", "key", F.ceil(F.col("size") / shard_symbols).cast("int").alias("parts"))
    rows = rows.join(broadcast_if_small(large), ["side", "key"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    whole = F.array(F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("c"), F.lit(True).alias("indexed"), F.lit(True).alias("asked")))
    # Part i indexed meets every part j asked; where i = j the row does both.
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    here = F.col("part")
    as_index = F.transform(others, lambda x: F.struct(here.alias("b"), x.alias("c"), F.lit(True).alias("indexed"), (x == here).alias("asked")))
    as_query = F.transform(F.filter(others, lambda x: x != here), lambda x: F.struct(x.alias("b"), here.alias("c"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")))
    places = F.when(F.col("parts").isNull(), whole).otherwise(F.concat(as_index, as_query))
    group = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(many))).otherwise(F.xxhash64("key"))
    return rows.select("side", group.alias("a"), "text", "n", F.explode(places).alias("p")).select("side", "a", "text", "n", "p.*")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """word, n, n_near, best_n, best of every row of ``words`` (distinct word of at least ``min_length`` code points, n)."""
    found = shards(words, min_length, shard_symbols).groupBy("side", "a", "b", "c").applyInPandas(
        search_shard, "word string, n long, n_near long, best_n long, best string"
    )
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("_first"))
    return merged.select("word", "n", "n_near", (-F.col("_first.m")).alias("best_n"), F.col("_first.w").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """The last word that ``links`` (word, form) lead to from each of its words: word, root. Links must not run in circles."""
    links = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = settle(moved)
        if not moved.where("_moved").limit(1).count():
            return links
        links = moved.drop("_moved")


def variants(words: DataFrame, ratio: int = FORM_RATIO, min_length: int = MIN_LENGTH, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n)."""
    words = settle(words)
    near = settle(near_words(words, min_length, shard_symbols))
    formed = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", F.when(formed, F.col("best")).alias("form"), "n", "n_near", F.when(formed, F.col("best_n")).alias("form_n"))
    roots = follow(near.where(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame, drop_every: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Variants of the vocabulary of ``docs``."""
    return variants(vocabulary(docs, min_length, min_count, drop_every), min_length=min_length)
