"""Toxicity: noisy-channel deobfuscation by Viterbi over character lattices, then a word score of the restored text.

Three passes. (1) A character trigram model is counted over all texts; the counts are one fixed-size table, summed by
Spark. (2) Word features (whole word and its first 4, 5 and 6 letters) are counted per class over a bounded sample of
labelled rows (``train_rows``, documented, chosen by hash of the id). (3) Every whole text is restored and scored.

Restoration looks at tokens that may be disguised: signs or digits among letters, letters repeated three times or more,
and single letters in a row with separators. Each becomes a lattice of readings (a digit or sign as itself or as the
letters it imitates, a run of letters as it is or shortened, separated letters as words or as one word) and the reading
of the highest channel times language-model probability wins. Tokens without such signs have one reading: themselves.

Defined cases: a null text counts as empty; an empty text gets the score of no evidence; rows without a label teach
nothing; of several labels of a document the highest counts; without labelled rows every score is the prior of zero;
repeated rows share their score; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import settle, text_blocks
from colonnade.llm.langid import Letters, code_points, held_out

TRAIN_ROWS = 20_000
SIZE = 64  # symbols of the language model: 0 border, 1-26 a-z, the rest other letters by code point
# Letters that a digit or sign imitates.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
}
SEPARATORS = " .-_*"
LOG_SELF, LOG_IMITATE, LOG_SHORTEN, LOG_JOIN = -0.05, -1.5, -0.5, -1.0
# Log-probability of a sign that stands for itself inside a token: it ends the word.
LOG_SIGN = -3.0
PREFIXES = (4, 5, 6)
FILTER_BITS = 20
MIN_SUPPORT = 3
# A feature's chance is its toxic support over that, its clean documents and a prior; below the floor it counts nothing.
PRIOR_SUPPORT = 3.0
CHANCE_FLOOR = 0.65


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point: 0 for anything that is no letter."""
    letter, lower, _ = Letters.tables()
    known = np.minimum(points, len(letter) - 1)
    low = lower[known]
    latin = (low >= 97) & (low <= 122)
    sign = np.where(latin, low - 96, 27 + low % (SIZE - 27))
    return np.where(letter[known] & (points < len(letter)), sign, 0).astype(np.int64)


def symbol(char: str) -> int:
    return int(symbols(code_points(char))[0])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log P(c | a, b) over symbols, counted over every row; 64^3 sums reach the driver whatever the input."""
    rows = docs.select(ref(text_col).alias("text")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in text_blocks(texts):
                s = symbols(code_points("  " + "  ".join(texts[lo:hi]) + "  "))
                s = s[(s > 0) | (np.concatenate([[1], s[:-1]]) > 0)]  # one border between words
                s = np.insert(s, np.flatnonzero(s == 0), 0)  # two, so that a word starts from nothing
                total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": total[at]})

    got = rows.mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(axis=0) + 0.1
    uni = bi / bi.sum(axis=1, keepdims=True)
    smooth = (tri + 5.0 * uni[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 5.0)
    return np.log(smooth)


class Restorer:
    """Viterbi decoder of disguised tokens under a language model; remembers what it decoded."""

    def __init__(self, log: np.ndarray):
        self.log = log.tolist()
        self.known: dict[str, str] = {}

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters its readings and their channel log-probabilities."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            char, n = m[1], len(m[0])
            if char.isalpha():
                kept = [(char * n, LOG_SELF)]
                if n >= 2:
                    kept.append((char, LOG_SHORTEN if n >= 3 else LOG_SHORTEN - 2.0))
                if n >= 3:
                    kept.append((char * 2, LOG_SHORTEN))
                out.append(kept)
            else:
                out.append([(m[0], LOG_SIGN)] + [(x, LOG_IMITATE) for x in IMITATED.get(char, "")])
        return out

    def best(self, readings: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """The most probable sequence of readings and its log-probability, between word borders."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in readings:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (value, path) in states.items():
                for text, cost in options:
                    x, y, v = a, b, value + cost
                    for char in text:
                        c = symbol(char)
                        if c or y:
                            v += log[x][y][c]
                            x, y = (y, c) if c else (0, 0)
                    if (x, y) not in after or v > after[x, y][0]:
                        after[x, y] = (v, (path, text))
            states = after
        value, path = max(((v + (log[a][b][0] if b else 0.0), p) for (a, b), (v, p) in states.items()), key=lambda s: s[0])
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts)), value

    def token(self, token: str) -> str:
        """A token with signs among its letters or long runs of a letter."""
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = self.best(self.readings(token))[0]
        return self.known[token]

    def spaced(self, piece: str) -> str:
        """Single letters in a row with separators: one word when that is more probable than as they stand."""
        if piece not in self.known:
            joined, one = self.best(self.readings("".join(c for c in piece if c not in SEPARATORS)))
            apart = sum(self.best([[(c, LOG_SELF)]])[1] for c in piece if c not in SEPARATORS)
            self.known[piece] = joined if one + LOG_JOIN > apart else piece
        return self.known[piece]


SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*]{1,2}[\w@$!|+]){3,}(?!\w)")
TOKEN = re.compile(r"\S+")
IMITATING = np.array([ord(c) for c in IMITATED])


def restore(text: str, restorer: Restorer) -> str:
    """The text with disguised tokens replaced by their most probable reading."""
    points = code_points(text)
    if len(points) < 4:
        return text
    letter, lower, _ = Letters.tables()
    known = np.minimum(points, len(letter) - 1)
    is_letter = letter[known]
    low = np.where(is_letter, lower[known], points)
    # Single letters two apart, four times: worth the expression below.
    alone = np.concatenate([[False], ~is_letter, [False]])
    alone[0] = alone[-1] = True
    single = is_letter & alone[:-2] & alone[2:]
    sign = np.isin(points, IMITATING)
    if (single[:-6] & (single | sign)[2:-4] & (single | sign)[4:-2]).any() or (single[:-6] & single[3:-3]).any():
        text = SPACED.sub(lambda m: restorer.spaced(m[0]), text)
        points = code_points(text)
        known = np.minimum(points, len(letter) - 1)
        is_letter = letter[known]
        low = np.where(is_letter, lower[known], points)
        sign = np.isin(points, IMITATING)
    if len(points) < 4:
        return text
    digit = sign & (points >= 48) & (points <= 57)
    disguised = np.zeros(len(points), dtype=bool)
    disguised[:-1] |= sign[:-1] & is_letter[1:]
    disguised[1:] |= digit[1:] & is_letter[:-1]
    disguised[2:] |= is_letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    at = np.flatnonzero(disguised)
    if not len(at):
        return text
    out, done = [], 0
    for i in at.tolist():
        if i < done:
            continue
        start = i
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, i).end() if not text[i].isspace() else i + 1
        out += [text[done:start], restorer.token(text[start:end])]
        done = end
    return "".join(out) + text[done:]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 64-bit feature, word before it) of every word: the whole word, and its first letters if longer."""
    letter, lower, _ = Letters.tables()
    points = code_points("\0" + "\0".join(texts) + "\0" * 8)
    known = np.minimum(points, len(letter) - 1)
    mask = letter[known] & (points < len(letter))
    step = np.diff(mask.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    breaks = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(breaks, starts, side="right") - 1
    low = np.where(mask, lower[known], 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        grown = np.zeros(len(starts), dtype=np.uint64)
        keys, at_word = [], []
        width = ends - starts
        longest = int(width.max()) if len(width) else 0
        live = np.arange(len(starts))
        for k in range(longest):
            live = live[width[live] > k]
            grown[live] = (grown[live] ^ low[starts[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
            grown[live] ^= grown[live] >> np.uint64(31)
            if k + 1 in PREFIXES:
                longer = live[width[live] > k + 1]
                keys.append(grown[longer] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                at_word.append(longer)
        keys.append(grown)
        at_word.append(np.arange(len(starts)))
    word = np.concatenate(at_word)
    before = np.concatenate([[0], grown[:-1]]).astype(np.uint64) if len(grown) else grown
    return owner[word], np.concatenate(keys), before[word]


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int, label_col: str, id_col: str) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that are not held out, the first by hash of the id."""
    picked = labels.where(ref(id_col).isNotNull() & ref(label_col).isNotNull() & ~held_out(id_col))
    picked = picked.groupBy(ref(id_col).alias("_id")).agg(F.max(ref(label_col).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    slim = docs.select(ref(id_col).alias("_id"), ref("text").alias("text")).where(F.col("text").isNotNull())
    # At most ``rows`` rows of two numbers each: a proven bound for a broadcast.
    return settle(slim.join(F.broadcast(picked), "_id").select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, log: np.ndarray, rows: int = TRAIN_ROWS, label_col: str = "toxic", id_col: str = "doc_id") -> dict:
    """Weights of the features with support in the toxic documents of the sample."""
    spark = docs.sparkSession
    sample = sample_labelled(docs, labels, rows, label_col, id_col)
    shared = spark.sparkContext.broadcast(log)

    def toxic_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for pdf in batches:
            texts = pdf["text"][pdf["toxic"] > 0].tolist()
            for lo, hi in text_blocks(texts):
                owner, key, before = features([restore(t, restorer) for t in texts[lo:hi]])
                _, first = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1, return_index=True)
                yield pd.DataFrame({"key": key[first].view(np.int64), "before": before[first].view(np.int64)})

    # Support: documents that hold the feature, counted once for each word it follows there first, so that copies of
    # one text count once.
    seen = sample.mapInPandas(toxic_features, "key long, before long").distinct()
    chosen = seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT).toPandas()
    names = chosen["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, toxic = names[order], chosen["n"].to_numpy(np.float64)[order]
    known = spark.sparkContext.broadcast(names)

    def clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, keys = Restorer(shared.value), known.value
        counts = np.zeros(len(keys), dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"][pdf["toxic"] == 0].tolist()
            for lo, hi in text_blocks(texts):
                owner, key, _ = features([restore(t, restorer) for t in texts[lo:hi]])
                counts += np.bincount(lookup(keys, owner, key)[1], minlength=len(keys))
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"at": at, "n": counts[at]})

    sums = sample.mapInPandas(clean_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    clean = np.zeros(len(names))
    clean[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy()
    chance = toxic / (toxic + clean + PRIOR_SUPPORT)
    strong = chance >= CHANCE_FLOOR
    return {"keys": names[strong], "weights": -np.log1p(-chance[strong]), "log": log}


def lookup(keys: np.ndarray, owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, place in the sorted ``keys``) of the features that are among ``keys``."""
    at = np.searchsorted(keys, key)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == key[hit]
    pairs = np.unique(owner[hit] * np.int64(max(len(keys), 1)) + at[hit])
    return pairs // max(len(keys), 1), pairs % max(len(keys), 1)


def score_texts(texts: list[str], model: dict, restorer: Restorer, gate: np.ndarray) -> np.ndarray:
    """Chance that at least one feature of a restored text is a toxic one (each distinct feature counts once)."""
    owner, key, _ = features([restore(t, restorer) for t in texts])
    maybe = gate[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    text, at = lookup(model["keys"], owner[maybe], key[maybe])
    return -np.expm1(-np.bincount(text, weights=model["weights"][at], minlength=len(texts)))


def toxicity_report(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, language_model(docs), rows, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(ref("doc_id").alias("doc_id"), held_out().alias("held_out"), ref("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        restorer = Restorer(m["log"])
        gate = np.zeros(1 << FILTER_BITS, dtype=bool)
        gate[(m["keys"] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            score = np.zeros(len(texts))
            for lo, hi in text_blocks(texts):
                score[lo:hi] = score_texts(texts[lo:hi], m, restorer, gate)
            yield pdf[["doc_id", "held_out"]].assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the restored text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(language_model(docs, text_col))
    slim = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for pdf in batches:
            yield pdf.assign(text=[restore(t, restorer) if isinstance(t, str) else None for t in pdf["text"]])

    return slim.mapInPandas(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")
