"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

The model is one table of letter trigrams (hashed within a word, with its borders) per language, counted over all
training rows by Spark; only its fixed-size sums reach the driver. A text is cut into words (runs of letters). Each word
gets a log-probability per language; languages that do not use the script of the word are no candidates for it (unless no
language uses it). Viterbi over the words of a text, paying a penalty for every change of language, labels each word;
words of equal label in a row are a span.

Defined cases: a null text or one without letters is ``und`` with score 0; ties go to the language first in order;
rows with a null lang, or held-out rows, teach nothing; without any training row every text is ``und``; repeated rows
share their result; a text of any length is read to its end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import text_blocks

BUCKETS = 1 << 16
SWITCH_PENALTY = 6.0  # nats paid for a change of language between two words
SMOOTHING = 0.5
# Share of a language's letters that a script must hold for the language to be a candidate in that script.
SCRIPT_SHARE = 0.01
# Upper ends of Unicode ranges and the script group of each; code points are public constants of the standard.
SCRIPT_RANGES = [
    (0x0250, 1), (0x0370, 0), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0780, 6), (0x0900, 0),
    (0x0980, 7), (0x0E00, 8), (0x0E80, 9), (0x10A0, 0), (0x1100, 10), (0x1200, 11), (0x1E00, 0), (0x1F00, 1),
    (0x2000, 2), (0x3040, 0), (0x30A0, 12), (0x3100, 13), (0xAC00, 14), (0xD7B0, 11), (0x110000, 15),
]
SCRIPTS = 16


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no rest by 5; false for a null id."""
    return F.coalesce(F.crc32(ref(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Letters:
    """Per code point: is it a letter, its lower case, its script. Built once per Python worker from the standard tables."""

    made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.made is None:
            top = 0x110000  # every code point there is
            chars = [chr(i) for i in range(top)]
            letter = np.array([c.isalpha() for c in chars])
            lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
            script = np.zeros(top, dtype=np.uint8)
            start = 0
            for end, s in SCRIPT_RANGES:
                script[start : min(end, top)] = s
                start = min(end, top)
            cls.made = letter, lower, script
        return cls.made


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """The words of several texts at once: (text number, start, end in its code points, script, trigram buckets, their word).

    Words are maximal runs of letters; trigrams run over the lower-cased word with a border sign on both sides.
    """
    letter, lower, script = Letters.tables()
    points = [code_points(t) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    flat = np.zeros(int(sizes.sum()) + 1, dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1] + 1  # a zero before each text and after the last
    for b, p in zip(begins, points):
        flat[b : b + len(p)] = p
    mask = letter[flat]
    step = np.diff(mask.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    owner = np.searchsorted(begins, starts, side="right") - 1
    low = np.where(mask, lower[flat], 0).astype(np.uint64)
    # The trigram centred at each letter; a border counts as code point 0.
    with np.errstate(over="ignore"):
        mix = low[:-2] * np.uint64(0x9E3779B97F4A7C15) + low[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + low[2:] * np.uint64(0x165667B19E3779F9)
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    centre = np.flatnonzero(mask)
    buckets = (mix[centre - 1] >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    return owner, starts - begins[owner], ends - begins[owner], script[flat[starts]], buckets, word


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """Count trigrams and scripts per language over all given rows; the sums are languages x (65536 + 16) numbers."""
    rows = docs.where(ref(lang_col).isNotNull() & ref(text_col).isNotNull())
    rows = rows.select(ref(lang_col).cast("string").alias("lang"), ref(text_col).alias("text"))
    width = BUCKETS + SCRIPTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang")["text"]:
                texts = part.tolist()
                total = sums.setdefault(lang, np.zeros(width, dtype=np.int64))
                for lo, hi in text_blocks(texts):
                    _, start, end, script, buckets, _ = words_of(texts[lo:hi])
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, weights=end - start, minlength=SCRIPTS).astype(np.int64)
        for lang, total in sums.items():
            slot = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": slot.astype(np.int32), "n": total[slot]})

    counts = rows.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(got["lang"].unique())
    grid = np.zeros((width, len(langs)))
    grid[got["slot"].to_numpy(), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    grams, scripts = grid[:BUCKETS], grid[BUCKETS:]
    log = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)) if langs else grams
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    uses[~uses.any(axis=1)] = True  # no language uses the script: all stay candidates
    return {"langs": langs, "log": log.astype(np.float32), "uses": uses}


def viterbi(scores: np.ndarray, owner: np.ndarray, texts: int, penalty: float) -> np.ndarray:
    """Best label of each word. ``scores`` (words x labels) lie text by text; all texts advance together, word by word."""
    total, labels = scores.shape
    best = np.empty(total, dtype=np.int32)
    counts = np.bincount(owner, minlength=texts)
    order = np.argsort(-counts, kind="stable")  # longest first: the texts still running are a prefix
    first = (np.concatenate([[0], np.cumsum(counts)])[:-1])[order]
    length = counts[order]
    running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    stay = np.zeros((total, labels), dtype=bool)
    source = np.zeros(total, dtype=np.int16)
    value = np.zeros((texts, labels))
    for t, live in enumerate(running):
        at = first[:live] + t
        v = value[:live]
        if t:
            top = v.argmax(axis=1)
            move = v[np.arange(live), top] - penalty
            keep = v >= move[:, None]
            stay[at], source[at] = keep, top
            v = np.where(keep, v, move[:, None])
        value[:live] = v + scores[at]
    state = value.argmax(axis=1) if labels else np.zeros(texts, dtype=np.int64)
    for t in range(len(running) - 1, -1, -1):
        live = running[t]
        at = first[:live] + t
        now = state[:live]
        best[at] = now
        if t:
            state[:live] = np.where(stay[at, now], now, source[at])
    return best


def label_words(texts: list[str], model: dict, penalty: float) -> tuple[np.ndarray, ...]:
    """(text number, start, end, label) of every word of the texts."""
    owner, start, end, script, buckets, word = words_of(texts)
    labels = len(model["langs"])
    if not len(owner) or not labels:
        return owner, start, end, np.zeros(len(owner), dtype=np.int32)
    first = np.concatenate([[0], np.cumsum(end - start)])[:-1]
    scores = np.empty((len(owner), labels))
    for k in range(labels):
        scores[:, k] = np.add.reduceat(model["log"][:, k][buckets], first)
    scores[~model["uses"][script]] = -1e6
    return owner, start, end, viterbi(scores, owner, len(texts), penalty)


def _model_of(spark, model: dict):
    return spark.sparkContext.broadcast(model)


def identify(
    docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """Per row its id, lang_pred and lang_score: the language of most letters and its share of the letters."""
    shared = _model_of(docs.sparkSession, model)
    slim = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        langs = np.array([*m["langs"], "und"], dtype=object)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            pred, score = np.full(len(texts), len(langs) - 1), np.zeros(len(texts))
            for lo, hi in text_blocks(texts):
                owner, start, end, label = label_words(texts[lo:hi], m, penalty)
                if len(m["langs"]):
                    mass = np.zeros((hi - lo, len(m["langs"])))
                    np.add.at(mass, (owner, label), end - start)
                    letters = mass.sum(axis=1)
                    pred[lo:hi] = np.where(letters > 0, mass.argmax(axis=1), len(langs) - 1)
                    score[lo:hi] = mass.max(axis=1) / np.maximum(letters, 1)
            yield pdf[["doc_id"]].assign(lang_pred=langs[pred], lang_score=score)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}, lang_pred string, lang_score double")


def spans(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per span of one language: doc_id, start, end (code points, end exclusive), lang, words."""
    shared = _model_of(docs.sparkSession, model)
    slim = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        langs = np.array(m["langs"], dtype=object)
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
            for lo, hi in text_blocks(texts):
                owner, start, end, label = label_words(texts[lo:hi], m, penalty)
                if not len(owner) or not len(langs):
                    continue
                new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(label) != 0)])
                at = np.flatnonzero(new)
                last = np.concatenate([at[1:], [len(owner)]]) - 1
                yield pd.DataFrame(
                    {"doc_id": ids[lo:hi][owner[at]], "start": start[at], "end": end[last], "lang": langs[label[at]], "words": last - at + 1}
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}, start long, end long, lang string, words long")


def train_on_rest(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> dict:
    """Model of the rows that are not held out."""
    return train(docs.where(~held_out(id_col)), lang_col, text_col)


def language_report(docs: DataFrame, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt from the rows that are not held out."""
    found = identify(docs, train_on_rest(docs), penalty=penalty)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(
    docs: DataFrame, min_score: float = 0.0, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` whose text has a language (not ``und``) that holds at least ``min_score`` of its letters."""
    shared = _model_of(docs.sparkSession, train_on_rest(docs, id_col, "lang", text_col))

    @F.pandas_udf("boolean")
    def good(column: pd.Series) -> pd.Series:
        m = shared.value
        texts = [t if isinstance(t, str) else "" for t in column]
        keep = np.zeros(len(texts), dtype=bool)
        for lo, hi in text_blocks(texts):
            owner, start, end, label = label_words(texts[lo:hi], m, penalty)
            if len(m["langs"]):
                mass = np.zeros((hi - lo, len(m["langs"])))
                np.add.at(mass, (owner, label), end - start)
                letters = mass.sum(axis=1)
                keep[lo:hi] = (letters > 0) & (mass.max(axis=1) >= min_score * letters)
        return pd.Series(keep)

    return docs.where(good(ref(text_col)))
