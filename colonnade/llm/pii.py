"""Personal data: fixed patterns, then a skip-chain conditional random field that carries labels across a document.

The patterns give the base spans of every whole text; they always stay. The random field labels the other tokens that
hold a digit or an at sign (tokens without either are observed as no data). Neighbouring tokens share a chain potential;
tokens of one document that repeat, whose last seven digits agree, or that repeat the part of an address before its at
sign, share a skip potential with a node of that form, however far apart they are. Sum-product messages run over this loopy graph, all documents of a batch at once, and tokens whose likeliest label
is a kind become added spans. So a number that stands in full once is found again where it is written differently.

Training is piecewise and closed-form: the base spans label the tokens of all documents, and the potentials of the
token's shape and of neighbouring labels are smoothed log frequencies of those counts, a fixed-size table summed by
Spark. The skip potential is a parameter.

Defined cases: a null text counts as empty; a document without data has zero counts, the digest of the empty string and
empty spans; overlapping base spans of different kinds all stay; repeated rows share their result; texts of any length
are read to their end; every pattern runs in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: no data
SHAPES = 65_536
SKIP_AGREE, SKIP_DIFFER = 4.0, -2.0
ROUNDS = 10  # at least; messages run on until they settle
SETTLED = 1e-3
DAMPING = 0.5
# Odds against a kind beyond those of a shape without any count say how often the shape is unlabelled in the corpus, not
# what this mention is. Skip evidence makes up for what exceeds them.
UNSEEN_ODDS = float(np.log(1.0 / 0.05))
UNEVIDENCED = 3.0  # odds that a repeated form is no data, as long as no mention says otherwise
CHAIN_LEAST = -1.0
CLAMPED = 40.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does: within a run every later start fails or is taken as well.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACTIVE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGE = re.compile(r"^[^A-Za-z0-9+(]*|[^A-Za-z0-9)]*$")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an at sign (after the last match) and a dotted domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> int:
    """Bucket of a token's form: runs of letters and of digits by length, signs as they are."""
    parts = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token[:64], re.S):
        c = m[0]
        parts.append(f"9{min(len(c), 20)}" if c[0].isdigit() else "a" if c[0].isalpha() else c)
    return int.from_bytes(hashlib.blake2b("".join(parts).encode("utf-8", "replace"), digest_size=4).digest(), "little") % SHAPES


class Tokens:
    """The tokens with a digit or an at sign of one text: places, labels from base spans, neighbours, signatures."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.start, self.end, self.label, self.shape, self.whole = [], [], [], [], []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []  # (mention, form that repeats)
        self.forms = 0
        if not ACTIVE.search(text):
            return
        seen: dict[str, list[int]] = {}
        k, last = 0, -1
        for nth, m in enumerate(TOKEN.finditer(text)):
            token = m[0]
            inside = None
            while k < len(spans) and spans[k][2] <= m.start():
                k += 1
            for s, kind, e in spans[k : k + 8]:
                if s < m.end() and e > m.start():
                    inside = kind
                    break
            if inside is None and not ACTIVE.search(token):
                continue
            i = len(self.start)
            bare = EDGE.sub("", token)
            lead = token.find(bare) if bare else 0
            self.start.append(m.start() + lead)
            self.end.append(m.start() + lead + len(bare) if bare else m.end())
            # A whole number that failed its check is observed as no data.
            digits = DIGITS.sub("", token)
            failed = inside is None and (14 <= len(digits) <= 19 and not luhn(digits) or IP.fullmatch(bare) is not None)
            self.label.append(0 if failed else -1 if inside is None else inside + 1)
            self.shape.append(shape(bare or token))
            self.whole.append("@" in token or len(digits) >= 10)  # stands for itself, never part of a longer span
            if i and nth == last + 1:
                self.chain.append((i - 1, i))
            last = nth
            if "@" in token:
                marks = [bare.lower(), bare.lower().partition("@")[0]]
            else:
                marks = [digits[-7:] if len(digits) >= 4 else "", bare.lower() if len(digits) >= 2 else ""]
            for mark in dict.fromkeys(m for m in marks if m):
                seen.setdefault(mark, []).append(i)
        # Every mention is linked to the node of its form: any two are two edges apart, edges grow with the mentions.
        for mentions in seen.values():
            if len(mentions) > 1:
                self.skip += [(i, self.forms) for i in mentions]
                self.forms += 1


def potentials(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(label x shape, label x label) log potentials, counted over every row."""
    rows = docs.select(ref(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unary = np.zeros((LABELS, SHAPES), dtype=np.int64)
        pair = np.zeros((LABELS, LABELS), dtype=np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                t = Tokens(text, base_spans(text))
                label = np.maximum(np.array(t.label, dtype=np.int64), 0)
                if len(label):
                    np.add.at(unary, (label, np.array(t.shape)), 1)
                    if t.chain:
                        a, b = np.array(t.chain).T
                        np.add.at(pair, (label[a], label[b]), 1)
        flat = np.concatenate([unary.ravel(), pair.ravel()])
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"at": at, "n": flat[at]})

    got = rows.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(LABELS * SHAPES + LABELS * LABELS)
    flat[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    unary = flat[: LABELS * SHAPES].reshape(LABELS, SHAPES) + np.array([[1.0]] + [[0.05]] * len(KINDS))
    pair = flat[LABELS * SHAPES :].reshape(LABELS, LABELS) + 1.0
    chance = unary / unary.sum(axis=0)  # P(label | shape): local factors of a conditional model
    joint = pair / pair.sum()
    return np.log(chance), np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0)))


def propagate(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Beliefs after damped sum-product messages over ``edges`` (pairs of nodes) with the tables of their kinds."""
    if not len(edges):
        return unary
    a, b = edges.T
    forth = np.zeros((len(edges), LABELS))
    back = np.zeros((len(edges), LABELS))
    table = tables[kinds]

    def beliefs() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, b, forth)
        np.add.at(total, a, back)
        return total

    def message(value: np.ndarray, weights: np.ndarray) -> np.ndarray:
        joint = value[:, :, None] + weights
        top = joint.max(axis=1, keepdims=True)
        out = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
        return out - out.max(axis=1, keepdims=True)

    done, change = 0, np.inf
    while done < ROUNDS or (change > SETTLED and done < ROUNDS + 2 * len(unary)):  # no path is longer than the nodes
        total = beliefs()
        new_forth = message(total[a] - back, table)
        new_back = message(total[b] - forth, table.transpose(0, 2, 1))
        change = max(np.abs(new_forth - forth).max(), np.abs(new_back - back).max())
        forth = DAMPING * forth + (1 - DAMPING) * new_forth
        back = DAMPING * back + (1 - DAMPING) * new_back
        done += 1
    return beliefs()


def skip_tables(unary: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Log potential of (label of a mention, label of its form) per mention.

    An observed mention speaks for its label. Any other one only listens: its table is the conditional probability of its
    label given the form's, so mentions without evidence neither lift one another nor outvote one that has some.
    """
    skip = np.full((LABELS, LABELS), SKIP_DIFFER)
    np.fill_diagonal(skip, SKIP_AGREE)
    skip[0, 0] = 0.0
    out = np.repeat(skip[None], len(unary), axis=0)
    beyond = np.maximum(unary[:, :1] - unary - UNSEEN_ODDS, 0.0)
    out += np.eye(LABELS)[None] * beyond[:, :, None]
    joint = out + unary[:, :, None]
    top = joint.max(axis=1, keepdims=True)
    out -= np.log(np.exp(joint - top).sum(axis=1, keepdims=True)) + top
    return np.where(known[:, None, None], skip, out)


def added_spans(found: list[Tokens], unary_log: np.ndarray, chain_log: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans that the random field adds in each text."""
    sizes = [len(t.start) for t in found]
    if not sum(sizes):
        return [[] for _ in found]
    shift = np.concatenate([[0], np.cumsum(sizes)])
    label = np.array([x for t in found for x in t.label])
    unary = unary_log[:, np.array([x for t in found for x in t.shape])].T.copy()
    known = label >= 0
    unary[known] = -CLAMPED
    unary[known, label[known]] = 0.0
    edges = [(i + s, j + s) for t, s in zip(found, shift) for i, j in t.chain]
    forms = shift[-1] + np.concatenate([[0], np.cumsum([t.forms for t in found])])
    skips = [(i + s, j + f) for t, s, f in zip(found, shift, forms) for i, j in t.skip]
    mention = np.array([i for i, _ in skips], dtype=np.int64)
    tables = np.concatenate([np.maximum(chain_log, CHAIN_LEAST)[None], skip_tables(unary[mention], known[mention])])
    form = np.zeros((forms[-1] - forms[0], LABELS))
    form[:, 1:] = -UNEVIDENCED
    belief = propagate(
        np.concatenate([unary, form]),
        np.array(edges + skips, dtype=np.int64).reshape(-1, 2),
        np.concatenate([np.zeros(len(edges), dtype=np.int64), 1 + np.arange(len(skips))]),
        tables,
    )[: shift[-1]]
    best = np.where(known, 0, belief.argmax(axis=1))
    out = []
    for t, s in zip(found, shift):
        spans: list[tuple[int, int, int]] = []
        linked = {j for _, j in t.chain}
        for i in range(len(t.start)):
            kind = best[s + i] - 1
            if kind < 0:
                continue
            if spans and i in linked and best[s + i - 1] - 1 == kind and not t.whole[i] and not t.whole[i - 1]:
                spans[-1] = (spans[-1][0], kind, t.end[i])
            else:
                spans.append((t.start[i], kind, t.end[i]))
        out.append([(a, int(k), b) for a, k, b in spans])
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_spans and spans (base and added) as text, n_added."""
    unary, chain = potentials(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((unary, chain))
    slim = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            base = [base_spans(t) if ACTIVE.search(t) else [] for t in texts]
            more = added_spans([Tokens(t, s) for t, s in zip(texts, base)], *shared.value)
            counts = {f"n_{k}": [sum(x[1] == i for x in s) for s in base] for i, k in enumerate(KINDS)}
            yield pdf[["doc_id"]].assign(
                **counts,
                base_spans=[written(s) for s in base],
                spans=[written(s + m) for s, m in zip(base, more)],
                n_added=[len(m) for m in more],
            )

    kind = slim.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return slim.mapInPandas(run, f"doc_id {kind}, {counts}, base_spans string, spans string, n_added long")


def pii_report(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added"
    )
