"""Chat formatting by token-level assembly.

Every turn is encoded on its own by a public byte-level vocabulary; the template's control strings never pass through the
encoder but are spliced in as reserved ids behind the vocabulary. Control strings that occur inside a text are escaped
first, by one backslash behind their opening bracket (an escaped one gains another), so formatted text and tokens can both
be read back. The loss mask comes from prefix sums: +1 at an id that opens an assistant turn, -1 at the id that closes it.

    system [SYS]text[/SYS]   user [INST]text[/INST]   assistant <s>text</s>   other [ROLE]name[/ROLE]text[END]

Turns are encoded where they lie and shuffled once, as packed ids. A conversation is then streamed in order through one
task in chunks of bounded size, so its length is not bounded by memory; digests of whole texts need that order anyway.

Defined cases: a null text or role is empty; a null conversation id is one conversation; a null turn comes first; equal
turn numbers go by role, then by the tokens; repeated rows are repeated turns; very long texts are encoded in pieces;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import text_blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# A rank file is read by the driver and broadcast; larger ones are refused.
VOCABULARY_BYTES = 64 << 20
# Fixed split pattern of the public byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The reserved ids follow the vocabulary in this order.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]"]
OPEN = {"assistant": "<s>", "user": "[INST]", "system": "[SYS]"}
CLOSE = {"assistant": "</s>", "user": "[/INST]", "system": "[/SYS]"}
_TAIL = r"<{0}(?=\\*/?s>)|\[{0}(?=\\*(?:/?(?:INST|SYS|ROLE)|END)\])"
_PLAIN, _ESCAPED = re.compile(_TAIL.format("")), re.compile(_TAIL.format(r"\\"))
# Code points encoded in one call: the encoder recurses over runs of one kind.
PIECE = 20_000
# Tokens of an output row, at most.
CHUNK = 4096
# Tokens gathered before a block of output rows is handed on.
BLOCK_TOKENS = 500_000


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def vocabulary_bytes(path: str) -> bytes:
    size = Path(path).stat().st_size
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{path} holds {size} bytes, more than {VOCABULARY_BYTES}")
    return Path(path).read_bytes()


def reserved(ranks: dict[bytes, int]) -> tuple[int, dict[str, int]]:
    """First reserved id, and the id of each control string."""
    base = max(ranks.values()) + 1
    return base, {c: base + i for i, c in enumerate(CONTROL)}


def encode_turns(turns: DataFrame, shared) -> DataFrame:
    """Per turn (conv, turn, role, text) its segment: conv, turn, role and the ids as packed little-endian numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = ranks_of(shared.value)
        coder = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        base, ids = reserved(ranks)
        kind = np.dtype("<u2") if base + len(CONTROL) <= 1 << 16 else np.dtype("<u4")

        def encoded(text: str) -> list[int]:
            safe = escape(text)
            out: list[int] = []
            for lo in range(0, len(safe), PIECE):
                out += coder.encode_ordinary(safe[lo : lo + PIECE])
            return out

        def segment(role: str, text: str) -> bytes:
            if role in OPEN:
                parts = [ids[OPEN[role]], *encoded(text), ids[CLOSE[role]]]
            else:
                parts = [ids["[ROLE]"], *encoded(role), ids["[/ROLE]"], *encoded(text), ids["[END]"]]
            return np.array(parts, dtype=kind).tobytes()

        for pdf in batches:
            for lo, hi in text_blocks(pdf["text"].tolist()):
                part = pdf.iloc[lo:hi]
                packed = [segment(r, t) for r, t in zip(part["role"], part["text"], strict=True)]
                yield part[["conv", "turn", "role"]].assign(ids=packed)

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return turns.mapInPandas(run, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, ids binary")


def prefix_mask(ids: np.ndarray, base: int, opens: int, closes: int, depth: int) -> tuple[np.ndarray, int]:
    """Loss mask of a stretch of tokens, and the depth behind it; ``depth`` is the depth before it."""
    inside = depth + np.cumsum((ids == opens).astype(np.int64) - (ids == closes))
    return (inside > 0) & (ids < base), int(inside[-1]) if len(ids) else depth


def same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def format_chat(
    conversations: DataFrame, vocabulary: str = VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """Token rows of every conversation: conv, chunk (from 0), ids, loss (under the loss mask?).

    All chunks of a conversation lie in one partition, in order, as ``read_back`` takes them.
    """
    empty = F.lit("")
    turns = conversations.select(
        ref(conv_col).alias("conv"), ref(turn_col).alias("turn"),
        F.coalesce(ref(role_col), empty).alias("role"), F.coalesce(ref(text_col), empty).alias("text"),
    )
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    dealt = encode_turns(turns, shared).repartition("conv").sortWithinPartitions("conv", "turn", "role", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, control = reserved(ranks_of(shared.value))
        kind = np.dtype("<u2") if base + len(CONTROL) <= 1 << 16 else np.dtype("<u4")
        opens, closes = control[OPEN["assistant"]], control[CLOSE["assistant"]]
        rest, conv, number, depth, started = np.empty(0, dtype=np.int32), None, 0, 0, False
        rows: list[tuple] = []
        held = 0

        def cut(ids: np.ndarray, last: bool) -> np.ndarray:
            """Emit chunks of ``ids``; unless ``last``, what does not fill one is returned."""
            nonlocal number, depth, held
            end = len(ids) if last else len(ids) // chunk * chunk
            for lo in range(0, end, chunk):
                piece = ids[lo : min(lo + chunk, end)]
                mask, depth = prefix_mask(piece, base, opens, closes, depth)
                rows.append((conv, number, piece, mask))
                number += 1
                held += len(piece)
            return ids[end:]

        def block() -> pd.DataFrame:
            nonlocal rows, held
            out = pd.DataFrame(rows, columns=["conv", "chunk", "ids", "loss"])
            rows, held = [], 0
            return out

        for pdf in batches:
            convs, packed = pdf["conv"].tolist(), pdf["ids"].tolist()
            edges = [0, *(i for i in range(1, len(convs)) if not same(convs[i], convs[i - 1])), len(convs)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if not (started and same(convs[lo], conv)):
                    cut(rest, True)
                    rest, conv, number, depth, started = np.empty(0, dtype=np.int32), convs[lo], 0, 0, True
                for at in range(lo, hi):
                    rest = np.concatenate([rest, np.frombuffer(packed[at], dtype=kind).astype(np.int32)])
                    if len(rest) >= chunk:
                        rest = cut(rest, False)
                    if held >= BLOCK_TOKENS:
                        yield block()
        cut(rest, True)
        if rows:
            yield block()

    kind = turns.schema["conv"].dataType.simpleString()
    return dealt.mapInPandas(run, f"conv {kind}, chunk long, ids array<int>, loss array<boolean>")


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY, in_order: bool = False) -> DataFrame:
    """What token rows (conv, chunk, ids, loss) say, from the tokens alone: one row per conversation.

    conv, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (all text under the
    loss mask, unescaped), formatted_chars, n_tokens, loss_tokens. ``in_order`` says that the rows come as ``format_chat``
    leaves them; others are dealt and sorted first.
    """
    if not in_order:
        formatted = formatted.repartition("conv").sortWithinPartitions("conv", "chunk")
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = ranks_of(shared.value)
        base, control = reserved(ranks)
        pieces = [b""] * base
        for piece, i in ranks.items():
            pieces[i] = piece
        opened = {control[c]: role for role, c in OPEN.items()}
        closed = {control[c] for c in CLOSE.values()} | {control["[END]"]}
        width = {control[c]: len(c) for c in CONTROL}

        def decoded(ids: list[int]) -> str:
            return b"".join([pieces[i] for i in ids]).decode("utf-8")

        class Reader:
            def __init__(self, conv):
                self.conv, self.turns, self.all, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
                self.chars = self.loss_chars = self.tokens = self.loss_tokens = 0
                self.role, self.ids, self.under = "", [], []

            def take(self, ids: np.ndarray, loss: np.ndarray) -> None:
                self.tokens += len(ids)
                self.loss_tokens += int(loss.sum())
                start = 0
                for at in np.flatnonzero(ids >= base).tolist():
                    self.ids += ids[start:at].tolist()
                    self.under += loss[start:at].tolist()
                    self.mark(int(ids[at]))
                    start = at + 1
                self.ids += ids[start:].tolist()
                self.under += loss[start:].tolist()

            def mark(self, sign: int) -> None:
                """A reserved id: what was gathered before it is a role, a text or nothing."""
                self.chars += width[sign]
                text = decoded(self.ids)
                self.chars += len(text)
                if sign in opened:
                    self.role = opened[sign]
                elif sign == control["[/ROLE]"]:
                    self.role = unescape(text)
                elif sign in closed:
                    self.turns += 1
                    self.all.update(f"{self.role}\n{unescape(text)}\n".encode())
                    if any(self.under):
                        learnt = unescape(decoded([i for i, u in zip(self.ids, self.under, strict=True) if u]))
                        self.loss_chars += len(learnt)
                        self.loss.update(learnt.encode())
                self.ids, self.under = [], []

            def row(self) -> tuple:
                digests = self.all.hexdigest(), self.loss.hexdigest()
                return (self.conv, self.turns, digests[0], self.loss_chars, digests[1], self.chars, self.tokens, self.loss_tokens)

        reader: Reader | None = None
        for pdf in batches:
            done = []
            for conv, ids, loss in zip(pdf["conv"].tolist(), pdf["ids"], pdf["loss"], strict=True):
                if reader is None or not same(conv, reader.conv):
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conv)
                reader.take(np.asarray(ids), np.asarray(loss, dtype=bool))
            if done:
                yield pd.DataFrame(done, columns=names)
        if reader is not None:
            yield pd.DataFrame([reader.row()], columns=names)

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.mapInPandas(
        run,
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long",
    )


# The conversation that holds the control strings of a common template as plain text.
PROBE = (-7, "</s>[INST] ok [/INST]")


def chat_report(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Formats ``conversations`` and the probe conversation, and reports what is read back from the tokens."""
    spark = conversations.sparkSession
    slim = conversations.select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    probe = probe.select(*[F.col(f.name).cast(f.dataType) for f in slim.schema])
    return read_back(format_chat(slim.unionAll(probe), vocabulary), vocabulary, in_order=True).withColumnRenamed("conv", "conv_id")
