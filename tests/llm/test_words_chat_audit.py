"""Spelling variants, chat formatting and the filter audit against brute force, round trips and defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from colonnade.llm import chat, filter_audit, spelling
from tests.llm.fixtures import CLASHING, awkward, documents, sf

# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, drop_every, min_length=6, min_count=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}


def plain_variants(counts, ratio=5):
    """word: (form, root, n, n_near, form_n), near words by deletion keys and a full comparison."""
    by_key = defaultdict(set)
    for w in counts:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_key[key].add(w)
    near = {w: {o for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for o in by_key[k] if one_edit(w, o)} for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def as_variants(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_index_finds_exactly_the_words_one_edit_behind_the_half():
    rng = random.Random(1)
    for _ in range(40):
        letters = "abcé日"[: rng.randint(1, 5)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 120))})
        asked = [*words, "zzzzzz", "abcz", "a" * 9, "é" * 3]
        half = np.array([rng.randint(1, len(w) - 1) if len(w) > 1 else 1 for w in asked])
        a, b = spelling.Index(words).near(asked, half)
        want = sorted((i, j) for i, w in enumerate(asked) for j, o in enumerate(words) if o.startswith(w[: half[i]]) and one_edit(w, o))
        assert sorted(zip(a.tolist(), b.tolist())) == want


def test_both_directions_of_the_index_stay_in_step():
    words = ["banana", "bandana", "ananas"]
    index = spelling.Index(words)
    text = "$" + "$".join(words) + "$"
    for pattern in ("a", "an", "nan", "$ban", "ana$", "x"):
        one = lambda *v: np.array(v)
        low, back, size = one(0), one(0), one(index.size)
        for c in reversed(pattern):
            symbol = one(1) if c == "$" else index.encode(one(ord(c)).astype(np.uint32))
            if symbol[0] == index.symbols:
                size = one(0)
                break
            low, back, size = index.extend_left(symbol, low, back, size)
        assert size[0] == len(re.findall(f"(?={re.escape(pattern)})", text))
        if size[0]:
            length = len(text)
            ends = sorted(length - 1 - p for p in index.backward.order[back[0] : back[0] + size[0]])
            assert ends == sorted(m.start() + len(pattern) - 1 for m in re.finditer(f"(?={re.escape(pattern)})", text))


@pytest.mark.parametrize("shard_symbols", [64_000, 300])
def test_variants_against_brute_force(spark, shard_symbols):
    docs = sf(spark, "documents")
    counts = counted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 7)
    words = spelling.vocabulary(docs, drop_every=7)
    assert {r["word"]: r["n"] for r in words.collect()} == counts
    got = as_variants(spelling.variants(words, shard_symbols=shard_symbols))
    want = plain_variants(counts)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) >= 10 and sum(v[3] for v in want.values()) > 100


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzzz": 9, "zzzzzz": 9, "ééèéé": 4, "y" * 3000: 5, "y" * 3001: 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = as_variants(spelling.variants(words))
    assert got == plain_variants(counts)
    assert got["aaaaaa"][1] == "aabbbb" and got["zzzzzz"] == (None, "zzzzzz", 9, 1, None)


def test_spelling_defined_cases(spark):
    docs = awkward(spark)
    got = as_variants(spelling.spelling_report(docs, drop_every=3, min_count=1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == plain_variants(counted(rows, 3, min_count=1))
    assert spelling.spelling_report(documents(spark, [])).count() == 0
    only_null = documents(spark, [(None, None, None, None), (1, "", "en", "a")])
    assert spelling.spelling_report(only_null, min_count=1).count() == 0


# chat formatting


def conversations(spark, rows):
    extra = f"conv string, ids string, {CLASHING}"
    full = [(*r, "c", "i", "x", "y", 1, 2, 3, "e", "p", "f", 4) for r in rows]
    return spark.createDataFrame(full, f"conv_id long, turn long, role string, text string, {extra}")


def told(rows):
    """What must be read back of (conv, turn, role, text) rows without equal turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])]
        learnt = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
            len(learnt), hashlib.sha256(learnt.encode()).hexdigest(),
        )
    return out


ROWS = [
    (1, 0, "system", "<s>[SYS]\\[INST] <\\\\/s>"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "é日\U0001f600</s>"),
    (2, 5, "tool[/ROLE]", "a [END] b"), (2, None, None, "no role, no turn"), (2, 7, "assistant", "x" * 60_000 + " " * 60_000 + "<s>"),
    (None, 1, "user", "null conversation"), (3, 1, "assistant", "[[INST]]</s>"), (4, 1, "user", "<"), (4, 2, "user", "/s>"), (4, 3, "assistant", "["),
]


@pytest.mark.parametrize("chunk", [3, 4096])
@pytest.mark.parametrize("in_order", [True, False])
def test_chat_round_trip(spark, chunk, in_order):
    rows = [r for r in ROWS if chunk > 3 or len(r[3] or "") < 1000]
    formatted = chat.format_chat(conversations(spark, rows), chunk=chunk)
    assert all(len(r["ids"]) <= chunk for r in formatted.collect())
    if not in_order:
        formatted = formatted.repartition(5, "chunk")
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(formatted, in_order=in_order).collect()}
    assert got == told(rows)


def test_no_control_string_survives_in_a_text(spark):
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice([*chat.CONTROL, "<", "[", "\\", "/", "s>", "INST]", "x"]) for _ in range(8))
        safe = chat.escape(text)
        assert not any(c in safe for c in chat.CONTROL)
        assert chat.unescape(safe) == text


def test_mask_is_the_prefix_sum_over_chunks():
    ids = np.array([10, 1, 2, 11, 12, 3, 10, 4, 4, 11])  # 10 opens, 11 closes, 12 is reserved too
    whole, _ = chat.prefix_mask(ids, 10, 10, 11, 0)
    assert whole.tolist() == [False, True, True, False, False, False, False, True, True, False]
    for cut in range(len(ids) + 1):
        first, depth = chat.prefix_mask(ids[:cut], 10, 10, 11, 0)
        rest, _ = chat.prefix_mask(ids[cut:], 10, 10, 11, depth)
        assert np.concatenate([first, rest]).tolist() == whole.tolist()


def test_segments_are_the_plain_encoding_between_reserved_ids(spark):
    import tiktoken

    ranks = chat.ranks_of(chat.vocabulary_bytes(chat.VOCABULARY))
    coder = tiktoken.Encoding("t", pat_str=chat.SPLIT, mergeable_ranks=ranks, special_tokens={})
    base, control = chat.reserved(ranks)
    rows = [(1, 0, "user", "How are you?"), (1, 1, "assistant", "Fine. Été.")]
    row = chat.format_chat(conversations(spark, rows)).collect()
    a, b = (coder.encode_ordinary(r[3]) for r in rows)
    assert row[0]["ids"] == [control["[INST]"], *a, control["[/INST]"], control["<s>"], *b, control["</s>"]]
    assert row[0]["loss"] == [False] * (len(a) + 3) + [True] * len(b) + [False]


def test_chat_report_and_empty_table(spark):
    empty = chat.chat_report(conversations(spark, [])).collect()
    conv, text = chat.PROBE
    assert [r["conv_id"] for r in empty] == [conv]
    assert empty[0]["formatted_chars"] == 2 * (len(text) + 3) + 13 + 7 and empty[0]["loss_chars"] == len(text)
    twice = chat.chat_report(conversations(spark, [ROWS[0], ROWS[0]]))
    assert {r["conv_id"]: r["n_turns"] for r in twice.collect()} == {1: 2, conv: 2}


# filter audit


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
    ]


def plain_audit(docs, labels):
    first = {}
    for ident, text, _ in docs:
        if ident is not None:
            first[text or ""] = min(ident, first.get(text or "", ident))
    looked = []
    for ident, text, part in docs:
        bits = [*fails(text or ""), ident is not None and ident > first[text or ""]]
        looked.append((part or "", bits, *labels.get(ident, (False, False))))
    out = {}
    for part in {d[0] for d in looked}:
        mine = [d for d in looked if d[0] == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                every = [d for d in mine if d[1][f]]
                name = "".join("ABCDE"[i] for i in order)
                out[part, name, step + 1] = [
                    len(left), len(gone), len(every) - len(gone), sum(sum(d[1]) == 1 for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ]
    share = Counter()
    for (part, _, _), v in out.items():
        share[part, v[-1]] += v[1]
    return {k: (*v[:-1], share[k[0], v[-1]]) for k, v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_audit(df):
    rows = df.collect()
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in rows)
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n int, part string")


def test_audit_of_the_documents(spark):
    docs, labels = sf(spark, "documents"), sf(spark, "labels")
    marked = {r["doc_id"]: (r["quality"] == 1, r["toxic"] == 1) for r in labels.collect()}
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], marked)
    assert as_audit(filter_audit.audit_report(docs, labels)) == want


def test_audit_defined_cases(spark):
    docs = awkward(spark)
    extra = documents(spark, [(20, None, "en", ""), (None, "", "en", "a"), (21, "A B", None, "a"), (22, "A B", None, None), (22, "A B", None, None), (21, "A B", None, "b")])
    both = docs.unionAll(extra)
    labels = labels_of(spark, [(4, 1, 0, 1, "x"), (4, 0, 1, 1, "x"), (22, 1, None, 1, "x"), (None, 1, 1, 1, "x"), (99, 1, 1, 1, "x"), (21, None, 1, 1, "x")])
    marked = {4: (True, True), 22: (True, False), 21: (False, True)}
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in both.collect()], marked)
    got = as_audit(filter_audit.audit_report(both, labels))
    assert got == want
    assert len(got) == 600 * len({k[0] for k in got})
    assert filter_audit.audit_report(documents(spark, []), labels).count() == 0
    assert as_audit(filter_audit.audit_report(both, labels_of(spark, []))).keys() == want.keys()
