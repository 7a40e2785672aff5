"""Language, toxicity, personal data, secrets and decontamination against brute force and defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from colonnade.llm import decontaminate, langid, pii, secrets, toxicity
from tests.llm.fixtures import EMPTY, awkward, documents, sf


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# language identification


def test_language_accuracy_on_held_out_rows(spark):
    docs = sf(spark, "documents")
    got = by_id(langid.language_report(docs))
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == docs.count()
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_defined_cases(spark):
    rows = langid.language_report(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    blank = {r["doc_id"]: r for r in rows if r["doc_id"] in (1, 2)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in blank.values())
    assert langid.language_report(documents(spark, [])).count() == 0
    untaught = documents(spark, [(1, "some words", None, "s"), (2, "other words", None, "s")])
    assert {r["lang_pred"] for r in langid.language_report(untaught).collect()} == {"und"}
    kept = langid.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert {1, 2}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_letters_of_every_plane_have_a_language(spark):
    rows = [(i, t, "zz", "s") for i, t in enumerate(["\U00020000\U00020001\U00020002", "\U00031350 \U0002f800", "𝒳𝒴", "ꙮ", "\U000e0041", "\U00100000"])]
    taught = [(100 + i, "plain words here", "en", "s") for i in range(20)]
    got = by_id(langid.language_report(documents(spark, rows + taught)))
    for i, text, *_ in rows:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text)), text


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes, labels, penalty = [1, 5, 3, 0, 6], 3, 0.7
    owner = np.repeat(np.arange(len(sizes)), sizes)
    scores = rng.normal(size=(len(owner), labels))
    got = langid.viterbi(scores, owner, len(sizes), penalty)

    def value(s, path):
        return sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    for k, n in enumerate(sizes):
        s = scores[owner == k]
        best = max((value(s, p) for p in itertools.product(range(labels), repeat=n)), default=0)
        assert value(s, got[owner == k].tolist()) == pytest.approx(best)


def test_spans_of_mixed_text(spark):
    docs = sf(spark, "documents", "0.01")
    model = langid.train_on_rest(docs)
    german = "und der die das ist nicht und mit für von der die " * 3
    english = "the and of that with this have from the and of that " * 3
    mixed = documents(spark, [(7, german + english, None, "s")])
    got = sorted(langid.spans(mixed, model).collect(), key=lambda r: r["start"])
    assert [r["lang"] for r in got] == ["de", "en"]
    assert got[0]["end"] <= len(german) <= got[1]["start"] + 1


# toxicity


def test_restores_disguised_words(spark):
    log = toxicity.language_model(sf(spark, "documents", "0.01"))
    restorer = toxicity.Restorer(log)
    for raw, want in [
        ("you 1d10t there", "you 1diot there"), ("stuuuupid", "stupid"), ("looooser cl0wn", "loser clown"), ("i d i o t and", "idiot and"),
        ("m-o-r-o-n", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("plain words, 12 of 30.", "plain words, 12 of 30."),
        ("hein.19@mail5.example.com", "hein.19@mail5.example.com"), ("", ""),
    ]:
        assert toxicity.restore(raw, restorer) == want


def test_toxicity_ranks_held_out_rows(spark):
    docs, labels = sf(spark, "documents", "0.01"), sf(spark, "labels", "0.01")
    got = by_id(toxicity.toxicity_report(docs, labels))
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(got[i]["score"], t) for i, t in truth.items() if got[i]["held_out"]]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= 0.8
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.toxicity_report(documents(spark, []), labels.limit(0))
    assert none.count() == 0


# personal data


def naive_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1.2 @-+()5_é") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(text) == naive_spans(text), text
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "4111 1111-1111 1111", "x" * 50_000 + "@", "9" * 50_000):
        assert pii.base_spans(text) == naive_spans(text) if len(text) < 100 else pii.base_spans(text) == []


def test_skip_chain_carries_labels(spark):
    filler = [(100 + i, f"call +1 (743) 555-{1000 + i} now", "en", "s") for i in range(20)]
    docs = documents(spark, [(1, "ring +1 (212) 555-7788 or else 555-7788 please", "en", "s"), *filler])
    got = by_id(pii.pii_report(docs))
    text = "ring +1 (212) 555-7788 or else 555-7788 please"
    start = text.rindex("555-7788")
    assert f"phone:{start}:{start + 8}" in got[1]["spans"].split(",")
    assert got[1]["n_phone"] == 1
    mail = "write to jo.77@mail.example.com soon, jo.77 will answer"
    other = by_id(pii.pii_report(documents(spark, [(2, mail, "en", "s"), *filler])))
    assert f"email:{mail.rindex('jo.77')}:{mail.rindex('jo.77') + 5}" in other[2]["spans"].split(",")
    assert all(r["n_added"] == 0 for i, r in other.items() if i >= 100)
    assert got[1]["base_sha256"] == hashlib.sha256(b"phone:5:22").hexdigest()


def test_skip_evidence_settles_whatever_the_distance():
    text = "write to jo.77@mail.example.com soon" + " and jo.77 will answer" * 100
    unary = np.repeat(np.array([[0.0], *[[-3.2]] * 4]), pii.SHAPES, axis=1)
    found = [pii.Tokens(text, pii.base_spans(text)), pii.Tokens(bare := "see" + " item jo.77 again" * 100, pii.base_spans(bare))]
    assert [len(s) for s in pii.added_spans(found, unary, np.zeros((5, 5)))] == [100, 0]


def test_skip_evidence_reaches_every_mention(spark):
    filler = [(100 + i, f"call +1 (743) 555-{1000 + i} now", "en", "s") for i in range(20)]
    mail = "write to jo.77@mail.example.com soon" + " and jo.77 will answer" * 100
    bare = "see" + " item jo.77 again" * 100
    got = by_id(pii.pii_report(documents(spark, [(1, mail, "en", "s"), (2, bare, "en", "s"), *filler])))
    assert got[1]["n_added"] == 100
    assert got[2]["n_added"] == 0  # mentions that nothing speaks for do not lift one another


@pytest.mark.parametrize("others", [20, 20_000])
def test_skip_evidence_keeps_its_weight_in_a_large_corpus(spark, others):
    filler = [(100 + i, f"call +1 (743) 555-{1000 + i} now", "en", "s") for i in range(20)]
    common = [(1000 + i, f"see item ab.{10 + i % 90} there", "en", "s") for i in range(others)]
    mail = "write to jo.77@mail.example.com soon, jo.77 will answer"
    got = by_id(pii.pii_report(documents(spark, [(1, mail, "en", "s"), *filler, *common])))
    assert f"email:{mail.rindex('jo.77')}:{mail.rindex('jo.77') + 5}" in got[1]["spans"].split(",")
    assert sum(r["n_added"] for r in got.values()) == 1


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    unary = rng.normal(size=(3, pii.LABELS))
    tables = rng.normal(size=(2, pii.LABELS, pii.LABELS)) * 0.5
    edges, kinds = np.array([[0, 1], [1, 2]]), np.array([0, 1])
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    got = pii.propagate(unary, edges, kinds, tables)
    pii.ROUNDS = rounds
    joint = unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + tables[0][:, :, None] + tables[1][None]
    p = np.exp(joint)
    for node, axes in enumerate([(1, 2), (0, 2), (0, 1)]):
        want = p.sum(axis=axes)
        mine = np.exp(got[node])
        assert np.allclose(mine / mine.sum(), want / want.sum(), atol=1e-6)


def test_pii_defined_cases(spark):
    rows = pii.pii_report(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    blank = next(r for r in rows if r["doc_id"] == 1)
    assert blank["spans"] == "" and blank["base_sha256"] == EMPTY
    assert pii.pii_report(documents(spark, [])).count() == 0


# secrets


def naive_secrets(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_secret_base_spans(spark):
    rnd = random.Random(4)
    parts = ["token", "=", ":", " ", '"', "secret", "apikey", "PassWord", "é𝒳", "AKIA", "ABCDEFGH12345678", "0123abcdef", "deadbeef", "zz", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))), "en", f"s{i % 3}") for i in range(300)]
    got = by_id(secrets.secret_report(documents(spark, rows)))
    for i, text, *_ in rows:
        want = naive_secrets(text)
        assert got[i]["base_sha256"] == digest(want), text
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(s for s in got[i]["spans"].split(",") if s) >= {f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want}


def test_ownership_separates_examples_from_live_values(spark):
    shared, own = "Zq3kT9xLw2Pv8Rn5Yb7Hd1", "Mx4jS8wKv1Qu7To6Xc2Ge0"
    rows = [(i, f"see {shared} there", "en", f"owner{i}") for i in range(6)] + [(50, f"see {own} there", "en", "owner1")]
    got = by_id(secrets.secret_report(documents(spark, rows)))
    assert all(got[i]["spans"] == "" and got[i]["n_live"] == 0 for i in range(6))
    assert got[50]["spans"] == f"bare:4:{4 + len(own)}" and got[50]["n_live"] == 1


def test_owners_of_equal_rows_all_count(spark):
    value, own = "Zq3kT9xLw2Pv8Rn5Yb7Hd1", "Mx4jS8wKv1Qu7To6Xc2Ge0"
    rows = [(7, f"see {value} there", "en", f"owner{i}") for i in range(6)] + [(8, f"see {own} there", "en", "a")] * 6
    docs = documents(spark, rows)
    found = {(r["owners"], r["repositories"], r["live"]) for r in secrets.scan(docs).collect()}
    assert found == {(6, 1, False), (1, 1, True)}
    report = secrets.secret_report(docs).collect()
    assert len(report) == 12
    assert {(r["doc_id"], r["n_live"], r["n_example"], r["spans"]) for r in report} == {(7, 0, 0, ""), (8, 1, 0, f"bare:4:{4 + len(own)}")}


@pytest.mark.parametrize("seed", range(3))
def test_ownership_against_plain_counts(spark, seed):
    rnd = random.Random(seed)
    values = [f"V{i}xQ{'aB3' * 7}{i}" for i in range(12)]
    rows = [(rnd.randrange(15), " ".join(rnd.sample(values, rnd.randrange(0, 4))), "en", rnd.choice(["a", "b", "c", "d", None])) for _ in range(120)]
    owners, repos = {}, {}
    for ident, text, _, owner in rows:
        for v in text.split():
            h = hashlib.sha256(v.encode()).hexdigest()
            owners.setdefault(h, set()).add(owner)
            repos.setdefault(h, set()).add(ident)
    got = {(r["hash"], r["owners"], r["repositories"]) for r in secrets.scan(documents(spark, rows)).collect()}
    assert got == {(h, len(owners[h]), len(repos[h])) for h in owners}


def test_secret_defined_cases(spark):
    rows = secrets.secret_report(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    assert next(r for r in rows if r["doc_id"] == 1)["base_sha256"] == EMPTY
    assert secrets.secret_report(documents(spark, [])).count() == 0


# decontamination


def naive_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_within():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64)
        assert decontaminate.edits_within(a, b)[0] == naive_edits(a.tolist(), b.tolist())


def test_leaks_against_brute_force(spark):
    docs, bench = sf(spark, "documents", "0.01"), sf(spark, "benchmark", "0.01")
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = re.findall(r"[^\W_]+", r["text"].lower())
        have = set(words)
        for i, item in items.items():  # an item within 0.2 edits shares 0.8 of its words with the text
            if sum(w in have for w in item) >= 0.8 * len(item) and naive_edits(item, words) <= 0.2 * len(item):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want and want
    left = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()} == {d for d, _ in want}


def test_edited_copies_reach_the_target_recall(spark):
    rnd = random.Random(9)
    texts = [r["text"] for r in sf(spark, "benchmark", "0.1").collect()]
    items = decontaminate.Items(list(range(len(texts))), texts)
    found = total = 0
    for i, t in enumerate(texts):
        words = t.split()
        for _ in range(int(0.15 * len(words))):
            words[rnd.randrange(len(words))] = f"changed{rnd.randrange(999)}"
        doc = " ".join(["before"] * rnd.randrange(9) + words + ["after"] * 5)
        edits, _ = decontaminate.edits_within(items.item(i), decontaminate.word_hashes([doc])[0])
        if edits <= 0.2 * len(items.item(i)):
            total += 1
            found += any(x[1] == i for x in decontaminate.leaks_of([doc], items, 0.8))
    assert found >= 0.95 * total > 0


@pytest.mark.parametrize("length", [16, 32, 64, 128, 256, 512])
@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_recall_does_not_fall_with_the_length_of_items(length, share):
    rnd = random.Random(length)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(length)) for _ in range(40)]
    items = decontaminate.Items(list(range(len(texts))), texts)
    docs = []
    for i, t in enumerate(texts):
        words = t.split()
        for nth, at in enumerate(sorted(rnd.sample(range(length), int(share * length + 1e-9)), reverse=True)):
            kind = rnd.randrange(3) if i % 2 else 0
            words[at : at + (kind != 2)] = [] if kind == 1 else [f"new{i}x{nth}"]
        docs.append(" ".join([f"b{k}" for k in range(rnd.randrange(60))] + words + [f"a{k}" for k in range(30)]))
    got = {(t, i) for t, i, *_ in decontaminate.leaks_of(docs, items, 0.8)}
    assert sum((i, i) in got for i in range(len(texts))) >= 38


def test_short_and_unspaced_items_are_found(spark):
    items = [("two", "Zebra quorum"), ("three", "one odd thing"), ("han", "春眠不觉曉處處聞啼鳥夜来風雨聲"), ("thai", "ภาษาไทย"), ("one", "zebra"), ("mixed", "第一 question 是")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [
        (1, "the zebra, quorum of it", "en", "s"), (2, "zebra of quorum", "en", "s"), (3, "x one odd", "en", "s"), (4, "thing one  ODD-thing", "en", "s"),
        (5, "前文春眠不觉曉處處聞啼鳥夜来風雨聲後文", "zh", "s"), (6, "前文春眠不觉曉处處聞啼鳥夜来風雨聲後文", "zh", "s"), (7, "春眠不觉曉", "zh", "s"),
        (8, "กภาษาไทยข", "th", "s"), (9, "它是第一question是的", "zh", "s"), (10, "一第 question 是", "zh", "s"), (11, "zebra quorum zebra quorum", "en", "s"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, "two"), (11, "two"), (4, "three"), (5, "han"), (6, "han"), (8, "thai"), (9, "mixed")}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(documents(spark, rows), bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    with pytest.raises(ValueError):
        decontaminate.find_leaks(documents(spark, rows), bench, min_similarity=0.7)


def test_decontamination_defined_cases(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    docs = awkward(spark).unionByName(documents(spark, [(77, "x alpha beta gamma delta epsilon zeta eta y", "en", "s")]))
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(77, 4)]
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(documents(spark, []), bench).count() == 0
