"""WARC, line dedup, SimHash, mixing, embeddings and the pipeline against brute force and defined cases."""

import collections
import hashlib
import math
import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import common, hnsw, linededup, mixing, simhash, warc
from tests.llm.fixtures import awkward, documents, sf


def least_reachable(ids, linked):
    label = dict(zip(range(len(ids)), ids))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [label[i] for i in range(len(ids))]


# connected components


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    assert got == dict(zip(nodes, least_reachable(nodes, [(at[a], at[b]) for a, b in pairs])))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# WARC


def test_loser_tree_merges_like_a_sort():
    rnd = random.Random(5)
    for k in (1, 2, 3, 5, 8, 13):
        runs = []
        for r in range(k):
            rows = [(f"k{rnd.randrange(9)}", f"t{rnd.randrange(4)}", rnd.choice([None, rnd.randrange(50)]), f"f{r}", i, i, "response", None, 0, "") for i in range(rnd.randrange(12))]
            runs.append(sorted(rows, key=warc.entry_key))
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc.entry_key)


def test_warc_round_trip(spark):
    tricky = "a" * 60 + "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" + "é𝒳" * 40
    rows = [
        (3, "http://www.Example.com:80/B?x=1#f", tricky, "z"), (1, "http://example.com/b?x=1", tricky, "z"), (2, None, None, "z"), (4, "http://a.org", "", "z"),
        (5, "http://a.org/", "short", "z"), (6, "bad\r\nurl", "short", "z"), (None, "http://a.org/n", tricky, "z"), (7, "http://a.org/2", "q" * 100, "z"),
        (7, "http://a.org/2", "q" * 100, "z"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.captures(pages).orderBy("range_id", "position").collect()
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        first = min((j for j, _, h, _ in rows if h == html and j is not None), default=None) if len(body) >= 100 else None
        revisit = first is not None and first != i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert collections.Counter(mine) == collections.Counter(want)
    order = [(r["url_key"], r["captured"]) for r in got]
    assert order == sorted(order)
    assert {r["url_key"] for r in got if r["page_id"] in (1, 3)} == {"com,example)/b?x=1"}
    assert warc.capture_report(pages.limit(0)).count() == 0


def test_global_order_over_many_runs(spark):
    pages = sf(spark, "pages", "0.01").repartition(7)
    got = warc.captures(pages).orderBy("range_id", "position").collect()
    assert len(got) == pages.count() and len({r["archive"] for r in got}) > 1
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in got]
    assert order == sorted(order)


# line dedup


def brute_lines(rows, min_words):
    """Positions to delete by the definition: lines of any repeated block of enough words that has an earlier copy."""
    seqs = []
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        found = [(p, x.rstrip("\r").strip(" ")) for p, x in enumerate(t.split("\n"))]
        seqs.append((i, t, [x for x in found if x[1]]))
    count = collections.Counter(x for _, _, s in seqs for _, x in s)
    first, gone = {}, collections.defaultdict(set)
    for k, (_, _, s) in enumerate(seqs):
        for a in range(len(s)):
            words, block = 0, ()
            for b in range(a, len(s)):
                if count[s[b][1]] < 2:
                    break
                words += len(s[b][1].split())
                block += (s[b][1],)
                if words >= min_words and first.setdefault(block, (k, a)) != (k, a):
                    gone[k].update(range(s[a][0], s[b][0] + 1))
    return {i: ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k]), len(gone[k])) for k, (i, t, _) in enumerate(seqs)}


def test_line_runs_against_brute_force(spark):
    rnd = random.Random(8)
    lines = [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 9))) for _ in range(14)] + [""]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 14)))) for i in range(60)]
    rows += [(100, "\n".join(["same line"] * 40)), (101, rows[0][1]), (102, None), (103, "")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    for min_words in (1, 6, 15):
        want = {i: filled(t) for i, (t, _) in brute_lines(rows, min_words).items()}
        got = {r["doc_id"]: filled(r["text"] or "") for r in linededup.deduplicate(docs, min_words).collect()}
        assert {i: t for i, t in got.items() if t} == {i: t for i, t in want.items() if t}
        assert {102, 103} <= set(got)  # had no lines to lose


def filled(text):
    return [x for x in text.split("\n") if x.strip()]


def test_line_runs_of_the_documents(spark):
    docs = sf(spark, "documents", "0.01")
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 50)
    got = {r["doc_id"]: r for r in linededup.line_report(docs).collect()}
    assert {i: r["text_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, (t, _) in want.items()}


def test_line_dedup_defined_cases(spark):
    docs = awkward(spark)
    out = linededup.deduplicate(docs, 3)
    assert out.columns == docs.columns
    left = collections.Counter(r["doc_id"] for r in out.collect())
    assert left[4] == 2 and left[5] == 0  # rows equal in id and text are one document; its later copy loses everything
    assert left[1] == left[2] == left[None] == 1
    assert linededup.deduplicate(documents(spark, [])).count() == 0


# SimHash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


@pytest.mark.parametrize("max_bits,blocks", [(1, 2), (2, 3), (3, 2), (3, 4), (4, 2)])
def test_balls_find_every_link(spark, max_bits, blocks):
    rng = np.random.default_rng(max_bits * 10 + blocks)
    fps = set()
    for _ in range(25):
        centre = int(rng.integers(0, 2**63)) * 2
        for _ in range(12):
            fp = centre
            for b in rng.choice(64, size=rng.integers(0, 5), replace=False):
                fp ^= 1 << int(b)
            fps.add(fp)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), max_bits, blocks)
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    want = least_reachable(signed, near)
    assert [got.get(s, s) for s in signed] == want


def test_long_runs_of_one_variant():
    rng = np.random.default_rng(4)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(12, size=rng.integers(0, 6), replace=False)) for _ in range(300)], dtype=np.uint64))
    links = simhash.run_links(fps, 2)
    assert len(links) < len(fps) and all((int(a) ^ int(b)).bit_count() <= 2 for a, b in links)
    at = {int(f): i for i, f in enumerate(fps)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
    ids = list(range(len(fps)))
    assert least_reachable(ids, [(at[int(a)], at[int(b)]) for a, b in links]) == least_reachable(ids, near)


def test_simhash_report(spark):
    docs = awkward(spark).unionByName(sf(spark, "documents").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    rows = simhash.simhash_report(docs).collect()
    raw = docs.select("doc_id", "text").collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in rows) == collections.Counter((r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in raw)
    ids = [r["doc_id"] if r["doc_id"] is not None else math.inf for r in rows]
    fps = [int(r["fingerprint"], 16) for r in rows]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = least_reachable(ids, near)
    assert [r["component_id"] for r in rows] == [None if w == math.inf else w for w in want]
    kept = simhash.deduplicate(docs).collect()
    assert len(kept) == len(set(zip(want, [f if w == math.inf else 0 for w, f in zip(want, fps)])))
    assert simhash.simhash_report(documents(spark, [])).count() == 0


# mixing


def test_mix_meets_budget_and_repeats(spark):
    docs = sf(spark, "documents", "0.1")
    words = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in docs.collect()}
    size = collections.Counter()
    for s, n in words.values():
        size[s] += n
    plan = {r["sid"][1:]: r for r in mixing.plan(docs, max_repeats=1.05).collect()}
    total = sum(size.values())
    assert sum(r["quota"] for r in plan.values()) == pytest.approx(total)
    assert max(r["epochs"] for r in plan.values()) == pytest.approx(1.05, abs=1e-6)
    alpha = plan["src0"]["exponent"]
    z = sum((n / total) ** alpha for n in size.values())
    assert all(plan[s]["weight"] == pytest.approx((n / total) ** alpha / z) for s, n in size.items())
    out = mixing.mix(docs, max_repeats=1.05, columns=["doc_id", "source"])
    rows = out.collect()
    copies = collections.Counter((r["doc_id"]) for r in rows)
    used = collections.Counter()
    for r in rows:
        used[r["source"]] += r["mix_tokens"]
        assert 0 <= r["mix_position"] < 1
    longest = max(n for _, n in words.values())
    for s, r in plan.items():
        assert r["quota"] - longest <= used[s] <= r["quota"] + 1
        assert all(r["whole"] <= copies[i] <= r["whole"] + 1 for i, (t, _) in words.items() if t == s)
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    again = mixing.mix(docs.repartition(5), max_repeats=1.05, columns=["doc_id", "source"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_rows_against_plain_permutations(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    rows = [(i, "w " * (1 + (i * 7919) % 90), "en", f"s{min(i % 11, 3)}" if i % 13 else None) for i in range(3000)]
    docs = documents(spark, rows)
    hashed = docs.select("doc_id", *[mixing.order_key(F.lit(e).cast("long"), mixing.row_hash("doc_id", "text")).alias(f"h{e}") for e in range(3)])
    place = {r["doc_id"]: r for r in hashed.collect()}
    words = {r[0]: len(r[1].split()) for r in rows}
    groups = collections.defaultdict(list)
    for i, _, _, s in rows:
        groups[s].append(i)
    size = {s: sum(words[i] for i in g) for s, g in groups.items()}
    total = sum(size.values())
    for budget, repeats in [(total, 1.3), (total // 3, 0.9), (2 * total, 2.4)]:
        low, high = 0.0, 1.0

        def most(a):
            z = sum((t / total) ** a for t in size.values())
            return max(budget * (t / total) ** a / z / t for t in size.values())

        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if most(mid) <= repeats else (mid, high)
        alpha = 0.0 if most(0.0) <= repeats else high
        z = sum((t / total) ** alpha for t in size.values())
        want = collections.Counter()
        for s, g in groups.items():
            quota = budget * (size[s] / total) ** alpha / z
            whole = int(quota / size[s] + 1e-9)
            rest, used = quota - whole * size[s], 0
            for i in g:
                want[i] += whole
            for i in sorted(g, key=lambda i: place[i][f"h{whole}"]):
                used += words[i]
                if used > rest:
                    break
                want[i] += 1
        got = collections.Counter(r["doc_id"] for r in mixing.mix(docs, budget=budget, max_repeats=repeats, columns=["doc_id"]).collect())
        assert got == +want


def test_mix_meets_entropy(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{min(i % 7, 3)}") for i in range(400)]
    docs = documents(spark, rows)
    plan = mixing.plan(docs, target_entropy=1.3, max_repeats=100.0).collect()
    assert -sum(r["weight"] * math.log(r["weight"]) for r in plan) == pytest.approx(1.3, abs=1e-6)


def test_mix_defined_cases(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "epoch_" in out.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).count() == 0


# embeddings


def test_hnsw_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 16)) * 0.25, rng.normal(size=(300, 16))]).round(3)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.9
    near |= (x[:, None] == x[None]).all(axis=2)
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    want = least_reachable(list(range(len(x))), list(zip(*np.nonzero(near))))
    assert np.mean([got[i]["component_id"] == w for i, w in enumerate(want)]) >= 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert got[906]["component_id"] == 905 and got[905]["n_links"] == 1  # vectors of two components, one direction
    assert hnsw.near_duplicates(table.limit(0)).count() == 0


def test_many_links_of_one_vector(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((300, 8)) + rng.normal(size=(300, 8)) * 0.02, rng.normal(size=(200, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int(((u @ u.T) >= 0.9).sum())
    graph = hnsw.Graph.build(hnsw.unit(x))
    for widest in (10_000, 64):  # by wide beams alone, then by comparison with the whole shard
        monkeypatch.setattr(hnsw, "WIDEST_BEAM", widest)
        q, v, recall = hnsw.links_of(graph, x, x, 0.9)
        assert len(set(zip(q.tolist(), v.tolist()))) == len(q) and recall >= 0.98
        assert 0.98 * want <= len(q) <= want
    again = hnsw.Graph.load(graph.dump(), graph.base)
    assert len(hnsw.links_of(again, x, x, 0.9)[0]) == len(q)


def sparse_pairs(n=20_000, pairs=50):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 16))
    x[pairs : 2 * pairs] = x[:pairs] + rng.normal(size=(pairs, 16)) * 0.02
    return x


class Losing(hnsw.Graph):
    """A graph whose search finds nothing but the query itself."""

    def search(self, queries, beam):
        ids = np.full((len(queries), beam), -1)
        sims = np.full((len(queries), beam), -3.0, dtype=np.float32)
        near = queries @ self.base.T
        ids[:, 0], sims[:, 0] = near.argmax(axis=1), near.max(axis=1)
        return ids, sims


def test_the_audit_sees_sparse_links_that_are_lost():
    x = sparse_pairs()
    graph = Losing(hnsw.unit(x), [])
    q, v, true, have = hnsw.audited_links(graph, x, x, 0.9, target=0.0)  # the first search is taken as it is
    assert true > 10 and have == 0
    # Beams that go on losing links end in the comparison with the whole shard.
    q, v, recall = hnsw.links_of(graph, x, x, 0.9)
    assert recall == 1.0 and (q != v).sum() >= 100


def test_small_shards_that_lose_links_are_compared_whole():
    x = sparse_pairs(400, 40)
    q, v, recall = hnsw.links_of(Losing(hnsw.unit(x), []), x, x, 0.9)
    assert recall == 1.0 and (q != v).sum() >= 80


def test_dense_links_are_verified_in_slices():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64)) * 0.02 + 1.0  # every vector links with every other
    graph = hnsw.Graph.build(hnsw.unit(x))
    assert len(graph.dump()) < 1.5 * len(x) * (8 * hnsw.DEGREE + 8)  # lists of members only
    tracemalloc.start()
    got, true, have = hnsw.audited_search(hnsw.Graph.load(graph.dump(), graph.base), x, x, 0.9, lambda: hnsw.Tally(np.arange(1200), np.arange(1200), np.full(1200, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000  # all links at once would take 1.4 GB in double precision
    assert have == true > 0 and (got.total == 2 * 1199).all() and len(got.kept) == 1199


def test_shards_travel_in_pieces_and_single_precision_counts_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[150:] = x[:150] + rng.normal(size=(150, 8)).astype(np.float32) * 0.2
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    got = {}
    for kind, size in (("double", 4_000_000), ("float", 4_000_000), ("float", 1000)):
        monkeypatch.setattr(hnsw, "PIECE_BYTES", size)
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got[kind, size] = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(table).collect())
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    assert len(set(map(tuple, got.values()))) == 1 and [n for _, n, _ in got["float", 1000]] == want.tolist()


def test_blocks_of_queries_follow_shards():
    assert [hnsw.block_count(n, max(4, -(-n // 100_000)), 100_000) for n in (0, 10_256, 51_282, 615_000, 6_150_000)] == [1, 1, 4, 7, 62]


def test_hnsw_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "b", 2), (2, [1.0, 0.001], None, 3), (None, [1.0, 0.0], "c", 4), (5, [0.0, 1.0], "d", 5), (None, None, "e", 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, component long")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(table).collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (5, 0, 5, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)


# pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = sf(spark, "documents").unionByName(awkward(spark).selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, folder)
        if k < 4:
            assert out.columns == docs.columns
            assert out.count() <= before.count()
        else:
            assert out.columns[:5] == docs.columns
        before = common.reread(out)
    assert before.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_first_stage_drops_mixtures_of_languages(spark):
    german, english = "und der die das ist nicht und mit von der die ", "the and of that with this have from the and of "
    taught = [(i, (german if i % 2 else english) * 4, "de" if i % 2 else "en", "s") for i in range(40)]
    asked = [(100, german * 5 + english * 5, None, "s"), (101, german * 9 + english, None, "s"), (102, english * 9, None, "s"), (103, "12 34", None, "s")]
    docs = documents(spark, taught + asked)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {*range(40), 101, 102}
