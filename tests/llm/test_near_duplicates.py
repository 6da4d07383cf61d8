"""Operator 8 against all pairs of a small corpus."""

import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import near_duplicates as nd


def corpus():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "eng", "ost", "ul", "ith", "ave", "ing", "ond")]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = new(150)
        texts.append(" ".join(base))
        for k in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).capitalize() + ".")
    chain = new(200)
    for k in range(8):  # neighbours are near, ends are not
        texts.append(" ".join(chain))
        chain = chain[:]
        chain[k * 15 : k * 15 + 3] = new(3)
    big = new(120)
    for k in range(40):
        copy = list(big)
        copy[k] = "changed"
        texts.append(" ".join(copy))
    return texts + ["", None, "a b", "A, b!", "one", " ".join(new(4000)), "!!!"]


def brute_classes(rows, idf):
    sampler = nd.Sampler(idf)
    contents = []
    for _, text in rows:
        words = nd.normal_words(text or "")
        codes, counts = nd.shingles(words)
        contents.append((b" ".join(words), codes, sampler.weights(codes, counts)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = contents[i], contents[j]
            if a[0] == b[0] or (len(a[1]) and len(b[1]) and nd.weighted_jaccard(a[1], a[2], b[1], b[2]) >= nd.SIMILARITY - 1e-9):
                root[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(i)
    return members


def test_classes_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(corpus())]
    rows += [(5, rows[5][1]), (None, rows[9][1]), (None, "only null here")]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, node string, class_id int").repartition(3)
    idf = nd.document_weights(docs.select("text"))
    want = {}
    for group in brute_classes(rows, idf).values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            want.setdefault(rows[i], []).append((min(ids) if ids else None, len(group)))
    got = nd.classes(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.class_id, r.class_size))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = defaultdict(list)
    for (doc_id, _), found in want.items():
        expected[doc_id] += found
    assert {k: sorted(v, key=key) for k, v in by_id.items()} == {k: sorted(v, key=key) for k, v in expected.items()}
    kept = nd.deduplicated(docs).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x or 0)) == sorted({c for v in expected.values() for c, _ in v}, key=lambda x: (x is None, x or 0))
    assert set(kept[0].asDict()) == {"doc_id", "text", "node", "class_id"}
    assert nd.classes(docs.limit(0)).count() == 0


def test_classes_that_share_an_id_are_kept_apart(spark):
    """Null and repeated ids name several classes; a row of each stays."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    rows = [(None, text(k)) for k in range(4)] + [(None, text(0))] + [(7, text(k)) for k in range(10, 13)] + [(8, text(10)), (7, text(20)), (6, text(20) + "!"), (9, text(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id is None, r.doc_id, r.text) for r in nd.deduplicated(docs).collect()), key=str)
    want = [(None, text(k)) for k in range(4)] + [(7, text(k)) for k in range(10, 13)] + [(6, text(20) + "!"), (9, text(30))]
    assert kept == sorted(((d is None, d, t) for d, t in want), key=str)
    roots = defaultdict(set)
    for r in nd.classes(docs).collect():
        roots[r.root].add((r.class_id, r.class_size))
    assert sorted((x for v in roots.values() for x in v), key=str) == sorted([(None, 2), *[(None, 1)] * 3, (7, 2), (7, 1), (7, 1), (6, 2), (9, 1)], key=str)


def test_similarity_and_collisions():
    rng = np.random.default_rng(1)
    idf = np.ones(1 << nd.DF_BITS, "f4") * 3
    sampler = nd.Sampler(idf)
    same = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 400).astype("u8")
        a, b = np.unique(base[:350]), np.unique(base[50:])
        wa, wb = sampler.weights(a, np.ones(len(a))), sampler.weights(b, np.ones(len(b)))
        s = sampler.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]))
        same.append((s[0] == s[1]).mean())
        assert nd.weighted_jaccard(a, wa, b, wb) == pytest.approx(300 / 400, abs=1e-6)
    assert abs(np.mean(same) - 0.75) < 0.03


def test_buckets_of_many_unlike_members(spark, monkeypatch):
    """Everything in one bucket: rounds must still find each link."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(60)]
        texts += [" ".join(base), " ".join(base[:59] + ["z"])]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as text_hash")
    idf = nd.document_weights(docs)
    members = nd._members(docs, idf).selectExpr("doc_id", "text_hash", "node", "array(7L) as bands")
    found = nd.links(members, docs, idf).count()
    assert found == 25


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.a): bytes(r.b) for r in nd.components(edges).collect()}
    assert got == {bytes([k]): b"\x00" for k in range(1, 41)} | {b"\xf1": b"\xf0"}


def test_blocks_equal_pairs():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 60).astype("u8")
    for _ in range(20):
        codes = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(12)]
        weights = [rng.choice([1.0, 1.5, 3.0], len(c)).astype("f4") for c in codes]
        rows = np.sort(rng.choice(12, 5, replace=False))
        both = nd.overlaps(codes, weights, rows)
        for r, row in enumerate(rows):
            for k in set(range(12)) - {row}:
                total = weights[row].sum(dtype="f8") + weights[k].sum(dtype="f8") - both[r, k]
                assert both[r, k] / total == pytest.approx(nd.weighted_jaccard(codes[row], weights[row], codes[k], weights[k]), abs=1e-12)


@pytest.mark.parametrize("peeled", [1, 100])
def test_slices_lose_no_link(spark, monkeypatch, peeled):
    """All nodes in one bucket of many slices: the components are those of all pairs."""
    monkeypatch.setattr(nd, "SLICE", 6)
    monkeypatch.setattr(nd, "PIVOTS", 2)
    monkeypatch.setattr(nd, "PEELED", peeled)
    rows = [(k, t) for k, t in enumerate(corpus()) if nd.normal_words(t or "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as text_hash").repartition(3)
    idf = nd.document_weights(docs)
    members = nd._members(docs, idf).selectExpr("doc_id", "text_hash", "node", "array(7L) as bands", "size").cache()
    node = {r.doc_id: bytes(r.node) for r in members.collect()}
    want = {frozenset(node[rows[i][0]] for i in group) for group in brute_classes(rows, idf).values()}
    found = {bytes(r.a): bytes(r.b) for r in nd.links(members, docs, idf).collect()}
    got = defaultdict(set)
    for n in node.values():
        got[found.get(n, n)].add(n)
    assert set(map(frozenset, got.values())) == want


def test_of_rows_that_differ_elsewhere_one_stays_whatever_their_order(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, source) for source in "abcdef"] + [(2, text, "z")]
    kept = {tuple(nd.deduplicated(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string").repartition(1 + k % 3)).collect()[0]) for k in (0, 2, 4)}
    assert len(kept) == 1


def test_recall_at_the_threshold(spark):
    """Of pairs just above the threshold nearly all share a band: 1 - (1 - 0.8 ** 4) ** 10 is 0.995."""
    rng = np.random.default_rng(9)
    sampler = nd.Sampler(np.ones(1 << nd.DF_BITS, "f4"))
    met = 0
    for _ in range(2000):
        base = np.unique(rng.integers(0, 2**63, 160).astype("u8"))
        n = len(base)
        own = round(n * (1 - 0.805) / (1 + 0.805))
        a, b = base, np.unique(np.concatenate([base[own:], rng.integers(0, 2**63, own).astype("u8")]))
        s = sampler.signatures(np.concatenate([a, b]), np.ones(len(a) + len(b), "f4"), np.array([len(a), len(b)]))
        bands = nd._bands(s)
        met += (bands[0] == bands[1]).any()
    assert met / 2000 >= 0.985
