"""Operator 4 against an edit distance at every place, and recall at each number of edits."""

import random

import numpy as np

from textloom.llm import decontamination as dc
from textloom.llm.common import normal_words


def distance_anywhere(item, words):
    """The least word edit distance of the item to any stretch."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def material(seed=1, items=30):
    rng = random.Random(seed)
    common = ["the", "of", "and", "a", "to", "in"]
    rare = [f"{a}{b}{c}" for a in "bcdfgl" for b in ("an", "or", "it") for c in ("tion", "er", "ing", "ed")]
    words = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    benchmark = [(k, " ".join(words(rng.randrange(5, 50))).capitalize() + ".") for k in range(items)]
    return rng, words, benchmark


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.choice("sid")
        if kind == "s":
            words[at] = "other"
        elif kind == "i":
            words.insert(at, "other")
        elif len(words) > 1:
            words.pop(at)
    return words


def test_search_against_brute_force():
    rng, words, benchmark = material()
    texts = ["", " ".join(words(3))]
    for k in range(150):
        body = words(rng.randrange(0, 120))
        if k % 3:
            item = normal_words(benchmark[k % len(benchmark)][1])
            item = edited(rng, [w.decode() for w in item], rng.randrange(0, dc.edits_allowed(len(item)) + 3))
            at = rng.randrange(len(body) + 1)
            body = body[:at] + item + body[at:]
        texts.append(" ".join(body))
    block = dc.Benchmark(benchmark)
    found = dc.search(texts, block)
    wanted = total = 0
    for text, hits in zip(texts, found):
        own = normal_words(text)
        got = {block.items[h[0]][0]: h[1] for h in hits}
        for item_id, item in benchmark:
            pattern = normal_words(item)
            least = distance_anywhere(pattern, own)
            if least <= dc.edits_allowed(len(pattern)):
                total += 1
                wanted += item_id in got
                assert got.get(item_id, least) == least
            else:
                assert item_id not in got
        for item, d, a, b in hits:
            assert distance_anywhere(normal_words(benchmark[item][1]), own[a:b]) == d
    assert total > 80 and wanted >= 0.97 * total


def test_an_item_at_the_end_of_a_chunk_that_lacks_its_last_words():
    words = [f"word{k}" for k in range(40)]
    block = dc.Benchmark([(1, " ".join(words))])
    for text, missing in ((" ".join(words[:37]), 3), ("other matter before " + " ".join(words[:36]), 4)):
        alone, within = dc.search([text], block)[0], dc.search([text, "filler " * 100], block)[0]
        assert alone == within and len(alone) == 1 and alone[0][1] == missing


def test_recall_at_each_number_of_edits():
    rng, words, benchmark = material(5, 60)
    block = dc.Benchmark(benchmark)
    for share in (0, 0.1, 0.2):
        texts = []
        for _, text in benchmark:
            item = text.lower().strip(".").split()
            texts.append(" ".join(words(80) + edited(rng, item, int(share * len(item))) + words(80)))
        hits = [any(h[0] == k for h in found) for k, found in enumerate(dc.search(texts, block))]
        assert np.mean(hits) >= (1.0 if not share else 0.95)


def test_fragments_are_no_items():
    _, words, benchmark = material(3)
    block = dc.Benchmark(benchmark)
    long = [i for i in benchmark if len(i[1].split()) > 20]
    assert dc.search([" ".join(words(30) + i[1].split()[:8] + words(30)) for i in long], block) == [[] for _ in long]


def test_rows(spark, monkeypatch):
    rng, words, benchmark = material()
    texts = [" ".join(words(60)) for _ in range(8)] + [" ".join(words(50_000)) + " " + benchmark[3][1] + " " + " ".join(words(9))]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    rows += [(20, "Before. " + benchmark[0][1], "x", 1), (20, "Before. " + benchmark[0][1], "x", 1), (21, benchmark[1][1].upper() + " " + benchmark[2][1], None, None), (22, None, None, None), (23, "", None, None), (None, benchmark[0][1], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, distance int")
    items = spark.createDataFrame(benchmark + [(900, None), (901, ""), (902, "the of"), (None, benchmark[5][1]), benchmark[0]], "item_id long, text string")
    want = sorted([(8, 3), (20, 0), (20, 0), (21, 1), (21, 2), (None, 0)], key=str)
    got = [(r.doc_id, r.item_id) for r in dc.contaminations(docs, items).collect()]
    assert sorted(got, key=str) == want
    kept = dc.decontaminated(docs, items)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect())) == [0, 1, 2, 3, 4, 5, 6, 7, 22, 23]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    blocks = list(dc.blocks_of(items, 400))
    assert len(blocks) > 3 and sum(len(b.items) for b in blocks) == 31
    assert dc.contaminations(docs.limit(0), items).count() == 0 and dc.contaminations(docs, items.limit(0)).count() == 0
    assert dc.decontaminated(docs, items.limit(0)).count() == len(rows)


def test_short_items_are_found_as_they_are(spark):
    items = spark.createDataFrame([(1, "Four words, exactly here"), (2, "One!"), (3, "two words"), (4, "..."), (5, "a longer item of seven words here")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "There are four words exactly here. And two"), (11, "words four words exactly"), (12, "One of two words: a longer item of seven words here"), (13, None), (14, "two"), (15, "words"), (16, "one")], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id): (r.distance, r.first_word, r.end_word) for r in dc.contaminations(docs, items, shortest=1).collect()}
    assert got == {(10, 1): (0, 2, 6), (12, 2): (0, 0, 1), (12, 3): (0, 2, 4), (12, 5): (0, 4, 11), (16, 2): (0, 0, 1)}
    assert {r.doc_id for r in dc.decontaminated(docs, items, shortest=1).collect()} == {11, 13, 14, 15}
