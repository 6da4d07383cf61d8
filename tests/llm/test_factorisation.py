"""Operator 2: the linear-time score against all pairs, and accuracy on rows held out."""

import random
import zlib

import numpy as np

from textloom.llm import factorisation as fm


def test_score_equals_all_pairs():
    rng = np.random.default_rng(2)
    model = {"w0": 0.3, "w": rng.normal(size=fm.SIZE), "v": rng.normal(size=(fm.SIZE, fm.FACTORS))}
    rows = [(rng.integers(0, fm.SIZE, n), rng.normal(size=n)) for n in (1, 4, 9)]
    got = fm.scores(model, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([len(r[0]) for r in rows]))
    for (index, x), score in zip(rows, got):
        want = 0.3 + sum(model["w"][i] * v for i, v in zip(index, x))
        want += sum(model["v"][index[a]] @ model["v"][index[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a + 1, len(x)))
        assert np.isclose(score, want)


def corpus(n=400):
    rng = random.Random(6)
    words = "river stone light people morning walk house tree road small quiet old water hill bird".split()
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choices(words, k=60)) + "." if good else " ".join(w.upper() + "!!" for w in rng.choices(words, k=60))
        rows.append((i, text, "en", "s", len(text)))
        if i % 5:
            labels.append((i, int(good), i % 2))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, rows[1][1], "en", "s", 5), (1, rows[1][1], "en", "s", 5), (9002, "z" * 200_000, "en", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = fm.classified(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, int(r.doc_id % 3 > 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    clash = docs.selectExpr("*", "0.5 as score", "1 as quality", "'x' as h")
    assert sorted(fm.classified(clash, marks).collect(), key=str) == sorted(got, key=str)
    assert {r.score for r in fm.classified(docs, marks.limit(0)).collect()} == {0.5}
    assert fm.classified(docs.limit(0), marks).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    frames = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, flipped)]
    a, b = (sorted(map(tuple, fm.classified(docs, f).collect())) for f in frames)
    assert a == b
    assert len(fm.training_rows(docs, frames[0], limit=10)) == 10
