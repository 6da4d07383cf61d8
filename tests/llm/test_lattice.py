"""Operator 9: marginals against all segmentations, and scores against plain counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lattice as lm
from textloom.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
MODEL = lm.lattice(PATH)
LOGS = np.log(np.maximum(MODEL.first, 1e-300))


def segmentations(text):
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(text[at:k])
                at = k
        parts.append(text[at:])
        ids = []
        for part in parts:
            if part in MODEL.pieces:
                ids.append([MODEL.pieces[part]])
            elif len(part) == 1:
                ids.append(MODEL._fallback(part))
            else:
                break
        else:
            yield [i for p in ids for i in p]


WORDS = ["the", "a", "station", "\U0001f600x", "ñandú", "zq", "日本", "don't", "▁", "aaaaaaa", "#"]


def test_marginals_and_expected_counts():
    for weights in (None, np.arange(1.0, len(WORDS) + 1)):
        counts = np.zeros(len(LOGS))
        got = MODEL.marginals(WORDS, LOGS, weights, counts)
        want_counts = np.zeros(len(LOGS))
        for k, word in enumerate(WORDS):
            paths = [(sum(LOGS[i] for i in s), s) for s in segmentations("▁" + word)]
            total = math.log(sum(math.exp(c) for c, _ in paths))
            assert got[k] == pytest.approx(total, abs=1e-9)
            for cost, s in paths:
                for i in s:
                    want_counts[i] += (k + 1) * math.exp(cost - total)
        if weights is not None:
            assert np.allclose(counts, want_counts)


def test_long_words_go_the_other_way_alike():
    rng = random.Random(1)
    for n in (5, 30, 46):
        word = "".join(rng.choice("abcdeñ😀") for _ in range(n))
        a, b = np.zeros(len(LOGS)), np.zeros(len(LOGS))
        batched = MODEL.marginals([word], LOGS, np.array([2.0]), a)[0]
        assert MODEL._one(word, LOGS, 2.0, b) == pytest.approx(batched)
        assert np.allclose(a, b)
    assert np.isfinite(MODEL.marginals(["q" * 3000], LOGS)[0])


def brute(rows):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2
    c = Counter(w for d, t, *_ in rows if not held(d) for w in token(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t, *_ in rows:
        words = token(t)
        out.append((d, held(d), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), [w for w in words if w]))
    return out


@pytest.mark.parametrize("head", [100_000, 20, 1])
def test_scores_against_brute_force(spark, head):
    rng = random.Random(9)
    vocabulary = ["the", "The", "of", "station", "Élan", "İx", "a\x1cb", "x\xa0y"] + [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))), "x", 1.5) for i in range(120)]
    rows += [(500, None, "x", None), (501, "", None, 0.0), (None, "the of", "x", 1.0), (7, rows[7][1], "x", 1.0), (7, rows[7][1], "x", 1.0), (7, "other", "x", 1.0), (502, "y" * 5000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, base double")
    got = sorted(lm.scored(docs, head=head).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0], r[2]))
    assert len(got) == len(want)
    learnt = lm.learnt(lm.word_table(docs.selectExpr("doc_id", "coalesce(text, '') text", "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2 held_out")), PATH)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        score = (MODEL.marginals(w[6], learnt).sum() if w[6] else 0.0) + learnt[MODEL.end]
        assert g.score == pytest.approx(score / math.log(10), rel=1e-6)
    if head == 20:
        assert lm.scored(docs.limit(0)).count() == 0
