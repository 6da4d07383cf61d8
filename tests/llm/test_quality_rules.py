"""Operator 6 against plain counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import quality_rules as q


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(4)
    alphabet = ["a", "b", "the", "é", "#x", "|", "$$", "\n", "  ", "\t", "\x85", "\xa0", "\x1c", "\r", "\x0b", "\x0c", "日本"]
    return ["", " ", "a", "a a a a", "a a a", *(" ".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(150)), "x y z " * 5000]


def test_base_measures():
    for text in texts():
        assert q.base_measures(text) == brute_base(text)


def test_verdicts_against_brute_force(spark):
    good = "The quiet river moved past the old stone houses and people walked along it in the morning light. " * 3
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample(good.split(), 40) + [f"w{i}{k}" for k in range(20)]), "x") for i in range(30)]
    rows += [(100 + i, " ".join(f"##{rng.random():.6f}$$" for _ in range(60)), "x") for i in range(10)] + [(200, None, None), (201, "", None), (None, rows[0][1], None), (3, rows[3][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(105, 0, 0), (None, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    target, raw = Counter(), Counter()
    for doc_id, text, _ in rows:
        for codes in q.gram_buckets((text or "").encode()):
            raw.update(codes.tolist())
            if doc_id is not None and doc_id < 20:
                target.update(codes.tolist())
    size = 1 << q.BITS
    t, r = sum(target.values()) + size, sum(raw.values()) + size
    want = {}
    for doc_id, text, _ in rows:
        codes = [c for part in q.gram_buckets((text or "").encode()) for c in part.tolist()]
        want.setdefault((doc_id, text or ""), sum(math.log((target[c] + 1) / t) - math.log((raw[c] + 1) / r) for c in codes) / len(codes) if codes else 0.0)
    got = q.judged(docs, labels, threshold=-0.2).collect()
    assert len(got) == len(rows)
    for row, (doc_id, text, _) in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id, x.n_words)), sorted(rows, key=lambda x: (x[0] is None, x[0], len((x[1] or "").split())))):
        base = brute_base(text or "")
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == base
        assert row.score == pytest.approx(want[doc_id, text or ""], abs=1e-5)
        assert row.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert row.kept == (not row.base_failed and row.score >= -0.2)
    scores = {row.doc_id: row.score for row in got}
    assert min(scores[i] for i in range(20)) > max(scores[i] for i in range(100, 110))
    assert q.judged(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.judged(docs, labels.limit(0)).collect()} == {0.0}


def test_target_covers_all_good_documents(spark):
    """More labels than were once sampled, whole and in blocks of ids."""
    n = 20_300
    rows = [(k, f"text {k * 7919 % 100_003:x}") for k in range(n)] + [(5, "again"), (None, "none"), (n, "not good"), (n + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(n)] + [(5, 1), (n, 0), (None, 1), (n + 1, 1)], "doc_id long, quality int")
    size = 1 << q.BITS
    target, raw = np.zeros(size), np.zeros(size)
    for doc_id, text in rows:
        codes = np.concatenate([np.zeros(0, "u4"), *q.gram_buckets((text or "").encode())]).astype("i8")
        np.add.at(raw, codes, 1)
        if doc_id is not None and doc_id != n:
            np.add.at(target, codes, 1)
    want = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    assert q.fit_ratios(docs, labels) == pytest.approx(want, abs=1e-12)
    assert q.fit_ratios(docs, labels, 6_000) == pytest.approx(want, abs=1e-12)


def test_windows_over_a_piece_edge(monkeypatch):
    data = np.random.default_rng(0).integers(0, 255, 1000).astype("u1").tobytes()
    whole = np.concatenate(list(q.gram_buckets(data)))
    monkeypatch.setattr(q, "_STRIDE", 64)
    assert np.concatenate(list(q.gram_buckets(data))).tolist() == whole.tolist()
