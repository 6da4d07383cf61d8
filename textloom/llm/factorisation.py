"""Operator 2: a quality classifier by factorisation machine.

Inputs of a score are hashed words of the whole text, statistics of its
structure and the length that the metadata states.  Pairwise interactions have
low rank: with factors v, their sum is half of (sum of v x) squared less the sum
of (v x) squared, for each factor, which takes time linear in the inputs.

The machine is fitted on at most ``MAX_TRAINING`` labelled rows, those with the
smallest hashes of doc_id; everything else covers all rows.

Defined results: null and empty texts are scored by structure alone; rows are
scored each for itself, so repeats and ties stay; a doc_id with several labels
counts with the smallest; null labels mark nothing; without any label all
scores are 0.5; an empty table gives no rows; other columns pass unread, and
so do lang, source and, but for the hold-out, doc_id.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket, crc_mod, texts_of

#: Labelled rows that the machine is fitted on, at most.
MAX_TRAINING = 6000
WORD_BITS = 18
FACTORS = 8
EPOCHS = 8
HELD_OUT = (4, 2)
THRESHOLD = 0.7
_BINS = 16
_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_STATS = 14
SIZE = (1 << WORD_BITS) + _STATS * _BINS


def _log_bin(x: float) -> int:
    return min(_BINS - 1, max(0, int(np.log2(x + 1))))


def _share_bin(x: float) -> int:
    """Shares by halves: 0 for none, up to the top bin for about all."""
    return 0 if x <= 0 else max(1, _BINS - 1 - int(-2 * np.log2(min(1.0, x))))


class Features:
    """Indices and values of a text's inputs."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.buckets = keep, {}

    def of(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        counts = Counter(words)
        n, size = max(1, len(words)), max(1, len(data))
        without = lambda chars: size - len(data.translate(None, chars)) if data else 0
        upper, lower = without(_UPPER), without(_LOWER)
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        stats = [
            _log_bin(len(words)),
            min(_BINS - 1, int(size / n)),
            _share_bin(without(b"#*$%&|<>") / size),
            _share_bin(upper / max(1, upper + lower)),
            _share_bin(without(b"!?") / size),
            _share_bin(without(_DIGITS) / size),
            _share_bin(without(b".,;:") / size),
            int((_BINS - 1) * len(counts) / n),
            _share_bin(sum(map(operator.eq, words, words[1:])) / n),
            _share_bin(1 - len(set(lines)) / max(1, len(lines))),
            _share_bin(len(lines) / n),
            int((_BINS - 1) * max(counts.values(), default=0) / n),
            _log_bin(float(max(map(len, counts), default=0))),
            _log_bin(float(max(0, n_chars if n_chars is not None else len(text)))),
        ]
        known = self.buckets
        if len(known) > self.keep:
            known.clear()
        places = list(map(known.get, counts))
        if None in places:
            for w, place in zip(counts, places):
                if place is None:
                    known[w] = bucket(w, WORD_BITS)
            places = list(map(known.__getitem__, counts))
        index = np.array(places, "i4")
        values = np.log1p(np.fromiter(counts.values(), "f4", len(counts)))
        values /= max(1e-6, float(np.sqrt((values * values).sum())))
        extra = (1 << WORD_BITS) + np.arange(_STATS, dtype="i4") * _BINS + np.array(stats, "i4")
        return np.concatenate([index, extra]), np.concatenate([values, np.full(_STATS, 0.5, "f4")])


def scores(model: dict, index: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log-odds of rows given end to end."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    linear = np.add.reduceat(model["w"][index] * values, starts)
    products = model["v"][index] * values[:, None]
    sums = np.add.reduceat(products, starts)
    squares = np.add.reduceat(products * products, starts)
    return model["w0"] + linear + 0.5 * (sums * sums - squares).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> dict:
    """Logistic loss by AdaGrad, mini-batches in a fixed order."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(SIZE, "f4"), "v": np.zeros((SIZE, FACTORS), "f4")}
    if not rows:
        return model
    seen = np.unique(np.concatenate([r[0] for r in rows]))
    model["v"][seen] = rng.normal(0, 0.05, (len(seen), FACTORS))
    share = np.clip(np.mean([r[2] for r in rows]), 0.01, 0.99)
    model["w0"] = float(np.log(share / (1 - share)))
    g0, gw, gv = 1e-3, np.full(SIZE, 1e-3, "f4"), np.full((SIZE, FACTORS), 1e-3, "f4")
    rate, decay = 0.08, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            some = [rows[i] for i in order[at : at + 64]]
            index, values = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            lengths = np.array([len(r[0]) for r in some])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            products = model["v"][index] * values[:, None]
            sums = np.add.reduceat(products, starts)
            logit = model["w0"] + np.add.reduceat(model["w"][index] * values, starts) + 0.5 * (sums * sums - np.add.reduceat(products * products, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - np.array([r[2] for r in some])) / len(some)
            each = np.repeat(error, lengths)
            places, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, each * values, len(places)) + decay * model["w"][places]
            by_value = (each * values)[:, None] * (np.repeat(sums, lengths, 0) - products)
            dv = np.stack([np.bincount(where, by_value[:, f], len(places)) for f in range(FACTORS)], 1) + decay * model["v"][places]
            d0 = float(error.sum())
            g0 += d0 * d0
            gw[places] += dw * dw
            gv[places] += dv * dv
            model["w0"] -= rate * d0 / g0**0.5
            model["w"][places] -= rate * dw / np.sqrt(gw[places])
            model["v"][places] -= rate * dv / np.sqrt(gv[places])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Inputs and label of the bounded sample; only its ids and inputs reach the driver."""
    modulus, out = HELD_OUT
    usable = labels.filter("doc_id is not null and quality is not null").filter(crc_mod("doc_id", modulus) != out)
    sample = bounded_sample(usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality")), "_id", limit)
    picked = _inputs(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "n_chars", "quality")  # at most ``limit`` pairs of numbers

    def features(batches: Iterator[pa.RecordBatch]):
        made = Features()
        for batch in batches:
            rows = [made.of(t, n) for t, n in zip(texts_of(batch), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "places": pa.array([r[0].tobytes() for r in rows], pa.binary()), "vals": pa.array([r[1].tobytes() for r in rows], pa.binary()), "quality": batch.column("quality")})

    made = picked.mapInArrow(features, "doc_id long, places binary, vals binary, quality int")
    # Of rows that repeat a doc_id one counts, so no more than ``limit`` come here.
    rows = made.groupBy("doc_id").agg(F.min(F.struct("places", "vals", "quality")).alias("row")).select("doc_id", "row.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.places))
    return [(np.frombuffer(r.places, "i4"), np.frombuffer(r.vals, "f4"), int(r.quality > 0)) for r in rows]


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def _scored(batch: pa.RecordBatch, model: dict, fitted: bool, made: Features) -> np.ndarray:
    out = []
    n_chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
    texts = texts_of(batch)
    for at in range(0, batch.num_rows, 128):
        parts = [made.of(t, n) for t, n in zip(texts[at : at + 128], n_chars[at : at + 128])]
        logit = scores(model, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts]))
        out.append(1 / (1 + np.exp(-np.clip(logit.astype("f8"), -30, 30))))
    found = np.concatenate(out) if out else np.zeros(0)
    return found if fitted else np.full(len(found), 0.5)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, whose score reaches the threshold (all of them where nothing was learnt)."""
    rows = training_rows(docs, labels)
    if not rows:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))  # of fixed size

    def keep(batches: Iterator[pa.RecordBatch]):
        made = Features()
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, shared.value, True, made) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    shared = spark.sparkContext.broadcast(fit(rows))  # of fixed size
    fitted = bool(rows)

    def score(batches: Iterator[pa.RecordBatch]):
        model, made = shared.value, Features()
        for batch in batches:
            found = _scored(batch, model, fitted, made)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(found), "predicted": pa.array((found >= threshold).astype("i4"))})

    modulus, out = HELD_OUT
    ready = _inputs(docs).withColumn("held_out", crc_mod("doc_id", modulus) == out)
    return ready.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
