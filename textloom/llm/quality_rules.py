"""Operator 6: quality rules by a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one of a trusted target
(all documents that ``labels`` marks as good), one of the whole raw corpus.  A document's
score is its mean log-likelihood ratio per n-gram; it is kept if the score
reaches a fixed threshold and the base rules hold.  Both counts are vectors of
fixed length, and no text is shuffled: the labels' ids are broadcast, in blocks
by their hashes if there are many, with a pass over the documents for each.

Defined results: null and empty texts have no words, so they fail the base
rule (score 0); repeated rows are scored each and count each; nulls in labels
mark nothing; a target without documents gives score 0 throughout, so the base
rules alone decide; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import summed, texts_of

#: Ids of the trusted target that are broadcast at once, about; beyond, they come in blocks.
BROADCAST_IDS = 500_000
BITS = 16
GRAM = 4
#: Mean natural-log ratio per n-gram below which a document is dropped.
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a text that are hashed at once.
_STRIDE = 1 << 20


def gram_buckets(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of GRAM bytes, in pieces of bounded size."""
    raw = np.frombuffer(data, "u1")
    for at in range(0, len(raw) - GRAM + 1, _STRIDE):
        some = raw[at : at + _STRIDE + GRAM - 1].astype("<u4")
        n = len(some) - GRAM + 1
        code = some[:n] | some[1 : n + 1] << np.uint32(8) | some[2 : n + 2] << np.uint32(16) | some[3 : n + 3] << np.uint32(24)
        yield (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()] if b"\n" in data else []
    seen: dict[bytes, int] = {}
    repeated = 0
    if len(words) > 3:
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], "i8")
        # A pair of words gets a number below the count of pairs, so that a triple's code never overflows.
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, where, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[where] > 1
        if again.any():
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(again)] |= again
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def fit_ratios(docs: DataFrame, labels: DataFrame, at_once: int = BROADCAST_IDS) -> np.ndarray:
    """Log ratio of every bucket: add-one smoothed target over raw, both counted from all documents."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    blocks = max(1, -(-good.count() // at_once))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = 1 << BITS

    def in_block(column: str, k: int):
        return F.pmod(F.xxhash64(column), F.lit(blocks)) == k

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * size)
        for batch in batches:
            for text, good, fresh in zip(texts_of(batch), batch.column("good").to_pylist(), batch.column("fresh").to_pylist()):
                for codes in gram_buckets(text.encode("utf-8", "surrogatepass")):
                    found = np.bincount(codes, minlength=size)
                    if fresh:
                        total[size:] += found
                    if good:
                        total[:size] += found
        return total

    counts = np.zeros(2 * size)
    for k in range(blocks):
        ids = F.broadcast(good.filter(in_block("_good", k)))  # about at_once numbers at most
        # The first pass sees every document, the others those of their block's ids only.
        marked = rows.join(ids, F.col("doc_id") == F.col("_good"), "inner" if k else "left")
        counts += summed(marked.select("text", F.col("_good").isNotNull().alias("good"), F.lit(k == 0).alias("fresh")), count, 2 * size)
    target, raw = counts[:size], counts[size:]
    if not target.any():
        return np.zeros(size)
    return np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's base measures, base_failed, score and kept."""
    ratios = docs.sparkSession.sparkContext.broadcast(fit_ratios(docs, labels).astype("f4"))  # a vector of fixed length

    def judge(batches: Iterator[pa.RecordBatch]):
        weights = ratios.value.astype("f8")
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                measures = base_measures(text)
                total, n = 0.0, 0
                for codes in gram_buckets(text.encode("utf-8", "surrogatepass")):
                    total += float(weights[codes].sum())
                    n += len(codes)
                score = total / n if n else 0.0
                failed = measures[0] < MIN_WORDS or 100 * measures[4] > MAX_REPEAT_PERCENT * measures[0]
                rows.append((*measures, failed, not failed and score >= threshold, score))
            out = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)
