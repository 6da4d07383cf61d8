"""Operator 9: marginal likelihood of texts over all subword segmentations.

The pieces and the order of their scores come from an existing vocabulary file;
a piece's first weight follows Zipf's law in that order.  ``EM_ROUNDS`` rounds
of expectation and maximisation over the training words then set the weights of
a unigram model over pieces.  A document's score is the log10 probability of its
words and end, summed over every segmentation by a forward recursion in log
space.  No piece holds a word's start but at its own start, so the sum over all
segmentations of a text is the product of those of its words, and each distinct
word is computed once for the whole corpus.

The words of the corpus and their counts form a table that grows with it.
Words that make up at least 1/``HEAD`` of all tokens, of which there can be no
more than ``HEAD``, are handed to every task; the rest meet their documents in a
join by word, so no hot word is ever shuffled.

Defined results: null and empty texts are one end token; repeated rows are
scored each and count each in training; a null doc_id counts as empty text for
the hold-out; without training rows all counts are 0 and the base is over no
token (probability 1 / 1), the weights stay at their start; an empty table gives
no rows; other columns pass unread.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, staged, summed, texts_of
from .tokens import vocabulary_path

HELD_OUT = (7, 2)
#: Words with at least N / HEAD occurrences are looked up, the others joined.
HEAD = 100_000
EM_ROUNDS = 1
#: Weight of the first guess against the counts, in tokens.
PRIOR = 1000.0
_START = "▁"
#: The end of a document in the table of words; no word has a line end.
END = "\n"
_LONGEST_BATCHED = 48
_EMIT = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with their bits spread, so that the upper ones tell them apart."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Lattice:
    """A unigram model over an existing vocabulary's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        order = sorted(ids, key=lambda i: (-model.get_score(i), i))
        weights = np.zeros(size + 1)
        weights[order] = 1 / (np.arange(len(order)) + 10.0)
        weights[size] = 1 / 100.0  # the end of a document
        self.end = size
        self.first = weights / weights.sum()
        self.bytes = np.zeros(256, "i8")
        self.pieces: dict[str, int] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            else:
                self.pieces[piece] = i
        self.longest = max(map(len, self.pieces))
        hashed = {}
        for piece, i in self.pieces.items():
            h = 0
            for c in piece:
                h = (h * 0x100000001B3 + ord(c) + 1) & (2**64 - 1)
            hashed[int(_mixed(np.array([h], "u8"))[0])] = i
        if len(hashed) != len(self.pieces):
            raise ValueError("two pieces have one hash")
        keys = np.array(sorted(hashed), "u8")
        # A direct table by the upper bits narrows each search to one or two keys.
        self.shift = np.uint64(64 - 20)
        self.keys = keys
        self.values = np.array([hashed[int(k)] for k in keys], "i4")
        self.slots = np.searchsorted(keys, np.arange(1 << 20, dtype="u8") << self.shift).astype("i4")
        self.deepest = int(np.max(np.diff(np.append(self.slots, len(keys)))))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 for none."""
        hashes = _mixed(hashes)
        at = self.slots[(hashes >> self.shift).astype("i8")]
        found = np.full(len(hashes), -1, "i4")
        last = len(self.keys) - 1
        for k in range(self.deepest):
            place = np.minimum(at + k, last)
            found = np.where(self.keys[place] == hashes, self.values[place], found)
        return found

    def _fallback(self, char: str) -> list[int]:
        return [int(self.bytes[b]) for b in char.encode("utf-8", "surrogatepass")]

    def marginals(self, words: list[str], logs: np.ndarray, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural-log probability of each word; with ``weights``, adds expected counts of pieces to ``counts``."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(k)
        for length, members in by_length.items():
            if length > _LONGEST_BATCHED:
                for k in members:
                    out[k] = self._one(words[k], logs, None if weights is None else weights[k], counts)
                continue
            for start in range(0, len(members), 4096):
                some = members[start : start + 4096]
                text = "".join([_START + words[k] for k in some])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), length)
                out[some] = self._batch(codes, logs, None if weights is None else weights[some], counts)
        return out

    def _batch(self, codes: np.ndarray, logs: np.ndarray, weights, counts) -> np.ndarray:
        n, length = codes.shape
        wide = codes.astype("u8") + np.uint64(1)
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        edges = []
        for i in range(length):
            h = np.zeros(n, "u8")
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * np.uint64(0x100000001B3) + wide[:, j - 1]
                ids = self._find(h)
                has = np.flatnonzero(ids >= 0)
                if len(has):
                    found = ids[has]
                    alpha[j, has] = np.logaddexp(alpha[j, has], alpha[i, has] + logs[found])
                    if weights is not None:
                        edges.append((i, j, has, found))
                if j == i + 1 and len(has) < n:
                    lacks = np.flatnonzero(ids < 0)
                    kinds, where = np.unique(codes[lacks, i], return_inverse=True)
                    each = [self._fallback(chr(c)) for c in kinds]
                    cost = np.array([logs[b].sum() for b in each])[where]
                    alpha[j, lacks] = np.logaddexp(alpha[j, lacks], alpha[i, lacks] + cost)
                    if weights is not None:
                        edges.append((i, j, lacks, (each, where, cost)))
        total = alpha[length]
        if weights is not None:
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0.0
            for i, j, rows, found in reversed(edges):
                cost = found[2] if isinstance(found, tuple) else logs[found]
                through = cost + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], through)
                share = np.exp(alpha[i, rows] + through - total[rows]) * weights[rows]
                if isinstance(found, tuple):
                    for pieces, amount in zip(found[0], np.bincount(found[1], share, len(found[0]))):
                        np.add.at(counts, pieces, amount)
                else:
                    counts += np.bincount(found, share, len(counts))
        return total

    def _one(self, word: str, logs: np.ndarray, weight, counts) -> float:
        """One long word, edge by edge."""
        text = _START + word
        n = len(text)
        alpha, edges = [0.0] + [-math.inf] * n, []

        def add(a: float, b: float) -> float:
            a, b = max(a, b), min(a, b)
            return a if b == -math.inf else a + math.log1p(math.exp(b - a))

        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = self.pieces.get(text[i:j])
                pieces = [k] if k is not None else self._fallback(text[i]) if j == i + 1 else None
                if pieces:
                    cost = float(sum(logs[p] for p in pieces))
                    alpha[j] = add(alpha[j], alpha[i] + cost)
                    if weight is not None:
                        edges.append((i, j, pieces, cost))
        if weight is not None:
            beta = [-math.inf] * n + [0.0]
            for i, j, pieces, cost in reversed(edges):
                beta[i] = add(beta[i], cost + beta[j])
                np.add.at(counts, pieces, weight * math.exp(alpha[i] + cost + beta[j] - alpha[n]))
        return alpha[n]


@functools.lru_cache(1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower leaves all else."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_table(docs: DataFrame) -> DataFrame:
    """Every distinct word of all texts with its count in training texts; END has the number of those."""

    def count(batches: Iterator[pa.RecordBatch]):
        known: list[Counter] = [Counter(), Counter()]  # held out, training

        def rows():
            every = list(known[1].keys() | known[0].keys())
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "surrogatepass") for w in every], pa.string()), "c": pa.array([known[1].get(w, 0) for w in every], pa.int64())})
            known[0].clear(), known[1].clear()
            return out

        for batch in batches:
            for text, held in zip(texts_of(batch), batch.column("held_out").to_pylist()):
                counter = known[not held]
                counter.update(words_of(text))
                counter[END.encode()] += 1
                if len(known[0]) + len(known[1]) > _EMIT:
                    yield rows()
        yield rows()

    return docs.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, for words are worked on by length."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def learnt(words: DataFrame, model_path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Natural logs of the pieces' weights after the rounds; only a vector of fixed length reaches the driver."""
    own = lattice(model_path)
    probabilities = own.first
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(np.log(np.maximum(probabilities, 1e-300)))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            model, logs = lattice(model_path), shared.value
            counts = np.zeros(len(logs))
            for batch in _larger(batches):
                texts, weights = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype("f8")
                ends = [k for k, w in enumerate(texts) if w == END]
                for k in ends:
                    counts[model.end] += weights[k]
                    weights[k], texts[k] = 0.0, ""
                if len(texts):
                    model.marginals(texts, logs, weights, counts)
            return counts

        counts = summed(words.filter("c > 0"), expect, len(probabilities))
        probabilities = (counts + PRIOR * own.first) / (counts.sum() + PRIOR)
    return np.log(np.maximum(probabilities, 1e-300))


def scored(docs: DataFrame, model_path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    model_path = model_path or vocabulary_path("piece_bpe_32k.model")
    modulus, out = HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", modulus) == out).alias("held_out"))
    words = staged(word_table(rows), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = totals["n"], totals["v"]
    logs = learnt(words, model_path)
    below = math.log10(n + v + 1)

    def weigh(batches: Iterator[pa.RecordBatch]):
        model = lattice(model_path)
        for batch in _larger(batches):
            texts, counts = batch.column("word").to_pylist(), batch.column("c")
            ends = [k for k, w in enumerate(texts) if w == END]
            for k in ends:
                texts[k] = ""
            found = model.marginals(texts, weights_of.value)
            found[ends] = weights_of.value[model.end]
            base = np.log10(counts.to_numpy().astype("f8") + 1) - below
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "c": counts, "base": pa.array(base), "lattice": pa.array(found / math.log(10))})

    weights_of = spark.sparkContext.broadcast(logs)  # a vector of fixed length
    weighed = lambda some: some.mapInArrow(weigh, "word string, c long, base double, lattice double")
    least = max(1, -(-n // head))
    common = weighed(words.filter((F.col("c") >= least) | (F.col("word") == END))).collect()  # at most ``head`` words and the end: their counts sum to n or less
    shared = spark.sparkContext.broadcast({r["word"].encode("utf-8", "surrogatepass"): (r["c"] > 0, r["base"], r["lattice"]) for r in common})

    def read(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        end = known.get(END.encode(), (False, -below, float(weights_of.value[-1]) / math.log(10)))
        names = ["doc_id", "held_out", "text_hash", "copies", "word", "tf", "n_tokens", "n_known", "base", "lattice"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        held: list[list] = [[] for _ in names]

        def rows():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types)], names)
            for c in held:
                c.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text_hash", "text")]
            for doc_id, held_out, text_hash, text in zip(*columns):
                found = words_of(text)
                counts = Counter(found)
                seen, base, score = (1 if end[0] else 0), end[1], end[2]
                rare, times = [], []
                for word, tf in counts.items():
                    if (w := known.get(word)) is not None:
                        seen += tf * w[0]
                        base += tf * w[1]
                        score += tf * w[2]
                    else:
                        rare.append(word.decode("utf-8", "surrogatepass"))
                        times.append(tf)
                # The document itself, under a key that no word has and many share.
                k = len(rare) + 1
                for column, value in zip(held, ([doc_id] * k, [held_out] * k, [text_hash] * k, [1] + [0] * (k - 1), [f"\n{text_hash % 4096}"] + rare, [0] + times, [len(found) + 1] + [0] * (k - 1), [seen] + [0] * (k - 1), [base] + [0.0] * (k - 1), [score] + [0.0] * (k - 1))):
                    column += value
                if len(held[0]) >= 20_000:
                    yield rows()
        yield rows()

    read_schema = "doc_id long, held_out boolean, text_hash long, copies long, word string, tf long, n_tokens long, n_known long, base double, lattice double"
    spread = rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(read, read_schema)
    rare = weighed(words.filter((F.col("c") < least) & (F.col("word") != END))).select(F.col("word").alias("of"), (F.col("c") > 0).cast("long").alias("of_known"), F.col("base").alias("of_base"), F.col("lattice").alias("of_lattice"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    summed_up = (
        spread.join(rare, F.col("word") == F.col("of"), "left")
        .groupBy("doc_id", "held_out", "text_hash")
        .agg(
            F.sum("copies").alias("copies"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.col("tf") * none("of_known")).alias("n_known"),
            F.sum(F.col("base") + F.col("tf") * none("of_base")).alias("base"),
            F.sum(F.col("lattice") + F.col("tf") * none("of_lattice")).alias("lattice"),
        )
    )
    # Equal rows were added up; each gets its share and its own row again.
    each = lambda c: (F.col(c) / F.col("copies"))
    return summed_up.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("lattice").alias("score")
    )
