"""Operator 4: benchmark passages in documents, by embedding edit distance.

Texts are sequences of words (lower case, no marks at the ends).  An item is
found where some stretch of a document has a word edit distance to it of at
most a fifth of its words.  Per repetition a random walk of the CGK kind embeds
a window of the item's size: at step j it writes the word it stands on and goes
on to the next if a random bit of (j, word) says so.  Edits cost few differing
places, so that windows and items that agree in ``SAMPLED`` sampled places of
one of ``REPEATS`` walks are candidates; the exact edit distance decides.

Walks are only made where an item can be at all: at most k edits leave n - 1 -
2k of an item's n - 1 word pairs and n - 2 - 3k of its triples, so a window with
fewer of those that occur in any item is passed over.  That test loses nothing.
Items of fewer than ``WALKED`` words allow no edit and are looked up as they are.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, which is
what a task holds of it; documents are read once a block and never joined.

Defined results: items of fewer than ``shortest`` words match nothing (the
registered query and the pipeline take 1), nor do those without any; null and
empty texts hold nothing; equal items give equal rows, repeated rows of
documents are searched each; a null id is reported as null; an empty table on
either side gives no rows; other columns pass unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import normal_words, texts_of

#: Words from which items are looked for by walks; shorter ones allow no edit.
WALKED = 5
#: Edits allowed: this share of an item's words, rounded down.
EDITS = 0.2
REPEATS = 32
SAMPLED = 3
BLOCK_BYTES = 4_000_000
_PAD = -1
#: Words of documents that are searched at once.
_AT_ONCE = 1_000_000


def edits_allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def _by_gram(grams: list[np.ndarray], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and behind one another the lengths of the items that have each, with their starts."""
    if not grams:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(1, "i8")
    both = np.unique(np.stack([np.concatenate(grams), np.repeat(lengths, [len(g) for g in grams])], 1), axis=0)
    values, starts = np.unique(both[:, 0], return_index=True)
    return values, both[:, 1], np.append(starts, len(both))


def _places(index: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Of the places ``at`` those whose gram is an item's, and by the lengths of its items."""
    values, lengths, starts = index
    if not len(values) or not len(at):
        return at[:0], {}
    found = np.minimum(np.searchsorted(values, grams), len(values) - 1)
    hit = values[found] == grams
    at, found = at[hit], found[hit]
    many = starts[found + 1] - starts[found]
    ends = np.cumsum(many)
    of = lengths[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[found] - (ends - many), many)]
    where = np.repeat(at, many)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    return at, {int(of[order[a]]): where[order[a:b]] for a, b in zip(cuts, cuts[1:])}


class Benchmark:
    """The items of a block, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = 4, shortest: int = WALKED):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            words = normal_words(text)
            if len(words) >= max(1, shortest):
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], "i8")))
        size = len(self.vocabulary) + 1
        self.size = size
        walked = [words for _, words in self.items if len(words) >= WALKED]
        # Codes of grams may run over; grams that share one are passed on to the walks alike.
        pairs = [words[:-1] * size + words[1:] for words in walked]
        triples = [p[:-1] * size + words[2:] for p, words in zip(pairs, walked)]
        lengths = [len(words) for words in walked]
        self.pairs, self.triples = _by_gram(pairs, lengths), _by_gram(triples, lengths)
        rng = np.random.default_rng(seed)
        self.word_hash = rng.integers(1, 2**63, size + 1, dtype="u8") * np.uint64(2) + np.uint64(1)  # the last stands for padding
        longest = max((len(w) for _, w in self.items), default=0)
        self.steps = rng.integers(1, 2**63, (REPEATS, 2 * longest + 1), dtype="u8") * np.uint64(2) + np.uint64(1)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(self.items):
            if len(words) < WALKED:
                self.short[len(words)][words.tobytes()].append(k)
            else:
                self.by_length[len(words)].append(k)
        self.short = {n: dict(of) for n, of in self.short.items()}
        self.places = {n: np.sort(np.stack([rng.choice(max(SAMPLED, int(1.5 * n)), SAMPLED, replace=False) for _ in range(REPEATS)]), 1) for n in self.by_length}
        self.keys = {}
        for n, members in self.by_length.items():
            flat = np.concatenate([self.items[k][1] for k in members] + [np.zeros(1, "i8")])
            starts = np.arange(len(members)) * n
            for walk in range(REPEATS):
                keys = self.embed(flat, starts, n, walk)
                order = np.argsort(keys, kind="stable")
                self.keys[n, walk] = (keys[order], np.array(members)[order])

    def embed(self, flat: np.ndarray, starts: np.ndarray, n: int, walk: int) -> np.ndarray:
        """The sampled places of one walk over each window, as one number."""
        at = np.zeros(len(starts), "i8")
        key = np.zeros(len(starts), "u8")
        places = self.places[n][walk].tolist()
        for j in range(places[-1] + 1):
            inside = at < n
            word = np.where(inside, flat[starts + np.minimum(at, n - 1)], _PAD)
            mixed = self.word_hash[word]
            if j in places:
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + mixed
            at += ((mixed * self.steps[walk, j]) >> np.uint64(63)).astype("i8") & inside
        return key

    def candidates(self, flat: np.ndarray) -> dict[int, list[int]]:
        """Starts of windows that agree with an item in a repetition, by item."""
        found: dict[int, set[int]] = defaultdict(set)
        if not len(self.items) or len(flat) < 2:
            return {}
        for n, members in self.short.items():
            begins = np.unique(np.fromiter((np.frombuffer(w, "i8")[0] for w in members), "i8", len(members)))
            for at in np.flatnonzero(np.isin(flat, begins)).tolist():
                for item in members.get(flat[at : at + n].tobytes(), ()):
                    found[item].add(at)
        if not self.by_length:
            return {item: sorted(starts) for item, starts in found.items()}
        # Windows may begin at any word; what they lack beyond the last is padded.
        last = len(flat) - 1
        flat = np.concatenate([flat, np.zeros(max(self.by_length), "i8")])
        # Where pairs and triples of the items begin, by the lengths of those items.
        likely = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        paired, pairs = _places(self.pairs, likely, flat[likely] * self.size + flat[likely + 1])
        likely = paired[:-1][np.diff(paired) == 1]
        _, triples = _places(self.triples, likely, (flat[likely] * self.size + flat[likely + 1]) * self.size + flat[likely + 2])
        for n in self.by_length:
            k = edits_allowed(n)
            need, at = (n - 2 - 3 * k, triples.get(n)) if n - 2 - 3 * k > 1 else (n - 1 - 2 * k, pairs.get(n))
            if at is None or len(at) < need:
                continue
            # Windows of n + k words from low to high hold the places i to i + need - 1.
            low, high = np.maximum(at[need - 1 :] - n - k + 1, 0), np.minimum(at[: len(at) - need + 1], last)
            fits = low <= high
            first = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low[fits].tolist(), high[fits].tolist())] or [low[:0]]))
            if not len(first):
                continue
            for walk in range(REPEATS):
                keys, members = self.keys[n, walk]
                own = self.embed(flat, first, n, walk)
                left = np.searchsorted(keys, own)
                hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == own)
                for h in hit.tolist():
                    at = left[h]
                    while at < len(keys) and keys[at] == own[h]:
                        found[int(members[at])].add(int(first[h]))
                        at += 1
        return {item: sorted(starts) for item, starts in found.items()}

    def verified(self, words: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """The least distance of the item to a stretch about the starts, and that stretch; None if none is near enough.

        ``words`` are those of one document; of equally near stretches the first counts.
        """
        pattern = self.items[item][1]
        n, k = len(pattern), edits_allowed(len(pattern))
        best = None
        known = np.zeros(self.size + 1, bool)
        known[pattern] = True
        at = 0
        while at < len(starts):
            low, high = starts[at], starts[at]
            while at < len(starts) and starts[at] <= high + n:
                high = starts[at]
                at += 1
            low, high = max(0, low - 2 * k), min(len(words), high + n + 2 * k)
            part = words[low:high]
            if int(known[part].sum()) < n - k:
                continue
            distances = _ends(pattern, part)
            e = int(np.argmin(distances))
            d = int(distances[e])
            if d <= k and (best is None or d < best[0]):
                back = _whole(pattern[::-1], part[:e][::-1])
                fits = np.flatnonzero(back == d)
                best = (d, low + e - int(fits[0]), low + e)
        return best


def _ends(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in the text, the least distance of the pattern to a stretch that ends there."""
    n = len(pattern)
    ramp = np.arange(n + 1)
    row = ramp.copy()
    out = np.empty(len(text) + 1, "i8")
    out[0] = n
    for i, word in enumerate(text, 1):
        fresh = np.empty(n + 1, "i8")
        fresh[0] = 0
        fresh[1:] = np.minimum(row[:-1] + (pattern != word), row[1:] + 1)
        row = np.minimum.accumulate(fresh - ramp) + ramp
        out[i] = row[n]
    return out


def _whole(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Distances of the pattern to each prefix of the text."""
    n = len(pattern)
    ramp = np.arange(n + 1)
    row = ramp.copy()
    out = [int(row[n])]
    for i, word in enumerate(text[: 2 * n], 1):
        fresh = np.empty(n + 1, "i8")
        fresh[0] = i
        fresh[1:] = np.minimum(row[:-1] + (pattern != word), row[1:] + 1)
        row = np.minimum.accumulate(fresh - ramp) + ramp
        out.append(int(row[n]))
    return np.array(out)


def search(texts: list[str], block: Benchmark) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item, distance, first word, word after the last)."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    get = block.vocabulary.get
    at = 0
    while at < len(texts):
        parts, first, n = [], at, 0
        while at < len(texts) and n < _AT_ONCE:
            words = normal_words(texts[at])
            parts.append(np.fromiter(map(get, words, repeat(0)), "i8", len(words)))
            # A stretch of unknown words keeps windows from reaching over texts unnoticed.
            parts.append(np.zeros(1, "i8"))
            n += len(words) + 1
            at += 1
        flat = np.concatenate(parts)
        edges = np.cumsum([len(a) + len(b) for a, b in zip(parts[::2], parts[1::2])])
        for item, starts in block.candidates(flat).items():
            texts_at = np.searchsorted(edges, starts, "right")
            by_text: dict[int, list[int]] = defaultdict(list)
            for start, t in zip(starts, texts_at.tolist()):
                by_text[t].append(start - int(edges[t] - len(parts[2 * t]) - 1))
            for t, own in by_text.items():
                if hit := block.verified(parts[2 * t], item, own):
                    out[first + t].append((item, *hit))
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shortest: int = WALKED) -> Iterator[Benchmark]:
    """The benchmark's distinct items, by id, a bounded number of bytes at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"].encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield Benchmark(held, shortest=shortest)
            held, size = [], 0
    if held:
        yield Benchmark(held, shortest=shortest)


_FOUND = "doc_id long, item_id long, distance int, n_words int, first_word int, end_word int"


def contaminations(docs: DataFrame, benchmark: DataFrame, shortest: int = WALKED) -> DataFrame:
    """A row for every document and item found in it, with the nearest stretch."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in blocks_of(benchmark, shortest=shortest):
        shared = spark.sparkContext.broadcast(block)  # of bounded text

        def look(batches: Iterator[pa.RecordBatch], shared=shared):
            own = shared.value
            for batch in batches:
                made = [(doc_id, own.items[item][0], d, len(own.items[item][1]), a, b) for doc_id, hits in zip(batch.column("doc_id").to_pylist(), search(texts_of(batch), own)) for item, d, a, b in hits]
                columns = list(zip(*made)) if made else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4)], ["doc_id", "item_id", "distance", "n_words", "first_word", "end_word"])

        part = rows.mapInArrow(look, _FOUND)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], _FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = WALKED) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item."""
    for block in blocks_of(benchmark, shortest=shortest):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # of bounded text

        def keep(batches: Iterator[pa.RecordBatch], shared=shared):
            for batch in batches:
                clean = [not hits for hits in search(texts_of(batch), shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
