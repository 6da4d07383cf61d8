"""Operator 10: BPE encoding by speculation, and decoding.

For each distinct word the longest vocabulary entries are taken greedily from
left to right; a vectorised check then asks of every adjacent pair of proposed
tokens whether the merges of the two joined would give those two again.  A word
all of whose pairs pass is encoded; only the others are merged step by step.
Verdicts on pairs are kept, so the check is a table look-up for almost all.

Works from the vocabulary file alone: text is normalised and cut as the file
says, by the library's own normaliser and pre-tokeniser, one white-space
delimited chunk at a time, and chunks are remembered.

Defined results: null and empty texts have no ids and decode to empty text;
rows are handled each for itself, so repeated rows and ties are kept as they
are; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .tokens import vocabulary_path

#: White space as the vocabulary's patterns have it: str.split() also cuts at four controls.
_SPACE = re.compile("[\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Symbols from which on merging keeps a heap.
_LONG = 400
#: ASCII letters and what may follow them, which the patterns cut in two.
_SIMPLE = re.compile(r"([A-Za-z]+)([!-&(-/:-;=-@\[-`{-~]*)")
#: The pre-tokeniser's pattern for which that holds.
_SIMPLE_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class SpeculativeBpe:
    """Encoder and decoder of a vocabulary file of the BPE kind."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("a BPE file without dropout, byte fallback, prefixes and decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.encoded_names = [n.encode() for n in self.names]
        # Inner and final forms of the entries, by the text they stand for.
        self.final = {n[: len(n) - len(self.end)]: i for n, i in self.vocab.items() if n.endswith(self.end)} if self.end else dict(self.vocab)
        self.inner = {n: i for n, i in self.vocab.items() if not self.end or not n.endswith(self.end)}
        self.longest = max(map(len, self.vocab))
        cuts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.simple = _SIMPLE_CUT in cuts and steps == ["NFC", "Replace", "Lowercase"]
        self.keep = keep
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.exact_words = self.checked_words = 0

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: the pair of the lowest rank first, of equal ones the leftmost."""
        symbols, ranks = list(symbols), self.ranks
        if len(symbols) > _LONG:
            return self._merged_long(symbols)
        none = len(ranks)
        of = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while of and (best := min(of)) < none:
            at = of.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del of[at]
            if at:
                of[at - 1] = ranks.get((symbols[at - 1], symbols[at]), none)
            if at < len(of):
                of[at] = ranks.get((symbols[at], symbols[at + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[str | None]) -> list[str]:
        """The same with a heap and links, in time n log n."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (pair := (symbols[i], symbols[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if before[i] >= 0 and (pair := (symbols[before[i]], symbols[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], before[i], *pair))
        return [s for s in symbols if s is not None]

    def _symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def exact(self, word: str) -> list[int]:
        """Ids of a byte-level word by exact merging; symbols without an entry have none."""
        return [self.vocab[s] for s in self.merged(self._symbols(word)) if s in self.vocab]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest entries from the left; None if some place has no entry."""
        ids, at, n = [], 0, len(word)
        while at < n:
            found = self.final.get(word[at:]) if n - at <= self.longest else None
            end = n
            if found is None:
                end = min(n - 1, at + self.longest)
                while end > at and (found := self.inner.get(word[at:end])) is None:
                    end -= 1
                if end == at:
                    return None
            ids.append(found)
            at = end
        return ids

    def _compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens, joined and merged anew, come out as they are.

        A token alone is checked as a pair of itself with none (``second`` -1).
        """
        names = [self.names[first]] + ([self.names[second]] if second >= 0 else [])
        last = names[-1]
        closed = bool(self.end) and last.endswith(self.end)
        text = "".join(names)[: -len(self.end) if closed else None]
        symbols = self._symbols(text) if closed else list(text)
        return self.merged(symbols) == names

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct byte-level words: propose, check all adjacent pairs at once, merge what fails."""
        proposals = [self.propose(w) for w in words]
        flat = np.array([i for p in proposals if p for i in p], "i8")
        lengths = np.array([len(p) if p else 0 for p in proposals])
        good = lengths > 0
        if len(flat):
            # Each token with its successor in the word; the last of a word with none.
            following = np.append(flat[1:], -1)
            ends = np.cumsum(lengths[good]) - 1
            single = lengths[good] == 1
            following[ends] = -1
            codes = (flat << 32) | (following + 1)
            check = np.ones(len(flat), bool)
            check[ends[~single]] = False  # the last token has been checked with the one before it
            distinct, where = np.unique(codes[check], return_inverse=True)
            verdicts = np.empty(len(distinct), bool)
            for k, code in enumerate(distinct.tolist()):
                verdict = self.pairs.get(code)
                if verdict is None:
                    verdict = self.pairs[code] = self._compatible(code >> 32, (code & 0xFFFFFFFF) - 1)
                verdicts[k] = verdict
            passed = np.ones(len(flat), bool)
            passed[check] = verdicts[where]
            good[good] = np.logical_and.reduceat(passed, np.concatenate([[0], ends[:-1] + 1]))
        self.checked_words += len(words)
        self.exact_words += int((~good).sum())
        if len(self.pairs) > self.keep:
            self.pairs.clear()
        return [p if ok else self.exact(w) for w, p, ok in zip(words, proposals, good)]

    def _words_of(self, chunk: str) -> list[str | int]:
        """Byte-level words of a chunk, and the ids of special tokens between them."""
        if self.simple and (m := _SIMPLE.fullmatch(chunk)):
            return [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
        out: list[str | int] = []
        at = 0
        for found in [*self._specials.finditer(chunk), None]:
            text = chunk[at : found.start() if found else None]
            if text:
                if self.library.normalizer:
                    text = self.library.normalizer.normalize_str(text)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []
            if found:
                out.append(self.special[found[0]])
                at = found.end()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > self.keep:
            self.chunks.clear()
        if 2 * len(self.words) > self.keep:
            self.words.clear()
        known = self.chunks
        cut = [_SPACE.split(t) if _CONTROLS.search(t) else t.split() for t in texts]
        found = [list(map(known.get, chunks)) for chunks in cut]
        missing = sorted({c for chunks, ids in zip(cut, found) if None in ids for c, i in zip(chunks, ids) if i is None})
        parts = [self._words_of(c) for c in missing]
        new = sorted({w for p in parts for w in p if isinstance(w, str) and w not in self.words})
        for start in range(0, len(new), 8192):
            some = new[start : start + 8192]
            for word, ids in zip(some, self.encode_words(some)):
                self.words[word] = np.array(ids, "<u4").tobytes()
        for chunk, part in zip(missing, parts):
            self.chunks[chunk] = b"".join([self.words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in part])
        return [b"".join(map(known.__getitem__, chunks) if None in ids else ids) for chunks, ids in zip(cut, found)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: without a decoder in the file, entries joined by spaces."""
        names = self.encoded_names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(1)
def speculative_bpe(path: str) -> SpeculativeBpe:
    """One encoder for all tasks of a process, which so share what it remembers."""
    return SpeculativeBpe(path)


def encoded(docs: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and with ``with_text`` ids and decoded text."""
    path = path or vocabulary_path("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]):
        bpe = speculative_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = bpe.encode(texts_of(some))
                decoded = [bpe.decode(i) for i in ids]
                out = {
                    "doc_id": some.column("doc_id"),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                }
                if with_text:
                    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype("i4")
                    out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                    out["decoded"] = pa.array([d.decode() for d in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
