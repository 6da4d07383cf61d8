"""Encoding of whole texts with a byte-level BPE file, one distinct piece at a time.

The file's own library makes the ids.  A text is first cut before single spaces
and around single line ends, and before a comma or full stop between a letter and
white space, places that no token of a byte-level vocabulary crosses, and each distinct piece is handed to the library once; texts with two
white space characters in a row, or others than those, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space and line end, and the mark of cuts.
_RARE_ASCII = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE = _RARE_ASCII + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Letters of Latin scripts and a tail without letters, numbers and apostrophes.
_TAILED = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]+)")
#: Marks that are cut off where white space follows them.
_TAILS = (",", ".")
#: Characters of text that are cut at once.
_AT_ONCE = 10_000_000
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def vocabulary_path(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Ids of whole texts as the library's ``encode(text, add_special_tokens=False)`` has them."""

    def __init__(self, path: str, keep: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known = keep, {}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(names.values()) + 2, "i8")
        for name, i in names.items():
            self.lengths[i] = len(name)  # a byte is one character of a byte-level entry

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes new pieces.

        Letters and a tail of marks are always tokens of their own, so such a
        piece is made of its two parts, which are seldom new.  Runs without
        white space are set end to end, those without a space before them
        behind a line end, and encoded together: no token crosses from one to
        the next, and as tokens keep every byte, their lengths tell whose they
        are.
        """
        known, parts, new = self.known, {}, set()
        for p in pieces:
            if p[-1:] in _MARKS and (m := _TAILED.fullmatch(p)):
                parts[p] = m.groups()
            else:
                new.add(p)
        for pair in parts.values():
            new.update(pair)
        new -= known.keys() & new
        special = new & {"", "\n"}
        runs = [p if p[0] == " " else "\n" + p for p in new - special]
        for start in range(0, len(runs), 2000):
            some = runs[start : start + 2000]
            ids = np.frombuffer(self._whole(["".join(some)])[0], "<u4")
            ends = np.cumsum(self.lengths[ids])
            cuts = (np.searchsorted(ends, np.cumsum([0, *map(len, map(str.encode, some))]), "right") * 4).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(some, cuts, cuts[1:]):
                if p[0] == " ":
                    known[p] = raw[a:b]
                else:
                    known[p[1:]] = raw[a + 4 : b]
        known.update(zip(special, self._whole(list(special))))
        for p, (a, b) in parts.items():
            known[p] = known[a] + known[b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for k, text in enumerate(texts):
            if _joins(text) or any(s in text for s in self.specials):
                out[k] = self._whole([text])[0]
            else:
                some.append(k)
                size += len(text)
            if some and (size >= _AT_ONCE or k == len(texts) - 1):
                for place, ids in zip(some, self._cut([texts[i] for i in some])):
                    out[place] = ids
                some, size = [], 0
        if some:
            for place, ids in zip(some, self._cut([texts[i] for i in some])):
                out[place] = ids
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The same for texts without white space in a row: Arrow cuts them and tells the distinct pieces."""
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.string()), " ", "\0 "), "\n", "\0\n\0")
        for mark in _TAILS:
            marked = pc.replace_substring(marked, f"{mark}\0", f"\0{mark}\0")
        lists = pc.split_pattern(marked, "\0")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        found = list(map(known.get, pieces))
        if None in found:
            self._learn({p for p, ids in zip(pieces, found) if ids is None})
            found = list(map(known.__getitem__, pieces))
        lengths = np.fromiter(map(len, found), "i8", len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy()
        # A mark cut off is a token of its own behind a letter or number only; other texts go to the library whole.
        closed = np.fromiter((p[-1:].isalnum() for p in pieces), bool, len(pieces))
        tails = np.isin(at, [k for k, p in enumerate(pieces) if p in _TAILS])
        offsets = lists.offsets.to_numpy()
        odd = np.searchsorted(offsets, np.flatnonzero(tails[1:] & ~closed[at[:-1]]) + 1, "right") - 1
        each = lengths[at]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - each), each)]
        cuts = np.concatenate([[0], ends])[offsets] * 4
        raw, cuts = ids.tobytes(), cuts.tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(odd).tolist():
            out[k] = self._whole([texts[k]])[0]
        return out


def _joins(text: str) -> bool:
    """Whether the text has white space in a row, or other than lone spaces and line ends."""
    return "  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE))


@functools.lru_cache(1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a process, which so share what it remembers."""
    return ByteEncoder(path)
