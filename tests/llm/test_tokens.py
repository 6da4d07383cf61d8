"""Operators 3 and 10 against the tokenizers library, text by text."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, token_binary
from textloom.llm.tokens import ByteEncoder, vocabulary_path

BYTES, WORDS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
BYTE_OWN, WORD_OWN = ByteEncoder(BYTES), bpe.SpeculativeBpe(WORDS)
TEXTS = ["", " ", "a", "a  b", "a   b", "x \n y", "end  ", " \n\n\t z", "it's they'RE 12 345", "<|endoftext|> a <|startoftext|>b", "ünïcödé é ΑΣ İ", "日本語 mixed　space", "nul\0char", "a\x1cb\x1d c", "#" * 300, "ab" * 4000, "́ combining", "A B C! ... don't"]

pieces = st.lists(st.sampled_from(["the", "ing", "Éclair", " ", "  ", "\n", "\t", "'s", "42", "<|endoftext|>", " ", "\x1c", "\0", "!!", ",", ".", ", ", ". ", "ñ", "é", "Σ", "\U0001f600", "zxqj", "THE"]), max_size=25).map("".join)


def expected_words(text):
    ids = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, WORD_LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(pieces, st.text(max_size=40)))
def test_both_encoders_equal_the_library(text):
    assert np.frombuffer(BYTE_OWN.encode([text])[0], "<u4").tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids
    ids, decoded = expected_words(text)
    own = WORD_OWN.encode([text])[0]
    assert np.frombuffer(own, "<u4").tolist() == ids
    assert WORD_OWN.decode(own).decode() == decoded


def test_fixed_texts_and_random_words():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rng.randrange(1, 18))) for _ in range(4000)]
    for text in [*TEXTS, " ".join(words), "".join(words[:300])]:
        assert np.frombuffer(BYTE_OWN.encode([text])[0], "<u4").tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(WORD_OWN.encode([text])[0], "<u4").tolist() == expected_words(text)[0]


def test_only_failing_words_are_merged_exactly():
    own = bpe.SpeculativeBpe(WORDS)
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr") for _ in range(8)) for _ in range(2000)]
    own.encode([" ".join(words)])
    assert 0 < own.exact_words < own.checked_words
    assert any(own.propose(w) != own.exact(w) for w in words)


def test_long_words_merge_alike(monkeypatch):
    rng = random.Random(2)
    own = bpe.SpeculativeBpe(WORDS)
    for k in range(40):
        symbols = own._symbols("".join(rng.choice("abcaether") for _ in range(60)) if k else "a" * 61)
        short = own.merged(symbols)
        assert own._merged_long(list(symbols)) == short


class _File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_codes_give_any_token():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (511, 300), (512, 70_000), (5000, 70_000), (2000, 1 << 32)):
        ids = rng.integers(0, top, n).astype("<u4")
        lengths = [n // 2, 0, n - n // 2]
        file = _File()
        token_binary.write_codes(file, [4, None, -9], lengths, ids)
        reader = token_binary.CodeReader(file)
        assert reader.doc_ids() == [4, None, -9] and reader.starts().tolist() == [0, n // 2, n // 2, n]
        assert reader.slice(0, n).tolist() == ids.tolist()
        for _ in range(60):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert reader.slice(a, b).tolist() == ids[a:b].tolist()
        for i in rng.integers(0, n, 20).tolist() if n else []:
            assert reader.token(i) == ids[i]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, start string")


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", None, None, None), (7, None, None, None, None), (7, TEXTS[7], None, None, None)]
    table = docs(spark, rows).repartition(5)
    order = sorted(((r[0] if r[0] is not None else -1), r[1] or "") for r in rows)
    folder = f"file://{tmp_path}/codes"
    manifest = token_binary.write_tokens(table, folder, file_tokens=500)
    assert len(manifest) > 3
    got = token_binary.read_tokens(spark, folder, manifest).orderBy("start").collect()
    start = 0
    assert len(got) == len(order)
    for row, (doc_id, text) in zip(got, order):
        ids = BYTE_LIBRARY.encode(text, add_special_tokens=False).ids + [0]
        assert (row.doc_id if row.doc_id is not None else -1) == doc_id
        assert row.ids == ids and row.start == start and row.n_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    digests = token_binary.token_digests(table)
    assert sorted(map(tuple, digests.collect()), key=lambda r: r[1]) == [tuple(r)[:4] for r in got]
    assert token_binary.token_digests(table.limit(0)).count() == 0


def test_bpe_rows(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] * 2 + [(None, None, None, None, None)]
    got = bpe.encoded(docs(spark, rows).coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for row, (_, text, *_rest) in zip(got, rows):
        ids, decoded = expected_words(text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == decoded
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encoded(docs(spark, rows).limit(0)).count() == 0
