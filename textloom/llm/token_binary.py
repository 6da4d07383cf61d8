"""Operator 3: token ids in a file of directly addressable codes.

A file holds the ids of consecutive documents, split into chunks of
``CHUNK_BITS`` bits.  Level 0 has the lowest chunk of every id, level 1 the
next chunk of those ids that need one, and so on.  Each level has a bitmap that
tells which of its ids go on in the next level, and a rank directory: the set
bits before every block of 512 bits.  The place of id ``i`` in level ``l + 1``
is the rank of its bit in level ``l``, so any token is found from one byte, one
directory entry and one block of bits a level, and nothing is decoded on the
way.

Defined results: a null text is an empty one and has the end id only; rows with
a null doc_id come first, equal doc_ids are ordered by text and all are kept;
an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_dir
from .tokens import byte_encoder, vocabulary_path

MAGIC = b"TLDAC01\n"
CHUNK_BITS = 8
RANK_BLOCK = 512
#: Tokens after which a file is closed; a longer document has a file to itself.
FILE_TOKENS = 4_000_000
#: Tokens that a reader holds at once.
READ_TOKENS = 1_000_000


def write_codes(stream, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    """Writes one file: header, directory of documents, levels."""
    ids = np.ascontiguousarray(ids, "<u4")
    levels, rest = [], ids
    while True:
        chunk, rest = (rest & 0xFF).astype("u1"), rest >> CHUNK_BITS
        more = rest > 0
        bits = np.zeros(-(-len(more) // RANK_BLOCK) * RANK_BLOCK, "u1")
        bits[: len(more)] = more
        blocks = bits.reshape(-1, RANK_BLOCK).sum(1, dtype="<u8") if len(bits) else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        levels.append((chunk, np.packbits(bits, bitorder="little"), ranks))
        if not more.any():
            break
        rest = rest[more]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    directory = [
        np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        starts.tobytes(),
    ]
    head = 8 + 24 + 32 * len(levels)
    at = head + sum(map(len, directory))
    entries = b""
    for chunk, bits, ranks in levels:
        entries += struct.pack("<4Q", len(chunk), at, at + len(chunk), at + len(chunk) + len(bits))
        at += len(chunk) + len(bits) + ranks.nbytes
    stream.write(MAGIC + struct.pack("<3Q", len(levels), len(doc_ids), len(ids)) + entries)
    for part in directory:
        stream.write(part)
    for chunk, bits, ranks in levels:
        stream.write(chunk.tobytes())
        stream.write(bits.tobytes())
        stream.write(ranks.tobytes())


class CodeReader:
    """Random access to a file of codes; reads only the bytes that an answer needs."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n_docs, self.n_tokens = struct.unpack("<3Q", head[8:])
        raw = file.read_at(32 * n_levels, 32)
        self.levels = [struct.unpack_from("<4Q", raw, 32 * k) for k in range(n_levels)]
        self._docs = 32 + 32 * n_levels

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self.file.read_at(8 * self.n_docs, self._docs), "<i8")
        has = np.frombuffer(self.file.read_at(self.n_docs, self._docs + 8 * self.n_docs), "u1")
        return [int(d) if h else None for d, h in zip(ids, has)]

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * (self.n_docs + 1), self._docs + 9 * self.n_docs), "<u8")

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of a level's bitmap."""
        _, _, bits, ranks = self.levels[level]
        block, within = divmod(i, RANK_BLOCK)
        before = struct.unpack("<Q", self.file.read_at(8, ranks + 8 * block))[0]
        if not within:
            return before
        raw = np.frombuffer(self.file.read_at(-(-within // 8), bits + block * RANK_BLOCK // 8), "u1")
        return before + int(np.unpackbits(raw, bitorder="little")[:within].sum())

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to before ``end``."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        out = np.zeros(end - start, "<u4")
        where = np.arange(end - start)
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            if start == end:
                break
            out[where] |= np.frombuffer(self.file.read_at(end - start, chunks + start), "u1").astype("<u4") << np.uint32(CHUNK_BITS * level)
            first, last = start // 8, -(-end // 8)
            raw = np.frombuffer(self.file.read_at(last - first, bits + first), "u1")
            more = np.unpackbits(raw, bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            where = where[more]
            if len(where):
                start = self._rank(level, start)
                end = start + len(where)
            else:
                break
        return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> list[dict]:
    """Encodes ``docs`` (doc_id, text) and writes files of codes to ``folder``.

    Documents are dealt out by ranges of doc_id and each task writes files of
    bounded size, so a task holds one file's ids and one batch of texts.  What
    comes back has one small entry a file, in order: name, n_docs, n_tokens and
    start, the ids of all files before it.
    """
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    SharedFiles(folder).make()

    def write(batches: Iterator[pa.RecordBatch]):
        files, encoder = SharedFiles(folder), byte_encoder(path)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, n = [], [], [], 0
        made = {"part": [], "number": [], "name": [], "n_docs": [], "n_tokens": []}
        end = struct.pack("<I", end_id)

        def close():
            nonlocal number, n
            if not doc_ids:
                return
            name = f"tokens-{part:06d}-{number:06d}.dac"
            ids = np.frombuffer(b"".join(held), "<u4")
            files.commit(name, lambda stream: write_codes(stream, doc_ids, lengths, ids))
            for k, v in zip(made, (part, number, name, len(doc_ids), len(ids))):
                made[k].append(v)
            number, n = number + 1, 0
            doc_ids.clear(), lengths.clear(), held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                encoded = encoder.encode([t or "" for t in some.column("text").to_pylist()])
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), encoded):
                    doc_ids.append(doc_id)
                    held.append(raw + end)
                    lengths.append(len(raw) // 4 + 1)
                    n += lengths[-1]
                    if n >= file_tokens:
                        close()
        close()
        yield pa.RecordBatch.from_pydict(made, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(write, "part int, number int, name string, n_docs long, n_tokens long").collect()
    start, manifest = 0, []
    for r in sorted(rows, key=lambda r: (r["part"], r["number"])):
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "start": start})
        start += r["n_tokens"]
    return manifest


def read_tokens(spark, folder: str, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]):
        files = SharedFiles(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with files.open(name) as file:
                    reader = CodeReader(file)
                    starts, doc_ids = reader.starts().astype("i8"), reader.doc_ids()
                    k = 0
                    while k < len(doc_ids):
                        j = k + 1
                        while j < len(doc_ids) and starts[j + 1] - starts[k] <= READ_TOKENS:
                            j += 1
                        out = {"doc_id": pa.array(doc_ids[k:j], pa.int64()), "start": pa.array(base + starts[k:j], pa.int64()), "n_tokens": pa.array(np.diff(starts[k : j + 1]), pa.int64())}
                        if with_ids:
                            ids = reader.slice(int(starts[k]), int(starts[j]))
                            raw, cuts = ids.tobytes(), 4 * (starts[k : j + 1] - starts[k])
                            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                            out["ids_crc32"] = pa.array(crcs, pa.int64())
                            out["ids"] = pa.ListArray.from_arrays(pa.array(starts[k : j + 1] - starts[k], pa.int32()), pa.array(ids.view("<i4")))
                        else:
                            out["ids_crc32"] = pa.array([_crc(reader, int(a), int(b)) for a, b in zip(starts[k:j], starts[k + 1 : j + 1])] if j == k + 1 else _crcs(reader, starts[k : j + 1]), pa.int64())
                        yield pa.RecordBatch.from_pydict(out)
                        k = j

    listed = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    return listed.repartition(min(len(manifest), max(2 * spark.sparkContext.defaultParallelism, len(manifest) // 8))).mapInArrow(read, schema)


def _crcs(reader: CodeReader, starts: np.ndarray) -> list[int]:
    raw = reader.slice(int(starts[0]), int(starts[-1])).tobytes()
    cuts = 4 * (starts - starts[0])
    return [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def _crc(reader: CodeReader, start: int, end: int) -> int:
    """The digest of one document, however long, a bounded number of tokens at a time."""
    crc = 0
    for at in range(start, end, READ_TOKENS):
        crc = zlib.crc32(reader.slice(at, min(end, at + READ_TOKENS)).tobytes(), crc)
    return crc


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns each document's digest."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer), with_ids=False)
