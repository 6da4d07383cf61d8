"""Operator 5: WARC archives by way of a table of payload chunks.

Both ways a payload travels as rows of (record, chunk number, bytes) of at most
``CHUNK_BYTES``, and digests are carried from chunk to chunk, so no task ever
holds a whole payload.  Records are written to ``.warc.gz`` files, a gzip
member each; of records with equal payloads the one with the smallest page_id
is a ``response`` and the others are ``revisit`` records without a body that
refer to it.

Defined results: null html is an empty payload; payloads shorter than
``min_revisit_bytes`` are always responses; rows that repeat a page_id with the
same payload give a response and revisits of that same page_id; a null page_id
is written as an empty identifier, read back as null, and is the smallest; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedFiles, dealt, fresh_dir, staged

CHUNK_BYTES = 256 * 1024
#: Bytes of payload after which an archive is closed.
FILE_BYTES = 256 * 1024 * 1024
_READ = 64 * 1024
#: In place of a null page_id where ids are compared: below every other.
_LEAST = -(2**63)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def chunk_table(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of every page's payload with the decision for its record.

    Which record is the response is settled on narrow rows of (digest,
    page_id), of which the digests of many pages are broadcast.  Payloads are
    cut where they are read; only chunks are dealt out, by page_id and digest,
    and sorted.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_LEAST)).alias("page_id"), "url", payload.alias("payload"))
    keyed = narrow.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    ids = keyed.filter(F.col("size") >= min_revisit_bytes).select("page_id", "digest")
    first = staged(ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"), "digests")
    decided = dealt(ids, first, "digest", "n").distinct().select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "first_id")
    # Rows with one page_id and one payload are told apart by their place, so that the chunks of each stay together.
    cut = F.expr(f"transform(sequence(0L, greatest(size - 1L, 0L), {chunk_bytes}L), at -> substring(payload, cast(at + 1 as int), {chunk_bytes}))")
    chunks = keyed.withColumn("place", F.monotonically_increasing_id()).select("page_id", "url", "digest", "size", "place", F.posexplode(cut).alias("chunk_no", "chunk"))
    joined = chunks.join(decided, (chunks.page_id == decided.of_page) & (chunks.digest == decided.of_digest), "left")
    return joined.select("page_id", "url", "digest", "size", "first_id", "place", "chunk_no", "chunk").sortWithinPartitions("page_id", "digest", "place", "chunk_no").drop("place")


def _header(kind: str, page_id: int, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'' if i == _LEAST else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{_base32(digest)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"X-Payload-Length: {size}", "Content-Length: 0"]
    else:
        lines.append(f"Content-Length: {size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Archive:
    """Records for one file, compressed as their chunks come."""

    def __init__(self, stream):
        self.stream, self.bytes, self.zip = stream, 0, None

    def begin(self, header: bytes) -> None:
        self.zip = zlib.compressobj(3, zlib.DEFLATED, 31)
        self.stream.write(self.zip.compress(header))

    def add(self, chunk: bytes) -> None:
        self.bytes += len(chunk)
        self.stream.write(self.zip.compress(chunk))

    def end(self) -> None:
        self.stream.write(self.zip.compress(b"\r\n\r\n") + self.zip.flush())


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes chunk rows, in the order of each partition, to archives in ``folder``; a small entry a file comes back."""
    SharedFiles(folder).make()

    def rows_of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "digest", "size", "first_id", "chunk_no", "chunk")]
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in columns)

    def write(batches: Iterator[pa.RecordBatch]):
        files, part, number = SharedFiles(folder), TaskContext.get().partitionId(), 0
        rows, made = rows_of(batches), []
        row = next(rows, None)
        written = None  # the (page_id, digest) before, to tell repeated rows
        while row is not None:
            name, records = f"pages-{part:06d}-{number:06d}.warc.gz", 0

            def fill(stream):
                nonlocal row, records, written
                archive = _Archive(stream)
                while row is not None and archive.bytes < file_bytes:
                    page_id, url, digest, size, first_id, _, chunk = row
                    again = first_id is not None and (first_id != page_id or written == (page_id, digest))
                    archive.begin(_header("revisit" if again else "response", page_id, url, digest, size, first_id))
                    sha = hashlib.sha1()
                    while True:
                        sha.update(chunk)
                        if not again:
                            archive.add(chunk)
                        row = next(rows, None)
                        if row is None or row[5] == 0:
                            break
                        chunk = row[6]
                    if sha.hexdigest() != digest:
                        raise ValueError(f"chunks of page {page_id} are out of order")
                    archive.end()
                    records, written = records + 1, (page_id, digest)

            files.commit(name, fill)
            made.append((name, records))
            number += 1
        yield pa.RecordBatch.from_pydict({"name": pa.array([m[0] for m in made], pa.string()), "records": pa.array([m[1] for m in made], pa.int64())})

    rows = chunks.mapInArrow(write, "name string, records long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["name"])


class _Members:
    """The inflated bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.zip, self.ended = stream, b"", b"", None, False

    def _more(self) -> bool:
        """Inflates some more of the present member; False at its end."""
        while True:
            if self.zip is None:
                self.zip = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(_READ)
            if not self.raw:
                self.ended = True
                return False
            got = self.zip.decompress(self.raw, _READ)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if self.zip.eof:
                self.zip = None
            if got:
                self.out += got
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.out:
            if not self._more():
                return None
        line, _, self.out = self.out.partition(b"\r\n")
        return line

    def take(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes."""
        while not self.out:
            if not self._more():
                raise EOFError("an archive ends within a record")
        got, self.out = self.out[:n], self.out[n:]
        return got


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("seen_bytes", pa.int64()), ("seen_sha1", pa.string())]


def read_chunks(spark: SparkSession, folder: str, manifest: list[dict], with_bytes: bool = True) -> DataFrame:
    """Chunk rows of all records of archives.

    page_id, url, record_type, refers_to, payload_digest (as the header has
    it), chunk_no, last, and the digest and length of the payload up to and
    with this chunk; ``with_bytes`` adds the chunk.  A revisit has one row, the
    length of which is the one its header states.
    """
    schema = pa.schema(_RECORD + [("chunk", pa.binary())] * with_bytes)
    ddl = "page_id long, url string, record_type string, refers_to long, payload_digest string, chunk_no long, last boolean, seen_bytes long, seen_sha1 string" + ", chunk binary" * with_bytes
    if not manifest:
        return spark.createDataFrame([], ddl)

    def records(stream):
        members = _Members(stream)
        while (line := members.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while line := members.line():
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            fixed = [_page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _page(head["warc-refers-to"]) if "warc-refers-to" in head else None, head["warc-payload-digest"].removeprefix("sha1:")]
            size, sha, seen, chunk_no = int(head["content-length"]), hashlib.sha1(), 0, 0
            if head["warc-type"] == "revisit":
                yield [*fixed, 0, True, int(head["x-payload-length"]), None, b""]
                continue
            while True:
                parts, have = [], 0
                while have < min(CHUNK_BYTES, size - seen):
                    parts.append(members.take(min(CHUNK_BYTES, size - seen) - have))
                    have += len(parts[-1])
                    sha.update(parts[-1])
                seen += have
                yield [*fixed, chunk_no, seen == size, seen, base64.b32encode(sha.digest()).decode(), b"".join(parts)]
                chunk_no += 1
                if seen == size:
                    break

    def read(batches: Iterator[pa.RecordBatch]):
        files = SharedFiles(folder)
        width = len(schema)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open(name) as file:
                    held, held_bytes = [], 0
                    for r in records(file):
                        held.append(r[:width])
                        held_bytes += len(r[-1]) if with_bytes else 0
                        if len(held) >= 2000 or held_bytes >= 8 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, held_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    listed = spark.createDataFrame([(m["name"],) for m in manifest], "name string")
    return listed.repartition(min(len(manifest), max(2 * spark.sparkContext.defaultParallelism, len(manifest) // 8))).mapInArrow(read, ddl)


def record_digests(chunks: DataFrame) -> DataFrame:
    """A row a record from its last chunk; the carried digest must be the header's."""
    checked = F.when(F.col("seen_sha1").isNull() | (F.col("seen_sha1") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return chunks.filter("last").select("page_id", "url", F.col("seen_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes every page to archives, reads them back and returns a row a record."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    manifest = write_archives(chunk_table(pages, min_revisit_bytes), folder)
    return record_digests(read_chunks(spark, folder, manifest, with_bytes=False))
