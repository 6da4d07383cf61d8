"""Operator 5 against a plain count over the pages."""

import base64
import gzip
import hashlib
import os

import pytest

from tests import oracle
from textloom.llm import queries, warc
from textloom.llm.common import SharedFiles


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        key = page_id if page_id is not None else float("-inf")
        first[data] = min(first.get(data, key), key)
    out, done = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: r[0] if r[0] is not None else float("-inf")):
        data = (html or "").encode()
        revisit = first[data] != (page_id if page_id is not None else float("-inf")) or (page_id, data) in done
        done.add((page_id, data))
        refers = first[data] if revisit and first[data] != float("-inf") else None
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", refers))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nv", None), (4, "é", ""), (5, "b", "é" * 400_000), (6, "c", "é" * 400_000), (7, "d", "WARC/1.1\r\n\r\n"), (9, "e", "only"), (8, "e", "\r\n"), (10, "f", "q"), (10, "f", "q"), (10, "f", "other"), (None, "g", "n"), (11, "g", "n")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, size int").repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    assert warc.archived(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archived(pages, min_revisit_bytes=9).collect()} == {"response"}


def test_archives_are_plain_warc_and_chunks_whole(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.chunk_table(pages, chunk_bytes=70_000), folder, file_bytes=500_000)
    assert sum(m["records"] for m in manifest) == len(ROWS)
    for m in manifest:
        raw = gzip.decompress(SharedFiles(folder).open(m["name"]).read())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"Content-Length: " in raw
    chunks = warc.read_chunks(spark, folder, manifest).collect()
    assert max(len(c.chunk) for c in chunks) <= warc.CHUNK_BYTES
    whole = b"".join(c.chunk for c in sorted((c for c in chunks if c.page_id == 5), key=lambda c: c.chunk_no))
    assert whole == ("é" * 400_000).encode()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf_dir), queries.QUERIES["op5_warc"], queries.ORACLE_SQL["op5_warc"], sf_dir) is None
