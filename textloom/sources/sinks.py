"""Writers of results; all of them commit whole or not at all."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_glossary(terms: DataFrame, path: str, suppressed: DataFrame | None = None, form: str = "csv") -> None:
    """``source -> target`` lines, or CSV without identical pairs and without the suppressed sources."""
    if form == "text":
        terms.select(F.concat_ws(" -> ", "source", "target").alias("value")).write.mode("overwrite").text(path)
        return
    kept = terms.filter("source <> target")
    if suppressed is not None:
        kept = kept.join(suppressed.select("source").distinct(), "source", "left_anti")
    kept.select("source", "target").write.mode("overwrite").option("header", True).csv(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_words(words: DataFrame, path: str) -> None:
    """A sorted, packed list of words."""
    words.select("word").distinct().orderBy("word").write.mode("overwrite").option("compression", "gzip").text(path)


def write_wide(rows: DataFrame, path: str, key: str, column: str, value: str, columns: list[str]) -> None:
    """A table with a column for each of the named values."""
    rows.groupBy(key).pivot(column, columns).agg(F.first(value)).write.mode("overwrite").option("header", True).csv(path)


def rewritten_book(book: bytes, changed: dict[str, str]) -> bytes:
    """A packed book with some members replaced: members keep their order, and the first, its type, stays unpacked."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for member in old.infolist():
            packed = zipfile.ZIP_STORED if member.filename == "mimetype" else zipfile.ZIP_DEFLATED
            data = changed[member.filename].encode() if member.filename in changed else old.read(member)
            new.writestr(zipfile.ZipInfo(member.filename, member.date_time), data, packed)
    return out.getvalue()


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small record of a job as JSON: written beside its place and put there by a rename that replaces the old one."""
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stream = beside.getFileSystem(conf).create(beside, True)
    try:
        stream.write(bytearray(json.dumps(state, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        stream.close()
    replaced = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replaced[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(beside, final, replaced)


def write_report(lines: DataFrame, path: str, order: str, line: str) -> None:
    """Lines of text in order."""
    lines.orderBy(order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


_PAGE = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{}</title></head><body>{}</body></html>'


def packed_book(title: str, chapters: list[tuple[str, str]]) -> bytes:
    """A packed book of chapters (title, body as markup) with its contents; equal input gives equal bytes."""
    names = [f"ch{n:04d}.xhtml" for n in range(1, len(chapters) + 1)]
    items = "".join(f'<item id="c{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, name in enumerate(names))
    refs = "".join(f'<itemref idref="c{n}"/>' for n in range(len(names)))
    links = "".join(f'<li><a href="{name}">{escape(head)}</a></li>' for name, (head, _) in zip(names, chapters, strict=True))
    nav = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    about = f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:identifier id="id">{escape(title)}</dc:identifier></metadata>'
    members = [
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">{about}<manifest>{nav}{items}</manifest><spine>{refs}</spine></package>'),
        ("OEBPS/nav.xhtml", _PAGE.format(escape(title), f'<nav epub:type="toc"><ol>{links}</ol></nav>')),
        *((f"OEBPS/{name}", _PAGE.format(escape(head), body)) for name, (head, body) in zip(names, chapters, strict=True)),
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in members:
            book.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def built_books(blocks: DataFrame) -> DataFrame:
    """name and content: packed books of blocks (name, ord, page, tag, title, html), a chapter from each h1 that does not follow another.

    A page's first block carries its mark; blocks before the first h1 are a
    chapter under the book's name.  A book is put together in memory, one at a
    time, from chapters that tasks have joined before.
    """
    by = Window.partitionBy("name").orderBy("ord")
    starts = (F.col("tag") == "h1") & (F.coalesce(F.lag("tag").over(by), F.lit("")) != "h1")
    first = F.row_number().over(Window.partitionBy("name", "page").orderBy("ord")) == 1
    marked = F.concat(F.when(first & F.col("page").isNotNull(), F.concat(F.lit('<span epub:type="pagebreak" id="p'), F.col("page").cast("string"), F.lit('"></span>'))).otherwise(""), "html")
    parts = blocks.select("name", "ord", "title", "tag", starts.cast("int").alias("start"), marked.alias("html"))
    numbered = parts.withColumn("ch", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    bodies = F.array_join(F.array_sort(F.collect_list(F.struct("ord", "html")))["html"], "\n")
    heads = F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") == "h1", F.struct("ord", "title"))))["title"], " ")
    chapters = numbered.groupBy("name", "ch").agg(F.coalesce(F.nullif(heads, F.lit("")), F.col("name")).alias("title"), bodies.alias("body"))
    listed = chapters.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ch", "title", "body"))).alias("chapters"))

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                name, chapters = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                content = packed_book(name, [(c["title"], c["body"]) for c in chapters])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

    return listed.mapInArrow(pack, "name string, content binary")
