"""Scans of the files that hold dictionaries, journals, lists and books."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def glossary(spark: SparkSession, path: str, hash_inside: bool = False, but: tuple[str, ...] = ()) -> DataFrame:
    """domain, source and target of CSV files with a header; blank sources and comments are left out.

    Sources with # inside are kept only with ``hash_inside``; ``but`` names
    domains (stems of files) that are not read.
    """
    raw = spark.read.option("header", True).schema("source string, target string, tgt_lng string").csv(path)
    source = F.trim(F.regexp_replace("source", "^" + chr(0xFEFF), ""))
    named = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1).alias("domain"), source.alias("source"), F.trim("target").alias("target"))
    comment = F.col("source").startswith("#") if hash_inside else F.col("source").contains("#")
    return named.filter((F.col("source") != "") & ~comment & ~F.col("domain").isin(list(but)))


def glossary_sizes(spark: SparkSession, path: str, but: tuple[str, ...] = ("keep",)) -> DataFrame:
    """domain and the number of its terms, files without a term included."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1).alias("domain"))
    return lines.filter(~F.col("domain").isin(list(but))).groupBy("domain").agg((F.count("*") - 1).alias("n"))


def sense_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules for words of several senses: CSV with # comment lines anywhere and quoted patterns; lists of domains are arrays."""
    raw = spark.read.option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').csv(path)
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda d: d != "")
    default = F.coalesce(F.nullif(F.trim("default"), F.lit("")), F.lit("own")) if "default" in raw.columns else F.lit("own")
    return raw.select(F.trim("word").alias("word"), listed("own").alias("own"), "own_target", listed("conflict_domains").alias("conflict"), "alt_target", "alt_cues", "own_cues", "verb", default.alias("default"))


def journal(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; bad ones are left out, or with ``strict`` end the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word and zipf of a tab-separated list with # comments, packed or not."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("word string, zipf double").csv(path)


def lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """The distinct words of several lists."""
    words = spark.read.text(list(paths)).select(F.trim("value").alias("word"))
    return words.filter("word <> ''").distinct()


def variants(spark: SparkSession, path: str) -> DataFrame:
    """term, variant and regex of lines parted by |; what follows the second | is the regex."""
    parts = F.split("value", r"\s*\|\s*", 3)
    return spark.read.text(path).filter(F.size(parts) == 3).select(*[parts[k].alias(n) for k, n in enumerate(("term", "variant", "regex"))])


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, size, mtime) that the manifest doesn't have in just this state."""
    return files.join(manifest.select("name", "size", "mtime"), ["name", "size", "mtime"], "left_anti")


def book_files(spark: SparkSession, folder: str, pattern: str = "*.epub") -> DataFrame:
    """name, size, mtime and content of the books under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


_OPF = "{http://www.idpf.org/2007/opf}"


def spine(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of a packed book in reading order; those that are missing are passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = {n.lower(): n for n in book.namelist()}
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        items = {e.attrib["id"]: e.attrib for e in package.iter(f"{_OPF}item")}
        for ref in package.iter(f"{_OPF}itemref"):
            item = items.get(ref.attrib["idref"])
            if item is None or "nav" in item.get("properties", "").split():
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item["href"])))
            if path.lower() in names:
                yield path, book.read(names[path.lower()])


def book_units(books: DataFrame) -> DataFrame:
    """name, ch, sec, unit_no, is_head and text of the units of packed books; sec counts headings through the book."""
    from textloom.sources.html_units import Units

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                rows, sec = [], 0
                for ch, (_, html) in enumerate(spine(content)):
                    parser = Units()
                    parser.feed(html.decode("utf-8", "replace"))
                    parser.close()
                    parser.flush(False)
                    for tag, text, _ in parser.units:
                        head = bool(re.fullmatch("h[1-6]", tag))
                        sec += head
                        rows.append((name, ch, sec, len(rows), head, text))
                columns = zip(*rows) if rows else [[]] * 6
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["name", "ch", "sec", "unit_no", "is_head", "text"])

    return books.select("name", "content").mapInArrow(read, "name string, ch int, sec int, unit_no int, is_head boolean, text string")


def joined_parts(members: DataFrame) -> DataFrame:
    """book, key and html: members (book, name, html) cut into ``_split_000`` pieces put together again in the order of their names."""
    key = F.regexp_replace("name", r"_split_\d+", "")
    pieces = F.array_sort(F.collect_list(F.struct("name", "html")))["html"]
    return members.groupBy("book", key.alias("key")).agg(F.array_join(pieces, "").alias("html"))


def layout_nodes(spark: SparkSession, path: str) -> DataFrame:
    """file, part, at and node (JSON) of layout trees: their texts, pictures, tables and groups, each by its place."""
    parts = ("texts", "pictures", "tables", "groups")
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("value", ", ".join(f"{p} array<string>" for p in parts)).alias("tree"))
    each = [whole.select("file", F.lit(p).alias("part"), F.posexplode(f"tree.{p}").alias("at", "node")) for p in parts]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def restricted(rows: DataFrame, pages: str | None = None, only: list[str] | None = None) -> DataFrame:
    """rows of the pages "first-last" (column page) and of the named files (column name): filters that reach the scan."""
    if pages:
        first, last = map(int, pages.split("-"))
        rows = rows.filter(F.col("page").between(first, last))
    return rows.filter(F.col("name").isin(only)) if only else rows
