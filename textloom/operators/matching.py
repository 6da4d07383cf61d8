"""Dictionary terms in texts, and the domains that they suggest."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import is_subsequence, whole_word

_SPACE = re.compile(r"[ \t\n\r\f\x0b]+")

#: Terms that a task holds at once, and up to which a table of terms is broadcast; beyond, Spark chooses a shuffled join.
BROADCAST_TERMS = 100_000
_ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


class Automaton:
    """Counts many strings in one pass over a text.

    forms: (form, what it counts for).  Forms in lower case are found in any
    case, others as they are written.  White space runs count as one space.
    """

    def __init__(self, forms: list[tuple[str, str]], ascii_words: bool = False):
        self.ascii_words = ascii_words
        self.lower = self._made([f for f in forms if f[0] == f[0].lower()])
        self.written = self._made([f for f in forms if f[0] != f[0].lower()])

    @staticmethod
    def _made(forms: list[tuple[str, str]]):
        import ahocorasick

        made, of = ahocorasick.Automaton(), defaultdict(list)
        for form, term in forms:
            if form:
                of[" ".join(form.split())].append(term)
        for form, terms in of.items():
            made.add_word(form, (len(form), terms))
        made.make_automaton()
        return made if of else None

    def _in_word(self, c: str) -> bool:
        return c in _ASCII_WORD if self.ascii_words else c.isalnum() or c == "_"

    def counts(self, text: str, whole: bool = True) -> dict[str, int]:
        """Occurrences by what they count for: of each form those that do not overlap, from the left; whole words only if ``whole``."""
        found: dict[str, int] = defaultdict(int)
        plain = _SPACE.sub(" ", text)
        for made, own in ((self.lower, plain.lower()), (self.written, plain)):
            if made is None:
                continue
            ends: dict[tuple[int, str], int] = {}
            for last, (n, terms) in made.iter(own):
                start = last + 1 - n
                if whole and (start and self._in_word(own[start - 1]) or last + 1 < len(own) and self._in_word(own[last + 1])):
                    continue
                key = (n, terms[0])
                if ends.get(key, -1) >= start:
                    continue
                ends[key] = last
                for term in terms:
                    found[term] += 1
        return found


def _blocks(forms: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Distinct (form, term), at most ``BROADCAST_TERMS`` at a time."""
    held: list[tuple[str, str]] = []
    for row in forms.select("form", "term").distinct().toLocalIterator():
        held.append((row["form"], row["term"]))
        if len(held) >= BROADCAST_TERMS:
            yield held
            held = []
    if held:
        yield held


def counted_forms(docs: DataFrame, forms: DataFrame, ascii_words: bool = False, whole: bool = True) -> DataFrame:
    """doc_id, term and n for every term of which a form (form, term) is found in a document.

    One pass over the texts for each ``BROADCAST_TERMS`` forms, of any length
    and any characters; only hits leave it.  Null texts hold nothing.
    """
    spark, parts = docs.sparkSession, []
    schema = docs.select("doc_id").schema
    for block in _blocks(forms):
        shared = spark.sparkContext.broadcast(block)  # of bounded length

        def look(batches, shared=shared):
            automaton = Automaton(shared.value, ascii_words)
            for batch in batches:
                at, terms, counts = [], [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    for term, n in automaton.counts(text or "", whole).items():
                        at.append(k)
                        terms.append(term)
                        counts.append(n)
                ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "term", "n"])

        parts.append(docs.select("doc_id", "text").mapInArrow(look, f"doc_id {schema[0].dataType.simpleString()}, term string, n long"))
    if not parts:
        return docs.select("doc_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    # Forms of one term may stand in several blocks.
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


def with_plurals(terms: DataFrame) -> DataFrame:
    """form and term: each term itself, its plural forms and, of acronyms, theirs."""
    from textloom.functions.text import acronym_plural, plurals

    term = F.col("term")
    return terms.select("term").distinct().select(F.explode(F.array_distinct(F.concat(F.array(term), plurals(term), F.array_compact(F.array(acronym_plural(term)))))).alias("form"), "term")


def term_occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term and n for every lower-case term found in a document as a whole ASCII word; each term counts by itself, nested ones too."""
    return counted_forms(docs, terms.select(F.col("term").alias("form"), "term"), ascii_words=True)


def domain_report(docs: DataFrame, terms: DataFrame, small_below: int = 100) -> DataFrame:
    """``domain_detect`` with plural forms, words of any script, shares of two decimals and the most frequent terms.

    terms: domain, term, target and ord, the order of the file.  ``top`` are
    eight terms by count, then ord; ``top_single`` three single words with their
    targets by count, term and target, all descending.
    """
    multi = F.col("term").rlike("[ -]")
    hits = counted_forms(docs, with_plurals(terms)).join(terms, "term")
    sizes = terms.groupBy("domain").agg((F.count_if(multi) < small_below).alias("small"), F.count_if(multi).alias("listed"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "ord", "term")))
    single = F.reverse(F.array_sort(F.collect_list(F.when(~multi, F.struct("n", "term", "target")))))
    by_domain = hits.groupBy("doc_id", "domain").agg(F.count("*").alias("n_terms"), F.count_if(multi).alias("n_multi"), F.sum("n").alias("occurrences"), F.slice(best, 1, 8)["term"].alias("best"), F.slice(single, 1, 3).alias("single"))
    total = F.sum("n_multi").over(Window.partitionBy("doc_id"))
    # Halves are rounded up, in whole numbers.
    cents = F.when(F.col("total") > 0, F.floor((200 * F.col("n_multi") + F.col("total")) / (2 * F.col("total")))).otherwise(F.lit(0))
    rated = by_domain.join(sizes, "domain").withColumn("total", total).withColumn("cents", cents)
    suggested = (F.col("n_multi") >= 3) & (F.col("cents") >= 15) | F.col("small") & (F.col("n_multi") >= 8) & (F.col("cents") >= 8)
    shown = F.array_join(F.transform("single", lambda x: F.concat(x["term"], F.lit("="), x["target"])), ", ")
    return rated.select("doc_id", "domain", "n_terms", "n_multi", "occurrences", (F.col("cents") / 100).alias("share"), suggested.alias("suggested"), F.array_join("best", ", ").alias("top"), shown.alias("top_single"))


def containing(rows: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id of the rows that hold any of the words (word), in any case and anywhere in a word."""
    found = counted_forms(rows, words.select(F.lower("word").alias("form"), F.lower("word").alias("term")), whole=False)
    return found.select("doc_id").distinct()


def domain_detect(docs: DataFrame, terms: DataFrame, small_below: int = 100) -> DataFrame:
    """For each document and domain its distinct terms, multi-word terms, occurrences, share and whether it is suggested.

    Suggested: at least 3 multi-word terms and a share of 15 per cent of all
    multi-word hits of the document, or, for domains with fewer than
    ``small_below`` multi-word terms, at least 8 and 8 per cent; shares compare
    as two rounded decimals do, in whole numbers.
    """
    multi = F.col("term").rlike("[ -]")
    hits = term_occurrences(docs, terms).join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")
    sizes = terms.groupBy("domain").agg((F.count_if(multi) < small_below).alias("small"))
    by_domain = hits.groupBy("doc_id", "domain").agg(F.count("*").alias("n_terms"), F.count_if(multi).alias("n_multi"), F.sum("n").alias("occurrences"))
    total = F.sum("n_multi").over(Window.partitionBy("doc_id"))
    sized = by_domain.join(sizes, "domain").withColumn("total", total)
    large = (F.col("n_multi") >= 3) & (1000 * F.col("n_multi") > 145 * F.col("total"))
    few = F.col("small") & (F.col("n_multi") >= 8) & (1000 * F.col("n_multi") > 75 * F.col("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("n_multi") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return sized.select("doc_id", "domain", "n_terms", "n_multi", "occurrences", share.alias("share"), (large | few).alias("suggested"))


def top_terms(docs: DataFrame, terms: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent single-word terms of each document and domain: by count, then term, both descending."""
    hits = term_occurrences(docs, terms).join(terms, "term").filter(~F.col("term").rlike("[ -]"))
    order = Window.partitionBy("doc_id", "domain").orderBy(F.desc("n"), F.desc("term"))
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("doc_id", "domain", "term", "n", F.col("place").cast("long").alias("place"))


def alternation_counts(docs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Matches of each group's terms as one alternation: from the left, longest first, nested ones once."""
    def pattern(terms: list[str]) -> str:
        return "(?i)(?:" + "|".join(whole_word(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"

    return docs.select("doc_id", *[F.regexp_count("text", F.lit(pattern(terms))).cast("long").alias(name) for name, terms in groups.items()])


def key_lookup(left: DataFrame, right: DataFrame, prefix: int = 40, within: int = 0) -> DataFrame:
    """Matches of keys in tiers: equal, else (for keys of ``prefix`` letters or more) one a prefix of the other.

    left: id, key; right: key, value and ord, the order in which equal
    candidates are tried.  A bucket of the first letters keeps the second tier an equi-join.
    With ``within``, what has no such match takes the one key of its bucket, if
    there is one only, that is longer by at most so many letters and holds its
    own letters in order.
    """
    best = Window.partitionBy("id").orderBy("tier", "ord")
    # Of equal keys only the first can be taken, so copies meet as one row.
    right = right.groupBy("key").agg(F.min_by(F.struct("value", "ord"), "ord").alias("r")).select("key", "r.value", "r.ord")
    exact = left.join(right, "key").select("id", "value", "ord", F.lit(1).alias("tier"))
    cut = lambda c: F.substring(F.col(c), 1, prefix)
    a = left.filter(F.length("key") >= prefix).select("id", F.col("key").alias("a"), cut("key").alias("bucket"))
    b = right.filter(F.length("key") >= prefix).select(F.col("key").alias("b"), "value", "ord", cut("key").alias("bucket"))
    near = a.join(b, "bucket").filter(F.col("a").startswith(F.col("b")) | F.col("b").startswith(F.col("a"))).select("id", "value", "ord", F.lit(2).alias("tier"))
    found = exact.union(near)
    if within:
        longer = F.length("b").between(F.length("a") + 1, F.length("a") + within)
        held = a.join(b, "bucket").filter(longer).filter(is_subsequence(F.col("a"), F.col("b")))
        by_key = held.groupBy("id", "b").agg(F.min_by(F.struct("value", "ord"), "ord").alias("first"))
        lone = by_key.groupBy("id").agg(F.count("*").alias("n"), F.first("first").alias("first")).filter("n = 1")
        found = found.union(lone.select("id", "first.value", "first.ord", F.lit(3).alias("tier")))
    return found.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("id", "value", F.col("tier").cast("long").alias("tier"))
