"""Terms that a corpus uses and its glossaries lack: kinds and scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ngrams
from textloom.operators.books import lemmas


def known_terms(glossaries: DataFrame, zipf: DataFrame) -> DataFrame:
    """term: the sources (term) of all glossaries in lower case, each word as its lemma."""
    words = glossaries.select(F.lower(F.trim("term")).alias("whole")).distinct().select("whole", F.posexplode(F.split("whole", r"\s+")).alias("at", "word"))
    by_word = lemmas(words.select("word").distinct(), zipf)
    ordered = F.array_sort(F.collect_list(F.struct("at", "lemma")))["lemma"]
    return words.join(by_word, "word").groupBy("whole").agg(F.array_join(ordered, " ").alias("term")).select("term").distinct()


def glossary_subset(entries: DataFrame, domains: list[str], always: list[str]) -> DataFrame:
    """term and target of the chosen domains and those that are always on; of equal terms the last row (ord) wins."""
    return entries.filter(F.col("domain").isin([*domains, *always])).groupBy("term").agg(F.max_by("target", "ord").alias("target"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """word, n, books, orig (its most frequent form, of equally frequent ones the least) and n_caps; tokens: book, token."""
    forms = tokens.groupBy("book", "token").agg(F.count("*").alias("n"))
    per_form = forms.groupBy(F.lower("token").alias("word"), "token").agg(F.sum("n").alias("n"))
    books = forms.select("book", F.lower("token").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("books"))
    caps = F.sum(F.when(F.col("token").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0))
    by_word = per_form.groupBy("word").agg(F.sum("n").alias("n"), F.min_by("token", F.struct(-F.col("n"), "token")).alias("orig"), caps.alias("n_caps"))
    return by_word.join(books, "word")


def word_scores(counts: DataFrame, total: Column, zipf: DataFrame, known: DataFrame, stop: list[str], least: int = 3) -> DataFrame:
    """kind, term, n, books, z and score of words that no glossary knows.

    counts as of ``word_counts``; total: words of the corpus; zipf: word, z;
    known: term.  Words with a hyphen that have no frequency go by the rarest
    part; rare ones (below 3) by rarity, the others by how much more frequent
    they are here (ten times at least).
    """
    kept = counts.filter((F.col("n") >= least) & (F.length("word") >= 3) & ~F.col("word").rlike(r"^\d+$") & ~F.col("word").isin(list(stop)))
    unknown = lemmas(kept.select("word"), zipf).join(known.select(F.col("term").alias("lemma")).distinct(), "lemma", "left_anti").select("word")
    rows = kept.join(unknown, "word", "left_semi").join(zipf.select("word", "z"), "word", "left")
    parts = F.filter(F.split("word", "[-']"), lambda p: p != "")
    split = rows.filter(F.col("z").isNull() & (F.size(parts) > 1)).select("word", F.explode(parts).alias("part"))
    rarest = split.join(zipf.select(F.col("word").alias("part"), F.col("z").alias("pz")), "part", "left").groupBy("word").agg(F.min(F.coalesce("pz", F.lit(0.0))).alias("least_z"))
    rows = rows.join(rarest, "word", "left")
    joined, rare = F.col("least_z").isNotNull(), F.col("z").isNull() | (F.col("z") < 3.0)
    spread = F.log(F.col("n") + 1) * (1 + F.col("books"))
    key = F.log10(F.col("n") / total * 1e6) - (F.coalesce("z", F.lit(0.0)) - 3)
    camel = F.col("orig").rlike("[a-z][A-Z]|^[A-Z][a-z]+[A-Z]") & (F.col("orig") != "camelCase")
    kind = (
        F.when(joined & (F.col("least_z") >= 3.5), "hyphen").when(joined, "rare").when(rare & camel, "code?")
        .when(rare & (F.col("n_caps") > 0.9 * F.col("n")), "name?").when(rare, "rare").when((key >= 1.0) & (F.col("n") >= 2 * least), "key")
    )
    score = F.when(joined, spread * (3.5 - F.col("least_z") / 2)).when(rare, spread * (3.5 - F.coalesce("z", F.lit(0.5)))).otherwise(key * spread)
    return rows.select(kind.alias("kind"), F.col("orig").alias("term"), "n", "books", F.coalesce("least_z", "z").alias("z"), F.round(score, 6).alias("score")).filter("kind is not null")


def phrase_scores(lists: DataFrame, counts: DataFrame, total: Column, zipf: DataFrame, known: DataFrame, stop: list[str], code: list[str] = (), least: int = 3) -> DataFrame:
    """kind, term, n, books and score of pairs of words that no glossary knows and that stick together.

    lists: book and t, the tokens of a text in lower case; counts, zipf and known
    as for ``word_scores``.  No word of a pair is a stop word or one of ``code``;
    short words must be common and long ones known.  A pair is at least 8 per
    cent of its rarer word, and its words are more frequent here than elsewhere.
    """
    word = counts.select("word", F.col("n").alias("c"), "orig", (F.col("n") / total * 1e6).alias("pm")).join(zipf.select("word", "z"), "word", "left").join(lemmas(counts.select("word"), zipf), "word")
    odd = F.col("word").isin([*stop, *code]) | ((F.length("word") < 3) & (F.coalesce("z", F.lit(0.0)) < 3)) | (F.col("z").isNull() & ~F.col("word").contains("-") & (F.length("word") > 10))
    # How much more frequent, as a power of ten, none below 0.
    more = F.greatest(F.lit(0.0), F.log10(F.col("pm") + 1e-9) - F.log10(F.pow(F.lit(10.0), F.coalesce("z", F.lit(0.0)) - 3) + 1e-3))
    word = word.filter(~odd).select("word", "c", F.col("orig").rlike(r"^\p{Lu}").alias("cap"), "lemma", more.alias("more"))
    grams = lists.select("book", F.explode(ngrams(F.col("t"), 2)).alias("gram")).groupBy("book", "gram").agg(F.count("*").alias("n"))
    pairs = grams.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("books")).filter(F.col("n") >= least)
    for side in (1, 2):
        pairs = pairs.withColumn("word", F.split_part("gram", F.lit(" "), F.lit(side))).join(word.select("word", *[F.col(c).alias(f"{c}{side}") for c in ("c", "cap", "lemma", "more")]), "word").drop("word")
    unknown = pairs.withColumn("term", F.concat_ws(" ", "lemma1", "lemma2")).join(known.select("term").distinct(), "term", "left_anti")
    stick, spec = F.col("n") / F.least("c1", "c2"), (F.col("more1") + F.col("more2")) / 2
    kept = unknown.withColumns({"stick": stick, "spec": spec}).filter("stick >= 0.08 and spec >= 0.4")
    score = F.log(F.col("n") + 1) * (1 + F.col("books")) * F.col("stick") * (1 + F.col("spec"))
    return kept.select(F.when(F.col("cap1") & F.col("cap2"), "name?").otherwise("phrase").alias("kind"), F.col("gram").alias("term"), "n", "books", F.round(score, 6).alias("score"))
