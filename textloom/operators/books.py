"""Operators over books and their translations: terms, words, pairs of versions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(reference: DataFrame, hypothesis: DataFrame, group: str) -> DataFrame:
    """group, pos, ref and hyp: matched by id, or by place in groups of which more than half of the ids have no match.

    Both sides: group, id, pos (the place in the group, from 0), text; an id occurs once a group.
    """
    ref = reference.select(group, "id", "pos", F.col("text").alias("ref"))
    by_id = ref.join(hypothesis.select(group, "id", F.col("text").alias("hyp")), [group, "id"], "left")
    lost = by_id.groupBy(group).agg((2 * F.count_if(F.col("hyp").isNull()) > F.count("*")).alias("by_place"))
    placed = ref.join(lost.filter("by_place"), group).join(hypothesis.select(group, "pos", F.col("text").alias("hyp")), [group, "pos"]).select(group, "pos", "ref", "hyp")
    return by_id.join(lost.filter("not by_place"), group).select(group, "pos", "ref", "hyp").unionByName(placed)


def partners(n: Column, m: Column, k: Column) -> tuple[Column, Column]:
    """First and last place among m sentences that may render the k-th of n: equal places if n = m, else about the proportional one."""
    centre = F.floor((2 * k * (m - 1) + F.greatest(F.lit(1), n - 1)) / (2 * F.greatest(F.lit(1), n - 1)))
    return F.when(n == m, k).otherwise(F.greatest(centre - 1, F.lit(0))), F.when(n == m, k).otherwise(F.least(centre + 1, m - 1))


def lemmas(words: DataFrame, zipf: DataFrame, drop: float = 0.7) -> DataFrame:
    """word and its rough singular, taken only if it isn't rarer by more than ``drop`` than the word; zipf: word, z."""
    word = F.col("word")
    cut = (
        F.when((F.length(word) > 4) & word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when((F.length(word) > 4) & word.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .when((F.length(word) > 3) & word.rlike("s$") & ~word.rlike("(ss|us|is)$"), F.regexp_replace(word, "s$", ""))
    )
    own, of_cut = zipf.select("word", F.col("z").alias("z")), zipf.select(F.col("word").alias("cut"), F.col("z").alias("z_cut"))
    joined = words.select("word", cut.alias("cut")).join(own, "word", "left").join(of_cut, "cut", "left")
    fits = F.col("z").isNull() | (F.coalesce("z_cut", F.lit(0.0)) >= F.col("z") - drop)
    return joined.select("word", F.when(F.col("cut").isNotNull() & fits, F.col("cut")).otherwise(word).alias("lemma"))


def known(words: DataFrame, lexicon: DataFrame, endings: list[str], suffixes: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """The words (word) that a lexicon (key) knows: as they are, by all their parts, by their stem, or behind a prefix.

    A stem is a word without one of the endings; it is known if a key without a
    hyphen begins with it and goes on for five letters at most.  Each key gives
    its few such beginnings, so all of this is an equi-join.
    """
    text = F.col("key")
    begins = lexicon.filter(~text.contains("-") & (F.length(text) >= 5))
    spans = F.sequence(F.greatest(F.length(text) - 5, F.lit(5)), F.length(text))
    stems = begins.select(F.explode(F.transform(spans, lambda n: F.substring(text, F.lit(1), n))).alias("form")).distinct()
    keys = lexicon.select(text.alias("form")).distinct()

    def without(w: Column, ends: list[str], least: int) -> Column:
        cut = [F.when(w.endswith(e) & (F.length(w) - len(e) >= least), F.substring(w, F.lit(1), F.length(w) - len(e))) for e in ends]
        return F.array_compact(F.array(*cut))

    def stemmed(w: Column) -> Column:
        return without(w, ["", *endings], 5)

    parts = words.select("word", F.explode(F.filter(F.split("word", "-"), lambda p: p != "")).alias("part"), F.col("word").contains("-").alias("joined")).distinct()
    w = F.col("part")
    derived = F.flatten(F.transform(F.flatten(F.transform(without(w, ["", *endings], 1), lambda s: without(s, list(suffixes), 6))), stemmed))
    behind = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(w.startswith(p) & (F.length(w) - len(p) >= 6), F.substring(w, F.lit(len(p) + 1), F.length(w))) for p in prefixes]))
    whole = F.concat(F.array(w), behind)
    stem_forms = F.concat(stemmed(w), derived, F.flatten(F.transform(behind, stemmed)))
    each = parts.select("part").distinct()
    found = each.select("part", F.explode(F.array_distinct(whole)).alias("form")).join(keys, "form", "left_semi").select("part")
    by_stem = each.select("part", F.explode(F.array_distinct(stem_forms)).alias("form")).join(stems, "form", "left_semi").select("part")
    good = found.union(by_stem).distinct().withColumn("good", F.lit(True))
    by_parts = parts.join(good, "part", "left").groupBy("word").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("all"))
    exact = words.select("word").distinct().join(keys.withColumnRenamed("form", "word"), "word", "left_semi")
    return by_parts.filter("all").select("word").union(exact).distinct()


def capped_report(rows: DataFrame, group: str, order: str, line: str, most: int = 15) -> DataFrame:
    """The first ``most`` lines of each group, and one that says how many more there are."""
    by = Window.partitionBy(group).orderBy(order)
    placed = rows.select(group, F.row_number().over(by).cast("long").alias("place"), F.col(line).alias("line"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    more = sizes.select(group, F.lit(most + 1).cast("long").alias("place"), F.concat(F.lit("… "), F.col("n") - most, F.lit(" more")).alias("line"))
    return placed.filter(F.col("place") <= most).unionByName(more)


def rarest(words: DataFrame, unit: str, most: int = 8) -> DataFrame:
    """unit and its ``most`` words (unit, word) that the fewest units have, then by word."""
    spread = words.distinct().groupBy("word").agg(F.count("*").alias("n"))
    listed = words.distinct().join(spread, "word").groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("l"))
    return listed.select(unit, F.array_join(F.slice(F.col("l")["word"], 1, most), " ").alias("rarest"))


def word_report(hits: DataFrame, most: int = 40) -> DataFrame:
    """kind, name and n: units with hits of each file, and the words most often hit; hits: file, unit, word."""
    files = hits.select("file", "unit").distinct().groupBy(F.col("file").alias("name")).agg(F.count("*").alias("n")).select(F.lit("file").alias("kind"), "name", "n")
    words = hits.groupBy(F.col("word").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most).select(F.lit("word").alias("kind"), "name", "n")
    return files.unionByName(words)


def sense_map(decisions: DataFrame) -> DataFrame:
    """key, word and kind: of units with equal keys the last decides; decisions: key, unit, word, kind."""
    return decisions.groupBy("key", "word").agg(F.max_by("kind", "unit").alias("kind"))


def with_senses(terms: DataFrame, senses: DataFrame, default: str = "own") -> DataFrame:
    """terms (key, word, target) with the kind that the map decides, else the default; those decided against lose their target."""
    joined = terms.join(senses.select("key", "word", "kind"), ["key", "word"], "left").withColumn("kind", F.coalesce("kind", F.lit(default)))
    return joined.withColumn("target", F.when(F.col("kind") == "own", F.col("target")))


def attempts(rows: DataFrame, unit: list[str], most: int = 3) -> DataFrame:
    """The attempts that were to be made: up to the first good one, ``most`` at most, the last only if the one before had wrong marks.

    rows: the unit's columns, attempt (from 1), ok and marks_ok.
    """
    w = Window.partitionBy(*unit)
    good = F.min(F.when(F.col("ok") & F.col("marks_ok"), F.col("attempt"))).over(w)
    before = F.lag("marks_ok").over(w.orderBy("attempt"))
    decided = rows.withColumns({"_good": good, "_before": before})
    made = (F.col("attempt") <= most) & (F.col("_good").isNull() | (F.col("attempt") <= F.col("_good"))) & ((F.col("attempt") < most) | ~F.col("_before"))
    return decided.filter(made).drop("_good", "_before")
