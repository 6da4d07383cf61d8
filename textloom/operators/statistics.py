"""Rank statistics, thresholds, modes, and scores of candidate terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranges


def value_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n rows of that value, and rank from 1, equal values sharing their mean; nulls come first.

    Values are counted before they are ordered, and ordered in ranges.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    summed = ranges.running_sums(counts, [group], F.col(value), ["n"], ranges.number_cuts(counts, [group], value))
    return summed.select(group, value, "n", "all_n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Correlation of ranks; null where all values of one side are equal."""
    pairs = rows.groupBy(group, a, b).agg(F.count("*").alias("_n"))
    centred = F.col("rank") - (F.col("all_n") + 1) / 2
    ranked = pairs
    for side, name in ((a, "_ra"), (b, "_rb")):
        ranks = value_ranks(rows, group, side).select(F.col(group).alias("_g"), F.col(side).alias("_v"), centred.alias(name))
        ranked = ranked.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(side).eqNullSafe(F.col("_v"))).drop("_g", "_v")
    n, x, y = F.col("_n"), F.col("_ra"), F.col("_rb")
    sums = ranked.groupBy(group).agg(F.sum(n).alias("n"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    spread = F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return sums.select(group, "n", F.round(F.col("xy") / spread, 6).alias("rho"))


def auc(rows: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """The chance that a positive scores above a negative, ties half, from counts of each score: no pairs."""
    counts = rows.groupBy(group, score).agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    summed = ranges.running_sums(counts, [group], F.col(score), ["n_neg"], ranges.number_cuts(counts, [group], score))
    above = F.sum(F.col("n_pos") * (F.col("before_n_neg") + F.col("n_neg") / 2))
    sums = summed.groupBy(group).agg(above.alias("s"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return sums.select(group, "n_pos", "n_neg", F.round(F.col("s") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)), 6).alias("auc"))


def order_threshold(rows: DataFrame, group: str, score: str, percent: int) -> DataFrame:
    """Each group's score at the exact place floor(n * percent / 100) of the ascending order, counted from 0."""
    counts = rows.groupBy(group, score).agg(F.count("*").alias("n"))
    summed = ranges.running_sums(counts, [group], F.col(score), ["n"], ranges.number_cuts(counts, [group], score))
    place = F.floor(F.col("all_n") * percent / 100)
    return summed.filter((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))).select(group, F.col(score).alias("threshold"), F.col("all_n").alias("n"))


def exact_mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the smallest."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(value)))
    return counts.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def repeated_ngrams(tokens: DataFrame, n: int, least: int = 2) -> DataFrame:
    """n-grams that a book has at least ``least`` times, then summed over books: tokens has book and t, a list."""
    from textloom.functions.text import ngrams

    grams = tokens.select("book", F.explode(ngrams(F.col("t"), n)).alias("gram"))
    per_book = grams.groupBy("book", "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return per_book.groupBy("gram").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("books"))


def unsubsumed(bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Bigrams but those within a trigram that has at least 80 per cent of their count."""
    parts = F.split("gram", " ")
    inside = trigrams.select(F.explode(F.array(F.array_join(F.slice(parts, 1, 2), " "), F.array_join(F.slice(parts, 2, 2), " "))).alias("gram"), F.col("n").alias("t"))
    most = inside.groupBy("gram").agg(F.max("t").alias("t"))
    return bigrams.join(most, "gram", "left").filter(F.col("t").isNull() | (F.col("t") * 10 < F.col("n") * 8)).drop("t")


def keyness(part: DataFrame, whole: DataFrame) -> DataFrame:
    """log10 of a word's frequency in a part over that in the whole, add-one; part and whole have w and n."""
    np, nw = part.agg(F.sum("n").alias("np")), whole.agg(F.sum("n").alias("nw"))
    joined = part.withColumnRenamed("n", "a").join(whole.withColumnRenamed("n", "b"), "w").crossJoin(F.broadcast(np)).crossJoin(F.broadcast(nw))  # one row each
    return joined.select("w", "a", "b", F.round(F.log10((F.col("a") + 1) / F.col("np")) - F.log10((F.col("b") + 1) / F.col("nw")), 6).alias("keyness"))
