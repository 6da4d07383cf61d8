"""Multisets of tokens, and the scores that come of comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the numbers lost (more on the left) and extra (more on the right)."""
    a, b = left.withColumnRenamed("n", "a"), right.withColumnRenamed("n", "b")
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.select(*keys, F.greatest(F.col("a") - F.col("b"), F.lit(0)).cast("long").alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).cast("long").alias("extra")).filter("lost > 0 or extra > 0")


def overlap(left: DataFrame, right: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per group the clipped number of common items."""
    a, b = left.withColumnRenamed("n", "a"), right.withColumnRenamed("n", "b")
    return a.join(b, keys).groupBy(*group).agg(F.sum(F.least("a", "b")).cast("long").alias("common"))


def chrf(pairs: DataFrame, group: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF by group and over all (group null), from summed n-gram statistics.

    pairs: id, group, hyp, ref.  Averages precision and recall over the orders
    for which both sides have n-grams.
    """
    from textloom.functions.text import char_ngrams

    def grams(column: str, name: str) -> DataFrame:
        lists = F.array(*[F.struct(F.lit(n).alias("order"), char_ngrams(F.col(column), n).alias("g")) for n in range(1, orders + 1)])
        each = pairs.select("id", group, F.explode(lists).alias("s")).select("id", group, "s.order", F.explode("s.g").alias("gram"))
        return each.groupBy("id", group, "order", "gram").agg(F.count("*").alias(name))

    both = grams("hyp", "h").join(grams("ref", "r"), ["id", group, "order", "gram"], "full_outer")
    sums = both.groupBy(group, "order").agg(F.sum(F.least(F.coalesce("h", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("m"), F.sum(F.coalesce("h", F.lit(0))).alias("h"), F.sum(F.coalesce("r", F.lit(0))).alias("r"))
    every = sums.rollup("order", group).agg(F.sum("m").alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r"), F.grouping(group).alias("all")).filter(F.col("order").isNotNull())
    used = every.filter("h > 0 and r > 0").groupBy(group, "all").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b = beta * beta
    score = F.when(F.col("p") + F.col("q") > 0, 100 * (1 + b) * F.col("p") * F.col("q") / (b * F.col("p") + F.col("q"))).otherwise(0.0)
    return used.select(group, F.round(score, 4).alias("chrf"))
