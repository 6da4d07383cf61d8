"""Choosing rows: first, best, within a budget, by sample or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranges


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def top_of(rows: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", rank.cast("long")).filter(F.col("place") <= most)


def greedy_budget(rows: DataFrame, size: str, share: float, *priority: Column | str, group: str | None = None) -> DataFrame:
    """Rows in priority order while the sizes before them stay below a share of the total; the one that crosses counts.

    priority: values that are taken in ascending order, nulls first, together
    different for each row.  With ``group`` each group has its own budget.
    """
    key = group or "_all"
    marked = rows if group else rows.withColumn(key, F.lit(0))
    order = F.struct(*[(F.col(p) if isinstance(p, str) else p).alias(f"_{i}") for i, p in enumerate(priority)])
    summed = ranges.running_sums(marked, [key], order, [size], ranges.sampled_cuts(marked, [key], order))
    kept = summed.filter(F.col(f"before_{size}") * 100 < F.greatest(f"all_{size}", F.lit(1)) * share)
    return kept.select(*rows.columns)


def best_attempt(attempts: DataFrame, item: str, attempt: str, *flags: str) -> DataFrame:
    """Of each item's attempts the one with the best flags, the earliest of equals."""
    return first_of(attempts, [item], *[F.desc(f) for f in flags], F.asc(attempt))


def replayed(rows: DataFrame, done: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """Rows that are done and not picked are reused, picked ones redone, the others are new."""
    marked = rows.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").join(picked.select(key).distinct().withColumn("_picked", F.lit(True)), key, "left")
    return marked.withColumn("action", F.when(F.col("_picked"), "redo").when(F.col("_done"), "reuse").otherwise("new")).drop("_done", "_picked")


def stride_sample(rows: DataFrame, partition: str, order: str, step: int) -> DataFrame:
    """Every step-th row of each partition."""
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    return rows.withColumn("_rn", rank).filter((F.col("_rn") - 1) % step == 0).drop("_rn")


def jargon(words: DataFrame, unit: str, word: str, least: int = 4) -> DataFrame:
    """Words that are suspect in at least ``least`` distinct units, with their number."""
    return words.groupBy(word).agg(F.count_distinct(unit).alias("n_units")).filter(F.col("n_units") >= least)


def page(rows: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def islands(rows: DataFrame, keys: list[str], value: Column) -> Column:
    """The same number for rows of consecutive whole values."""
    return value - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
