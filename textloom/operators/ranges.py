"""Running sums of large groups: a group is cut into ranges of its order, so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group, about: cuts of a group are one row with so many values.
PARTS = 256


def equal_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys, null ones too, and keeps them once."""
    other = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(other, same, how).drop(*[f"_on_{k}" for k in keys])


def number_cuts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and _cuts: about evenly spaced quantiles of a number, in one pass with a sketch of fixed size for each group."""
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    return rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 4 * PARTS)).alias("_cuts"))


def sampled_cuts(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """keys and _cuts: values of any type of order, chosen by hash at a rate that leaves each group about ``PARTS`` of them."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    marked = equal_keys(rows.select(*keys, order.alias("_order")), sizes, keys)
    chosen = marked.filter(F.pmod(F.xxhash64("_order"), F.floor(F.col("_size") / PARTS) + 1) == 0)
    return chosen.groupBy(*keys).agg(F.array_sort(F.collect_set("_order")).alias("_cuts"))


def running_sums(rows: DataFrame, keys: list[str], order: Column, amounts: list[str], cuts: DataFrame) -> DataFrame:
    """rows with before_x, the sum of x over the rows before, and all_x, over the group, for each amount x; nulls come first.

    Where the cuts lie changes the work of tasks, not the result; rows of equal
    order come in any order, so give each its own, or sum over them beforehand.
    """
    placed = equal_keys(rows, cuts, keys, "left").withColumn("_part", F.coalesce(F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < order))), F.lit(0))).drop("_cuts")
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    # At most some hundred parts a group.
    group, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_start_{a}") for a in amounts], *[F.coalesce(F.sum(f"_sum_{a}").over(group), F.lit(0)).alias(f"all_{a}") for a in amounts])
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = equal_keys(placed, offsets, [*keys, "_part"])
    added = {f"before_{a}": F.col(f"_start_{a}") + F.coalesce(F.sum(a).over(within), F.lit(0)) for a in amounts}
    return joined.withColumns(added).drop("_part", *[f"_start_{a}" for a in amounts])
