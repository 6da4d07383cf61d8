"""Evidence from a unit's surroundings, and votes on what an ambiguous word means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranges


def neighbour_sums(units: DataFrame, book: str, order: str, value: str, reach: int = 2) -> Column:
    """The sum of a value over a unit and ``reach`` units on either side of it, across sections."""
    return F.sum(value).over(Window.partitionBy(book).orderBy(order).rowsBetween(-reach, reach))


def section_number(book: str, order: str, is_head: Column) -> Column:
    """How many headings have come so far."""
    return F.sum(is_head.cast("long")).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


#: Rows of a book that one task takes at a time for sums over neighbours.
STRETCH = 10_000


def with_sections(units: DataFrame, book: str, order: str, is_head: Column) -> DataFrame:
    """units with pos, the place in the book from 0, and sec, how many headings have come so far, itself among them.

    A book is worked on in ranges of its order (numbers, different within a book), so one of any length is no task of its own.
    """
    marked = units.withColumns({"_one": F.lit(1), "_head": F.coalesce(is_head.cast("long"), F.lit(0))})
    summed = ranges.running_sums(marked, [book], F.col(order), ["_one", "_head"], ranges.number_cuts(units, [book], order))
    return summed.withColumns({"pos": F.col("before__one").cast("long"), "sec": (F.col("before__head") + F.col("_head")).cast("long")}).drop("_one", "_head", "before__one", "before__head", "all__one", "all__head")


def near_sums(units: DataFrame, book: str, values: list[str], reach: int = 2) -> DataFrame:
    """units (pos: places of a book without gaps) with near sums of values, ``reach`` units to either side.

    Stretches of a book are summed apart; units at their ends are lent to the stretch beside them.
    """
    at = F.floor(F.col("pos") / STRETCH)
    reached = F.array_distinct(F.array(at, F.floor((F.col("pos") - reach) / STRETCH), F.floor((F.col("pos") + reach) / STRETCH)))
    lent = units.withColumn("_own", at).withColumn("_at", F.explode(reached))
    near = Window.partitionBy(book, "_at").orderBy("pos").rowsBetween(-reach, reach)
    return lent.withColumns({f"{v}_near": F.sum(v).over(near) for v in values}).filter("_at = _own").drop("_own", "_at")


def context_counts(units: DataFrame) -> DataFrame:
    """Adds near, section and chapter counts of ``own`` and ``alt`` to units of (book, ch, sec, unit_no, pos, own, alt).

    Sections and chapters are summed before they are joined, so that a large one isn't a task of its own.
    """
    made = near_sums(units, "book", ["own", "alt"])
    for name in ("sec", "ch"):
        sums = units.groupBy("book", name).agg(*[F.sum(kind).alias(f"{kind}_{name}") for kind in ("own", "alt")])
        made = ranges.equal_keys(made, sums, ["book", name])
    return made


def ladder(levels: list[tuple[Column, Column]]) -> Column:
    """The first level with enough evidence decides for own or alt: two hits at least, and twice the other."""
    decided = []
    for own, alt in levels:
        decided.append(F.when(own + alt >= 2, F.when(own >= 2 * alt, F.lit("own")).when(alt >= 2 * F.greatest(own, F.lit(1)), F.lit("alt"))))
    return F.coalesce(*decided)


def votes(sentences: DataFrame) -> DataFrame:
    """One decision for each (unit, word) from its sentences' votes.

    sentences: unit, word, pos, own_cue, alt_cue, verb (booleans), fallback (the
    ladder's or the default's choice).  A verb vetoes; one cue alone decides;
    else the fallback; kinds that differ, and a verb beside another kind, give none.
    """
    vote = F.when(F.col("verb"), F.lit("none")).when(F.col("alt_cue") & ~F.col("own_cue"), F.lit("alt")).when(F.col("own_cue") & ~F.col("alt_cue"), F.lit("own")).otherwise(F.coalesce("fallback", F.lit("none")))
    voted = sentences.withColumn("vote", vote)
    grouped = voted.groupBy("unit", "word").agg(F.array_sort(F.collect_set(F.when(F.col("vote") != "none", F.col("vote")))).alias("kinds"), F.bool_or("verb").alias("verb"), F.count("*").alias("n_votes"))
    kind = F.when((F.size("kinds") != 1) | F.col("verb"), F.lit("none")).otherwise(F.try_element_at("kinds", F.lit(1)))
    return grouped.select("unit", "word", kind.alias("kind"), "n_votes")


def next_body(rows: DataFrame, partition: str, order: str, is_head: Column, text: str, reach: int = 3) -> Column:
    """The first text that isn't a heading among the next ``reach`` rows."""
    after = Window.partitionBy(partition).orderBy(order).rowsBetween(1, reach)
    return F.first(F.when(~is_head, F.col(text)), ignorenulls=True).over(after)
