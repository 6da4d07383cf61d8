"""Glyphs, boxes, lines and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_points(points: DataFrame, boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Each point's smallest box that holds it, of equally small ones the first by ref; points in none are left out.

    points: page, id, x, y; boxes: page, ref, x0, y0, x1, y1.  The join is by page.
    """
    inside = F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("y0") - tolerance, F.col("y1") + tolerance)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    held = points.join(boxes, "page").filter(inside).withColumn("area", area)
    return held.groupBy("page", "id").agg(F.min_by("ref", F.struct("area", "ref")).alias("ref"))


def nearest_line(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Each mark's nearest line on its page, of equally near ones the first.  marks: page, id, y; lines: page, line, ly."""
    joined = marks.join(lines, "page")
    return joined.groupBy("page", "id").agg(F.min_by("line", F.struct(F.abs(F.col("y") - F.col("ly")), "line")).alias("line"))


def cluster_lines(words: DataFrame, reach: float = 2.5) -> DataFrame:
    """Numbers the visual lines of each page: a word starts a line if its top is more than ``reach`` from the line's first word.

    The anchor is the line's first word, so that no fixed window can tell it.
    Words are sorted by page and top and folded as they stream by in Arrow
    batches, of which a page may fill many; a task calls Python once, not once a
    page.  Words without a top are of their page's last line.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor, line = object(), None, 0
        for batch in batches:
            out = []
            for page, top in zip(batch["page"].to_pylist(), batch["top"].to_pylist(), strict=True):
                if page != now:
                    now, anchor, line = page, top, 0
                elif top is not None and top - anchor > reach:
                    anchor, line = top, line + 1
                out.append(line)
            yield pa.RecordBatch.from_arrays([batch["page"], batch["id"], pa.array(out, pa.int64())], ["page", "id", "line"])

    placed = words.select(*[F.col(c).cast("long").alias(c) for c in ("page", "id")], F.col("top").cast("double").alias("top"))
    # Words of equal top are of one line, in whatever order they come.
    ordered = placed.repartition("page").sortWithinPartitions("page", F.asc_nulls_last("top"))
    return ordered.mapInArrow(fold, "page long, id long, line long")


def gap_blocks(keys: list[str], order: str, value: Column, gap: float) -> Column:
    """The number of gaps wider than ``gap`` so far: equal for rows of one block."""
    by = Window.partitionBy(*keys).orderBy(order)
    wide = (value - F.lag(value).over(by)) > gap
    return F.sum(F.coalesce(wide, F.lit(False)).cast("long")).over(by)


def offsets(sizes: DataFrame, group: str, order: str, size: str) -> Column:
    """What comes before a chunk: the exclusive running sum of sizes."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def fill_numbers(pages: DataFrame, offset: DataFrame, group: str) -> DataFrame:
    """Printed page numbers, where they are missing by the group's offset."""
    return pages.join(offset, group, "left").withColumn("printed", F.coalesce("printed", F.col("page") - F.col("offset")))


def connected(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, for edges of (a, b).

    Large and small stars in turn until nothing changes; each turn is
    checkpointed in the shared folder, so lineage stays short.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == tuple(state):
            nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            return nodes.join(now, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("root"))
        before = tuple(state)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        now = large.join(lower, F.col("u") == F.col("of")).select("v", "m").filter("v <> m").union(lower).toDF("u", "v").distinct().checkpoint()
