"""Reading order: glyph runs, blocks, chapters, tables, fonts and trees of layout nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spaced_text(glyphs: DataFrame, line: str, x0: str, x1: str, size: str, text: str) -> DataFrame:
    """The text of each line, with a space where the gap to the glyph before is over 0.15 of the size."""
    by = Window.partitionBy(line).orderBy(x0, x1, text)
    gap = F.col(x0) - F.lag(x1).over(by)
    piece = F.concat(F.when(gap > 0.15 * F.col(size), F.lit(" ")).otherwise(F.lit("")), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_n"), F.col("_p"))))
    return glyphs.select(line, piece.alias("_p"), F.row_number().over(by).alias("_n")).groupBy(line).agg(F.array_join(F.transform(ordered, lambda s: s["_p"]), "").alias("text"))


def style_runs(glyphs: DataFrame, group: str, order: str, style: str) -> DataFrame:
    """Runs of equal style in order: group, run, style, n."""
    by = Window.partitionBy(group).orderBy(order)
    change = ~F.col(style).eqNullSafe(F.lag(style).over(by))
    marked = glyphs.select(group, style, F.sum(change.cast("long")).over(by).alias("run"))
    return marked.groupBy(group, "run", style).agg(F.count("*").alias("n"))


def chapters(blocks: DataFrame, book: str, order: str, is_title: Column) -> Column:
    """The running number of chapters; titles that follow one another are of one chapter."""
    by = Window.partitionBy(book).orderBy(order)
    return F.sum((is_title & ~F.coalesce(F.lag(is_title).over(by), F.lit(False))).cast("long")).over(by)


def title_first(blocks: DataFrame, page: str, order: str, is_title: Column) -> Column:
    """Places within a page with its titles before the rest."""
    return F.row_number().over(Window.partitionBy(page).orderBy(F.desc(is_title.cast("int")), order)).cast("long")


def next_number(rows: DataFrame, part: str, order: str, number: Column) -> Column:
    """The first number at or behind a row, within its part."""
    return F.first(number, ignorenulls=True).over(Window.partitionBy(part).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def continued(rows: DataFrame, group: str, order: str, open_end: Column, lower_start: Column) -> Column:
    """The number of the paragraph that a row belongs to: a lower-case start behind an open end goes on."""
    by = Window.partitionBy(group).orderBy(order)
    goes_on = F.coalesce(F.lag(open_end).over(by), F.lit(False)) & lower_start
    return F.sum((~goes_on).cast("long")).over(by)


def dense_grid(cells: DataFrame, table: str, rows: str, columns: str) -> DataFrame:
    """Every (row, column) of each table that no cell begins at; cells: table, row, col; the grid goes to the greatest of each."""
    size = cells.groupBy(table).agg(F.max(rows).alias("_r"), F.max(columns).alias("_c"))
    grid = size.select(table, F.explode(F.sequence(F.lit(0).cast("long"), "_r")).alias(rows), "_c").select(table, rows, F.explode(F.sequence(F.lit(0).cast("long"), "_c")).alias(columns))
    return grid.join(cells.select(table, rows, columns), [table, rows, columns], "left_anti")


def font_profile(glyphs: DataFrame, font: str, width: str) -> DataFrame:
    """Each font's glyphs, modal width and the share of glyphs within 0.02 of it."""
    counts = glyphs.groupBy(font, F.round(width, 2).alias("w")).agg(F.count("*").alias("n"))
    modal = counts.groupBy(font).agg(F.max_by("w", F.struct("n", -F.col("w"))).alias("modal"), F.sum("n").alias("n"))
    near = counts.join(modal.select(font, "modal"), font).groupBy(font).agg(F.sum(F.when(F.abs(F.col("w") - F.col("modal")) <= 0.0201, F.col("n")).otherwise(0)).alias("near"))
    return modal.join(near, font).select(font, "n", "modal", F.round(F.col("near") / F.col("n"), 6).alias("share"))


def overlapping(a: DataFrame, b: DataFrame, page: str, how: str) -> DataFrame:
    """Boxes of ``a`` that meet one of ``b`` on their page (left_semi), or none (left_anti)."""
    other = b.select(F.col(page).alias("_p"), *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col(page) == F.col("_p")) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1"))
    return a.join(other, meets, how)


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor and distance for every node; depth by depth, so a level costs one join.

    Where parents form a cycle a node's ancestors end before the first that
    repeats.  The folder of ``spark.checkpoint.dir`` must be set.
    """
    edges = nodes.filter(F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_a"))
    level = edges.select(F.col("_n").alias(node), F.col("_a").alias("ancestor"), F.lit(1).cast("long").alias("distance")).filter(F.col(node) != F.col("ancestor"))
    found = level
    while True:
        further = level.join(edges, F.col("ancestor") == F.col("_n")).select(F.col(node), F.col("_a").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        level = further.filter(F.col(node) != F.col("ancestor")).join(found.select(node, "ancestor"), [node, "ancestor"], "left_anti").dropDuplicates([node, "ancestor"]).checkpoint()
        if level.isEmpty():
            return found
        found = found.union(level)


def skipped_sections(rows: DataFrame, book: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """Rows outside sections that a start opens and the next end closes."""
    event = F.when(starts, F.lit("skip")).when(ends, F.lit("keep"))
    state = F.last(event, ignorenulls=True).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_state", state).filter(F.coalesce(F.col("_state") != "skip", F.lit(True))).drop("_state")


def contents_like(lines: DataFrame, page: str, text: str) -> DataFrame:
    """Pages of five lines or more of which half end in digits."""
    return lines.groupBy(page).agg(F.count("*").alias("n"), F.count_if(F.col(text).rlike(r"[0-9]+\s*$")).alias("numbered")).filter((F.col("n") >= 5) & (F.col("numbered") * 2 >= F.col("n")))
