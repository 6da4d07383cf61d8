"""Glyphs of laid-out pages: their classes, boxes, sizes and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import font_family
from textloom.operators.statistics import exact_mode

#: Names of fonts of one width.
MONO = "(?i)(Courier|Mono|Consol|Menlo|Inconsolata|Code|Fira|Letter ?Gothic|Lucida ?Console|Andale|Monaco|Typewriter)"


def glyph_class(font: str, size: str, line_size: Column, text: str) -> Column:
    """code, sup (a digit or note mark below three quarters of the line's size), strong, em, strongem or p."""
    family = font_family(F.col(font))
    bold, italic = family.rlike("(?i)Bold|Demi|Black|Heavy|Semibold"), family.rlike("(?i)Ital|Oblique")
    raised = (F.col(size) < 0.75 * line_size) & F.col(text).rlike(r"^[0-9*†‡]")
    return F.when(family.rlike(MONO), "code").when(raised, "sup").when(bold & italic, "strongem").when(bold, "strong").when(italic, "em").otherwise("p")


def upright(low: str, high: str, origin: str, height: Column) -> tuple[Column, Column]:
    """top and bottom of boxes as distances from the page's upper edge, whichever corner they are measured from."""
    below = F.col(origin) == "BOTTOMLEFT"
    return F.when(below, height - F.col(high)).otherwise(F.col(low)).alias("top"), F.when(below, height - F.col(low)).otherwise(F.col(high)).alias("bottom")


def large_type(glyphs: DataFrame, block: str, size: str, body: float, most: int = 80) -> DataFrame:
    """Blocks of at most ``most`` glyphs whose most frequent size is half again as large as the body's."""
    counts = glyphs.groupBy(block).agg(F.count("*").alias("all")).filter(F.col("all") <= most)
    return exact_mode(glyphs, block, size).join(counts, block).filter(F.col(size) >= 1.5 * body).select(block, F.col(size).alias("dominant"))


def conserved(glyphs: DataFrame, placed: DataFrame, book: str) -> DataFrame:
    """Of each book the glyphs of code in all, those that have a place (id), and those lost; glyphs: book, id, code."""
    seen = placed.select("id").distinct().withColumn("seen", F.lit(True))
    joined = glyphs.join(seen, "id", "left")
    return joined.groupBy(book).agg(F.count_if("code").alias("total"), F.count_if(F.col("code") & F.col("seen").isNotNull()).alias("placed"), F.count_if(F.col("code") & F.col("seen").isNull()).alias("lost"))


def hyphens_kept(breaks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """breaks (a, b: what stands before and after a hyphen at a line's end) with keep, by the more frequent spelling.

    vocabulary: word, n.  Where both are as frequent, a hyphen inside ``a`` decides.
    """
    joined = vocabulary.select(F.col("word").alias("_j"), F.col("n").alias("_jn"))
    split = vocabulary.select(F.col("word").alias("_h"), F.col("n").alias("_hn"))
    both = breaks.join(joined, F.concat("a", "b") == F.col("_j"), "left").join(split, F.concat("a", F.lit("-"), "b") == F.col("_h"), "left")
    one, other = F.coalesce("_jn", F.lit(0)), F.coalesce("_hn", F.lit(0))
    return both.withColumn("keep", (other > one) | ((other == one) & F.col("a").contains("-"))).drop("_j", "_jn", "_h", "_hn")


def runs_of_pages(pages: DataFrame, book: str, page: str, source: str) -> DataFrame:
    """book, source, first and last: stretches of pages taken from one source, as a file is put together."""
    from pyspark.sql import Window

    w = Window.partitionBy(book).orderBy(page)
    new = F.coalesce((F.lag(source).over(w) != F.col(source)) | (F.lag(page).over(w) + 1 != F.col(page)), F.lit(True))
    numbered = pages.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(book, "_run", source).agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_run")
