"""Blocks of laid-out pages: listings, callouts, lists and pictures, from tables of lines and glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.runs import first_state


def returned_to_prose(glyphs: DataFrame, lines: DataFrame) -> DataFrame:
    """glyphs (page, id, x, y: centres) with ref, that of the first line of prose they stand on; those on none are left out.

    lines: page, ord, top, bottom, x0, x1, ref.
    """
    on = F.col("y").between(F.col("top") - 0.5, F.col("bottom") + 0.5) & F.col("x").between(F.col("x0") - 2, F.col("x1") + 2)
    return glyphs.join(lines, "page").filter(on).groupBy("page", "id").agg(F.min_by("ref", "ord").alias("ref"))


def line_boxes(glyphs: DataFrame, page: str) -> DataFrame:
    """page, line (from 0) and id: glyphs put into lines by overlap of heights, from top to bottom.

    glyphs: page, id, x0, top, bottom, blank.  A glyph joins the latest of the
    last three lines whose box, half a point wider, holds its middle; letters
    let the box grow, blanks don't.  One page is one group.
    """
    given = F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("id").cast("string").alias("id"), F.col("bottom").cast("double").alias("bottom"), "blank")))
    state = "struct<lines:array<struct<top:double,bottom:double>>,of:array<struct<id:string,line:int>>>"
    nothing = F.from_json(F.lit('{"lines":[],"of":[]}'), state)

    def step(s: Column, g: Column) -> Column:
        n, middle = F.size(s["lines"]), (g["top"] + g["bottom"]) / 2
        at = F.lit(None).cast("int")
        for back in (3, 2, 1):
            line = F.try_element_at(s["lines"], F.lit(-back))
            at = F.when(middle.between(line["top"] - 0.5, line["bottom"] + 0.5), n - back).otherwise(at)
        own = F.struct(g["top"].alias("top"), g["bottom"].alias("bottom"))
        grown = F.transform(s["lines"], lambda l, i: F.when((i == at) & ~g["blank"], F.struct(F.least(l["top"], g["top"]).alias("top"), F.greatest(l["bottom"], g["bottom"]).alias("bottom"))).otherwise(l))
        lines = F.when(at.isNull(), F.concat(s["lines"], F.array(own))).otherwise(grown)
        return F.struct(lines.alias("lines"), F.concat(s["of"], F.array(F.struct(g["id"].alias("id"), F.coalesce(at, n).alias("line")))).alias("of")).cast(state)

    placed = glyphs.groupBy(page).agg(given.alias("g")).select(page, F.explode(F.aggregate("g", nothing, step)["of"]).alias("o"))
    return placed.select(page, F.col("o.line").cast("long").alias("line"), F.col("o.id").alias("id"))


def callout_groups(lines: DataFrame, page: str) -> DataFrame:
    """page, id and group (from 1): lines of notes beside a listing that belong together.

    lines: page, id, x0, top, bottom.  A line goes on with the group before if it
    begins less than 0.8 heights below it and within 25 of the group's first left edge.
    """
    given = F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("id").cast("long").alias("id"), F.col("bottom").cast("double").alias("bottom"))))
    state = "struct<no:bigint,edge:double,top:double,bottom:double,of:array<struct<id:bigint,no:bigint>>>"

    def step(s: Column, g: Column) -> Column:
        same = (s["no"] > 0) & (g["top"] - s["bottom"] < 0.8 * (s["bottom"] - s["top"])) & (F.abs(g["x0"] - s["edge"]) < 25)
        no = F.when(same, s["no"]).otherwise(s["no"] + 1)
        return F.struct(no.alias("no"), F.when(same, s["edge"]).otherwise(g["x0"]).alias("edge"), g["top"].alias("top"), g["bottom"].alias("bottom"), F.concat(s["of"], F.array(F.struct(g["id"].alias("id"), no.alias("no")))).alias("of")).cast(state)

    none = F.from_json(F.lit('{"no":0,"edge":0,"top":0,"bottom":0,"of":[]}'), state)
    placed = lines.groupBy(page).agg(given.alias("g")).select(page, F.explode(F.aggregate("g", none, step)["of"]).alias("o"))
    return placed.select(page, F.col("o.id").alias("id"), F.col("o.no").alias("group"))


def numbered_callouts(callouts: DataFrame, listing: str, line: str, order: str) -> DataFrame:
    """callouts with no, from 1 in the order of the lines they point to."""
    return callouts.withColumn("no", F.row_number().over(Window.partitionBy(listing).orderBy(line, order)).cast("long"))


def code_lines_in_prose(glyphs: DataFrame, block: str, line: str) -> DataFrame:
    """Lines of three visible glyphs or more that are all code; glyphs: block, line, text, code."""
    visible = glyphs.filter(F.trim("text") != "")
    return visible.groupBy(block, line).agg(F.count("*").alias("n"), F.bool_and("code").alias("all_code")).filter("n >= 3 and all_code").drop("all_code")


def group_texts(glyphs: DataFrame, group: str) -> DataFrame:
    """group, text and pages: the texts of a group's glyphs in order (page, ord) and its pages."""
    listed = F.array_sort(F.collect_list(F.struct("page", "ord", "text")))
    return glyphs.groupBy(group).agg(F.array_join(listed["text"], "").alias("text"), F.array_join(F.array_sort(F.collect_set("page")), " ").alias("pages"))


def list_items(children: DataFrame, of: str) -> DataFrame:
    """of, item (from 1), text and ordered: children (ord, text, nested, enumerated) as items of their list.

    A nested group goes to the item before it, or makes the first one; a list is
    ordered if any child is enumerated.
    """
    by = Window.partitionBy(of).orderBy("ord")
    own = ((~F.col("nested")) | (F.row_number().over(by) == 1)).cast("long")
    marked = children.withColumns({"own": own, "ordered": F.bool_or("enumerated").over(Window.partitionBy(of))})
    numbered = marked.withColumn("item", F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(of, "item").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n").alias("text"), F.first("ordered").alias("ordered"))


def repaired_lists(items: DataFrame, of: str) -> DataFrame:
    """of, tag, item, sub and text: items (pos from 1, text) whose bullets were set as text.

    Raised numbers 1, 2, 3 … of all items make an ordered list; bullets go; an
    item with a dash is a sub-item of the one before it, unless it is the first.
    """
    number = F.regexp_extract("text", r"^<sup>(\d+)</sup>\s*", 1)
    whole, by = Window.partitionBy(of), Window.partitionBy(of).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.regexp_replace("text", r"^[■●•▪]\s*", "")
    marked = items.withColumns({"ordered": F.bool_and(number == F.col("pos").cast("string")).over(whole), "plain": plain})
    marked = marked.withColumn("dash", ~F.col("ordered") & (F.col("pos") > 1) & F.col("plain").rlike(r"^[–—-]\s+"))
    numbered = marked.withColumn("item", F.sum((~F.col("dash")).cast("long")).over(by))
    sub = F.row_number().over(Window.partitionBy(of, "item").orderBy("pos")).cast("long") - 1
    text = F.when(F.col("ordered"), F.regexp_replace("text", r"^<sup>\d+</sup>\s*", "")).when(F.col("dash"), F.regexp_replace("plain", r"^[–—-]\s+", "")).otherwise(F.col("plain"))
    return numbered.select(of, F.when(F.col("ordered"), "ol").otherwise("ul").alias("tag"), "item", sub.alias("sub"), text.alias("text"))


def split_by_prose(lines: DataFrame, listing: str) -> DataFrame:
    """lines (ord, x0, code, callout) with prose and segment: lines of prose between lines of code part a listing.

    They are no callouts and begin less than 20 right of the leftmost code; segment counts those above.
    """
    whole, by = Window.partitionBy(listing), Window.partitionBy(listing).orderBy("ord")
    left = F.min(F.when(F.col("code"), F.col("x0"))).over(whole)
    first, last = (f(F.when(F.col("code"), F.col("ord"))).over(whole) for f in (F.min, F.max))
    prose = ~F.col("code") & ~F.col("callout") & (F.col("x0") < left + 20) & (F.col("ord") > first) & (F.col("ord") < last)
    marked = lines.withColumn("prose", F.coalesce(prose, F.lit(False)))
    return marked.withColumn("segment", F.coalesce(F.sum(F.col("prose").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def fragments(lines: DataFrame, back: int = 8) -> DataFrame:
    """page, block, other, shares and touches: fragments of code and the earlier blocks of their page, ``back`` of them at most.

    lines: page, block (in reading order), top, bottom.  shares: each line of the
    fragment has its middle on a line of the other; touches: any has, or they are
    at most 1.6 median heights apart and overlap by half a height at most.
    """
    boxes = F.array_sort(F.collect_list(F.struct("top", "bottom")))
    blocks = lines.groupBy("page", "block").agg(boxes.alias("b"))
    other = blocks.select("page", F.col("block").alias("other"), F.col("b").alias("a"))
    pairs = blocks.join(other, "page").filter((F.col("other") < F.col("block")) & (F.col("other") >= F.col("block") - back))
    on = lambda y: F.exists("a", lambda x: ((y["top"] + y["bottom"]) / 2).between(x["top"] - 1, x["bottom"] + 1))
    heights = F.array_sort(F.transform(F.concat("a", "b"), lambda x: x["bottom"] - x["top"]))
    n = F.size(heights)
    median = (F.element_at(heights, ((n + 1) / 2).cast("int")) + F.element_at(heights, (n / 2 + 1).cast("int"))) / 2
    h = F.when(median == 0, 8.0).otherwise(median)
    below = F.col("b")[0]["top"] - F.array_max(F.col("a")["bottom"])
    above = F.array_min(F.col("a")["top"]) - F.array_max(F.col("b")["bottom"])
    near = ((below > -0.5 * h) & (below < 1.6 * h)) | ((above > -0.5 * h) & (above < 1.6 * h))
    return pairs.select("page", "block", "other", F.forall("b", on).alias("shares"), (F.exists("b", on) | near).alias("touches"))


def code_outcome(has_code: Column, bullet_led: Column, parted: Column, goes_on: Column, touches: Column, shares: Column, n_lines: Column) -> Column:
    """What becomes of a block that was taken for code: the first rule that fits."""
    rules = [(bullet_led, "list"), (parted, "parted"), (~has_code, "paragraph"), (goes_on, "continued"), (touches, "merged"), (shares & (n_lines <= 3), "returned")]
    return first_state(*rules, otherwise="listing")


def pictures(glyphs: DataFrame, boxes: DataFrame, picture: str, body: float) -> DataFrame:
    """picture, kind and bottom: code of a picture's box is a listing, few large letters are a heading, else it is a figure, cut above its caption.

    glyphs: picture, text, code, size, top, bottom, caption (part of it);
    boxes: picture, box_top, box_bottom.  A caption cuts only where nothing else reaches below its top by more than a point.
    """
    seen = F.trim("text") != ""
    drawn, inner = seen & ~F.col("caption"), seen & F.col("caption")
    sums = glyphs.groupBy(picture).agg(
        F.count_if(seen).alias("n"), F.count_if(seen & F.col("code")).alias("n_code"), F.count_if(inner).alias("n_caption"), F.min(F.when(seen, F.col("size"))).alias("least"),
        F.min(F.when(inner, F.col("top"))).alias("caption_top"), F.max(F.when(drawn, F.col("bottom"))).alias("rest"),
    )
    joined = boxes.join(sums, picture, "left")
    bare = F.coalesce(F.col("n_caption"), F.lit(0)) == 0
    listing = bare & (F.col("n_code") >= 40) & (F.col("n_code") >= 0.6 * F.col("n"))
    heading = bare & F.col("n").between(1, 80) & (F.col("least") >= 1.8 * body)
    cut = (F.col("caption_top") > F.col("box_top")) & (F.col("caption_top") < F.col("box_bottom")) & (F.col("caption_top") >= F.coalesce("rest", "box_top") - 1)
    kind = F.when(listing, "listing").when(heading, "heading").otherwise("figure")
    return joined.select(picture, kind.alias("kind"), F.when((kind == "figure") & cut, F.col("caption_top") - 2).otherwise(F.col("box_bottom")).alias("bottom"))
