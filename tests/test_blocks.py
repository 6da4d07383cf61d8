"""Markup, blocks of pages, terms and models: small cases and brute force."""

import json
import random

from pyspark.sql import functions as F

from textloom.functions import markup, models
from textloom.operators import listings, terms
from textloom.sources import files, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def lines_by_hand(glyphs):
    lines, of = [], {}
    for top, _, key, bottom, blank in sorted(glyphs):
        middle, at = (top + bottom) / 2, None
        for k in range(len(lines) - 1, max(-1, len(lines) - 4), -1):
            if lines[k][0] - 0.5 <= middle <= lines[k][1] + 0.5:
                at = k
                break
        if at is None:
            lines.append([top, bottom])
            at = len(lines) - 1
        elif not blank:
            lines[at] = [min(lines[at][0], top), max(lines[at][1], bottom)]
        of[key] = at
    return of


def test_lines_by_overlap_equal_a_fold_by_hand(spark):
    rng = random.Random(3)
    pages = {p: [(float(rng.randrange(60)), float(rng.randrange(90)), f"{p}-{k}", 0.0, rng.random() < 0.2) for k in range(n)] for p, n in ((1, 60), (2, 1), (3, 25))}
    pages = {p: [(t, x, k, t + rng.randrange(1, 9), b) for t, x, k, _, b in g] for p, g in pages.items()}
    rows = [(p, *g) for p, glyphs in pages.items() for g in glyphs]
    df = spark.createDataFrame(rows, "page long, top double, x0 double, id string, bottom double, blank boolean")
    got = {(r.page, r.id): r.line for r in listings.line_boxes(df, "page").collect()}
    assert got == {(p, key): at for p, glyphs in pages.items() for key, at in lines_by_hand(glyphs).items()}
    assert listings.line_boxes(df.limit(0), "page").count() == 0


def test_repaired_marks(spark):
    fixed = markup.repaired_marks(F.col("a"), F.col("b"))
    assert one(spark, fixed, a="⟦code1⟧ x ⟦var2⟧", b="⟦код1⟧ y ⟦2» z ⟦foo 7] ⟦имя8⟧ ⟦9⟧") == "⟦code1⟧ y ⟦var2⟧» z ⟦foo7⟧ ⟦имя8⟧ ⟦code9⟧"
    assert one(spark, fixed, a="", b="no marks") == "no marks"


def test_border_spaces(spark):
    fixed = markup.border_spaces(F.col("a"))
    assert one(spark, fixed, a="вызов<code>f</code>даёт<a id='x'></a>слово и<a class='noteref'>1</a>.") == "вызов <code>f</code> даёт <a id='x'></a>слово и<a class='noteref'>1</a>."
    assert one(spark, fixed, a="<pre>я<code>x</code>я</pre>я<b>x</b>я") == "<pre>я<code>x</code>я</pre>я<b>x</b> я"


def test_terms_change_outside_code_only(spark):
    rules = markup.inflected("([Фф])игур", {"а": "$1-ок", "ой": "$1-ком"}, r"(?= \d)")
    assert one(spark, markup.normalised_terms(F.col("a"), rules), a="<p id='фигура 1'>Фигура 1, фигурой 2, фигура</p><code>фигура 3</code>") == "<p id='фигура 1'>Ф-ок 1, ф-ком 2, фигура</p><code>фигура 3</code>"
    assert one(spark, markup.capital_headings(F.col("a")), a="<h1>слово</h1><p>слово</p><th>ёж</th><head>x</head>") == "<h1>Слово</h1><p>слово</p><th>Ёж</th><head>x</head>"


def test_hints_and_index(spark):
    assert one(spark, markup.mark_hints(F.col("a"), "k-means", "метод k-средних"), a="⟦var3⟧-means, ⟦var3⟧-Means and ⟦var4⟧-meanst") == ["⟦var3⟧-means=метод ⟦var3⟧-средних"]
    assert one(spark, markup.is_index(F.col("a")), a='<section data-type="index">') and not one(spark, markup.is_index(F.col("a")), a='<p data-type="index">')


def test_lists(spark):
    rows = [("a", 1, "■ one"), ("a", 2, "– two"), ("a", 3, "— three"), ("a", 4, "four"), ("b", 1, "<sup>1</sup> x"), ("b", 2, "<sup>2</sup> y"), ("c", 1, "– z"), ("c", 2, "<sup>2</sup> q")]
    got = [tuple(r) for r in listings.repaired_lists(spark.createDataFrame(rows, "l string, pos long, text string"), "l").orderBy("l", "item", "sub").collect()]
    assert got == [("a", "ul", 1, 0, "one"), ("a", "ul", 1, 1, "two"), ("a", "ul", 1, 2, "three"), ("a", "ul", 2, 0, "four"), ("b", "ol", 1, 0, "x"), ("b", "ol", 2, 0, "y"), ("c", "ul", 1, 0, "– z"), ("c", "ul", 2, 0, "<sup>2</sup> q")]
    kids = [("n", 1, "in", True, False), ("n", 2, "x", False, True), ("n", 3, "sub", True, False)]
    items = listings.list_items(spark.createDataFrame(kids, "l string, ord long, text string, nested boolean, enumerated boolean"), "l").orderBy("item").collect()
    assert [(r.item, r.text, r.ordered) for r in items] == [(1, "in", True), (2, "x\nsub", True)]


def test_models_in_batches_and_nulls(spark):
    seen = spark.sparkContext.accumulator(0)

    def predict(source, out):
        seen.add(1)
        assert len(source) <= 4
        return [float(len(s or "") + len(o or "")) for s, o in zip(source, out, strict=True)]

    rows = spark.createDataFrame([("ab", "c"), ("ab", None), (None, "cd")] * 5, "src string, out string").coalesce(1)
    got = models.scored_sides(rows, predict, "src", ["out"], batch=4).select("score_out").collect()
    assert [r.score_out for r in got[:3]] == [3.0, None, 2.0] and seen.value >= 4
    assert models.scored_sides(rows.limit(0), predict, "src", ["out"]).count() == 0
    told = rows.select(models.in_batches(lambda texts: [t and t[::-1] for t in texts], "string")(F.col("src")).alias("x"))
    assert {r.x for r in told.collect()} == {"ba", None}
    scores = spark.createDataFrame([("m", 1.0, ["s"]), ("m", 2.0, []), ("k", None, None)], "model string, score double, spans array<string>")
    assert {tuple(r) for r in models.score_summary(scores, "model", "score", "spans").collect()} == {("m", 1.5, 2, 1), ("k", None, 0, 0)}


def test_known_terms_and_subsets(spark):
    zipf = spark.createDataFrame([("tokens", 3.0), ("token", 4.0), ("news", 5.0)], "word string, z double")
    got = terms.known_terms(spark.createDataFrame([("Data  Tokens",), ("news",), ("tokens data",)], "term string"), zipf).collect()
    assert {r.term for r in got} == {"data token", "news", "token data"}
    entries = spark.createDataFrame([("a", "t", "1", 1), ("keep", "t", "2", 2), ("b", "t", "3", 3)], "domain string, term string, target string, ord long")
    assert [tuple(r) for r in terms.glossary_subset(entries, ["a"], ["keep"]).collect()] == [("t", "2")]


def test_built_books_are_read_back(spark):
    blocks = [("b", 1, 1, "p", None, "<p>Before all</p>"), ("b", 2, 1, "h1", "One & 1", "<h1>One</h1>"), ("b", 3, 2, "h1", "more", "<h1>more</h1>"), ("b", 4, 2, "p", None, "<p>Text of one</p>"), ("b", 5, 3, "h1", "Two", "<h1>Two</h1>"), ("b", 6, None, "p", None, "<p>Text of two</p>")]
    df = spark.createDataFrame(blocks, "name string, ord long, page long, tag string, title string, html string").repartition(3)
    books = sinks.built_books(df)
    content = bytes(books.first().content)
    assert content == sinks.packed_book("b", [("b", '<span epub:type="pagebreak" id="p1"></span><p>Before all</p>'), ("One & 1 more", '<h1>One</h1>\n<span epub:type="pagebreak" id="p2"></span><h1>more</h1>\n<p>Text of one</p>'), ("Two", '<span epub:type="pagebreak" id="p3"></span><h1>Two</h1>\n<p>Text of two</p>')])
    assert content[30:38] == b"mimetype" and b"application/epub+zip" in content[:80]
    units = [(r.ch, r.is_head, r.text) for r in files.book_units(books).orderBy("unit_no").collect()]
    assert [u for u in units if u[0] == 0][-1][2].endswith("Before all") and (2, False, "Text of two") in units and (1, True, "more") in units
    assert sinks.built_books(df.limit(0)).count() == 0


def test_parts_trees_and_restrictions(spark, tmp_path):
    members = spark.createDataFrame([("b", "x_split_001.html", "2"), ("b", "x_split_000.html", "1"), ("b", "y.html", "3")], "book string, name string, html string")
    assert {(r.key, r.html) for r in files.joined_parts(members).collect()} == {("x.html", "12"), ("y.html", "3")}
    (tmp_path / "t.json").write_text(json.dumps({"texts": [{"label": "p"}, {"label": "code"}], "pictures": [], "groups": [{"children": [1]}]}, indent=1))
    got = {(r.file, r.part, r.at): json.loads(r.node) for r in files.layout_nodes(spark, str(tmp_path)).collect()}
    assert got == {("t.json", "texts", 0): {"label": "p"}, ("t.json", "texts", 1): {"label": "code"}, ("t.json", "groups", 0): {"children": [1]}}
    pages = spark.createDataFrame([("a", 1), ("a", 7), ("b", 3)], "name string, page long")
    assert files.restricted(pages, "1-3", ["a"]).count() == 1 and files.restricted(pages).count() == 3
