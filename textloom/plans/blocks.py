"""Queries about marks and markup, blocks of pages, candidate terms and models; numbers of the tables stand for positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import markup, models
from textloom.functions import text as tx
from textloom.operators import listings, runs, terms
from textloom.plans.catalogue import _BOXES, points_of, query, table, turn_pairs

# ---- marks and markup


def _between(inside: str, outside: str = "g[i]") -> str:
    """SQL of a text put together from its gaps g and what ``inside`` makes of the i-th match."""
    return f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: {outside} || CASE WHEN i > len(w) THEN '' ELSE {inside} END), '')"


_LOOSE = r"⟦([^⟧»\]\d]{0,20})(\d+)[ ]*([⟧»\]])"
_MENDED = "CASE WHEN NOT list_contains(sno, no[i]) AND NOT regexp_matches(trim(nm[i], ' '), '^[a-z]*$') THEN w[i] ELSE '⟦' || coalesce(sn[list_position(sno, no[i])], nullif(trim(nm[i], ' '), ''), 'code') || no[i] || '⟧' || CASE WHEN e[i] = '»' THEN '»' ELSE '' END END"


@query(rf"""WITH p AS (SELECT conv_id, turn, replace(replace(text, 'the', '⟦name1⟧'), 'of', '⟦code2⟧') AS src, replace(replace(replace(replace(text, 'the', '⟦имя1⟧'), 'of', '⟦2»'), 'to', '⟦kode3 ]'), 'an', '⟦имя9⟧') AS o FROM conversations),
m AS (SELECT conv_id, turn, regexp_extract_all(o, '{_LOOSE}') AS w, regexp_extract_all(o, '{_LOOSE}', 1) AS nm, regexp_extract_all(o, '{_LOOSE}', 2) AS no, regexp_extract_all(o, '{_LOOSE}', 3) AS e, regexp_split_to_array(o, '{_LOOSE}') AS g, regexp_extract_all(src, '⟦([a-z]+)(\d+)⟧', 1) AS sn, regexp_extract_all(src, '⟦([a-z]+)(\d+)⟧', 2) AS sno FROM p)
SELECT conv_id, turn, {_between(_MENDED)} AS mended FROM m""")
def repaired_marks(spark, sf_dir):
    def replaced(pairs):
        made = F.col("text")
        for a, b in pairs:
            made = F.replace(made, F.lit(a), F.lit(b))
        return made

    src, out = replaced([("the", "⟦name1⟧"), ("of", "⟦code2⟧")]), replaced([("the", "⟦имя1⟧"), ("of", "⟦2»"), ("to", "⟦kode3 ]"), ("an", "⟦имя9⟧")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", markup.repaired_marks(src, out).alias("mended"))


_CYR = "replace(replace(html, '> ', '>я'), ' <', 'я<')"
_EMPTY_SQL = "|".join(rf"<{t}(?:[^A-Za-z>][^>]*)?></{t}\s*>" for t in ("code", "a", "var", "i", "b", "em", "strong", "span", "kbd", "samp"))
_SPACED = rf"replace(regexp_replace(regexp_replace(regexp_replace(g[i], '({_EMPTY_SQL})', '\1' || chr(57344), 'g'), '(</(?:code|a|var|i|b|em|strong|span|kbd|samp)\s*>)([А-Яа-яЁё«])', '\1 \2', 'g'), '([А-Яа-яЁё])(<(?:code|a|var|i|kbd|samp)(?:[^A-Za-z>][^>]*)?>)', '\1 \2', 'g'), chr(57344), '')"


@query(rf"""WITH m AS (SELECT page_id, regexp_extract_all({_CYR}, '(?s)<pre[^A-Za-z].*?</pre>') AS w, regexp_split_to_array({_CYR}, '(?s)<pre[^A-Za-z].*?</pre>') AS g FROM pages) SELECT page_id, {_between("w[i]", _SPACED)} AS spaced FROM m""")
def border_spaces(spark, sf_dir):
    html = F.replace(F.replace("html", F.lit("> "), F.lit(">я")), F.lit(" <"), F.lit("я<"))
    return table(spark, sf_dir, "pages").select("page_id", markup.border_spaces(html).alias("spaced"))


_RULES = [("([Tt])he ", "$1e "), *markup.inflected("(a)", {"nd": "x", "n": "m", "re": "rre"}, "( )")]
_KEPT_SQL = "(?is)<pre[^A-Za-z].*?</pre>|<code[^A-Za-z].*?</code>|<math[^A-Za-z].*?</math>|<var[^A-Za-z].*?</var>|<[^>]+>"
_RULED = "g[i]"
for _pattern, _to in [("([Tt])he ", r"\1e "), ("(a)nd( )", "x"), ("(a)re( )", "rre"), ("(a)n( )", "m")]:
    _RULED = f"regexp_replace({_RULED}, '{_pattern}', '{_to}', 'g')"


@query(f"""WITH m AS (SELECT page_id, regexp_extract_all(html, '{_KEPT_SQL}') AS w, regexp_split_to_array(html, '{_KEPT_SQL}') AS g FROM pages) SELECT page_id, {_between("w[i]", _RULED)} AS normal FROM m""")
def normalised_terms(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.normalised_terms(F.col("html"), _RULES).alias("normal"))


_CAP_SQL = r"(<(?:h[1-6]|caption|th|td|dt)(?:[^A-Za-z0-9>][^>]*)?>\s*)(\p{Ll})"


@query(f"""WITH p AS (SELECT page_id, lower(html) AS h FROM pages), m AS (SELECT page_id, regexp_extract_all(h, '{_CAP_SQL}') AS w, regexp_extract_all(h, '{_CAP_SQL}', 1) AS t, regexp_extract_all(h, '{_CAP_SQL}', 2) AS l, regexp_split_to_array(h, '{_CAP_SQL}') AS g FROM p) SELECT page_id, {_between("t[i] || upper(l[i])")} AS headed FROM m""")
def capital_headings(spark, sf_dir):
    # Letter by letter: lower() writes İ as two and Σ by its place in a word.
    single = F.replace(F.replace("html", F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return table(spark, sf_dir, "pages").select("page_id", markup.capital_headings(F.lower(single)).alias("headed"))


@query(r"""SELECT page_id, regexp_matches(replace(html, '<div class=', '<div epub:type='), '<(?:section|body|div)[^A-Za-z>][^>]*(?:data-type="index"|epub:type="[^"]*\bpost\b)') AS is_index FROM pages""")
def index_pages(spark, sf_dir):
    html = F.replace(F.replace("html", F.lit("<div class="), F.lit("<div epub:type=")), F.lit("post"), F.lit("index"))
    return table(spark, sf_dir, "pages").select("page_id", markup.is_index(html).alias("is_index"))


@query(r"""WITH p AS (SELECT doc_id, replace(replace(lower(text), ' la ', ' ⟦var1⟧-la '), ' the ', ' ⟦var2⟧-la ') AS t FROM documents)
SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '(⟦var\d+⟧)-la[^\p{L}\p{N}_]', 1))) AS mark, mark || '-la=метод ' || mark || ' средних' AS hint FROM p""")
def mark_hints(spark, sf_dir):
    marked = F.replace(F.replace(F.lower("text"), F.lit(" la "), F.lit(" ⟦var1⟧-la ")), F.lit(" the "), F.lit(" ⟦var2⟧-la "))
    hints = table(spark, sf_dir, "documents").select("doc_id", F.explode(markup.mark_hints(marked, "k-la", "метод k средних")).alias("hint"))
    return hints.select("doc_id", F.substring_index("hint", "-", 1).alias("mark"), "hint")


# ---- blocks


_PROSE = [(p, k, 5.0 * k, 900.0 * k, 5.0 * k + 14.0, 900.0 * k + 30000.0, r) for p, r, k in ((b[0], b[1], n) for n, b in enumerate(_BOXES))]


@query("WITH l(page, ord, x0, top, x1, bottom, ref) AS (VALUES " + ", ".join(f"({p}, {k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, '{r}')" for p, k, a, b, c, d, r in _PROSE) + """)
SELECT CAST(l_linenumber AS BIGINT) AS page, l_orderkey AS id, arg_min(ref, ord) AS ref FROM lineitem JOIN l ON page = l_linenumber WHERE l_quantity BETWEEN x0 - 2 AND x1 + 2 AND l_extendedprice BETWEEN top - 0.5 AND bottom + 0.5 GROUP BY ALL""")
def returned_to_prose(spark, sf_dir):
    lines = spark.createDataFrame(_PROSE, "page long, ord long, x0 double, top double, x1 double, bottom double, ref string")
    return listings.returned_to_prose(points_of(spark, sf_dir), F.broadcast(lines))  # 35 rows


#: Places of lines from 1: the tables repeat line numbers.
_NO = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


def _placed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("no", F.expr(_NO).cast("long"))


def _lines(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 60).cast("double").alias("x0"), q.alias("top"), (q + 2 + F.col("l_suppkey") % 4).alias("bottom"), (F.col("l_suppkey") % 7 == 0).alias("blank"))


@query()
def line_boxes(spark, sf_dir):
    return listings.line_boxes(_lines(spark, sf_dir), "page")


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_quantity AS DOUBLE) AS top, CAST(l_quantity + 2 + l_suppkey % 4 AS DOUBLE) AS bottom, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey % 60, l_linenumber, l_suppkey % 4) AS rn FROM lineitem),
g AS (SELECT page, id, rn, x0 AS edge, top, bottom, CAST(1 AS BIGINT) AS no FROM o WHERE rn = 1 UNION ALL SELECT page, id, rn, CASE WHEN same THEN edge ELSE x0 END, top, bottom, CASE WHEN same THEN no ELSE no + 1 END FROM (SELECT o.*, g.edge, g.no, o.top - g.bottom < 0.8 * (g.bottom - g.top) AND abs(o.x0 - g.edge) < 25 AS same FROM g JOIN o ON o.page = g.page AND o.rn = g.rn + 1))
SELECT page, id, no AS "group" FROM g""")
def callout_groups(spark, sf_dir):
    return listings.callout_groups(_lines(spark, sf_dir), "page")


@query(f"WITH p AS (SELECT *, {_NO} AS place FROM lineitem) SELECT l_orderkey, place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 5, place) AS no FROM p")
def numbered_callouts(spark, sf_dir):
    rows = _placed(spark, sf_dir).select("l_orderkey", F.col("no").alias("place"), (F.col("l_suppkey") % 5).alias("line"))
    return listings.numbered_callouts(rows, "l_orderkey", "line", "place").select("l_orderkey", "place", "no")


@query("SELECT l_orderkey AS block, l_suppkey % 2 AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3 AND bool_and(l_linestatus = 'O')")
def code_lines_in_prose(spark, sf_dir):
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), (F.col("l_suppkey") % 2).alias("line"), F.col("l_returnflag").alias("text"), (F.col("l_linestatus") == "O").alias("code"))
    return listings.code_lines_in_prose(glyphs, "block", "line")


@query("""WITH g AS (SELECT l_orderkey AS grp, l_suppkey % 3 AS page, l_linenumber AS ord, l_returnflag AS t FROM lineitem) SELECT grp, string_agg(t, '' ORDER BY page, ord, t) AS text, array_to_string(list_sort(list(DISTINCT page)), ' ') AS pages FROM g GROUP BY grp""")
def group_texts(spark, sf_dir):
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), (F.col("l_suppkey") % 3).alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("text"))
    return listings.group_texts(glyphs, "grp")


@query("""WITH c AS (SELECT o_custkey AS list, o_orderkey AS ord, o_orderpriority AS t, o_orderkey % 4 = 0 AS nested, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS ordered, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders),
i AS (SELECT *, CAST(sum(CAST(NOT nested OR first AS BIGINT)) OVER (PARTITION BY list ORDER BY ord) AS BIGINT) AS item FROM c) SELECT list, item, string_agg(t, chr(10) ORDER BY ord, t) AS text, any_value(ordered) AS ordered FROM i GROUP BY list, item""")
def list_items(spark, sf_dir):
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 4 == 0).alias("nested"), (F.col("o_orderstatus") == "P").alias("enumerated"))
    return listings.list_items(children, "list")


@query(rf"""WITH p AS (SELECT *, {_NO} AS no FROM lineitem), t AS (SELECT l_orderkey AS list, no AS pos, CASE WHEN l_orderkey % 3 = 0 THEN '<sup>' || no || '</sup> ' WHEN l_partkey % 3 = 0 THEN '– ' WHEN l_partkey % 3 = 1 THEN '■ ' ELSE '' END || l_returnflag || l_partkey AS text FROM p),
o AS (SELECT *, bool_and(regexp_extract(text, '^<sup>(\d+)</sup>', 1) = CAST(pos AS VARCHAR)) OVER (PARTITION BY list) AS ordered, regexp_replace(text, '^[■●•▪]\s*', '') AS plain FROM t), d AS (SELECT *, NOT ordered AND pos > 1 AND regexp_matches(plain, '^[–—-]\s+') AS dash FROM o),
i AS (SELECT *, CAST(sum(CAST(NOT dash AS BIGINT)) OVER (PARTITION BY list ORDER BY pos) AS BIGINT) AS item FROM d)
SELECT list, CASE WHEN ordered THEN 'ol' ELSE 'ul' END AS tag, item, row_number() OVER (PARTITION BY list, item ORDER BY pos) - 1 AS sub, CASE WHEN ordered THEN regexp_replace(text, '^<sup>\d+</sup>\s*', '') WHEN dash THEN regexp_replace(plain, '^[–—-]\s+', '') ELSE plain END AS text FROM i""")
def repaired_lists(spark, sf_dir):
    lead = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("<sup>"), F.col("no").cast("string"), F.lit("</sup> "))).when(F.col("l_partkey") % 3 == 0, "– ").when(F.col("l_partkey") % 3 == 1, "■ ").otherwise("")
    items = _placed(spark, sf_dir).select(F.col("l_orderkey").alias("list"), F.col("no").alias("pos"), F.concat(lead, "l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return listings.repaired_lists(items, "list")


@query(f"""WITH p AS (SELECT *, {_NO} AS no FROM lineitem), l AS (SELECT l_orderkey AS listing, no AS ord, CAST(l_quantity AS DOUBLE) AS x0, l_suppkey % 2 = 0 AS code, l_suppkey % 5 = 1 AS callout FROM p), w AS (SELECT *, min(x0) FILTER (code) OVER p AS edge, min(ord) FILTER (code) OVER p AS a, max(ord) FILTER (code) OVER p AS b FROM l WINDOW p AS (PARTITION BY listing)),
m AS (SELECT *, coalesce(NOT code AND NOT callout AND x0 < edge + 20 AND ord > a AND ord < b, false) AS prose FROM w) SELECT listing, ord, prose, CAST(coalesce(sum(CAST(prose AS BIGINT)) OVER (PARTITION BY listing ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM m""")
def listings_split_by_prose(spark, sf_dir):
    lines = _placed(spark, sf_dir).select(F.col("l_orderkey").alias("listing"), F.col("no").alias("ord"), F.col("l_quantity").cast("double").alias("x0"), (F.col("l_suppkey") % 2 == 0).alias("code"), (F.col("l_suppkey") % 5 == 1).alias("callout"))
    return listings.split_by_prose(lines, "listing").select("listing", "ord", "prose", "segment")


_ON = "len(list_filter(a, lambda x: (y.top + y.bottom) / 2 BETWEEN x.top - 1 AND x.bottom + 1)) > 0"


@query(f"""WITH l AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS block, CAST(l_quantity AS DOUBLE) + k * 6 AS top, CAST(l_quantity AS DOUBLE) + k * 6 + 2 + l_suppkey % 3 AS bottom FROM lineitem, (VALUES (0), (1)) v(k)), b AS (SELECT page, block, list(struct_pack(top := top, bottom := bottom) ORDER BY top, bottom) AS b FROM l GROUP BY ALL),
p AS (SELECT b.page, b.block, o.block AS other, b.b, o.b AS a FROM b JOIN b o ON o.page = b.page AND o.block < b.block AND o.block >= b.block - 8),
h AS (SELECT *, list_aggregate(list_transform(list_concat(a, b), lambda x: x.bottom - x.top), 'median') AS h, b[1].top - list_max(list_transform(a, lambda x: x.bottom)) AS below, list_min(list_transform(a, lambda x: x.top)) - list_max(list_transform(b, lambda x: x.bottom)) AS above FROM p)
SELECT page, block, other, len(list_filter(b, lambda y: {_ON})) = len(b) AS shares, len(list_filter(b, lambda y: {_ON})) > 0 OR (below > -0.5 * h AND below < 1.6 * h) OR (above > -0.5 * h AND above < 1.6 * h) AS touches FROM h""")
def code_fragments(spark, sf_dir):
    top = F.col("l_quantity").cast("double") + F.col("k") * 6
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("block"), top.alias("top"), (top + 2 + F.col("l_suppkey") % 3).alias("bottom"))
    return listings.fragments(lines)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'list' WHEN o_orderkey % 11 = 0 THEN 'parted' WHEN o_orderkey % 7 = 0 THEN 'paragraph' WHEN o_orderkey % 5 = 0 THEN 'continued' WHEN o_orderkey % 3 = 0 THEN 'merged' WHEN o_orderkey % 2 = 0 AND o_custkey % 6 <= 3 THEN 'returned' ELSE 'listing' END AS outcome FROM orders""")
def code_outcomes(spark, sf_dir):
    by = lambda n: F.col("o_orderkey") % n == 0
    return table(spark, sf_dir, "orders").select("o_orderkey", listings.code_outcome(~by(7), by(13), by(11), by(5), by(3), by(2), F.col("o_custkey") % 6).alias("outcome"))


@query("""WITH g AS (SELECT l_partkey AS picture, l_linestatus = 'O' OR l_quantity > 10 AS code, CAST(l_quantity AS DOUBLE) AS size, CAST(l_quantity * 10 AS DOUBLE) AS top, CAST(l_quantity * 10 + l_suppkey % 4 AS DOUBLE) AS bottom, l_quantity >= 49 AS caption FROM lineitem),
s AS (SELECT picture, count(*) AS n, count(*) FILTER (code) AS n_code, count(*) FILTER (caption) AS n_cap, min(size) AS least, min(top) FILTER (caption) AS cap_top, max(bottom) FILTER (NOT caption) AS rest FROM g GROUP BY picture),
k AS (SELECT p_partkey AS picture, 495.0::DOUBLE AS bb, s.* EXCLUDE picture, CASE WHEN coalesce(n_cap, 0) = 0 AND n_code >= 40 AND n_code >= 0.6 * n THEN 'listing' WHEN coalesce(n_cap, 0) = 0 AND n BETWEEN 1 AND 80 AND least >= 1.8 THEN 'heading' ELSE 'figure' END AS kind FROM part LEFT JOIN s ON picture = p_partkey)
SELECT picture, kind, CASE WHEN kind = 'figure' AND cap_top > 0 AND cap_top < bb AND cap_top >= coalesce(rest, 0) - 1 THEN cap_top - 2 ELSE bb END AS bottom FROM k""")
def pictures(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("picture"), F.lit("x").alias("text"), ((F.col("l_linestatus") == "O") | (q > 10)).alias("code"), q.alias("size"), (q * 10).alias("top"), (q * 10 + F.col("l_suppkey") % 4).alias("bottom"), (q >= 49).alias("caption"))
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("picture"), F.lit(0.0).alias("box_top"), F.lit(495.0).alias("box_bottom"))
    return listings.pictures(glyphs, boxes, "picture", 1.0)


# ---- terms and models

_STOP = ["the", "and", "for", "that", "with"]


@query(r"""WITH t AS (SELECT source AS book, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-''’][A-Za-z0-9]+)*(?:[+#]+)?')) AS token FROM documents), f AS (SELECT lower(token) AS word, token, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT lower(token) AS word, count(DISTINCT book) AS books FROM t GROUP BY 1),
c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, arg_min(token, (-n, token)) AS orig, sum(CASE WHEN regexp_matches(token, '^\p{Lu}') THEN n ELSE 0 END) AS caps FROM f GROUP BY word),
zt AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), z AS (SELECT word, round(log10(count(*) + 1) + 2, 6) AS z FROM zt GROUP BY word), total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c),
known AS (SELECT DISTINCT lower(p_type) AS term FROM part), kept AS (SELECT * FROM c JOIN b USING (word) WHERE n >= 3 AND len(word) >= 3 AND NOT regexp_matches(word, '^\d+$') AND word NOT IN ('the', 'and', 'for', 'that', 'with')),
cut AS (SELECT *, CASE WHEN len(word) > 4 AND word LIKE '%ies' THEN left(word, len(word) - 3) || 'y' WHEN len(word) > 4 AND regexp_matches(word, '(ss|sh|ch|x|z)es$') THEN left(word, len(word) - 2) WHEN len(word) > 3 AND word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, len(word) - 1) END AS cut FROM kept),
lem AS (SELECT cut.*, a.z, CASE WHEN cut IS NOT NULL AND (a.z IS NULL OR coalesce(y.z, 0) >= a.z - 0.7) THEN cut ELSE cut.word END AS lemma FROM cut LEFT JOIN z a ON a.word = cut.word LEFT JOIN z y ON y.word = cut),
u AS (SELECT *, list_filter(regexp_split_to_array(word, '[-'']'), lambda p: p <> '') AS parts FROM lem WHERE lemma NOT IN (SELECT term FROM known)), pz AS (SELECT e.word, min(coalesce(z.z, 0)) AS least FROM (SELECT word, unnest(parts) AS part FROM u WHERE z IS NULL AND len(parts) > 1) e LEFT JOIN z ON z.word = part GROUP BY e.word),
j AS (SELECT u.*, least, ln(n + 1) * (1 + books) AS spread, log10(n / total * 1e6) - (coalesce(z, 0) - 3) AS key, z IS NULL OR z < 3 AS rare FROM u LEFT JOIN pz USING (word), total),
k AS (SELECT *, CASE WHEN least >= 3.5 THEN 'hyphen' WHEN least IS NOT NULL THEN 'rare' WHEN rare AND regexp_matches(orig, '[a-z][A-Z]|^[A-Z][a-z]+[A-Z]') AND orig <> 'camelCase' THEN 'code?' WHEN rare AND caps > 0.9 * n THEN 'name?' WHEN rare THEN 'rare' WHEN key >= 1 AND n >= 6 THEN 'key' END AS kind FROM j)
SELECT kind, orig AS term, n, books, coalesce(least, z) AS z, round(CASE WHEN least IS NOT NULL THEN spread * (3.5 - least / 2) WHEN rare THEN spread * (3.5 - coalesce(z, 0.5)) ELSE key * spread END, 6) AS score FROM k WHERE kind IS NOT NULL""")
def term_scores(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.explode(tx.term_tokens(F.col("text"))).alias("token"))
    counts = terms.word_counts(tokens)
    zipf = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.round(F.log10(F.count("*") + 1) + 2, 6).alias("z"))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    known = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term")).distinct()
    return terms.word_scores(counts.crossJoin(F.broadcast(total)), F.col("total"), zipf, known, _STOP)  # one row


_TOKEN = r"'[A-Za-z][A-Za-z0-9]*(?:[-''’][A-Za-z0-9]+)*(?:[+#]+)?'"


@query(rf"""WITH l AS (SELECT source AS book, list_transform(regexp_extract_all(text, {_TOKEN}), lambda x: lower(x)) AS t, regexp_extract_all(text, {_TOKEN}) AS raw FROM documents), f AS (SELECT lower(token) AS word, token, count(*) AS n FROM (SELECT unnest(raw) AS token FROM l) GROUP BY ALL),
c AS (SELECT word, CAST(sum(n) AS BIGINT) AS c, arg_min(token, (-n, token)) AS orig FROM f GROUP BY word), z AS (SELECT word, round(log10(count(*) + 1) + 2, 6) AS z FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word),
cut AS (SELECT c.*, z.z, CASE WHEN len(c.word) > 4 AND c.word LIKE '%ies' THEN left(c.word, len(c.word) - 3) || 'y' WHEN len(c.word) > 4 AND regexp_matches(c.word, '(ss|sh|ch|x|z)es$') THEN left(c.word, len(c.word) - 2) WHEN len(c.word) > 3 AND c.word LIKE '%s' AND NOT regexp_matches(c.word, '(ss|us|is)$') THEN left(c.word, len(c.word) - 1) END AS cut FROM c LEFT JOIN z USING (word)),
w AS (SELECT cut.word, c, regexp_matches(orig, '^\p{{Lu}}') AS cap, CASE WHEN cut IS NOT NULL AND (cut.z IS NULL OR coalesce(y.z, 0) >= cut.z - 0.7) THEN cut ELSE cut.word END AS lemma, greatest(0.0, log10(c / (SELECT sum(c) FROM c) * 1e6 + 1e-9) - log10(pow(10.0, coalesce(cut.z, 0) - 3) + 1e-3)) AS more FROM cut LEFT JOIN z y ON y.word = cut
WHERE NOT (cut.word IN ('the', 'and', 'for', 'that', 'with', 'of', 'void') OR (len(cut.word) < 3 AND coalesce(cut.z, 0) < 3) OR (cut.z IS NULL AND NOT contains(cut.word, '-') AND len(cut.word) > 10))),
g AS (SELECT a, b, count(*) AS n, count(DISTINCT book) AS books FROM (SELECT book, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM l WHERE len(t) >= 2) GROUP BY a, b HAVING count(*) >= 3),
j AS (SELECT g.a || ' ' || g.b AS term, n, books, x.cap AND y.cap AS cap, n / least(x.c, y.c) AS stick, (x.more + y.more) / 2 AS spec FROM g JOIN w x ON x.word = a JOIN w y ON y.word = b WHERE x.lemma || ' ' || y.lemma NOT IN (SELECT lower(p_type) FROM part))
SELECT CASE WHEN cap THEN 'name?' ELSE 'phrase' END AS kind, term, n, books, round(ln(n + 1) * (1 + books) * stick * (1 + spec), 6) AS score FROM j WHERE stick >= 0.08 AND spec >= 0.4""")
def phrase_scores(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), tx.term_tokens(F.col("text")).alias("raw"))
    counts = terms.word_counts(tokens.select("book", F.explode("raw").alias("token")))
    zipf = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.round(F.log10(F.count("*") + 1) + 2, 6).alias("z"))
    lists = tokens.select("book", F.transform("raw", lambda t: F.lower(t)).alias("t"))
    known = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term")).distinct()
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    return terms.phrase_scores(lists, counts.crossJoin(F.broadcast(total)), F.col("total"), zipf, known, [*_STOP, "of"], ["void"])  # one row


def _share(source: list, out: list) -> list[float]:
    return [len(o) / (len(s) + len(o) + 1) for s, o in zip(source, out, strict=True)]


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS out FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant') SELECT conv_id, turn, len(out) / (len(src) + len(out) + 1) AS score_out, len(src) / (len(src) + len(src) + 1) AS score_src FROM p""")
def model_scores(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select("conv_id", "turn", "src", "out")
    return models.scored_sides(pairs, _share, "src", ["out", "src"]).select("conv_id", "turn", "score_out", "score_src")


# ---- joins and frames in their variants


@query("SELECT 'merge' AS hint, n_nationkey, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey UNION ALL SELECT 'shuffle_hash', n_nationkey, count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey UNION ALL SELECT 'broadcast', n_nationkey, count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def hinted_joins(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    made = [customer.join(nation.hint(h), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_nationkey").agg(F.count("*").alias("n")).select(F.lit(h).alias("hint"), "n_nationkey", "n") for h in ("merge", "shuffle_hash", "broadcast")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) <= 2")
def lateral_last_orders(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer").alias("c"), table(spark, sf_dir, "orders")
    last = orders.filter(F.col("o_custkey") == F.col("c.c_custkey").outer()).orderBy(F.desc("o_orderkey")).limit(2)
    return customer.lateralJoin(last).select("c_custkey", "o_orderkey")


@query("SELECT n_nationkey, r_regionkey FROM nation FULL JOIN region ON n_regionkey < r_regionkey AND n_nationkey % 2 = r_regionkey % 2")
def theta_full_outer(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, (F.col("n_regionkey") < F.col("r_regionkey")) & (F.col("n_nationkey") % 2 == F.col("r_regionkey") % 2), "full_outer").select("n_nationkey", "r_regionkey")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS second_after, ntile(3) OVER w AS third, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS dist, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_measures(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("second_after"), F.ntile(3).over(w).cast("long").alias("third"),
        F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.cume_dist().over(w), 9).alias("dist"), F.count("*").over(w.rangeBetween(-100, 0)).alias("near"),
    )


@query("SELECT lang, true AS close, count(DISTINCT text) AS n FROM documents GROUP BY lang")
def distinct_sketch(spark, sf_dir):
    # A sketch of 2^12 registers, held against the exact count.
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("about"), F.count_distinct("text").alias("n"))
    return by.select("lang", (F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n") + 1).alias("close"), "n")


# ---- runs


@query("""WITH f AS (SELECT o_custkey AS folder, CASE WHEN o_orderkey % 7 = 0 THEN '.lock' WHEN o_orderkey % 7 = 1 THEN 'work.' ELSE '' END || o_orderkey AS name FROM orders) SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name) AS place FROM f WHERE name NOT LIKE '.%' AND name NOT LIKE 'work%'""")
def listed_outputs(spark, sf_dir):
    key = F.col("o_orderkey")
    lead = F.when(key % 7 == 0, ".lock").when(key % 7 == 1, "work.").otherwise("")
    return runs.listed_outputs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.concat(lead, key.cast("string")).alias("name")))


@query("SELECT d.doc_id AS book, coalesce(b.text, left(d.text, 100)) AS text, b.item_id IS NOT NULL AS whole FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def text_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.substring("text", 1, 100).alias("text"))
    derived = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("book"), "text")
    return runs.text_sources(docs.select("book"), derived, docs)


@query("""SELECT o_orderkey AS book, 'm' || o_orderkey % 3 AS model, o_orderkey % 5 = 0 AS fresh, i.model AS interrupted, o_orderkey % 5 <> 0 AND coalesce(i.model <> 'm' || o_orderkey % 3, false) AS conflict FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS book, CASE WHEN l_orderkey % 4 <> 0 THEN 'm' || l_orderkey % 2 END AS model FROM lineitem) i ON book = o_orderkey""")
def resumable_jobs(spark, sf_dir):
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(key.alias("book"), F.concat(F.lit("m"), (key % 3).cast("string")).alias("model"), (key % 5 == 0).alias("fresh"))
    line = F.col("l_orderkey")
    stopped = table(spark, sf_dir, "lineitem").select(line.alias("book"), F.when(line % 4 != 0, F.concat(F.lit("m"), (line % 2).cast("string"))).alias("model")).distinct()
    return runs.resumable(jobs, stopped)
