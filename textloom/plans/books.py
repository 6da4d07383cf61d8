"""Queries of the catalogue about books and their translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import predicates as pr
from textloom.functions import text as tx
from textloom.operators import books, glyphs, matching, runs, statistics
from textloom.plans.catalogue import query, table
from textloom.streaming import progress

# ---- terms

#: (domain, term, target, ord) and, for the SQL, all forms of each term.
_LISTED = [("a", "the", "x1", 1, ["the", "thes"]), ("a", "ion", "x2", 2, ["ion", "ions"]), ("a", "of the", "x3", 3, ["of the", "of thes"]), ("a", "by the of the", "x4", 4, ["by the of the", "by the of thes"]), ("a", "in the", "x5", 5, ["in the", "in thes"]), ("a", "to the", "x6", 6, ["to the", "to thes"]), ("a", "is a", "x7", 7, ["is a"]), ("b", "où", "y1", 1, ["où"]), ("b", "à la", "y2", 2, ["à la"]), ("b", "de la", "y3", 3, ["de la"]), ("b", "en", "y4", 4, ["en"]), ("b", "ç", "y5", 5, ["ç"]), ("b", "é, la", "y6", 6, ["é, la"]), ("c", "für", "z1", 1, ["für", "fürs"]), ("c", "und die", "z2", 2, ["und die", "und dies"]), ("c", "The", "z3", 3, ["The"]), ("c", "der. Die", "z4", 4, ["der. Die"])]
_FORMS_SQL = "forms(domain, term, target, ord, form) AS (VALUES " + ", ".join(f"('{d}', '{t}', '{g}', {o}, '{f}')" for d, t, g, o, forms in _LISTED for f in forms) + ")"
# Words are put in brackets on both sides, so that a plain substring is a whole word.
_WORD = r"'([\p{L}\p{N}_]+)', '‹\1›', 'g'"
_HITS_SQL = rf"""{_FORMS_SQL}, marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), {_WORD}) AS own FROM documents), lowered AS (SELECT doc_id, own, lower(own) AS low FROM marked),
pat AS (SELECT *, regexp_replace(form, {_WORD}) AS p, form = lower(form) AS small FROM forms),
n AS (SELECT doc_id, domain, term, target, ord, sum(CASE WHEN small THEN len(low) - len(replace(low, p, '')) ELSE len(own) - len(replace(own, p, '')) END // len(p)) AS n FROM lowered, pat GROUP BY ALL),
hits AS (SELECT doc_id, domain, term, target, ord, CAST(n AS BIGINT) AS n, contains(term, ' ') AS multi FROM n WHERE n > 0)"""


def listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in _LISTED], "domain string, term string, target string, ord long")


@query(rf"""WITH {_HITS_SQL}, d AS (SELECT doc_id, domain, count(*) AS n_terms, count(*) FILTER (multi) AS n_multi, CAST(sum(n) AS BIGINT) AS occurrences, array_to_string(list(term ORDER BY n DESC, ord)[1:8], ', ') AS top, coalesce(array_to_string((list(term || '=' || target ORDER BY n DESC, term DESC, target DESC) FILTER (NOT multi))[1:3], ', '), '') AS top_single FROM hits GROUP BY ALL),
s AS (SELECT *, sum(n_multi) OVER (PARTITION BY doc_id) AS total FROM d), c AS (SELECT *, CASE WHEN total > 0 THEN floor((200 * n_multi + total) / (2 * total)) ELSE 0 END AS cents FROM s)
SELECT doc_id, domain, n_terms, n_multi, occurrences, CAST(cents / 100 AS DOUBLE) AS share, (n_multi >= 3 AND cents >= 15) OR (n_multi >= 8 AND cents >= 8) AS suggested, top, top_single FROM c""")
def domain_report(spark, sf_dir):
    return matching.domain_report(table(spark, sf_dir, "documents"), listed(spark))


@query(r"""WITH w(term, forms) AS (VALUES ('matrix', ['matrices']), ('index', ['indexes', 'indices']), ('vertex', ['vertices']), ('hypothesis', ['hypotheses']), ('analysis', ['analyses']), ('axis', ['axes']), ('criterion', ['criteria']), ('leaf', ['leaves']), ('child', ['children']), ('basis', ['bases']), ('datum', ['data']), ('appendix', ['appendices']), ('phenomenon', ['phenomena']), ('cache miss', ['cache misses']), ('dependency', ['dependencies']), ('key', ['keys']), ('branch', ['branches']), ('person', ['persons']), ('open leaf', ['open leaves']))
SELECT term, unnest(forms) AS form FROM w""")
def plural_forms_of_terms(spark, sf_dir):
    words = ["matrix", "index", "vertex", "hypothesis", "analysis", "axis", "criterion", "leaf", "child", "basis", "datum", "appendix", "phenomenon", "cache miss", "dependency", "key", "branch", "person", "open leaf", "data", "feedback", "code", "throughput", "features", "GPU", "is"]
    return spark.createDataFrame([(w,) for w in words], "term string").select("term", F.explode(tx.plurals(F.col("term"))).alias("form"))


_LONG_WORD = r"([a-z]{11,})"


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_LONG_WORD}', 1)) AS word FROM benchmark) SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM w WHERE contains(lower(text), word))""")
def rows_with_invented_words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LONG_WORD), 1)).alias("word")).distinct()
    return matching.containing(table(spark, sf_dir, "documents"), words)


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-''’][A-Za-z0-9]+)*(?:[+#]+)?')) AS token FROM documents), w AS (SELECT lower(token) AS word, count(*) AS n FROM t GROUP BY 1), z AS (SELECT word, round(log10(n), 6) AS z FROM w),
c AS (SELECT word, CASE WHEN len(word) > 4 AND word LIKE '%ies' THEN left(word, len(word) - 3) || 'y' WHEN len(word) > 4 AND regexp_matches(word, '(ss|sh|ch|x|z)es$') THEN left(word, len(word) - 2) WHEN len(word) > 3 AND word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, len(word) - 1) END AS cut FROM w)
SELECT c.word, CASE WHEN cut IS NOT NULL AND coalesce(b.z, 0) >= a.z - 0.7 THEN cut ELSE c.word END AS lemma FROM c JOIN z a ON a.word = c.word LEFT JOIN z b ON b.word = cut""")
def word_lemmas(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(tx.term_tokens(F.col("text"))).alias("token"))
    counts = tokens.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    return books.lemmas(counts.select("word"), counts.select("word", F.round(F.log10("n"), 6).alias("z")))


_ENDINGS, _SUFFIXES, _PREFIXES = ["s", "ing", "ed", "er", "ly", "ement", "ation"], ["tion", "ment", "able"], ["re", "un", "dé"]


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+(?:-[\p{L}]+)*')) AS word FROM documents), x AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS key FROM benchmark),
stems AS (SELECT DISTINCT left(key, CAST(n AS BIGINT)) AS form FROM (SELECT key, unnest(range(greatest(len(key) - 5, 5), len(key) + 1)) AS n FROM x WHERE len(key) >= 5)),
e(e) AS (VALUES (''), ('s'), ('ing'), ('ed'), ('er'), ('ly'), ('ement'), ('ation')), d(d) AS (VALUES ('tion'), ('ment'), ('able')), pre(p) AS (VALUES ('re'), ('un'), ('dé')),
part AS (SELECT word, unnest(list_filter(string_split(word, '-'), lambda p: p <> '')) AS part FROM w), p AS (SELECT DISTINCT part FROM part),
whole AS (SELECT part, part AS form FROM p UNION SELECT part, substring(part, len(p) + 1) FROM p, pre WHERE starts_with(part, p) AND len(part) - len(p) >= 6),
stripped AS (SELECT part, left(part, len(part) - len(e)) AS s FROM p, e WHERE ends_with(part, e) AND len(part) > len(e)),
derived AS (SELECT part, left(s, len(s) - len(d)) AS s FROM stripped, d WHERE ends_with(s, d) AND len(s) - len(d) >= 6),
tostem AS (SELECT part, form AS s FROM whole UNION SELECT part, s FROM derived), cut AS (SELECT part, left(s, len(s) - len(e)) AS form FROM tostem, e WHERE ends_with(s, e) AND len(s) - len(e) >= 5),
good AS (SELECT part FROM whole WHERE form IN (SELECT key FROM x) UNION SELECT part FROM cut WHERE form IN (SELECT form FROM stems))
SELECT word FROM part GROUP BY word HAVING bool_and(part IN (SELECT part FROM good)) UNION SELECT word FROM w WHERE word IN (SELECT key FROM x)""")
def known_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+(?:-[\p{L}]+)*)"), 1)).alias("word")).distinct()
    lexicon = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("key")).distinct()
    return books.known(words, lexicon, _ENDINGS, _SUFFIXES, _PREFIXES)


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT doc_id, array_to_string(list(word ORDER BY n, word)[1:8], ' ') AS rarest FROM w JOIN n USING (word) GROUP BY doc_id""")
def rarest_words(spark, sf_dir):
    return books.rarest(table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("word")), "doc_id")


@query(r"""WITH h AS (SELECT source AS file, doc_id AS unit, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS word FROM documents)
SELECT 'file' AS kind, file AS name, count(DISTINCT unit) AS n FROM h GROUP BY file UNION ALL (SELECT 'word', word, count(*) FROM h GROUP BY word ORDER BY count(*) DESC, word LIMIT 40)""")
def word_hits_report(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("unit"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1)).alias("word"))
    return books.word_report(hits)


# ---- two versions of a text

_SIDES = """r AS (SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS ref FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN turn ELSE turn - 1 END AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS hyp FROM conversations WHERE role = 'assistant')"""


def _side(spark: SparkSession, sf_dir: str, role: str, turn) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").filter(F.col("role") == role).select("conv_id", turn.alias("id"), pos.cast("long").alias("pos"), "text")


@query(f"""WITH {_SIDES}, j AS (SELECT r.conv_id, r.pos, ref, hyp FROM r LEFT JOIN h ON r.conv_id = h.conv_id AND r.id = h.id), l AS (SELECT conv_id, 2 * count(*) FILTER (hyp IS NULL) > count(*) AS place FROM j GROUP BY conv_id)
SELECT j.conv_id, pos, ref, hyp FROM j JOIN l USING (conv_id) WHERE NOT place UNION ALL SELECT r.conv_id, r.pos, ref, hyp FROM r JOIN l USING (conv_id) JOIN h ON r.conv_id = h.conv_id AND r.pos = h.pos WHERE place""")
def reference_and_hypothesis(spark, sf_dir):
    shifted = F.when(F.col("conv_id") % 3 == 0, F.col("turn")).otherwise(F.col("turn") - 1)
    return books.paired(_side(spark, sf_dir, "user", F.col("turn")), _side(spark, sf_dir, "assistant", shifted), "conv_id")


_SENT_SQL = r"[.!?]\s+"


@query(rf"""WITH p AS (SELECT a.conv_id, a.turn, regexp_split_to_array(a.text, '{_SENT_SQL}') AS s, regexp_split_to_array(b.text, '{_SENT_SQL}') AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
k AS (SELECT conv_id, turn, s, o, len(s) AS n, len(o) AS m, unnest(range(0, len(s))) AS k FROM p), c AS (SELECT *, CAST(floor((2 * k * (m - 1) + greatest(1, n - 1)) / (2 * greatest(1, n - 1))) AS BIGINT) AS c FROM k),
b AS (SELECT *, CASE WHEN n = m THEN k ELSE greatest(c - 1, 0) END AS lo, CASE WHEN n = m THEN k ELSE least(c + 1, m - 1) END AS hi FROM c)
SELECT conv_id, turn, k, s[k + 1] AS sentence, array_to_string(o[lo + 1 : hi + 1], ' ') AS partners FROM b""")
def sentence_partners(spark, sf_dir):
    from textloom.plans.catalogue import turn_pairs

    cut = turn_pairs(spark, sf_dir).select("conv_id", "turn", F.split("src", _SENT_SQL).alias("s"), F.split("out", _SENT_SQL).alias("o"))
    each = cut.select("conv_id", "turn", "o", F.size("s").cast("long").alias("n"), F.size("o").cast("long").alias("m"), F.posexplode("s").alias("k", "sentence"))
    low, high = books.partners(F.col("n"), F.col("m"), F.col("k").cast("long"))
    joined = F.array_join(F.slice("o", (low + 1).cast("int"), (high - low + 1).cast("int")), " ")
    return each.select("conv_id", "turn", F.col("k").cast("long").alias("k"), "sentence", joined.alias("partners"))


@query("""SELECT s.source, d.doc_id, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id) JOIN (SELECT DISTINCT source FROM documents) s ON s.source = d.source""")
def missing_counterparts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of")).distinct()
    docs = table(spark, sf_dir, "documents")
    return docs.join(labels, docs.doc_id == F.col("of"), "left").select("source", "doc_id", F.col("of").isNull().alias("missing"))


@query(r"""WITH m AS (SELECT d.source, d.doc_id, d.doc_id || ' ' || d.lang AS line FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, line, count(*) OVER (PARTITION BY source) AS n FROM m)
SELECT source, place, line FROM r WHERE place <= 15 UNION ALL SELECT DISTINCT source, 16, '… ' || (n - 15) || ' more' FROM r WHERE n > 15""")
def capped_report(spark, sf_dir):
    docs = missing_counterparts(spark, sf_dir).filter("missing").select("source", "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return books.capped_report(docs.withColumn("line", F.concat_ws(" ", F.col("doc_id").cast("string"), "lang")), "source", "doc_id", "line")


_TURNS = "p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS out FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


@query(rf"""WITH {_TURNS}, a AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(src), '[\p{{L}}0-9]+')) AS w FROM p), b AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(out), '[\p{{L}}0-9]+')) AS w FROM p),
u AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY ALL), v AS (SELECT conv_id, turn, w, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT coalesce(u.conv_id, v.conv_id) AS conv_id, coalesce(u.turn, v.turn) AS turn, coalesce(u.w, v.w) AS w, coalesce(u.n, 0) - coalesce(v.n, 0) AS d FROM u FULL JOIN v ON u.conv_id = v.conv_id AND u.turn = v.turn AND u.w = v.w)
SELECT conv_id, turn, CAST(sum(greatest(d, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-d, 0)) AS BIGINT) AS extra, CAST(sum(CASE WHEN regexp_matches(w, '^[0-9]+$') THEN greatest(d, 0) ELSE 0 END) AS BIGINT) AS numbers, CAST(3 * sum(greatest(d, 0)) + sum(greatest(-d, 0)) + 5 * sum(CASE WHEN regexp_matches(w, '^[0-9]+$') THEN greatest(d, 0) ELSE 0 END) AS BIGINT) AS score FROM j GROUP BY conv_id, turn""")
def page_scores(spark, sf_dir):
    from textloom.plans.catalogue import turn_pairs

    pairs = turn_pairs(spark, sf_dir)
    word = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}0-9]+)"), 1)).alias("w")
    signed = pairs.select("conv_id", "turn", word("src"), F.lit(1).alias("d")).unionByName(pairs.select("conv_id", "turn", word("out"), F.lit(-1).alias("d")))
    by_word = signed.groupBy("conv_id", "turn", "w").agg(F.sum("d").alias("d"))
    lost = F.greatest(F.col("d"), F.lit(0))
    sums = by_word.groupBy("conv_id", "turn").agg(F.sum(lost).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"), F.sum(F.when(F.col("w").rlike("^[0-9]+$"), lost).otherwise(0)).alias("numbers"))
    return sums.withColumn("score", 3 * F.col("missing") + F.col("extra") + 5 * F.col("numbers"))


@query("""WITH k AS (SELECT doc_id AS unit, regexp_replace(lower(left(text, 60)), '[^a-z]', '', 'g') AS key, CASE n_chars % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'alt' ELSE 'none' END AS kind FROM documents), m AS (SELECT key, 'w' AS word, arg_max(kind, unit) AS kind FROM k GROUP BY key),
t AS (SELECT item_id AS id, regexp_replace(lower(left(text, 60)), '[^a-z]', '', 'g') AS key FROM benchmark UNION ALL SELECT doc_id, regexp_replace(lower(left(text, 60)), '[^a-z]', '', 'g') FROM documents)
SELECT id, t.key, 'w' AS word, coalesce(kind, 'own') AS kind, CASE WHEN coalesce(kind, 'own') = 'own' THEN 'target' END AS target FROM t LEFT JOIN m USING (key)""")
def sense_map(spark, sf_dir):
    # The key is the feature: paragraphs are known by how they begin.
    key = tx.paragraph_key(F.substring("text", 1, 60)).alias("key")
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") % 3 == 0, "own").when(F.col("n_chars") % 3 == 1, "alt").otherwise("none")
    found = books.sense_map(docs.select(key, F.col("doc_id").alias("unit"), F.lit("w").alias("word"), kind.alias("kind")))
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), key).unionByName(docs.select(F.col("doc_id").alias("id"), key))
    return books.with_senses(terms.select("id", "key", F.lit("w").alias("word"), F.lit("target").alias("target")), found).select("id", "key", "word", "kind", "target")


# ---- predicates and text functions

@query(r"""SELECT conv_id, turn, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_-])the(?:$|[^\p{L}\p{N}_(-])') AS has_the, regexp_matches(text, '^ *[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*[.:]? *$') AND len(trim(text, ' ')) <= 30 AND regexp_matches(text, '[a-z]') AS camel, trim(text, ' ') <> '' AND (len(trim(text, ' ')) <= 3 OR NOT regexp_matches(text, '[A-Za-z]{4}')) AND lower(trim(text, ' ')) NOT IN ('a','an','the','not','all','and','or','is','any','no') AS variable, regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:t\.me/|vk\.com/)|telegram|телеграм') AS ad, regexp_matches(text, '^[0-9\s.,:;%±≥≤<>=+–—−×/()-]+$') AS numeric, nullif(regexp_extract(text, '^\s*([A-J](?:, [A-J])*)\.\s', 1), '') AS answers,
len(regexp_replace(text, '\p{Cf}', '', 'g')) <> len(text) AS invisible, CAST(len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS BIGINT) AS n_words FROM conversations""")
def paragraph_predicates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pr.has_word(F.lower(t), "the").alias("has_the"), (pr.name_only(t) & t.rlike("[a-z]")).alias("camel"), pr.is_variable(t, ["a", "an", "the", "not", "all", "and", "or", "is", "any", "no"]).alias("variable"), pr.ad_line(t).alias("ad"), pr.numeric_cell(t).alias("numeric"), pr.answer_letters(t).alias("answers"), t.rlike(r"\p{Cf}").alias("invisible"), F.regexp_count(t, F.lit("[A-Za-z]{2,}")).cast("long").alias("n_words"))


@query(r"""SELECT page_id, CAST(len(regexp_replace(regexp_replace(html, '(?is)<pre\b.*?</pre>', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS BIGINT) AS n_stripped, regexp_replace(left(html, 400), '<(/?)(b|i|em|p)>', '‹\1\2›', 'g') AS escaped, CAST(len(regexp_extract_all(html, '(?i)</code>[a-z]')) AS BIGINT) AS glued FROM pages""")
def stripped_pages(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.without_tags(html)).cast("long").alias("n_stripped"), tx.escaped_tags(F.substring(html, 1, 400), ["b", "i", "em", "p"]).alias("escaped"), F.regexp_count(html, F.lit("(?i)</code>[a-z]")).cast("long").alias("glued"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_split_to_array(text, '[.] ') AS s FROM documents), c AS (SELECT doc_id, text, s, array_to_string(s[1 : len(s) - 1], '. ') AS kept FROM s), n AS (SELECT doc_id, text, s, kept, regexp_extract(text, '([0-9]{1,9})', 1) AS num FROM c)
SELECT doc_id, CASE WHEN len(s) > 1 AND len(kept) * 10 >= len(text) * 4 THEN kept || '.' ELSE text END AS cut, CASE WHEN num <> '' THEN left(text, instr(text, num) - 1) || CASE WHEN CAST(num AS BIGINT) < 10 THEN CAST(num AS BIGINT) + 2 ELSE CAST(num AS BIGINT) * 2 END || substring(text, instr(text, num) + len(num)) ELSE text END AS renumbered FROM n""")
def corrupted_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.without_last_sentence(F.col("text")).alias("cut"), tx.other_number(F.col("text")).alias("renumbered"))


@query("""WITH r AS (SELECT o_orderkey, 'b' || o_custkey || '_epub_p' || (o_orderkey % 90) || '-' || (o_orderkey % 90 + 7) AS name FROM orders) SELECT o_orderkey, regexp_extract(name, '^(.+)_epub_p([0-9]+)-([0-9]+)$', 1) AS book, CAST(regexp_extract(name, '^(.+)_epub_p([0-9]+)-([0-9]+)$', 2) AS BIGINT) AS first, CAST(regexp_extract(name, '^(.+)_epub_p([0-9]+)-([0-9]+)$', 3) AS BIGINT) AS last FROM r""")
def page_runs(spark, sf_dir):
    start = F.col("o_orderkey") % 90
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("b"), "o_custkey", F.lit("_epub_p"), start, F.lit("-"), start + 7).alias("name"))
    return named.select("o_orderkey", *tx.page_run(F.col("name")))


# ---- sets, statistics, windows, layout

@query(r"""WITH a AS (SELECT lang AS side, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents), b AS (SELECT role AS side, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations) SELECT w, count(*) AS n, count(DISTINCT side) AS sides FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY w""")
def multiset_union(spark, sf_dir):
    word = F.explode(tx.words(F.col("text"))).alias("w")
    parts = [table(spark, sf_dir, name).select(F.col(side).alias("side"), word).groupBy("side", "w").agg(F.count("*").alias("n")) for name, side in (("documents", "lang"), ("conversations", "role"))]
    return parts[0].unionByName(parts[1]).groupBy("w").agg(F.sum("n").alias("n"), F.count_distinct("side").alias("sides"))


@query(r"""WITH f AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '\b([A-Z][A-Z0-9]{1,5})\b', 1)), lambda x: x NOT IN ('THE', 'OF')) AS l FROM documents) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_sort(l), ' ') AS acronyms FROM f""")
def acronyms_but_kept(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{1,5})(?![A-Za-z0-9_])"), 1)
    left = F.array_except(F.array_distinct(found), F.array(F.lit("THE"), F.lit("OF")))
    return table(spark, sf_dir, "documents").select("doc_id", left.alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.array_join(F.array_sort("l"), " ").alias("acronyms"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey % 5 AS model, [CAST(l_quantity AS DOUBLE), CAST(l_linenumber * 3 AS DOUBLE), CAST(l_partkey % 50 AS DOUBLE)] AS q FROM lineitem), r AS (SELECT model, (q[1] + q[2] + q[3]) / 3 AS mean, greatest(q[1], q[2], q[3]) AS most FROM s)
SELECT model, count(*) AS n, count(*) FILTER (most > 40) AS spans, round(avg(mean), 6) AS mean_of_means, round(avg(most), 6) AS mean_of_most FROM r GROUP BY model""")
def model_means(spark, sf_dir):
    q = F.array(F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 3).cast("double"), (F.col("l_partkey") % 50).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("model"), tx.mean_of(q).alias("mean"), F.array_max(q).alias("most"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("most") > 40).alias("spans"), F.round(F.avg("mean"), 6).alias("mean_of_means"), F.round(F.avg("most"), 6).alias("mean_of_most"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def order_windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    near = F.count("*").over(w.rangeBetween(-1000, Window.currentRow))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), near.alias("near"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT regexp_extract_all(lower(line), '[\p{L}]+') AS w FROM l), e AS (SELECT unnest(w[1 : len(w) - 1]) AS word FROM w) SELECT word, count(*) AS n FROM e GROUP BY word""")
def hyphenation_vocabulary(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(tx.words(F.col("line")).alias("w"))
    inner = lines.select(F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("word"))
    return inner.groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey % 2 AS parity, floor(l_quantity * 2) / 2 AS x FROM lineitem), c AS (SELECT parity, x, count(*) AS n FROM g GROUP BY ALL) SELECT parity, CAST(x AS DOUBLE) AS margin, n FROM c QUALIFY row_number() OVER (PARTITION BY parity ORDER BY n DESC, x) = 1""")
def code_margin(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("parity"), (F.floor(F.col("l_quantity") * 2) / 2).cast("double").alias("margin"))
    return statistics.exact_mode(rows, "parity", "margin").select("parity", "margin", "n")


@query("""WITH g AS (SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_quantity AS DOUBLE) AS x0 FROM lineitem), m AS (SELECT *, min(x0) OVER (PARTITION BY page) AS base FROM g) SELECT page, no, repeat(' ', CAST(floor((x0 - base) / 6 + 0.5) AS BIGINT)) || 'x' AS line FROM m""")
def code_indents(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.col("l_quantity").cast("double").alias("x0"))
    base = F.min("x0").over(Window.partitionBy("page"))
    return lines.select("page", "no", F.concat(F.repeat(F.lit(" "), F.floor((F.col("x0") - base) / 6 + 0.5).cast("int")), F.lit("x")).alias("line"))


@query("""WITH g AS (SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_extendedprice AS DOUBLE) % 60 AS top, l_suppkey % 2 AS x FROM lineitem), o AS (SELECT *, lag(top) OVER w AS t, lag(x) OVER w AS lx FROM g WINDOW w AS (PARTITION BY page ORDER BY top, no)),
s AS (SELECT page, no, CASE WHEN t IS NULL OR top - t >= 8 OR x <> lx THEN 1 ELSE 0 END AS new, top FROM o) SELECT page, no, CAST(sum(new) OVER (PARTITION BY page ORDER BY top, no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS callout FROM s""")
def callout_groups(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), (F.col("l_extendedprice").cast("double") % 60).alias("top"), (F.col("l_suppkey") % 2).alias("x"))
    # Tables repeat line numbers: what the SQL leaves open goes by x, so that the answer hangs on rows alone.
    w = Window.partitionBy("page").orderBy(*[F.asc_nulls_last(c) for c in ("top", "no", "x")])
    new = F.lag("top").over(w).isNull() | (F.col("top") - F.lag("top").over(w) >= 8) | (F.col("x") != F.lag("x").over(w))
    return g.withColumn("new", new.cast("int")).select("page", "no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("callout"))


@query("""WITH w AS (SELECT event_type, value, ts, unnest(range(0, 3)) AS k FROM events), s AS (SELECT event_type, value, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 5 MINUTE AS started FROM w) SELECT started, event_type, count(*) AS n FROM s GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return progress.sliding(table(spark, sf_dir, "events"), "ts", "15 minutes", "5 minutes", "event_type")


# ---- texts mended, runs, glyphs

@query(r"""SELECT conv_id, turn, replace(replace(replace(replace(left(text, 300), 'fi', 'ﬁ'), 'ﬁ', 'fi'), chr(160), ' '), 'ё', 'е') AS plain, regexp_replace(left(text, 300), '⟦[^⟧]*⟧', ' ', 'g') AS unmarked, regexp_replace('⟪' || role || '⟫ ' || left(text, 40), '⟪([^⟫]*)⟫', '<em>\1</em>', 'g') AS italic,
CASE WHEN turn BETWEEN 1 AND 20 THEN substring('❶❷❸❹❺❻❼❽❾❿⓫⓬⓭⓮⓯⓰⓱⓲⓳⓴', turn, 1) ELSE '(' || turn || ')' END AS number, CASE role WHEN 'user' THEN 'Reader' WHEN 'assistant' THEN 'Helper' ELSE role END AS named FROM conversations""")
def mended_texts(spark, sf_dir):
    t = F.substring("text", 1, 300)
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.folded_yo(tx.without_ligatures(F.replace(t, F.lit("fi"), F.lit("ﬁ")))).alias("plain"), tx.without_marks(t).alias("unmarked"), tx.italics(F.concat(F.lit("⟪"), "role", F.lit("⟫ "), F.substring("text", 1, 40))).alias("italic"), tx.circled(F.col("turn")).alias("number"), tx.translated(F.col("role"), {"user": "Reader", "assistant": "Helper"}).alias("named"))


@query(r"""WITH c AS (SELECT page_id, html, instr(html, 'p>') AS place FROM pages), r AS (SELECT page_id, place, substring(html, place + 2, 200) AS rest FROM c WHERE place > 0) SELECT page_id, CASE WHEN regexp_matches(rest, '^<sup(?:[^\p{L}]|$)|^<a(?:[^\p{L}>][^>]*)?>\s*<sup') THEN 'footnote' WHEN starts_with(rest, '<') THEN 'tag' WHEN rest = '' OR regexp_matches(rest, '^\s') THEN 'space' ELSE 'text' END AS context FROM r""")
def contexts_after(spark, sf_dir):
    at = F.instr("html", F.lit("p>"))
    return table(spark, sf_dir, "pages").filter(at > 0).select("page_id", tx.context_after(F.substring("html", at + 2, F.lit(200))).alias("context"))


@query("""WITH a AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS attempt, CAST(ts AS DATE) AS unit, event_type <> 'error' AS ok, value > 50 AS marks_ok FROM events), f AS (SELECT job, unit, min(attempt) FILTER (ok AND marks_ok) AS good FROM a GROUP BY ALL), b AS (SELECT a.*, f.good, lag(marks_ok) OVER (PARTITION BY a.job, a.unit ORDER BY attempt) AS before FROM a JOIN f ON a.job = f.job AND a.unit = f.unit)
SELECT job, event_id, attempt FROM b WHERE attempt <= 3 AND (good IS NULL OR attempt <= good) AND (attempt < 3 OR NOT before)""")
def attempts_made(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.to_date("ts").alias("unit"), (F.col("event_type") != "error").alias("ok"), (F.col("value") > 50).alias("marks_ok"))
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("job", "unit").orderBy("event_id")).cast("long"))
    return books.attempts(rows, ["job", "unit"]).select("job", "event_id", "attempt")


@query("""WITH g AS (SELECT l_orderkey AS page, l_linenumber AS no, CASE WHEN l_suppkey % 4 = 0 THEN 'Courier-Bold' WHEN l_suppkey % 4 = 1 THEN 'Serif-BoldItalic' WHEN l_suppkey % 4 = 2 THEN 'Serif-Italic' ELSE 'Serif' END AS font, CAST(l_quantity AS DOUBLE) AS size, l_returnflag || l_linenumber AS text FROM lineitem), s AS (SELECT *, max(size) OVER (PARTITION BY page) AS line FROM g)
SELECT page, no, CASE WHEN font LIKE 'Courier%' THEN 'code' WHEN size < 0.75 * line AND regexp_matches(substring(text, 2), '^[0-9*†‡]') THEN 'sup' WHEN font LIKE '%Bold%' AND font LIKE '%Ital%' THEN 'strongem' WHEN font LIKE '%Bold%' THEN 'strong' WHEN font LIKE '%Ital%' THEN 'em' ELSE 'p' END AS class FROM s""")
def glyph_classes(spark, sf_dir):
    kind = F.col("l_suppkey") % 4
    font = F.when(kind == 0, "Courier-Bold").when(kind == 1, "Serif-BoldItalic").when(kind == 2, "Serif-Italic").otherwise("Serif")
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), font.alias("font"), F.col("l_quantity").cast("double").alias("size"), F.col("l_linenumber").cast("string").alias("text"))
    return g.select("page", "no", glyphs.glyph_class("font", "size", F.max("size").over(Window.partitionBy("page")), "text").alias("class"))


@query("""SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_quantity AS DOUBLE) AS x0, CASE WHEN l_returnflag = 'A' THEN 800 - CAST(l_linenumber AS DOUBLE) - 10 ELSE CAST(l_linenumber AS DOUBLE) END AS top, CASE WHEN l_returnflag = 'A' THEN 800 - CAST(l_linenumber AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) + 10 END AS bottom FROM lineitem""")
def upright_boxes(spark, sf_dir):
    y = F.col("l_linenumber").cast("double")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.col("l_quantity").cast("double").alias("x0"), y.alias("low"), (y + 10).alias("high"), F.when(F.col("l_returnflag") == "A", "BOTTOMLEFT").otherwise("TOPLEFT").alias("origin"))
    return boxes.select("page", "no", "x0", *glyphs.upright("low", "high", "origin", F.lit(800.0)))


@query("""WITH g AS (SELECT l_orderkey AS block, CAST(l_quantity AS DOUBLE) AS size FROM lineitem), c AS (SELECT block, size, count(*) AS n FROM g GROUP BY ALL), d AS (SELECT block, size, sum(n) OVER (PARTITION BY block) AS n FROM c QUALIFY row_number() OVER (PARTITION BY block ORDER BY c.n DESC, size) = 1) SELECT block, size AS dominant FROM d WHERE n <= 80 AND size >= 1.5 * 24""")
def large_type(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_quantity").cast("double").alias("size"))
    return glyphs.large_type(g, "block", "size", 24.0)


@query("""WITH g AS (SELECT l_returnflag AS book, l_orderkey * 10 + l_linenumber AS id, l_linestatus = 'O' AS code FROM lineitem), p AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_quantity > 5) SELECT book, count(*) FILTER (code) AS total, count(*) FILTER (code AND p.id IS NOT NULL) AS placed, count(*) FILTER (code AND p.id IS NULL) AS lost FROM g LEFT JOIN p ON g.id = p.id GROUP BY book""")
def glyphs_conserved(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("book"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linestatus") == "O").alias("code"), "l_quantity")
    return glyphs.conserved(g.drop("l_quantity"), g.filter("l_quantity > 5").select("id"), "book")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, line, regexp_extract(lower(line), '([\\p{L}]+)[^\\p{L}]*$', 1) AS tail FROM w), v AS (SELECT tail AS word, count(*) AS n FROM n WHERE tail <> '' GROUP BY tail),
p AS (SELECT DISTINCT tail, left(tail, len(tail) // 2) AS a, substring(tail, len(tail) // 2 + 1) AS b FROM n WHERE len(tail) >= 2) SELECT tail, coalesce(h.n, 0) > coalesce(j.n, 0) OR (coalesce(h.n, 0) = coalesce(j.n, 0) AND contains(a, '-')) AS keep FROM p LEFT JOIN v j ON j.word = a || b LEFT JOIN v h ON h.word = a || '-' || b""".replace("\\\\p", "\\p"))
def kept_hyphens(spark, sf_dir):
    tails = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.regexp_extract(F.lower("line"), r"([\p{L}]+)[^\p{L}]*$", 1).alias("tail")).filter("tail <> ''")
    vocabulary = tails.groupBy(F.col("tail").alias("word")).agg(F.count("*").alias("n"))
    half = F.floor(F.length("tail") / 2).cast("int")
    breaks = tails.distinct().filter(F.length("tail") >= 2).select("tail", F.substring("tail", F.lit(1), half).alias("a"), F.substring("tail", half + 1, F.length("tail")).alias("b"))
    return glyphs.hyphens_kept(breaks, vocabulary).select("tail", "keep")


@query("""WITH f AS (SELECT user_id AS job, max(ts) FILTER (event_type = 'purchase') AS a, max(ts) FILTER (event_type = 'view') AS b, min(ts) FILTER (event_type = 'error') AS lock FROM events GROUP BY user_id) SELECT job, greatest(a, b) AS latest, coalesce(a >= lock, false) AS finished FROM f""")
def latest_activity(spark, sf_dir):
    kind = F.col("event_type")
    times = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max(F.when(kind == "purchase", F.col("ts"))).alias("a"), F.max(F.when(kind == "view", F.col("ts"))).alias("b"), F.min(F.when(kind == "error", F.col("ts"))).alias("lock"))
    return times.select("job", F.greatest("a", "b").alias("latest"), F.coalesce(F.col("a") >= F.col("lock"), F.lit(False)).alias("finished"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS name FROM part WHERE NOT starts_with(p_brand, 'Brand#5')) SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'Brand#33' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, name) AS place FROM m""")
def models_in_order(spark, sf_dir):
    return runs.listed_models(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), ["Brand#33", "Brand#12"], ["Brand#5"])


@query("""WITH j AS (SELECT o_orderkey AS id, o_custkey AS book, o_orderstatus AS state, 'm' || o_orderkey % 3 AS model FROM orders) SELECT id, NOT (state = 'F' AND id % 3 = 0) AS kept, state = 'O' AND model <> (SELECT min(b.model) FROM j b WHERE b.book = j.book AND b.state = 'P') AS conflict FROM j""")
def job_decisions(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book"), F.col("o_orderstatus").alias("state"), F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("model"))
    interrupted = jobs.filter("state = 'P'").groupBy("book").agg(F.min("model").alias("stopped"))
    removed = (F.col("state") == "F") & (F.col("id") % 3 == 0)
    return jobs.join(interrupted, "book", "left").select("id", (~removed).alias("kept"), ((F.col("state") == "O") & (F.col("model") != F.col("stopped"))).alias("conflict"))
