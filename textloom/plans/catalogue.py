"""All registered queries of the engine's own operators, each with the SQL that DuckDB runs for it.

Every query reads whole tables.  Names of columns are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import context, glossary, layout, matching, multisets, selection, statistics
from textloom.sources import html_units
from textloom.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Terms of the test vocabulary: (domain, term).
TERMS = [("a", "the"), ("a", "of the"), ("a", "and the"), ("a", "in the"), ("a", "to the"), ("a", "that"), ("b", "de"), ("b", "de la"), ("b", "que"), ("b", "en"), ("b", "la que"), ("b", "el"), ("c", "der"), ("c", "die"), ("c", "und die"), ("c", "von der"), ("c", "mit der"), ("d", "is"), ("d", "with"), ("d", "of a"), ("d", "by the"), ("d", "from the"), ("d", "on the")]
_TERMS_SQL = "terms(domain, term) AS (VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in TERMS) + ")"
_HITS_SQL = f"""{_TERMS_SQL},
clean AS (SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g') AS t FROM documents),
hits AS (SELECT doc_id, domain, term, CAST(len(regexp_extract_all(t, '\\b' || term || '\\b')) AS BIGINT) AS n FROM clean, terms WHERE regexp_matches(t, '\\b' || term || '\\b'))"""


def terms_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "domain string, term string")


@query(f"""WITH {_HITS_SQL},
d AS (SELECT doc_id, domain, count(*) AS n_terms, count(*) FILTER (contains(term, ' ')) AS n_multi, CAST(sum(n) AS BIGINT) AS occurrences FROM hits GROUP BY ALL),
s AS (SELECT *, CAST(sum(n_multi) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM d)
SELECT doc_id, domain, n_terms, n_multi, occurrences, CASE WHEN total > 0 THEN round(n_multi / total, 4) ELSE 0.0 END::DOUBLE AS share,
(n_multi >= 3 AND 1000 * n_multi > 145 * total) OR (n_multi >= 8 AND 1000 * n_multi > 75 * total) AS suggested FROM s""")
def domain_detect(spark, sf_dir):
    return matching.domain_detect(table(spark, sf_dir, "documents"), terms_of(spark))


@query(f"WITH {_HITS_SQL} SELECT doc_id, term, n FROM hits")
def term_occurrences_per_doc(spark, sf_dir):
    return matching.term_occurrences(table(spark, sf_dir, "documents"), terms_of(spark))


@query(f"""WITH {_HITS_SQL} SELECT doc_id, domain, term, n, row_number() OVER (PARTITION BY doc_id, domain ORDER BY n DESC, term DESC) AS place
FROM hits WHERE NOT contains(term, ' ') QUALIFY place <= 3""")
def top_terms_per_domain(spark, sf_dir):
    return matching.top_terms(table(spark, sf_dir, "documents"), terms_of(spark))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:\bof the\b|\band the\b|\bthe\b|\bof\b)')) AS BIGINT) AS english,
CAST(len(regexp_extract_all(text, '(?i)(?:\bvon der\b|\bmit der\b|\bder\b)')) AS BIGINT) AS german FROM documents""")
def alternation_counts(spark, sf_dir):
    return matching.alternation_counts(table(spark, sf_dir, "documents"), {"english": ["the", "of", "of the", "and the"], "german": ["der", "von der", "mit der"]})


_PART = "SELECT p_brand AS domain, p_type AS source, p_name AS target, p_partkey AS ord, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS prio FROM part"


def parts_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("source"), F.col("p_name").alias("target"), F.col("p_partkey").alias("ord"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("prio"))


@query(f"WITH e AS ({_PART}) SELECT lower(source) AS key, domain, source, target, ord FROM e QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY prio DESC, ord DESC) = 1")
def glossary_override(spark, sf_dir):
    return glossary.override(parts_as_entries(spark, sf_dir)).select("key", "domain", "source", "target", "ord")


@query(f"WITH e AS ({_PART}), l AS (SELECT source, target, ord, lag(target) OVER (PARTITION BY lower(source) ORDER BY prio, ord) AS previous FROM e) SELECT * FROM l WHERE previous IS NOT NULL AND previous <> target")
def glossary_conflicts(spark, sf_dir):
    return glossary.conflicts(parts_as_entries(spark, sf_dir)).select("source", "target", "ord", "previous")


#: A table of exceptions that the query gives; ``plural_forms_of_terms`` takes the engine's own.
_EXCEPTIONS = {"child": ["children"], "person": ["people", "persons"], "index": ["indexes", "indices"], "matrix": ["matrices"]}
_NO_PLURAL = ["data", "software", "hardware", "information", "middleware", "metadata"]
_WORDS = ["child", "person", "index", "matrix", "data", "hardware", "class", "bus", "analysis", "box", "branch", "quiz", "query", "key", "node", "nodes", "GPU", "DNS", "open file", "open index", "two-way", "of", "Node"]


@query(
    "WITH w(term) AS (VALUES " + ", ".join(f"('{w}')" for w in _WORDS) + r"""),
s AS (SELECT term, string_split(term, ' ')[-1] AS word FROM w),
f AS (SELECT term, left(term, len(term) - len(word)) AS stem, CASE
 WHEN NOT regexp_matches(word, '^[a-z]{3,}$') OR word IN ('data','software','hardware','information','middleware','metadata') THEN CAST([] AS VARCHAR[])
 WHEN regexp_matches(word, 's$') AND NOT regexp_matches(word, '(ss|us|is|as)$') THEN CAST([] AS VARCHAR[])
 WHEN word = 'child' THEN ['children'] WHEN word = 'person' THEN ['people', 'persons'] WHEN word = 'index' THEN ['indexes', 'indices'] WHEN word = 'matrix' THEN ['matrices']
 WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN [word || 'es'] WHEN regexp_matches(word, '[^aeiou]y$') THEN [left(word, len(word) - 1) || 'ies'] ELSE [word || 's'] END AS forms FROM s)
SELECT term, stem || unnest(forms) AS form FROM f"""
)
def plural_forms(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in _WORDS], "term string").select("term", F.explode(tx.plurals(F.col("term"), _EXCEPTIONS, _NO_PLURAL)).alias("form"))


_COORD_TERMS = [(f"{a} {b}",) for a in ("the", "in", "of", "that", "on") for b in ("is", "the", "of", "to", "a", "in", "was", "be")]


@query(
    "WITH terms(term) AS (VALUES " + ", ".join(f"('{t}')" for (t,) in _COORD_TERMS) + r"""),
p AS (SELECT unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])([a-z]+ (?:and|or) [a-z]+ [a-z]+)', 1)) AS phrase FROM documents),
c AS (SELECT phrase, count(*) AS n FROM p GROUP BY phrase), s AS (SELECT phrase, n, string_split(phrase, ' ') AS w FROM c)
SELECT phrase, n FROM s WHERE w[1] || ' ' || w[4] IN (SELECT term FROM terms) AND w[3] || ' ' || w[4] IN (SELECT term FROM terms)"""
)
def coordinations(spark, sf_dir):
    return glossary.coordinations(table(spark, sf_dir, "documents"), spark.createDataFrame(_COORD_TERMS, "term string"))


def counted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.pmod(F.col("doc_id"), F.lit(7)) == 0
    units = docs.select(F.col("source").alias("book"), F.col("lang").alias("ch"), F.col("doc_id").alias("unit_no"), head.alias("head"), tx.count_word(F.lower("text"), "the").alias("own"), tx.count_word(F.lower("text"), "of").alias("alt"))
    # Texts are read once; what follows takes the counts several times.
    return context.with_sections(units.checkpoint(), "book", "unit_no", F.col("head"))


_UNITS = r"""u0 AS (SELECT source AS book, lang AS ch, doc_id AS unit_no, doc_id % 7 = 0 AS head, CAST(len(regexp_extract_all(lower(text), '\bthe\b')) AS BIGINT) AS own, CAST(len(regexp_extract_all(lower(text), '\bof\b')) AS BIGINT) AS alt FROM documents),
u AS (SELECT *, CAST(sum(CAST(head AS BIGINT)) OVER (PARTITION BY book ORDER BY unit_no) AS BIGINT) AS sec FROM u0),
c AS (SELECT book, ch, sec, unit_no, own, alt, CAST(sum(own) OVER n AS BIGINT) AS own_near, CAST(sum(alt) OVER n AS BIGINT) AS alt_near, CAST(sum(own) OVER s AS BIGINT) AS own_sec, CAST(sum(alt) OVER s AS BIGINT) AS alt_sec, CAST(sum(own) OVER h AS BIGINT) AS own_ch, CAST(sum(alt) OVER h AS BIGINT) AS alt_ch FROM u
WINDOW n AS (PARTITION BY book ORDER BY unit_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), s AS (PARTITION BY book, sec), h AS (PARTITION BY book, ch))"""


@query(f"WITH {_UNITS} SELECT book, ch, sec, unit_no, own, alt, own_near, alt_near, own_sec, alt_sec, own_ch, alt_ch FROM c")
def neighbour_context(spark, sf_dir):
    return context.context_counts(counted_units(spark, sf_dir)).select("book", "ch", "sec", "unit_no", "own", "alt", "own_near", "alt_near", "own_sec", "alt_sec", "own_ch", "alt_ch")


_STEP = "CASE WHEN {0} + {1} >= 2 THEN CASE WHEN {0} >= 2 * {1} THEN 'own' WHEN {1} >= 2 * greatest({0}, 1) THEN 'alt' END END"


@query(f"WITH {_UNITS} SELECT unit_no, coalesce({', '.join(_STEP.format('own' + s, 'alt' + s) for s in ('', '_near', '_sec', '_ch'))}) AS decided FROM c")
def evidence_ladder(spark, sf_dir):
    units = context.context_counts(counted_units(spark, sf_dir))
    return units.select("unit_no", context.ladder([(F.col("own" + s), F.col("alt" + s)) for s in ("", "_near", "_sec", "_ch")]).alias("decided"))


@query(r"""WITH s AS (SELECT doc_id AS unit, unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT unit, regexp_matches(line, '(^|[^A-Za-z0-9_])of($|[^A-Za-z0-9_])') AS own_cue, regexp_matches(line, '(^|[^A-Za-z0-9_])to($|[^A-Za-z0-9_])') AS alt_cue, regexp_matches(line, '^Th') AS verb FROM s),
w AS (SELECT unit, verb, CASE WHEN verb THEN 'none' WHEN alt_cue AND NOT own_cue THEN 'alt' WHEN own_cue AND NOT alt_cue THEN 'own' ELSE 'none' END AS vote FROM v)
SELECT unit, 'x' AS word, CASE WHEN count(DISTINCT vote) FILTER (vote <> 'none') <> 1 OR bool_or(verb) THEN 'none' ELSE min(vote) FILTER (vote <> 'none') END AS kind, count(*) AS n_votes FROM w GROUP BY unit""")
def sense_votes(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cue = lambda w: F.col("line").rlike(tx.whole_word(w))
    return context.votes(lines.select("unit", F.lit("x").alias("word"), "pos", cue("of").alias("own_cue"), cue("to").alias("alt_cue"), F.col("line").rlike("^Th").alias("verb"), F.lit("none").alias("fallback")))


@query("""WITH l AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS a FROM documents), r AS (SELECT item_id AS value, regexp_replace(lower(text), '[^a-z]', '', 'g') AS b FROM benchmark), p AS (SELECT id, value, a, b FROM l JOIN r ON left(a, 40) = left(b, 40) WHERE len(a) >= 40 AND len(b) >= 40),
s AS (SELECT id, min(value) AS value FROM p WHERE len(b) BETWEEN len(a) + 1 AND len(a) + 400 AND regexp_matches(b, array_to_string(string_split(a, ''), '[a-z]*')) GROUP BY id HAVING count(DISTINCT b) = 1),
c AS (SELECT id, value, 1 AS tier FROM l JOIN r ON a = b UNION ALL SELECT id, value, 2 FROM p WHERE starts_with(a, b) OR starts_with(b, a) UNION ALL SELECT id, value, 3 FROM s),
f AS (SELECT id, value, CAST(tier AS BIGINT) AS tier FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, value) = 1) SELECT id, value, tier FROM l LEFT JOIN f USING (id)""")
def key_lookup_tiers(spark, sf_dir):
    # All documents, with nulls where nothing matches.
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.paragraph_key(F.col("text")).alias("key"))
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("value"), F.col("item_id").alias("ord"), tx.paragraph_key(F.col("text")).alias("key"))
    return left.select("id").join(matching.key_lookup(left, right, within=400), "id", "left")


@query("""WITH s AS (SELECT d.doc_id, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
w AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY quality NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n_chars) OVER (PARTITION BY source) AS t FROM s)
SELECT doc_id, source, n_chars, CAST(quality AS INTEGER) AS quality FROM w WHERE b * 100 < greatest(t, 1) * 20""")
def hybrid_pick_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return selection.greedy_budget(rows, "n_chars", 20, F.col("quality").isNull(), F.col("quality"), F.col("doc_id"), group="source").select("doc_id", "source", "n_chars", "quality")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_occurrence_dedupe(spark, sf_dir):
    return selection.first_of(table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", "lang")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, value > 50 DESC, event_id) = 1")
def best_attempt(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"good": F.col("event_type") == "purchase", "large": F.col("value") > 50})
    return selection.best_attempt(events, "user_id", "event_id", "good", "large").select("user_id", "event_id", "event_type")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'redo' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'reuse' ELSE 'new' END AS action FROM documents""")
def replay_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return selection.replayed(table(spark, sf_dir, "documents").select("doc_id"), labels, labels.filter("quality = 0"), "doc_id").select("doc_id", "action")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS word FROM documents)
SELECT word, count(DISTINCT doc_id) AS n_units FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 4""")
def jargon_filter(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    return selection.jargon(words, "doc_id", "word")


_TURNS = """p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS out FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    a = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"), (F.col("turn") + 1).alias("next"))
    b = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("out"))
    return a.join(b, ["conv_id", "next"]).drop("next")


_NEG = r"\b(?:not|no|never|without|cannot|nor)\b"


@query(f"WITH {_TURNS}, c AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(src), '{_NEG}')) AS BIGINT) AS src_neg, CAST(len(regexp_extract_all(lower(out), '{_NEG}')) AS BIGINT) AS out_neg FROM p) SELECT * FROM c WHERE src_neg <> out_neg")
def polarity_mismatch(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select("conv_id", "turn", tx.negations(F.col("src")).alias("src_neg"), tx.negations(F.col("out")).alias("out_neg"))
    return pairs.filter("src_neg <> out_neg")


@query("SELECT conv_id, turn, first_value(CASE WHEN role <> 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS body FROM conversations")
def next_body_asof(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", context.next_body(turns, "conv_id", "turn", F.col("role") == "user", "text").alias("body"))


@query(rf"""WITH {_TURNS}, s AS (SELECT conv_id, turn, regexp_split_to_array(src, '[.!?]\s+') AS a, regexp_split_to_array(out, '[.!?]\s+') AS b FROM p),
z AS (SELECT conv_id, turn, unnest(range(len(a))) AS k, a, b FROM s WHERE len(a) = len(b)) SELECT conv_id, turn, k AS pos, a[k + 1] AS src, b[k + 1] AS out FROM z""")
def sentence_zip(spark, sf_dir):
    cut = lambda c: F.split(c, r"[.!?]\s+")
    both = turn_pairs(spark, sf_dir).select("conv_id", "turn", cut("src").alias("a"), cut("out").alias("b")).filter(F.size("a") == F.size("b"))
    return both.select("conv_id", "turn", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("z.a").alias("src"), F.col("z.b").alias("out"))


@query(rf"WITH {_TURNS} SELECT count(*) AS n, count(*) FILTER (len(regexp_split_to_array(src, '[.!?]\s+')) = len(regexp_split_to_array(out, '[.!?]\s+'))) AS equal FROM p")
def sentence_count_agreement(spark, sf_dir):
    size = lambda c: F.size(F.split(c, r"[.!?]\s+"))
    return turn_pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(size("src") == size("out")).alias("equal"))


_WORDS_SQL = r"unnest(regexp_extract_all(lower({}), '[\p{{L}}]+')) AS w"


@query(rf"""WITH {_TURNS}, a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {_WORDS_SQL.format('src')} FROM p) GROUP BY ALL), b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {_WORDS_SQL.format('out')} FROM p) GROUP BY ALL),
j AS (SELECT conv_id, turn, w, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (conv_id, turn, w)) SELECT conv_id, turn, w, CAST(greatest(x - y, 0) AS BIGINT) AS lost, CAST(greatest(y - x, 0) AS BIGINT) AS extra FROM j WHERE x <> y""")
def multiset_lost_extra(spark, sf_dir):
    left, right = (multisets.counted(turn_pairs(spark, sf_dir).select("conv_id", "turn", F.explode(tx.words(F.col(c))).alias("w")), "conv_id", "turn", "w") for c in ("src", "out"))
    return multisets.difference(left, right, ["conv_id", "turn", "w"])


@query(rf"""WITH {_TURNS}, a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {_WORDS_SQL.format('src')} FROM p) GROUP BY ALL), b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {_WORDS_SQL.format('out')} FROM p) GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL""")
def multiset_clipped_overlap(spark, sf_dir):
    left, right = (multisets.counted(turn_pairs(spark, sf_dir).select("conv_id", "turn", F.explode(tx.words(F.col(c))).alias("w")), "conv_id", "turn", "w") for c in ("src", "out"))
    return multisets.overlap(left, right, ["conv_id", "turn", "w"], ["conv_id", "turn"])


@query("WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS k, CAST(30 AS BIGINT) AS n FROM part), j AS (SELECT k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (k)) SELECT k, CAST(greatest(x - y, 0) AS BIGINT) AS lost, CAST(greatest(y - x, 0) AS BIGINT) AS extra FROM j WHERE x <> y")
def multiset_parts(spark, sf_dir):
    left = multisets.counted(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k")
    return multisets.difference(left, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit(30).cast("long").alias("n")), ["k"])


_CHRF = " UNION ALL ".join(f"SELECT id, g, {n} AS o, unnest(list_transform(range(1, len({{0}}) - {n - 1} + 1), lambda i: substring({{0}}, i, {n}))) AS gram FROM t WHERE len({{0}}) >= {n}" for n in range(1, 7))


@query(rf"""WITH {_TURNS}, t AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id % 5 AS BIGINT) AS g, regexp_replace(out, '[ \t\n\r\f\x0b]+', '', 'g') AS hyp, regexp_replace(src, '[ \t\n\r\f\x0b]+', '', 'g') AS ref FROM p),
h AS (SELECT id, g, o, gram, count(*) AS n FROM ({_CHRF.format('hyp')}) GROUP BY ALL), r AS (SELECT id, g, o, gram, count(*) AS n FROM ({_CHRF.format('ref')}) GROUP BY ALL),
j AS (SELECT g, o, coalesce(h.n, 0) AS hn, coalesce(r.n, 0) AS rn FROM h FULL JOIN r USING (id, g, o, gram)), s AS (SELECT g, o, sum(least(hn, rn)) AS m, sum(hn) AS h, sum(rn) AS r FROM j GROUP BY GROUPING SETS ((o, g), (o))),
f AS (SELECT g, avg(m / h) AS p, avg(m / r) AS q FROM s WHERE h > 0 AND r > 0 GROUP BY g) SELECT g, round(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END, 4) AS chrf FROM f""")
def chrf_corpus(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.pmod("conv_id", F.lit(5)).cast("long").alias("g"), F.col("out").alias("hyp"), F.col("src").alias("ref"))
    return multisets.chrf(pairs, "g")


@query("""WITH j AS (SELECT d.lang, d.n_chars AS a, l.quality + 2 * l.toxic AS b FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2 AS rb FROM j)
SELECT lang, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY lang""")
def spearman_ties(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("n_chars").alias("a"), (F.col("quality") + 2 * F.col("toxic")).alias("b"))
    return statistics.spearman(rows, "lang", "a", "b")


@query("""WITH j AS (SELECT d.lang, d.n_chars AS s, l.quality = 1 AS pos FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT lang, pos, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r FROM j)
SELECT lang, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS auc FROM r GROUP BY lang""")
def auc_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "n_chars", "quality")
    return statistics.auc(rows, "lang", "n_chars", F.col("quality") == 1)


@query("WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, n_chars AS threshold, n FROM r WHERE rn = n * 10 // 100 + 1")
def order_stat_threshold(spark, sf_dir):
    return statistics.order_threshold(table(spark, sf_dir, "documents"), "lang", "n_chars", 10)


@query("""WITH j AS (SELECT d.lang, d.n_chars FROM documents d), t(thr) AS (VALUES (500), (1000), (2000), (5000))
SELECT CAST(thr AS BIGINT) AS thr, count(*) FILTER (lang = 'de' AND n_chars < thr) AS de, count(*) FILTER (lang = 'en' AND n_chars < thr) AS en, count(*) FILTER (lang = 'es' AND n_chars < thr) AS es, count(*) FILTER (lang = 'fr' AND n_chars < thr) AS fr FROM j, t GROUP BY thr""")
def threshold_sweep_pivot(spark, sf_dir):
    thresholds = F.explode(F.array(*[F.lit(t).cast("long") for t in (500, 1000, 2000, 5000)]))
    rows = table(spark, sf_dir, "documents").select("lang", "n_chars", thresholds.alias("thr"))
    return rows.groupBy("thr").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count_if(F.col("n_chars") < F.col("thr"))).na.fill(0)


@query(r"""WITH t AS (SELECT source AS book, lang, """ + _WORDS_SQL.format("text") + r""" FROM documents), a AS (SELECT w, count(*) AS n FROM t WHERE lang = 'en' GROUP BY w), b AS (SELECT w, count(*) AS n FROM t GROUP BY w)
SELECT w, a.n AS a, b.n AS b, round(log10((a.n + 1) / (SELECT sum(n) FROM a)) - log10((b.n + 1) / (SELECT sum(n) FROM b)), 6) AS keyness FROM a JOIN b USING (w)""")
def keyness(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(tx.words(F.col("text"))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("e"))
    return statistics.keyness(counts.filter("e > 0").select("w", F.col("e").alias("n")), counts.select("w", "n"))


_TOKENS = r"tok AS (SELECT source AS book, regexp_extract_all(lower(text), '[\p{L}]+') AS t FROM documents)"
_GRAMS = "SELECT book, unnest(list_transform(range(1, len(t) - {0} + 2), lambda i: array_to_string(t[i:i + {0} - 1], ' '))) AS gram FROM tok WHERE len(t) >= {0}"
_TWO_LEVEL = "SELECT gram, CAST(sum(n) AS BIGINT) AS n, count(*) AS books FROM (SELECT book, gram, count(*) AS n FROM ({}) GROUP BY ALL HAVING count(*) >= 2) GROUP BY gram"


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book"), tx.words(F.col("text")).alias("t"))


@query(f"WITH {_TOKENS} {_TWO_LEVEL.format(_GRAMS.format(2))}")
def ngrams_two_level(spark, sf_dir):
    return statistics.repeated_ngrams(token_lists(spark, sf_dir), 2)


@query(f"""WITH {_TOKENS}, b AS ({_TWO_LEVEL.format(_GRAMS.format(2))}), c AS ({_TWO_LEVEL.format(_GRAMS.format(3))}),
i AS (SELECT array_to_string(string_split(gram, ' ')[1:2], ' ') AS gram, n FROM c UNION ALL SELECT array_to_string(string_split(gram, ' ')[2:3], ' '), n FROM c), m AS (SELECT gram, max(n) AS t FROM i GROUP BY gram)
SELECT gram, n, books FROM b LEFT JOIN m USING (gram) WHERE t IS NULL OR t * 10 < n * 8""")
def subsumed_bigrams(spark, sf_dir):
    tokens = token_lists(spark, sf_dir)
    return statistics.unsubsumed(statistics.repeated_ngrams(tokens, 2), statistics.repeated_ngrams(tokens, 3))


@query(r"""WITH c AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, """ + _WORDS_SQL.format("text") + r""" FROM documents) GROUP BY ALL) SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS place FROM c QUALIFY place <= 25""")
def topn_per_kind(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").select("lang", F.explode(tx.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return selection.top_of(counts, ["lang"], 25, F.desc("n"), "w")


@query(r"""WITH s AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT term, source, doc_id, line FROM s, (VALUES ('of the'), ('de la'), ('und die')) t(term) WHERE len(line) <= 260 AND regexp_matches(lower(line), '\b' || term || '\b')),
r AS (SELECT *, row_number() OVER (PARTITION BY term, source ORDER BY doc_id, line) AS k FROM h) SELECT term, line AS example FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY k, source, doc_id, line) <= 2""")
def examples_two_per_term(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") <= 260)
    terms = F.explode(F.array_compact(F.array(*[F.when(F.lower("line").rlike(tx.whole_word(t)), F.lit(t)) for t in ("of the", "de la", "und die")])))
    first = selection.top_of(lines.select("*", terms.alias("term")), ["term", "source"], 2, "doc_id", "line").withColumnRenamed("place", "k")
    return selection.top_of(first, ["term"], 2, "k", "source", "doc_id", "line").select("term", F.col("line").alias("example"))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ROLLUP (tag, page_id) HAVING tag IS NOT NULL""")
def tag_rollup(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.rollup("tag", "page_id").agg(F.count("*").alias("n")).filter("tag is not null").select("page_id", "tag", "n")


@query()
def html_paragraphs(spark, sf_dir):
    return html_units.html_units(table(spark, sf_dir, "pages"))


@query()
def leaf_blocks(spark, sf_dir):
    return html_units.html_units(table(spark, sf_dir, "pages")).filter("leaf")


@query()
def translatable_units(spark, sf_dir):
    units = html_units.html_units(table(spark, sf_dir, "pages"))
    return units.groupBy("page_id").agg(F.count_if(F.col("text").rlike("[A-Za-z]{2}")).alias("n_units"))


@query("SELECT page_id, nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '') AS heading, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, coalesce(nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), url) AS shown FROM pages")
def toc_titles(spark, sf_dir):
    got = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    heading, title = got("<h1[^>]*>([^<]*)</h1>"), got("<title>([^<]*)</title>")
    return table(spark, sf_dir, "pages").select("page_id", heading.alias("heading"), title.alias("title"), F.coalesce(heading, title, "url").alias("shown"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (len(line) > 15 AND NOT regexp_matches(line, '[а-яё]') AND regexp_matches(line, '[A-Za-z]{3}')) AS untranslated,
count(*) FILTER (len(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 20 AND NOT regexp_matches(line, '[а-яё]')) AS latin FROM l GROUP BY doc_id""")
def untranslated(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cyrillic = F.col("line").rlike("[а-яё]")
    return lines.groupBy("doc_id").agg(F.count_if((F.length("line") > 15) & ~cyrillic & F.col("line").rlike("[A-Za-z]{3}")).alias("untranslated"), F.count_if((F.regexp_count("line", F.lit("[A-Za-z]")) >= 20) & ~cyrillic).alias("latin"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\{\{[a-z]+_[0-9]+\}\}|⟦')) AS BIGINT) AS marks_left, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS BIGINT) AS cjk, CAST(len(regexp_extract_all(text, '[#$%&*]{3}')) AS BIGINT) AS junk FROM documents")
def residue(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(r"\{\{[a-z]+_[0-9]+\}\}|⟦").alias("marks_left"), count("[\\u4e00-\\u9fff]").alias("cjk"), count("[#$%&*]{3}").alias("junk"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM l WHERE len(line) > 0 GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 0")
    # Two steps, so that a line of many documents is counted before it meets in one task.
    each = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).filter("n_docs >= 2")


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{Cf}\x{00a0}\x{2009}]|[^\x00-\x7f]')) AS ch FROM documents) SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY ch""")
def invisible_census(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{Cf}  ]|[^\x00-\x7f])"), 1)).alias("ch"))
    each = found.groupBy("ch", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(r"""WITH a AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z0-9]{1,5}$')) AS f, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS u FROM documents),
e AS (SELECT doc_id, x, min(pos) AS pos FROM (SELECT doc_id, unnest(f) AS x, unnest(range(len(f))) AS pos FROM a WHERE NOT (l >= 8 AND u * 10 > l * 7)) GROUP BY ALL)
SELECT doc_id, x AS acronym FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 8""")
def acronyms_first8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.acronyms(F.col("text"))).alias("acronym"))


@query("""WITH k AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), i AS (SELECT o_custkey % 100 AS g, o_orderkey AS v FROM k), s AS (SELECT g, v, v - row_number() OVER (PARTITION BY g ORDER BY v) AS island FROM i)
SELECT CAST(g AS BIGINT) AS g, min(v) AS first, max(v) AS last, count(*) AS n FROM s GROUP BY g, island""")
def islands_chunks(spark, sf_dir):
    return order_islands(table(spark, sf_dir, "orders"))


def order_islands(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.pmod("o_custkey", F.lit(100)).cast("long").alias("g"), F.col("o_orderkey").alias("v"))
    marked = rows.withColumn("island", selection.islands(rows, ["g"], F.col("v")))
    return marked.groupBy("g", "island").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n")).drop("island")


@query("""WITH l AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 AS wide FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, ts, CAST(sum(CAST(coalesce(wide, false) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS block FROM l) SELECT user_id, block, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 3""")
def gap_blocks(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.struct("ts", "event_id"))
    marked = events.withColumn("block", layout.gap_blocks(["user_id"], "k", F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000))
    return marked.groupBy("user_id", "block").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem")
def offset_prefix_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_quantity").cast("long"), "k": F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", layout.offsets(rows, "l_orderkey", "k", "q").alias("start"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, o_orderpriority AS common FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN common ELSE o_orderpriority END AS priority FROM orders JOIN m USING (o_custkey)""")
def mode_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    common = statistics.exact_mode(orders, "o_custkey", "o_orderpriority").select("o_custkey", F.col("o_orderpriority").alias("common"))
    missing = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return orders.join(common, "o_custkey").select("o_orderkey", F.coalesce(missing, "common").alias("priority"))


_BOXES = [(p, f"b{k}", 5.0 * k, 1000.0 * k, 5.0 * k + w, 1000.0 * k + 40000.0) for p in range(1, 8) for k, w in enumerate((60.0, 12.0, 9.0, 25.0, 14.0))]
_BOXES_SQL = "boxes(page, ref, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({p}, '{r}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for p, r, a, b, c, d in _BOXES) + ")"


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("page"), F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))


@query(f"""WITH {_BOXES_SQL}, j AS (SELECT CAST(l_linenumber AS BIGINT) AS page, l_orderkey AS id, ref, (x1 - x0) * (y1 - y0) AS area FROM lineitem JOIN boxes ON l_linenumber = page WHERE l_quantity BETWEEN x0 - 1 AND x1 + 1 AND l_extendedprice BETWEEN y0 - 1 AND y1 + 1)
SELECT page, id, ref FROM j QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY area, ref) = 1""")
def spatial_assign(spark, sf_dir):
    boxes = F.broadcast(spark.createDataFrame(_BOXES, "page long, ref string, x0 double, y0 double, x1 double, y1 double"))  # 35 rows
    return layout.assign_points(points_of(spark, sf_dir), boxes)


@query("""WITH lines(page, line, ly) AS (SELECT p, k, CAST(k * 7000 AS DOUBLE) FROM range(1, 8) a(p), range(0, 16) b(k)), j AS (SELECT CAST(l_linenumber AS BIGINT) AS page, l_orderkey AS id, line, abs(l_extendedprice - ly) AS d FROM lineitem JOIN lines ON l_linenumber = page)
SELECT page, id, line FROM j QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d, line) = 1""")
def nearest_line(spark, sf_dir):
    lines = F.broadcast(spark.createDataFrame([(p, k, k * 7000.0) for p in range(1, 8) for k in range(16)], "page long, line long, ly double"))  # 112 rows
    return layout.nearest_line(points_of(spark, sf_dir), lines)


@query()
def line_clusters(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").cast("double").alias("top"))
    return layout.cluster_lines(words)


def part_edges(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")).distinct()


@query()
def connected_components(spark, sf_dir):
    # All rows form large components, for which recursive SQL is too slow.
    return layout.connected(part_edges(table(spark, sf_dir, "lineitem")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (i % 7))), 3) AS score FROM embeddings")
def dot_score(spark, sf_dir):
    weights = F.array(*[F.lit(float((i + 1) % 7)) for i in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(tx.dot(F.col("embedding"), weights), 3).alias("score"))


@query("""WITH d AS (SELECT doc_id, source, n_chars FROM documents) SELECT a.doc_id, min(b.doc_id) AS other FROM d a JOIN d b ON a.source = b.source AND a.doc_id <> b.doc_id AND b.n_chars * 10 BETWEEN a.n_chars * 7 AND a.n_chars * 14 WHERE a.doc_id % 50 = 0 GROUP BY a.doc_id""")
def band_join_swap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    b = docs.select(F.col("doc_id").alias("other"), "source", F.col("n_chars").alias("m"))
    # A stated set of queries against all rows of their source.
    near = docs.filter("doc_id % 50 = 0").join(b, "source").filter((F.col("doc_id") != F.col("other")) & (F.col("m") * 10).between(F.col("n_chars") * 7, F.col("n_chars") * 14))
    return near.groupBy("doc_id").agg(F.min("other").alias("other"))


@query("""WITH a AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS v FROM part WHERE p_partkey % 5 <> 0)
SELECT k, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def full_outer_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    a = part.filter("k % 3 <> 0").select("k", F.col("p_brand").alias("before"))
    b = part.filter("k % 5 <> 0").select("k", F.when(F.col("k") % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, "k", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("kind", kind)


@query("SELECT DISTINCT p_name AS term FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)")
def added_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"))
    return part.select("term").distinct().join(part.filter("p_partkey % 2 = 0").select("term"), "term", "left_anti")


@query("""SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND e.ts BETWEEN r.ts - INTERVAL 2 HOUR AND r.ts + INTERVAL 2 HOUR)""")
def interval_antijoin(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    two = F.expr("INTERVAL 2 HOURS")
    return events.filter("event_type = 'view'").join(runs, (F.col("user_id") == F.col("u")) & F.col("ts").between(F.col("t") - two, F.col("t") + two), "left_anti").select("event_id")


@query("""WITH l AS (SELECT user_id, ts, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS fresh FROM events), s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    return progress.sessions(table(spark, sf_dir, "events"))


@query("""SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'fast' WHEN 'view' THEN 'fast' WHEN 'purchase' THEN 'strong' END AS stage FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id""")
def stage_last_match(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("user_id"), "event_id", F.concat(F.lit("["), "event_type", F.lit("] done")).alias("line"))
    return progress.stages(lines, [("fast", "click|view"), ("strong", "purchase")], "user_id", "event_id")


@query("""WITH w AS (SELECT user_id, event_id, count(*) OVER s - 1 AS steps, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER s AS took FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, steps, CASE WHEN took > 0 THEN round(steps / took, 6) END AS rate FROM w""")
def eta_rate(spark, sf_dir):
    return progress.rates(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "steps", "rate")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return progress.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type").withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, event_type FROM events WHERE value < 50 ORDER BY event_id LIMIT 50 OFFSET 100")
def paging(spark, sf_dir):
    return selection.page(table(spark, sf_dir, "events").filter("value < 50").select("event_id", "user_id", "event_type"), 100, 50, "event_id")


@query(r"""SELECT v.variant, CAST(sum(len(regexp_extract_all(lower(text), v.rx))) AS BIGINT) AS n, count(*) FILTER (regexp_matches(lower(text), v.rx)) AS docs FROM documents, (VALUES ('the', '\bthe\b'), ('tion', 'tion'), ('de', '\bde\b'), ('digits', '[0-9]+')) v(variant, rx) GROUP BY v.variant""")
def variant_usage(spark, sf_dir):
    patterns = {"the": tx.whole_word("the"), "tion": "tion", "de": tx.whole_word("de"), "digits": "[0-9]+"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.regexp_count(F.lower("text"), F.lit(p)).cast("long").alias("n")) for n, p in patterns.items()]))
    return table(spark, sf_dir, "documents").select(each.alias("s")).groupBy("s.variant").agg(F.sum("s.n").alias("n"), F.count_if(F.col("s.n") > 0).alias("docs"))


@query(f"""WITH {_HITS_SQL}, b AS (SELECT source, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT term) AS kinds FROM hits JOIN documents USING (doc_id) GROUP BY source) SELECT source, total, kinds FROM b ORDER BY total DESC, kinds DESC, source LIMIT 12""")
def chapter_terms_top12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = matching.term_occurrences(docs, terms_of(spark)).join(docs.select("doc_id", "source"), "doc_id")
    return hits.groupBy("source").agg(F.sum("n").alias("total"), F.count_distinct("term").alias("kinds")).orderBy(F.desc("total"), F.desc("kinds"), "source").limit(12)


@query(f"""WITH {_HITS_SQL}, s AS (SELECT lang, domain FROM hits JOIN documents USING (doc_id) GROUP BY lang, domain, doc_id HAVING count(*) FILTER (contains(term, ' ')) >= 2) SELECT lang, count(*) FILTER (domain = 'a') AS a, count(*) FILTER (domain = 'b') AS b, count(*) FILTER (domain = 'c') AS c, count(*) FILTER (domain = 'd') AS d FROM s GROUP BY lang""")
def theme_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = matching.domain_detect(docs, terms_of(spark)).filter("n_multi >= 2").join(docs.select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").pivot("domain", ["a", "b", "c", "d"]).count().na.fill(0)


@query("SELECT doc_id, n_chars FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 = 0")
def stride_sample(spark, sf_dir):
    return selection.stride_sample(table(spark, sf_dir, "documents"), "source", "doc_id", 10).select("doc_id", "n_chars")


@query("SELECT conv_id, turn, regexp_matches(text, '[A-Za-z]{3}') AND len(text) BETWEEN 2 AND 79 AND NOT regexp_matches(text, '[.:;?!,]\\s*$') AS heading FROM conversations")
def heading_predicate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_heading(F.col("text")).alias("heading"))


@query("""SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)""")
def supplier_cube(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.cube("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "balance")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0")
def customers_intersect(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    even = customers.join(orders.filter("o_orderkey % 2 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
    return even.intersect(orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")))
