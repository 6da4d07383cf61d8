"""Further queries of the catalogue: scalar functions, runs and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import runs, selection
from textloom.plans.catalogue import query, table, turn_pairs

_TURN_SQL = "p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS out FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
s AS (SELECT word, [CASE WHEN word LIKE '%ies' THEN left(word, len(word) - 3) || 'y' END, CASE WHEN word LIKE '%es' THEN left(word, len(word) - 2) END, CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, len(word) - 1) END] AS f FROM w WHERE word LIKE '%s')
SELECT word, form FROM (SELECT word, unnest(f) AS form FROM s) WHERE form IN (SELECT word FROM w)""")
def known_singulars(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    forms = words.filter(F.col("word").endswith("s")).select("word", F.explode(tx.singulars(F.col("word"))).alias("form"))
    return forms.join(words.withColumnRenamed("word", "form"), "form", "left_semi").select("word", "form")


@query(r"""WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.,;:!?()\[\]"|]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS chunk FROM documents) SELECT doc_id, count(*) AS n, max(len(chunk)) AS longest FROM c GROUP BY doc_id""")
def chunk_sizes(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("chunk"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("chunk")).cast("long").alias("longest"))


@query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN substring(text, greatest(instr(text, 'the') - 20, 1), 3 + least(instr(text, 'the') - 1, 20) + 20) END AS shown FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.lit("the"), 20).alias("shown"))


@query(r"SELECT doc_id, CASE WHEN len(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]', '', 'g')) = 0 THEN NULL WHEN len(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) > len(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS script FROM documents")
def script_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.script_language(F.col("text")).alias("script"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents), s AS (SELECT word, CASE WHEN regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_.]*\(\)$') THEN 'call' WHEN regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$') THEN 'dotted'
WHEN regexp_matches(word, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(word, '^--?[a-z][a-z-]*$') THEN 'flag' WHEN regexp_matches(word, '^@[A-Z][A-Za-z]*$') THEN 'annotation' WHEN regexp_matches(word, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(word, '^([A-Z][a-z0-9]+){2,}$') THEN 'pascal' END AS shape FROM w)
SELECT shape, count(*) AS n FROM s WHERE shape IS NOT NULL GROUP BY shape""")
def code_shapes(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select(tx.code_shape(F.col("word")).alias("shape")).filter("shape is not null").groupBy("shape").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role = 'user' THEN 'Question.' END, CASE WHEN len(text) > 200 THEN 'Long.' END, 'Role: ' || role], lambda x: x IS NOT NULL), chr(10)) AS prompt FROM conversations""")
def prompt_lines(spark, sf_dir):
    built = tx.prompt((F.col("role") == "user", F.lit("Question.")), (F.length("text") > 200, F.lit("Long.")), (F.lit(True), F.concat(F.lit("Role: "), "role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", built.alias("prompt"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def salvaged_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k is not null")


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e, max(value) AS m FROM events GROUP BY user_id) SELECT user_id, CASE WHEN p > 20 THEN 'done' WHEN e > 10 THEN 'failed' WHEN m > 90 THEN 'running' ELSE 'not started' END AS state FROM s""")
def book_states(spark, sf_dir):
    flags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("value").alias("m"))
    return flags.select("user_id", runs.first_state((F.col("p") > 20, "done"), (F.col("e") > 10, "failed"), (F.col("m") > 90, "running")).alias("state"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'out' WHEN bool_or(event_type = 'click') THEN 'strong' WHEN bool_or(event_type = 'view') THEN 'fast' ELSE 'started' END AS stage FROM events GROUP BY user_id""")
def stage_of_files(spark, sf_dir):
    return runs.stage_by_files(table(spark, sf_dir, "events"), "user_id", "event_type", [("view", "fast"), ("click", "strong"), ("purchase", "out")])


@query("""WITH r AS (SELECT d.n_chars, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' END AS why FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT count(*) AS paragraphs, CAST(sum(n_chars) AS BIGINT) AS total_chars, count(why) AS n, CAST(coalesce(sum(n_chars) FILTER (why IS NOT NULL), 0) AS BIGINT) AS chars,
round(100.0::DOUBLE * coalesce(sum(n_chars) FILTER (why IS NOT NULL), 0) / nullif(sum(n_chars), 0), 4) AS pct, count(*) FILTER (why = 'toxic') AS why_toxic, count(*) FILTER (why = 'poor') AS why_poor FROM r""")
def pick_summary(spark, sf_dir):
    why = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("n_chars", why.alias("why"))
    return runs.pick_summary(rows, "why", "n_chars", ["toxic", "poor"])


@query("SELECT l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_linenumber) = 1")
def best_version_per_page(spark, sf_dir):
    return runs.best_version(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", "l_quantity")


@query("""WITH p AS (SELECT DISTINCT o_custkey % 50 AS book, o_orderkey // 4 AS page FROM orders), i AS (SELECT book, page, page - row_number() OVER (PARTITION BY book ORDER BY page) AS island FROM p), c AS (SELECT *, (row_number() OVER (PARTITION BY book, island ORDER BY page) - 1) // 3 AS part FROM i)
SELECT book, min(page) AS first, max(page) AS last FROM c GROUP BY book, island, part""")
def page_ranges(spark, sf_dir):
    return order_pages(table(spark, sf_dir, "orders"))


def order_pages(orders: DataFrame) -> DataFrame:
    pages = orders.select(F.expr("o_custkey % 50").alias("book"), F.expr("o_orderkey div 4").alias("page"))
    return runs.page_ranges(pages, "book", "page", 3)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def log_tail(spark, sf_dir):
    return runs.tail(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query(f"WITH {_TURN_SQL} SELECT CAST(conv_id % 4 AS BIGINT) AS kind, count(*) FILTER (len(out) > len(src)) AS second, count(*) FILTER (NOT coalesce(len(out) > len(src), false)) AS first FROM p GROUP BY 1")
def better_version(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select(F.pmod("conv_id", F.lit(4)).cast("long").alias("kind"), F.length("src").alias("a"), F.length("out").alias("b"))
    return runs.better_version(rows, "kind", "a", "b")


@query("SELECT d.lang AS kind, count(*) FILTER (l.quality = 0) AS caught, count(*) AS total FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def caught_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("kind"), "quality")
    return runs.caught_by_kind(rows, "kind", F.col("quality") == 0)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return runs.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7, table(spark, sf_dir, "labels"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total, n * 2 > sum(n) OVER (PARTITION BY source) AS majority FROM c""")
def majority_style(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source"))
    return counts.withColumn("total", total).withColumn("majority", F.col("n") * 2 > F.col("total"))


@query("SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 5")
def worst_five(spark, sf_dir):
    return selection.top_of(table(spark, sf_dir, "documents"), ["lang"], 5, "n_chars", "doc_id").select("doc_id", "n_chars")


@query("SELECT o_custkey, median(o_totalprice) AS middle FROM orders GROUP BY o_custkey")
def exact_medians(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.median("o_totalprice").alias("middle"))


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT w AS word, count(*) AS n FROM w WHERE len(w) >= 2 GROUP BY w HAVING count(*) >= 3")
def vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return words.filter("length(word) >= 2").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
