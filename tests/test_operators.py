"""Operators on rows written here, for what the driver's tables do not hold."""

import io
import random
import zipfile

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tests import oracle
from textloom.functions import predicates
from textloom.functions import text as tx
from textloom.operators import books, context, glossary, layout, matching, multisets, pages, ranges, selection, statistics
from textloom.sources import files, html_units, sinks
from textloom.streaming import progress


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_marks_are_multisets(spark):
    a, b, c = (F.lit(t) for t in ("x ⟦id_1⟧ y ⟦id_2⟧ ⟦id_1⟧", "⟦id_1⟧⟦id_1⟧ z ⟦id_2⟧", "⟦id_1⟧ ⟦id_2⟧"))
    row = one(spark, same=tx.marks(a) == tx.marks(b), other=tx.marks(a) == tx.marks(c))
    assert row.same and not row.other


def test_subsequence_and_case(spark):
    row = one(spark, a=tx.is_subsequence(F.lit("ace"), F.lit("abcde")), b=tx.is_subsequence(F.lit("aec"), F.lit("abcde")), c=tx.is_subsequence(F.lit(""), F.lit("x")))
    assert (row.a, row.b, row.c) == (True, False, True)
    texts = spark.createDataFrame([("use go here",), ("use Go here",), ("use GO here",)], "t string")
    assert [r[0] for r in texts.select(F.col("t").rlike(tx.case_policy("go"))).collect()] == [True, True, True]
    assert [r[0] for r in texts.select(F.col("t").rlike(tx.case_policy("Go"))).collect()] == [False, True, False]


def test_plurals_and_acronyms(spark):
    words = spark.createDataFrame([("file index",), ("bus",), ("nodes",), ("ab",), ("API",), ("DNS",)], "t string")
    got = {r.t: (r.p, r.a) for r in words.select("t", tx.plurals(F.col("t")).alias("p"), tx.acronym_plural(F.col("t")).alias("a")).collect()}
    assert got == {"file index": (["file indexes", "file indices"], None), "bus": (["buses"], None), "nodes": ([], None), "ab": ([], None), "API": ([], "APIs"), "DNS": ([], None)}


def test_glossary(spark):
    rows = [("Key", "k1", 0, 0, False), ("key", "k2", 1, 0, False), ("keys", "ks", 1, 1, False), ("GPU", "gpu", 1, 2, True), ("branch", "b", 0, 3, False)]
    entries = spark.createDataFrame(rows, "source string, target string, prio int, ord int, keep boolean")
    assert {(r.key, r.target) for r in glossary.override(entries).collect()} == {("key", "k2"), ("keys", "ks"), ("gpu", "gpu"), ("branch", "b")}
    assert [(r.source, r.previous) for r in glossary.conflicts(entries).collect()] == [("key", "k1")]
    assert {r.form for r in glossary.with_plurals(entries).collect()} == {"GPUs", "branches"}


def test_nested_terms_count_each(spark):
    docs = spark.createDataFrame([(1, "A big red, big red dog. big\n red"), (2, ""), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("d", "big red"), ("d", "red"), ("d", "red dog"), ("d", "red big")], "domain string, term string")
    assert {(r.doc_id, r.term, r.n) for r in matching.term_occurrences(docs, terms).collect()} == {(1, "big red", 3), (1, "red", 3), (1, "red dog", 1)}


def test_ladder_and_votes(spark):
    rows = spark.createDataFrame([(0, 2, 0, 0), (0, 1, 3, 1), (1, 0, 0, 2), (0, 0, 0, 1)], "a int, b int, c int, d int")
    got = [r[0] for r in rows.select(context.ladder([(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))])).collect()]
    assert got == ["alt", "own", "alt", None]
    votes = [(1, "w", 0, True, False, False, None), (1, "w", 1, False, False, False, "own"), (2, "w", 0, True, False, False, None), (2, "w", 1, False, True, False, None), (3, "w", 0, True, False, True, None), (4, "w", 0, False, False, False, None)]
    table = spark.createDataFrame(votes, "unit int, word string, pos int, own_cue boolean, alt_cue boolean, verb boolean, fallback string")
    assert {(r.unit, r.kind) for r in context.votes(table).collect()} == {(1, "own"), (2, "none"), (3, "none"), (4, "none")}


def test_budget_takes_the_row_that_crosses(spark):
    rows = spark.createDataFrame([("a", k, 10) for k in range(10)], "g string, k int, size int")
    assert sorted(r.k for r in selection.greedy_budget(rows, "size", 25, "k", group="g").collect()) == [0, 1, 2]
    assert selection.greedy_budget(rows, "size", 0, "k").count() == 0


def test_lines_have_an_anchor(spark):
    words = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.0, 2.0, 4.0, 4.5, 9.0])], "page long, id long, top double")
    assert [r.line for r in layout.cluster_lines(words).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_lines_of_many_pages_and_of_a_long_page_take_one_pass(spark):
    # Page 7 fills several Arrow batches; a null among ids or tops changes no other id.
    tops = [(k * 7919 % 25013) / 4 for k in range(25013)]
    words = [(7, k, t) for k, t in enumerate(tops)] + [(p, 2**60 + p, 1.0) for p in range(100, 400)] + [(8, None, 1.0), (8, 2**53 + 1, None), (8, 3, 9.0), (9, 1, None), (None, 1, 5.0), (None, 2, 1.0)]
    numbered = layout.cluster_lines(spark.createDataFrame(words, "page long, id long, top double"))
    want, anchor, line = {}, None, -1
    for top, k in sorted((t, k) for k, t in enumerate(tops)):
        if anchor is None or top - anchor > 2.5:
            anchor, line = top, line + 1
        want[7, k] = line
    want |= {(p, 2**60 + p): 0 for p in range(100, 400)} | {(8, None): 0, (8, 2**53 + 1): 1, (8, 3): 1, (9, 1): 0, (None, 1): 1, (None, 2): 0}
    assert {(r.page, r.id): r.line for r in numbered.collect()} == want
    # A call of Python for each page took 480 CPU seconds for 600,000 words.
    assert "InPandas" not in numbered._jdf.queryExecution().toString()


def test_small_box_wins_and_ties_go_by_ref(spark):
    points = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 50.0, 50.0), (2, 3, 5.0, 5.0), (1, 4, 500.0, 1.0)], "page long, id long, x double, y double")
    boxes = spark.createDataFrame([(1, "big", 0.0, 0.0, 100.0, 100.0), (1, "b", 0.0, 0.0, 10.0, 10.0), (1, "a", 1.0, 0.0, 11.0, 10.0)], "page long, ref string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.id, r.ref) for r in layout.assign_points(points, boxes).collect()} == {(1, "a"), (2, "big")}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    assert {(r.node, r.root) for r in layout.connected(edges).collect()} == {(k, 0) for k in range(21)} | {(30, 30), (31, 30), (40, 40)}


def test_ranks_and_modes(spark):
    rows = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, False), ("g", 2.0, True), ("g", 3.0, True)], "g string, s double, p boolean")
    assert statistics.auc(rows, "g", "s", F.col("p")).first().auc == 0.5
    modes = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("h", "z")], "g string, v string")
    assert {(r.g, r.v) for r in statistics.exact_mode(modes, "g", "v").collect()} == {("g", "a"), ("h", "z")}


def test_multiset_difference(spark):
    a, b = (spark.createDataFrame(x, "k string, n long") for x in ([("x", 3), ("y", 1)], [("x", 1), ("z", 2), ("y", 1)]))
    assert {tuple(r) for r in multisets.difference(a, b, ["k"]).collect()} == {("x", 2, 0), ("z", 0, 2)}


def test_html_units(spark):
    html = "<nav>no</nav><h1>A title</h1><p>One <b>two</b> &amp; three<br>four<pre>code</pre></p><div>out<p>inner</p></div><script>no</script>"
    got = [(r.tag, r.text) for r in html_units.html_units(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("unit_no").collect()]
    assert got == [("h1", "A title"), ("p", "One two & three"), ("p", "four"), ("div", "out"), ("p", "inner")]


def book(chapters):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="ch%20{k}.xhtml"/>' for k in range(len(chapters)))
        refs = "".join(f'<itemref idref="i{k}"/>' for k in reversed(range(len(chapters)))) + '<itemref idref="missing"/>'
        z.writestr("O/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for k, html in enumerate(chapters):
            z.writestr(f"O/ch {k}.xhtml", html)
    return held.getvalue()


def test_books_are_read_in_spine_order(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.epub").write_bytes(book(["<h1>Last one</h1><p>end text</p>", "<h1>First one</h1><p>start text</p><h2>Second</h2><p>more</p>"]))
    got = [(r.ch, r.sec, r.unit_no, r.is_head, r.text) for r in files.book_units(files.book_files(spark, str(tmp_path))).orderBy("unit_no").collect()]
    assert got == [(0, 1, 0, True, "First one"), (0, 1, 1, False, "start text"), (0, 2, 2, True, "Second"), (0, 2, 3, False, "more"), (1, 3, 4, True, "Last one"), (1, 3, 5, False, "end text")]


def test_file_scans_and_sinks(spark, tmp_path):
    (tmp_path / "web.csv").write_text(chr(0xFEFF) + "source,target,tgt_lng\nnode,knoten,de\n# note,x,de\nC#,c,de\nsame,same,de\n", encoding="utf-8")
    terms = files.glossary(spark, str(tmp_path / "web.csv"))
    assert {tuple(r) for r in terms.collect()} == {("web", "node", "knoten"), ("web", "same", "same")}
    sinks.write_glossary(terms, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("node", "knoten")]
    (tmp_path / "j.jsonl").write_text('{"src": "a", "n": 1}\nnot json\n{"src": "b"}\n')
    assert {r.src for r in files.journal(spark, str(tmp_path / "j.jsonl"), "src string, n long").collect()} == {"a", "b"}
    sinks.append_journal(spark.createDataFrame([("c", 2)], "src string, n long"), str(tmp_path / "journal"))
    sinks.append_journal(spark.createDataFrame([("d", 3)], "src string, n long"), str(tmp_path / "journal"))
    assert spark.read.json(str(tmp_path / "journal")).count() == 2
    (tmp_path / "v.txt").write_text("node | knoten | kn.t|en\nbad line\n")
    assert [tuple(r) for r in files.variants(spark, str(tmp_path / "v.txt")).collect()] == [("node", "knoten", "kn.t|en")]
    sinks.write_words(spark.createDataFrame([("b",), ("a",), ("b",)], "word string"), str(tmp_path / "words"))
    assert sorted(r.word for r in files.lexicon(spark, str(tmp_path / "words")).collect()) == ["a", "b"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("1|start\n2|[fast] 1/10 [\n3|[fast] 4/10 [\n4|[strong] go\n")
    stream = progress.log_lines(spark, str(folder)).selectExpr("'r' as run", "cast(split(value, '[|]')[0] as long) as line_no", "split(value, '[|]')[1] as line")
    out = progress.stages(stream, [("any", r"^\["), ("strong", "strong")]).writeStream.outputMode("complete").format("memory").queryName("stages").start()
    out.processAllAvailable()
    out.stop()
    assert [r.stage for r in spark.sql("select stage from stages").collect()] == ["strong"]
    lines = spark.createDataFrame([("r", 1, "[x] 1/10 ["), ("r", 2, "[x] 4/10 ["), ("r", 3, "none")], "run string, line_no long, line string")
    assert [(r.done, r.total) for r in progress.counters(lines).collect()] == [(4, 10)]


def test_key_lookup_in_three_tiers(spark):
    head = "abcdefghij" * 4
    whole = head + "klm" * 300
    right = [(whole + "x", 1, 1), (whole, 2, 2), (head + "pq", 3, 3), (head + "stuv", 4, 4), ("short", 5, 5), ("b" * 40 + "cxd" + "y" * 398, 6, 6), ("c" * 40 + "dxxe", 7, 7), ("c" * 40 + "dxxe", 8, 8), ("d" * 40 + "e" + "x" * 401, 9, 9), ("d" * 40 + "e" + "f" * 10, 10, 10), ("e" * 40 + "xf", 11, 11), ("e" * 40 + "yf", 12, 12)]
    left = [(1, whole), (2, whole[:500]), (3, head + "su"), (4, "short"), (5, "shor"), (6, "b" * 40 + "cd"), (7, "c" * 40 + "de"), (8, "d" * 40 + "ez"), (9, "e" * 40 + "f"), (10, "none"), (11, "b" * 40 + "dc")]

    def inside(a, b):
        rest = iter(b)
        return all(c in rest for c in a)

    def brute(k):
        for kk, value, _ in right:
            if kk == k:
                return value, 1
        if len(k) >= 40:
            near = [(kk, v) for kk, v, _ in right if kk[:40] == k[:40]]
            for kk, value in near:
                if kk.startswith(k) or k.startswith(kk):
                    return value, 2
            hits = dict(reversed([(kk, v) for kk, v in near if len(k) < len(kk) <= len(k) + 400 and inside(k, kk)]))
            if len(hits) == 1:
                return *hits.values(), 3

    found = matching.key_lookup(spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "key string, value long, ord long"), within=400)
    want = {i: brute(k) for i, k in left if brute(k)}
    assert {r.id: (r.value, r.tier) for r in found.collect()} == want
    assert want[1] == (2, 1) and want[3] == (4, 3) and want[7] == (7, 3) and 9 not in want


def test_terms_of_any_length_and_characters(spark):
    listed = ["two-way", "two-way merge", "the big red sort", "c++", "café", "node.js", "sort key", "GPU", "leaf"]
    docs = spark.createDataFrame([(1, "A Two-Way  merge by the big red sort of C++, café; node.js and the sort key."), (2, "GPUs, gpu GPU leaves leaf"), (3, "cafés recafé xnode.js c++x"), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(t,) for t in listed], "term string")
    got = {(r.doc_id, r.term, r.n) for r in matching.counted_forms(docs, matching.with_plurals(terms)).collect()}
    assert got == {(1, t, 1) for t in listed[:7]} | {(2, "GPU", 2), (2, "leaf", 2), (3, "café", 1)}
    assert {r.doc_id for r in matching.containing(docs, spark.createDataFrame([("CAF",)], "word string")).collect()} == {1, 3}
    assert matching.counted_forms(docs, terms.limit(0).withColumn("form", F.col("term"))).count() == 0


def test_forms_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_TERMS", 2)
    docs = spark.createDataFrame([(1, "leaf leaves tree trees")], "doc_id long, text string")
    terms = spark.createDataFrame([("leaf",), ("tree",)], "term string")
    assert {(r.term, r.n) for r in matching.counted_forms(docs, matching.with_plurals(terms)).collect()} == {("leaf", 2), ("tree", 2)}


def test_ancestors_of_a_cycle(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None)], "node long, parent long")
    got = {(r.node, r.ancestor) for r in pages.ancestors(nodes, "node", "parent").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)}


def test_balanced_tags(spark):
    cases = [("<p>a<b>c</b></p>", True), ("<p>a<b>c</p></b>", False), ("a<br>b<img src='x'>", True), ("</p>", False), ("<p class='x'>", False), ("<hr/>text", True), ("", True)]
    rows = spark.createDataFrame(cases, "html string, want boolean").withColumn("got", predicates.balanced(F.col("html"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_known_words_by_stem_and_prefix(spark):
    lexicon = spark.createDataFrame([(k,) for k in ("running", "blue", "green", "station", "реактивный")], "key string")
    words = spark.createDataFrame([(w,) for w in ("runnings", "blue-green", "blue-grey", "runnin", "restation", "нереактивный", "zzz", "green")], "word string")
    got = {r.word for r in books.known(words, lexicon, ["s", "ing"], [], ["re", "не"]).collect()}
    assert got == {"runnings", "blue-green", "runnin", "restation", "нереактивный", "green"}


def test_streams_of_events(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00"), (2, "b", "2024-01-01 00:20:00")]
    events = spark.createDataFrame(rows, "id long, kind string, at string").select("id", "kind", F.to_timestamp("at").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def result(df, name):
        run = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.id for r in result(progress.first_events(stream(), ["id"], "ts", "1 hour"), "firsts")) == [1, 2]
    joined = result(progress.followed(stream(), stream(), "id", "ts", "5 minutes", "1 hour"), "joined")
    assert sorted((r.id, (r.followed_at - r.ts).seconds) for r in joined) == [(1, 0), (1, 0), (1, 60), (2, 0)]
    batch = {(r.started.strftime("%H:%M"), r.kind): r.n for r in progress.sliding(events, "ts", "10 minutes", "5 minutes", "kind").collect()}
    assert batch == {("23:55", "a"): 2, ("00:00", "a"): 2, ("00:15", "b"): 1, ("00:20", "b"): 1}


def test_glossary_scans(spark, tmp_path):
    (tmp_path / "net.csv").write_text("source,target\nC#,sharp\n# note,x\nhost,узел\n", encoding="utf-8-sig")
    (tmp_path / "base.csv").write_text("source,target\na,b\n")
    (tmp_path / "keep.csv").write_text("source,target\nk,k\n")
    folder = str(tmp_path)
    assert {(r.domain, r.source) for r in files.glossary(spark, folder, hash_inside=True, but=("base", "keep")).collect()} == {("net", "C#"), ("net", "host")}
    assert {(r.domain, r.n) for r in files.glossary_sizes(spark, folder).collect()} == {("net", 3), ("base", 1)}
    rules = tmp_path / "senses.txt"
    rules.write_text('# head\nword,own,own_target,conflict_domains,alt_target,alt_cues,own_cues,verb,default\ntree,cs math,дерево,bio,,"leaf|root, bark",,,\n# more\nport,net,порт,,,,,,none\n')
    got = {r.word: (r.own, r.conflict, r.alt_cues, r.default) for r in files.sense_rules(spark, str(rules)).collect()}
    assert got == {"tree": (["cs", "math"], ["bio"], "leaf|root, bark", "own"), "port": (["net"], [], None, "none")}


def test_books_and_states_are_rewritten(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("b.xhtml", "old")
        z.writestr("a.xhtml", "same")
    with zipfile.ZipFile(io.BytesIO(sinks.rewritten_book(packed.getvalue(), {"b.xhtml": "neu é"}))) as z:
        assert [m.filename for m in z.infolist()] == ["mimetype", "b.xhtml", "a.xhtml"]
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("b.xhtml").decode() == "neu é" and z.read("a.xhtml") == b"same"
    for state in ({"done": 1}, {"done": 2, "name": "é"}):
        sinks.write_state(spark, "file://" + str(tmp_path / "state.json"), state)
    assert (tmp_path / "state.json").read_text(encoding="utf-8") == '{"done": 2, "name": "é"}'


def test_scoring_in_batches_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(k, k * 2) for k in range(6)], "id long, v long")
    rows.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    rows.limit(0).withColumn("score", F.lit(0)).write.parquet(out)
    spark.createDataFrame([(3, 0, 9)], "id long, v long, score int").write.mode("append").parquet(out)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    progress.scored_in_batches(stream, lambda b: b.withColumn("score", F.lit(1)), out, lambda: spark.read.parquet(out), "id", str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.id, r.score) for r in spark.read.parquet(out).collect()) == [(0, 1), (1, 1), (2, 1), (3, 9), (4, 1), (5, 1)]


def test_page_runs_by_source(spark):
    from textloom.operators import glyphs

    rows = spark.createDataFrame([("b", p, s) for p, s in [(1, "x"), (2, "x"), (3, "y"), (4, "x"), (6, "x")]], "book string, page long, src string")
    assert sorted((r.src, r.first, r.last) for r in glyphs.runs_of_pages(rows, "book", "page", "src").collect()) == [("x", 1, 2), ("x", 4, 4), ("x", 6, 6), ("y", 3, 3)]


def test_code_shapes(spark):
    cases = {"run()": "call", "os.path": "dotted", "max_size": "snake", "--force": "flag", "@Bean": "annotation", "getName": "camel", "HashMap": "pascal", "word": None, "": None}
    rows = spark.createDataFrame([(w,) for w in cases], "word string").select("word", tx.code_shape(F.col("word")).alias("shape")).collect()
    assert {r.word: r.shape for r in rows} == cases


def test_rank_correlation_without_spread(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 5), ("c", 1, 7), ("c", 2, 7)], "g string, x long, y long")
    assert {r.g: r.rho for r in statistics.spearman(rows, "g", "x", "y").collect()} == {"a": 1.0, "b": None, "c": None}


def test_running_sums_in_ranges_equal_one_pass(spark):
    rows = [(g, v, v % 7) for g, size in (("a", 3000), ("b", 1), (None, 40)) for v in range(size)] + [("b", None, 5)]
    df = spark.createDataFrame(rows, "g string, v long, n long").repartition(3)
    want = {}
    for g in {r[0] for r in rows}:
        before = 0
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        for _, v, n in own:
            want[g, v] = (before, sum(r[2] for r in own))
            before += n
    for cuts in (ranges.number_cuts(df, ["g"], "v"), ranges.sampled_cuts(df, ["g"], F.col("v"))):
        got = {(r.g, r.v): (r.before_n, r.all_n) for r in ranges.running_sums(df, ["g"], F.col("v"), ["n"], cuts).collect()}
        assert got == want
    cut = {r.g: len(r._cuts) for r in ranges.number_cuts(df, ["g"], "v").collect()}
    assert 200 < cut["a"] <= ranges.PARTS


def test_ranks_and_budget_with_nulls_ties_and_no_rows(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 1, 5), ("g", None, 2), (None, 3, 1)], "g string, a int, b int")
    assert {(r.g, r.a): (r.n, r.rank) for r in statistics.value_ranks(rows, "g", "a").collect()} == {("g", None): (1, 1.0), ("g", 1): (2, 2.5), (None, 3): (1, 1.0)}
    assert {r.g: r.rho for r in statistics.spearman(rows, "g", "a", "b").collect()} == {"g": 1.0, None: None}
    assert statistics.spearman(rows.limit(0), "g", "a", "b").count() == 0
    assert selection.greedy_budget(rows.limit(0), "b", 20, "a", group="g").count() == 0


def test_sections_and_neighbours_of_long_books(spark, monkeypatch):
    monkeypatch.setattr(context, "STRETCH", 5)
    rng = random.Random(5)
    rows = [(b, n % 3 and "x" or None, n * 2, rng.random() < 0.2, rng.randrange(9), rng.randrange(9)) for b, size in (("a", 700), (None, 12), ("c", 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "book string, ch string, unit_no long, head boolean, own long, alt long").repartition(3)
    got = {(r.book, r.unit_no): r for r in context.context_counts(context.with_sections(df, "book", "unit_no", F.col("head"))).collect()}
    assert len(got) == len(rows)
    for book in ("a", None, "c"):
        own = [r for r in rows if r[0] == book]
        secs = [sum(r[3] for r in own[: k + 1]) for k in range(len(own))]
        for k, r in enumerate(own):
            g = got[book, r[2]]
            assert (g.pos, g.sec, g.own_near, g.alt_near) == (k, secs[k], sum(x[4] for x in own[max(0, k - 2) : k + 3]), sum(x[5] for x in own[max(0, k - 2) : k + 3]))
            assert g.own_sec == sum(x[4] for x, s in zip(own, secs) if s == secs[k]) and g.alt_ch == sum(x[5] for x in own if x[1] == r[1])


def _lineitem(spark, tmp_path, parts):
    """A folder with a table lineitem of a file for each part."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / f"lineitem.parquet/part-{k}.parquet")
    return str(tmp_path)


def test_callouts_of_equal_place_go_by_side_and_nulls_come_last(spark, tmp_path):
    # Page 1 has two lines numbered 7 of one top on either side: whichever file they are read from first, the left one leads.
    apart = [[(1, 7, 19.0, 99), (2, 7, 19.0, 380), (3, 1, None, 2), (4, 1, 5.0, 2)], [(1, 2, 13.0, 912), (1, 7, 19.0, 380), (1, 5, 22.0, 43), (2, 2, 13.0, 912), (2, 7, 19.0, 99), (2, 5, 22.0, 43), (3, 2, 30.0, 2), (4, None, 5.0, 3)]]
    # The query's SQL, with x behind its ORDER BY.
    full = """WITH g AS (SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_extendedprice AS DOUBLE) % 60 AS top, l_suppkey % 2 AS x FROM lineitem), o AS (SELECT *, lag(top) OVER w AS t, lag(x) OVER w AS lx FROM g WINDOW w AS (PARTITION BY page ORDER BY top, no, x)),
s AS (SELECT page, no, CASE WHEN t IS NULL OR top - t >= 8 OR x <> lx THEN 1 ELSE 0 END AS new, top, x FROM o) SELECT page, no, CAST(sum(new) OVER (PARTITION BY page ORDER BY top, no, x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS callout FROM s"""
    sf_dir = _lineitem(spark, tmp_path, apart)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet/*.parquet'")
    assert oracle.compare(spark, db, __spark_entry__.queries()["callout_groups"], full, sf_dir) is None
    one = sorted((r.no, r.callout) for r in __spark_entry__.queries()["callout_groups"](spark, sf_dir).filter("page = 1").collect())
    assert one == [(2, 1), (5, 2), (7, 1), (7, 2)]


def test_lines_that_end_in_digits_do_not_stand_for_numbered_ones(spark, tmp_path):
    texts = ["a\nb\nx 1\nx 2\nx 3", "a\nb\nc 7\nd.\nz", "a\nb\nc \t\r\nz\nz", "a\u2028\nb\u0085\nc\x0b\nz\nz", "a\nb \u00a0\nc\r\nd\n", "1\n2\n3\n4\n5", "a\nb\nc\nd", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, db, __spark_entry__.queries()["contents_pages"], __spark_entry__.oracle_sql()["contents_pages"], str(tmp_path)) is None
    assert {r.doc_id: r.numbered for r in __spark_entry__.queries()["contents_pages"](spark, str(tmp_path)).collect()} == {1: 3, 2: 3, 4: 3}


def test_headings_have_one_capital_for_one_letter(spark, tmp_path):
    letters = ["ß", "ŉ", "ﬁ", "ᾳ", "ᾀ", "ΐ", "և", "ǆ", "ƛ", "ɤ", "ё", "ª", "\U00010597", "\U00010428", "\u2c5f", "İ", "ΑΣ", "ΑΣ Σ", "\x0bb", "\u00a0b", " \t\r\n\fb", "1b", "B", ""]
    rows = [(k, f'<H1 class="ß">{a}ieung</H1> ß <td\n>{a}</td><th>{a}<h7>ß<h1x>ß') for k, a in enumerate(letters)] + [(90, None), (91, ""), (92, "<h1>"), (93, "ß<dt>ß<dt>ß")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert oracle.compare(spark, db, __spark_entry__.queries()["capital_headings"], __spark_entry__.oracle_sql()["capital_headings"], str(tmp_path)) is None
    got = {r.page_id: r.headed for r in __spark_entry__.queries()["capital_headings"](spark, str(tmp_path)).collect()}
    assert got[0] == '<h1 class="ß">ẞieung</h1> ß <td\n>ẞ</td><th>ẞ<h7>ß<h1x>ß' and got[93] == "ß<dt>ẞ<dt>ẞ"
