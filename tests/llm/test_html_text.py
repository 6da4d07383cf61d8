"""Operator 1: parsing, decoding, accuracy on pages held out, and odd pages."""

import itertools
import random
import time

import numpy as np
import pytest

from textloom.llm import html_text as ht


@pytest.fixture(scope="module")
def trees():
    return ht.model()


def test_parse_closes_tags():
    nodes, blocks = ht.parse("<p>a<p>b <b>c<div>d</div><ul><li>e<li>f</ul><table><tr><td>g<td>h</table>&amp;&eacute;<!-- x --><script>'</p>'</script> i<br>j\n  k")
    assert [t for _, t in blocks] == ["a", "b c", "d", "e", "f", "g", "h", "&é i j k"]
    assert all(nodes[k].parent < k for k in range(len(nodes)))
    for odd in ("", "<", "<p", "</p></div>", "<a href=\"x", "<!--", "<script>", "text", "<p class='x\">y</p>", "<title>t</title>z"):
        ht.parse(odd)
    assert ht.parse("x <title>no</title>&lt;b&gt;")[1] == [(0, "x <b>")]


def test_decode_is_the_best_consistent_choice():
    rng = random.Random(3)
    for _ in range(40):
        nodes = [ht.Node("html", -1, 0, "", 0)]
        for k in range(1, 9):
            parent = rng.randrange(k)
            nodes.append(ht.Node("div", parent, nodes[parent].depth + 1, "", 0))
            nodes[parent].children.append(k)
        scores = np.array([rng.uniform(-3, 3) for _ in nodes])
        kept = ht.decode(nodes, scores)
        best = -np.inf
        for choice in itertools.product([False, True], repeat=8):
            choice = (True, *choice)
            if all(choice[nodes[k].parent] or not choice[k] for k in range(1, 9)):
                best = max(best, sum(s for s, c in zip(scores, choice) if c))
        assert all(kept[nodes[k].parent] or not kept[k] for k in range(1, 9))
        assert np.isclose(scores[kept].sum(), best)


def test_accuracy_on_pages_held_out(trees):
    x, y = ht.training_nodes(120, 77)
    assert ((trees.scores(x) > 0) == (y > 0)).mean() > 0.99
    rng, wrong = random.Random(78), 0
    for _ in range(120):
        page = ht._written_page(rng)
        nodes, blocks = ht.parse(page)
        want = "\n".join(t for k, t in blocks if ht._MARK in nodes[k].attrs)
        wrong += ht.texts([page.replace(f" {ht._MARK}=1", "")], trees)[0] != want
    assert wrong <= 4


def test_rows(spark, trees):
    para = "The quiet river moved past the old stone houses, and people walked along it. " * 3
    page = f"<html><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>A title here</h1><p>{para}<p>More &amp; more.</article><div id=comments><p>Nice post!</p></div><footer>&copy; x</footer>"
    long = "<article>" + f"<p>{para}</p>" * 3000 + "</article><footer>f</footer>"
    deep = "<div>" * 5000 + "x"
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", None), (4, "u", long, "c"), (1, "u", page, "c"), (None, "v", page, "c"), (5, "w", deep, "c")]
    got = ht.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)).collect()
    want = "A title here\n" + para.strip() + "\nMore & more."
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [got[k].text for k in (0, 1, 2, 4, 5)] == [want, "", "", want, want]
    assert got[3].text == "\n".join([para.strip()] * 3000) and all(r.n_chars == len(r.text) for r in got)
    assert ht.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("n", [3, 63, 64, 200])
def test_siblings_of_a_parent_with_many_children(n):
    lengths = [1 + k * 37 % 90 for k in range(n)]
    nodes, _ = ht.parse("<div>own text" + "".join(f"<p>{'x' * m}</p>" for m in lengths) + "</div>")
    rows = ht.features(nodes)[2:]
    logs = [np.log1p(m) for m in lengths]
    assert rows[:, 8].tolist() == list(range(n))
    assert rows[:, 9] == pytest.approx([k / n for k in range(n)])
    assert rows[:, 11] == pytest.approx([m / sum(lengths) for m in lengths])
    assert rows[:, 12] == pytest.approx([-1, *logs[:-1]])
    assert rows[:, 13] == pytest.approx([*logs[1:], -1])


P = "This is a paragraph of the article, with several words in it, and a comma. It has a second sentence as well, as paragraphs often do."
SHAPED = {
    "head left open": (f"<html><head><title>t</title><body><article><p>{P}</p><p>{P}</p></article>", [P, P]),
    "no wrapper": (f"<body><h1>Title of it</h1><p>{P}</p><p>{P}</p><p>{P}</p></body>", ["Title of it", P, P, P]),
    "text parted by br": (f"<html><body>{P}<br><br>{P}</body></html>", [f"{P} {P}"]),
    "section": (f"<body><section><h2>Title of it</h2><p>{P}</p><p>{P}</p></section></body>", ["Title of it", P, P]),
    "plain div": (f"<body><div><h1>Title of it</h1><p>{P}</p><p>{P}</p></div></body>", ["Title of it", P, P]),
    "table layout": (f"<body><table><tr><td><a href=/>Home</a> <a href=/b>About</a></td><td><h1>Title of it</h1><p>{P}</p><p>{P}</p></td></tr></table></body>", ["Title of it", P, P]),
    "sidebar in main": (f"<main><div class=sidebar><h3>More</h3><p>Some text here in the sidebar of the page.</p></div><div class=post><h1>Title of it</h1><p>{P}</p><p>{P}</p></div></main>", ["Title of it", P, P]),
    "masthead in a wrapper": (f"<body><div class=wrapper><header id=masthead><h1>Site name</h1><p>A tagline of the site</p></header><div class=content><h1>Title of it</h1><p>{P}</p><p>{P}</p></div></div></body>", ["Title of it", P, P]),
}


@pytest.mark.parametrize("name", SHAPED)
def test_pages_of_many_shapes(trees, name):
    page, want = SHAPED[name]
    assert ht.texts([page], trees)[0].split("\n") == want


@pytest.mark.parametrize("shape", ["section", "table"])
def test_a_shape_that_was_not_trained_on(shape):
    trees = ht.Boosted(trees=40).fit(*ht.training_nodes(350, 5, tuple(s for s in ht.SHAPES if s != shape)))
    x, y = ht.training_nodes(60, 6, (shape,))
    kept, true = trees.scores(x) > 0, y > 0
    assert 2 * (kept & true).sum() / (kept.sum() + true.sum()) > 0.9


@pytest.mark.parametrize("soup", ['<a href="x', '<p "', "<div>", "<b>", "<ul><li>", "<!--", "</span>", "<a b='>\" "])
def test_soup_is_parsed_in_linear_time(soup):
    page = soup * (1_000_000 // len(soup) // 2) + ("</span>" if "<div" in soup else "<div></div>" if "<b" in soup else "x ") * 20_000
    began = time.process_time()
    ht.parse(page)
    assert time.process_time() - began < 12
