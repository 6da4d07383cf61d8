"""Operator 1: main text of web pages by boosted trees over DOM nodes.

A tolerant parser makes a tree of a page's block elements.  Every node has
features of its subtree (text, links, tags, punctuation), of the tokens of its
attributes and its ancestors', of its depth and place, and of its siblings.
Gradient-boosted trees, fitted here on pages that a generator writes with
known main text, give each node the log-odds that it belongs to the article.
Decoding is hierarchical: of all choices in which a kept node's parent is kept
too, the one with the greatest sum of log-odds is taken, so no descendant of a
rejected node is in the text.

Defined results: null and empty pages, and pages without a kept block, have the
empty text; unclosed and misnested tags are closed as browsers do for
paragraphs, list items and cells, and else at the end of their parent; pages
are handled each for itself, so repeats and ties stay; an empty table gives no
rows; other columns pass unread.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("""[>"']""")
#: Elements of HTML by how they are laid out.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object select".split())
_SILENT = frozenset("button option datalist audio video canvas".split())
_CLOSES_P = _BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption", "legend", "summary"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"})}
#: Elements whose end tags have no effect beyond the table cell that they stand in.
_HELD_BY_CELLS = frozenset(("p", "li", "a", "b", "i", "span", "div"))
_TAGS = [{"article", "main"}, {"nav", "menu", "dir"}, {"aside"}, {"header"}, {"footer", "address"}, {"form", "fieldset", "legend", "dialog"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"div", "section", "center", "body", "html"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"figure", "figcaption"}, {"blockquote", "pre"}, {"#run"}]
_GROUPS = [
    set("nav navigation menu navbar breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip".split()),
    set("header masthead banner logo branding top".split()),
    set("footer foot copyright colophon legal contentinfo bottom".split()),
    set("sidebar side aside widget related recommended recirc trending popular more rail complementary".split()),
    set("ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense dfp taboola outbrain".split()),
    set("comment comments disqus reply replies respond discussion reader readers feedback".split()),
    set("share sharing social follow tweet facebook twitter".split()),
    set("cookie cookies consent notice gdpr alert popup modal newsletter subscribe signup paywall overlay dialog hidden".split()),
    set("form search login register contact".split()),
    set("content article post entry story body main text prose page".split()),
]
_MARK = "data-y"


class Node:
    __slots__ = ("tag", "parent", "depth", "attrs", "own", "links", "start", "nodes", "children", "marks")

    def __init__(self, tag: str, parent: int, depth: int, attrs: str, start: int):
        self.tag, self.parent, self.depth, self.attrs, self.start = tag, parent, depth, attrs, start
        self.own = self.links = self.nodes = self.marks = 0
        self.children: list[int] = []


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name (with a slash before it if it ends an element) and attributes of every tag, in one pass.

    Comments and declarations have an empty name.  A ``>`` in quotes ends no
    tag; where quotes turn out to be left open up to the page's end, they are
    ordinary characters from there on.  Who reads may send a place to go on at.
    """
    at, quoted = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", ""
            continue
        name = _NAME.match(page, start + 1)
        if name is None and not page.startswith(("<!", "<?"), start):
            at = start + 1
            continue
        inside = name.end() if name else start + 2
        end = page.find(">", inside)
        if end < 0:  # a tag that never ends takes the rest with it
            yield start, len(page), "", ""
            return
        if quoted and name:
            k = inside
            while True:
                mark = _QUOTE_OR_END.search(page, k)
                if mark is None or mark[0] == ">":
                    break
                k = page.find(mark[0], mark.end()) + 1
                if not k:
                    mark = None
                    break
            if mark is None:
                quoted = False
            else:
                end = mark.start()
        at = end + 1
        moved = yield start, at, name[0].lower() if name else "", page[inside:end] if name else ""
        if moved is not None:
            at = moved
            yield at, at, "", ""


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, parents first, and (node, text) of every block of text.

    Text that stands directly in the page, or in a node behind blocks, is a node
    of its own, named ``#run``, unless the page is nothing but text.  The work is linear in the page's length.
    """
    nodes = [Node("html", -1, 0, "", 0)]
    blocks: list[tuple[int, str]] = []
    # Open elements: name, its block node or -1 for inline ones; of each name the places in the stack.
    stack: list[tuple[str, int]] = [("html", 0)]
    where: dict[str, list[int]] = defaultdict(list)
    open_blocks = [0]
    held: list[str] = []
    links, silent, written, link_chars = 0, 0, 0, 0
    current = 0

    def child(name: str, attrs: str) -> int:
        nodes.append(Node(name, current, nodes[current].depth + 1, attrs, written))
        nodes[current].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def flush():
        nonlocal written, link_chars
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                at = child("#run", "") if not current or nodes[current].children else current
                node = nodes[at]
                node.own += len(text)
                node.links += min(len(text), link_chars)
                node.marks += sum(map(text.count, ".,;:!?"))
                written += len(text)
                blocks.append((at, text))
        link_chars = 0

    def close(k: int):
        """Closes open elements from the k-th on."""
        nonlocal links, silent, current
        for name, node in reversed(stack[k:]):
            links -= name == "a"
            silent -= name in _SILENT
            where[name].pop()
            if node >= 0:
                flush()
                open_blocks.pop()
                current = nodes[node].parent
        del stack[k:]

    def say(text: str):
        nonlocal link_chars
        if text and not silent:
            if "&" in text:
                text = entities.unescape(text)
            held.append(text)
            if links:
                link_chars += len(text)

    def last(names) -> int:
        return max((where[name][-1] for name in names if where[name]), default=0)

    found, said = tags(page), 0
    for start, end, name, attrs in found:
        say(page[said:start])
        said = end
        if not name or name in ("head", "/head"):
            continue
        if name[0] == "/":
            name = name[1:]
            k = last([name])
            if k and (name not in _HELD_BY_CELLS or k > last(("td", "th", "table"))):
                close(k)
            continue
        if name in _RAW:
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            closing = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, end)
            said = len(page) if closing is None else (page.find(">", closing.start()) + 1 or len(page))
            found.send(said)
            continue
        if name == "br":
            say(" ")
            continue
        block = name in _BLOCKS or "-" in name
        if block:
            if name in _CLOSES_P and stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
            if name in _IMPLIED:
                ends, scope = _IMPLIED[name]
                within = last(scope)
                low = min((where[e][at] for e in ends if (at := bisect_right(where[e], within)) < len(where[e])), default=0)
                if low:
                    close(low)
            flush()
            if name in ("html", "body") and len(stack) <= 2:
                nodes[0].attrs += " " + attrs
                continue
        if name in _VOID or attrs.endswith("/") and not block:
            continue
        where[name].append(len(stack))
        if block:
            k = child(name, attrs)
            open_blocks.append(len(stack))
            stack.append((name, k))
            current = k
        else:
            stack.append((name, -1))
            nodes[current].nodes += 1
            links += name == "a"
            silent += name in _SILENT
    say(page[said:])
    close(1)
    flush()
    if len(nodes) == 2 and nodes[1].tag == "#run":  # the page is nothing but text
        nodes[0].own, nodes[0].links, nodes[0].marks = nodes[1].own, nodes[1].links, nodes[1].marks
        nodes[0].children, blocks = [], [(0, text) for _, text in blocks]
        del nodes[1]
    return nodes, blocks


@functools.lru_cache(50_000)
def _groups_of(attrs: str) -> int:
    """Groups of tokens in class, id and role values, a bit each."""
    values = " ".join(v for _, v in re.findall(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", attrs, re.I))
    tokens = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", values).lower()))
    found = sum(1 << k for k, group in enumerate(_GROUPS) if tokens & group)
    return found | (1 << len(_GROUPS) if re.search(r"\bhidden\b|display\s*:\s*none", attrs, re.I) else 0)


FEATURES = 20 + len(_TAGS) + 3 * (len(_GROUPS) + 1)


def features(nodes: list[Node]) -> np.ndarray:
    """A row a node."""
    n = len(nodes)
    text, links, marks, count, inline = (np.zeros(n) for _ in range(5))
    groups, above, within, tags_above = [0] * n, [0] * n, [0] * n, [0] * n
    for k, node in enumerate(nodes):
        text[k], links[k], marks[k], inline[k] = node.own, node.links, node.marks, node.nodes
        groups[k] = _groups_of(node.attrs) if node.attrs else 0
        if k:
            above[k] = above[node.parent] | groups[node.parent]
            tags_above[k] = tags_above[node.parent] | _tag_bits(nodes[node.parent].tag)
    own = text.copy()
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        text[p] += text[k]
        links[p] += links[k]
        marks[p] += marks[k]
        inline[p] += inline[k]
        count[p] += count[k] + 1
        within[p] |= within[k] | groups[k]
    places, beside = [0] * n, text.copy()
    for node in nodes:
        siblings = sum(text[c] for c in node.children)
        for place, c in enumerate(node.children):
            places[c], beside[c] = place, siblings
    out = np.zeros((n, FEATURES), "f4")
    total = max(1.0, text[0])
    for k, node in enumerate(nodes):
        around = nodes[node.parent].children if k else [0]
        place = places[k]
        t = max(1.0, text[k])
        out[k, :20] = (
            node.depth, np.log1p(text[k]), np.log1p(own[k]), links[k] / t, count[k] / t * 100, inline[k] / t * 100, marks[k] / t * 100, text[k] / total, place, place / len(around), len(around),
            text[k] / max(1.0, beside[k]), np.log1p(text[around[place - 1]]) if place else -1, np.log1p(text[around[place + 1]]) if place + 1 < len(around) else -1, node.start / total, (node.start + text[k]) / total,
            np.log1p(text[node.parent]) if k else -1, tags_above[k] & 1, tags_above[k] >> 1 & 1, tags_above[k] >> 2 & 1,
        )
        for i, tags in enumerate(_TAGS):
            if node.tag in tags:
                out[k, 20 + i] = 1
        at = 20 + len(_TAGS)
        for bits in (groups[k], above[k], within[k]):
            if bits:
                for i in range(len(_GROUPS) + 1):
                    out[k, at + i] = bits >> i & 1
            at += len(_GROUPS) + 1
    return out


def _tag_bits(tag: str) -> int:
    return 1 if tag in ("article", "main") else 2 if tag in ("nav", "footer", "aside", "form", "menu", "dialog") else 4 if tag == "header" else 0


class Boosted:
    """Gradient-boosted trees of fixed depth with logistic loss, on histograms of quantiles."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.splits, self.leaves = [], []
        width = self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), "i8")
            splits = np.zeros((2**self.depth - 1, 2), "i4")
            for level in range(self.depth):
                n = 2**level
                best = np.full(n, 1e-6)
                chosen = np.tile(np.array([0, self.bins], "i4"), (n, 1))  # without gain all go left
                for f in range(x.shape[1]):
                    code = at * width + binned[:, f]
                    gs = np.bincount(code, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(code, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    b = gain.argmax(1)
                    value = gain[np.arange(n), b]
                    better = value > best
                    best[better] = value[better]
                    chosen[better, 0], chosen[better, 1] = f, b[better]
                splits[n - 1 : 2 * n - 1] = chosen
                at = at * 2 + (binned[np.arange(len(y)), chosen[at, 0]] > chosen[at, 1])
            n = 2**self.depth
            leaves = -self.rate * np.bincount(at, g, n) / (np.bincount(at, h, n) + 1)
            score += leaves[at]
            self.splits.append(splits)
            self.leaves.append(leaves)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1).astype("i2")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        binned = self._binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, leaves in zip(self.splits, self.leaves):
            at = np.zeros(len(x), "i8")
            for level in range(self.depth):
                chosen = splits[2**level - 1 + at]
                at = at * 2 + (binned[rows, chosen[:, 0]] > chosen[:, 1])
            out += leaves[at]
        return out


def decode(nodes: list[Node], scores: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best choice in which every kept node's parent is kept."""
    gain = np.clip(scores, -6, 6).tolist()
    for k in range(len(nodes) - 1, 0, -1):
        if gain[k] > 0:
            gain[nodes[k].parent] += gain[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and gain[k] > 0
    return kept


#: How the generator places an article in its page.
SHAPES = ("wrapped", "bare", "section", "plain", "nested", "table", "runs", "beside")
_RUN = "\x01"


def _written_page(rng: random.Random, shape: str = "wrapped") -> str:
    """A page of the generator; blocks of the article are marked."""
    syllables = "an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    mess = rng.choice(["", "", "", "###", "&amp;&amp;", "!!", " |"])

    def sentence(a=4, b=22):
        s = words(a, b).capitalize()
        if mess:
            s = s.replace(" ", mess + " ")
        return s + rng.choice([".", ".", ".", "?", "!", ""])

    para = lambda: " ".join(sentence(1, 25) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    classes = rng.random() < 0.6

    def named(*names):
        return f' class="{rng.choice(names)}"' if classes and names and rng.random() < 0.9 else ""

    def links(n):
        items = "".join(f'<li><a href="/{word()}">{words(1, 4)}</a>' + rng.choice(["</li>", "</li>", ""]) for _ in range(n))
        return f"<ul>{items}</ul>"

    y = f" {_MARK}=1"
    soup = rng.random() < 0.5
    end_p = lambda: "" if soup and rng.random() < 0.4 else "</p>"
    p = lambda: f"<p{y}>" + (rng.choice(["<b>", "<i>", ""]) if soup else "") + para() + (rng.choice(["<br>", ""]) if soup else "") + end_p()
    body = [f"<h1{y}>{words(3, 14)}</h1>"] if rng.random() < 0.85 else []
    if body and rng.random() < 0.25:
        body = [f"<header>{body[0]}</header>"]
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        if kind < 0.72:
            body.append(p())
        elif kind < 0.8:
            body.append(f"<h{rng.choice('23')}{y}>{words(2, 8)}</h2>")
        elif kind < 0.87:
            tag = rng.choice(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(f"<li{y}>{sentence(2, 14)}" + rng.choice(["</li>", ""]) for _ in range(rng.randrange(2, 7))) + f"</{tag}>")
        elif kind < 0.91:
            body.append(f"<blockquote{y}>{para()}</blockquote>")
        elif kind < 0.94:
            body.append("<table>" + "".join("<tr>" + "".join(f"<td{y}>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randrange(2, 5))) + "</table>")
        elif kind < 0.97:
            body.append(f"<figure><img src='x.png'><figcaption{y}>{sentence()}</figcaption></figure>")
        else:
            body.append(f"<pre{y}>{words(5, 30)}</pre>")
        if rng.random() < 0.08:
            body.append(rng.choice([f"<div{named('ad', 'advert', 'sponsored')}>{sentence()}</div>" if classes else "", f"<div{named('share', 'social-links')}><a href='#'>{word()}</a> <a href='#'>{word()}</a></div>", f"<aside{named('related', 'more-stories')}><h3>{words(1, 3)}</h3>{links(3)}</aside>"]))
    if shape == "runs":
        title = body[:1] if body and body[0].startswith("<h1") else []
        body = [*title, _RUN, rng.choice(["<br><br>", "<br>\n"]).join(para() for _ in range(rng.randrange(1, 7)))]
        if rng.random() < 0.4:
            body += ["<hr>" if rng.random() < 0.5 else f"<h2{y}>{words(2, 6)}</h2>", _RUN, para()]
    wrapped = rng.choice([lambda b: f"<article>{b}</article>", lambda b: f"<article{named('post', 'story')}>{b}</article>", lambda b: f"<main><article>{b}</article></main>", lambda b: f"<main>{b}</main>", lambda b: f"<div class='{rng.choice(['content', 'article-body', 'post-content', 'entry'])}'>{b}</div>", lambda b: f"<div id='main'><div class='story'>{b}</div></div>"])
    ad = lambda: f"<div class=\"{rng.choice(['ad', 'ads', 'advertisement', 'promo', 'sponsored'])}\">{para()}</div>"
    nav = lambda: rng.choice([f"<nav>{links(rng.randrange(2, 9))}</nav>", f"<div class='{rng.choice(['menu', 'navbar', 'breadcrumbs', 'topbar'])}'>{links(rng.randrange(2, 7))}</div>"])
    notice = lambda: f"<div class='{rng.choice(['cookie-notice', 'consent', 'newsletter', 'alert', 'popup'])}'><p>{sentence()}</p><button>{word()}</button></div>"
    aside = lambda: rng.choice([f"<aside>{links(4)}<p>{para()}</p></aside>", f"<div class='{rng.choice(['sidebar', 'widget', 'related'])}'><h3>{words(1, 3)}</h3><p>{sentence()}</p>{links(3)}</div>"])
    form = lambda: f"<form action='/s'><label>{words(1, 3)}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>"
    comments = lambda: f"<{(t := rng.choice(['section', 'div']))} {rng.choice(['class', 'id'])}='{rng.choice(['comments', 'comment-list', 'discussion', 'replies'])}'><h3>{words(1, 3)}</h3>" + "".join(f"<div{named('comment', 'reply')}><p>{para()}</p></div>" for _ in range(rng.randrange(1, 6))) + f"</{t}>"
    header = lambda: f"<{(t := rng.choice(['header', 'header', 'div']))} {rng.choice(['class', 'id'])}='{rng.choice(['masthead', 'site-header', 'banner'])}'>{rng.choice(['<h1>', '<p>', '<h1>' + words(1, 4) + '</h1>', ''])}{rng.choice(["<a href='/'>" + words(1, 3) + '</a>', words(1, 4)])}{rng.choice([f'<p>{sentence(2, 8)}</p>', words(2, 6), nav()])}</{t}>"
    footer = lambda: rng.choice([f"<footer>&copy; {word()}.example &middot; {para()}</footer>", f"<div class='{rng.choice(['footer', 'site-footer'])}'><p>{sentence()}</p>{links(3)}</div>"])
    some = lambda f, share: f() if rng.random() < share else ""
    neutral = lambda: f" class='{rng.choice(['row', 'col', 'inner', 'wrap', 'container', 'box', 'l-grid', 'c1'])}'" if rng.random() < 0.5 else ""

    def around(b):
        if shape == "section":
            return f"<section>{b}</section>"
        if shape == "plain":
            return f"<div{neutral()}>{b}</div>"
        if shape == "nested":
            for _ in range(rng.randrange(2, 5)):
                b = f"<div{neutral()}>{b}</div>"
            return b
        if shape == "table":
            beside = f"<td>{links(rng.randrange(2, 7))}</td>"
            cells = [some(lambda: beside, 0.7), f"<td{neutral()}>{b}</td>", some(lambda: f"<td>{rng.choice([aside, ad])()}</td>", 0.4)]
            top = f"<tr><td colspan=3><a href='/'>{words(1, 3)}</a></td></tr>" if rng.random() < 0.5 else ""
            return f"<table{rng.choice([' width=100%', ' border=0', ''])}>{top}<tr>{''.join(cells)}</tr></table>"
        if shape == "beside":
            parts = [rng.choice([lambda: f"<article>{b}</article>", lambda: f"<div class='{rng.choice(['post', 'content', 'entry'])}'>{b}</div>", lambda: f"<div{neutral()}>{b}</div>"])()] + [f() for f in (aside, ad, comments, nav, form) if rng.random() < 0.35]
            if rng.random() < 0.5:
                parts.reverse()
            t = rng.choice(["main", "main", "div"])
            return f"<{t}{neutral()}>{''.join(parts)}</{t}>"
        if shape == "bare":
            return b
        return rng.choice([lambda b: b, lambda b: f"<div{neutral()}>{b}</div>", wrapped])(b) if shape == "runs" else wrapped(b)

    article = around("".join(body))
    before = some(header, 0.4) + some(nav, 0.8) + some(notice, 0.25) + some(ad, 0.5) + some(aside, 0.15) + some(form, 0.15)
    inner = article
    if rng.random() < 0.2 and "</article>" in inner:
        inner = inner.replace("</article>", comments() + "</article>")
    after = some(aside, 0.3) + some(ad, 0.2) + some(comments, 0.35) + some(form, 0.15) + some(footer, 0.9) + some(notice, 0.1)
    inside = before + inner + after
    if rng.random() < 0.4:
        inside = f"<div{named('wrapper', 'page', 'container')}>{inside}</div>"
    tail = rng.choice(["</body></html>", "</body></html>", ""])
    head = f"<title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>"
    start = rng.choice([f"<html><head>{head}</head><body>"] * 3 + [f"<html><head>{head}<body>", f"{head}", f"<html><body{neutral()}>"])
    return f"<!DOCTYPE html>{start}{inside}{tail}"


#: Pages that the generator writes for fitting.
TRAINING_PAGES = 1200


def training_nodes(pages: int, seed: int, shapes: tuple[str, ...] = SHAPES) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of written pages, and whether each holds marked text; many of the pages are wrapped."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        nodes, blocks = parse(_written_page(rng, "wrapped" if "wrapped" in shapes and rng.random() < 0.4 else rng.choice(shapes)))
        holds = [_MARK in node.attrs for node in nodes]
        for k, text in blocks:
            if text.startswith(_RUN):
                holds[k] = True
                nodes[k].own -= len(_RUN)
        for k in range(len(nodes) - 1, 0, -1):
            if holds[k]:
                holds[nodes[k].parent] = True
        for node in nodes:
            node.attrs = node.attrs.replace(f" {_MARK}=1", "")
        x.append(features(nodes)[1:])  # the page itself is always kept
        y.append(holds[1:])
    return np.concatenate(x), np.concatenate(y).astype("f8")


@functools.lru_cache(1)
def model() -> Boosted:
    return Boosted().fit(*training_nodes(TRAINING_PAGES, 1))


def texts(pages: list[str], trees: Boosted) -> list[str]:
    """Main text of each page."""
    parsed = [parse(page) for page in pages]
    rows = [features(nodes) for nodes, _ in parsed]
    scores = trees.scores(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for (nodes, blocks), own in zip(parsed, rows):
        kept = decode(nodes, scores[at : at + len(own)])
        at += len(own)
        out.append("\n".join(text for k, text in blocks if kept[k]))
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())  # of fixed size

    def extract(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                found = texts([h or "" for h in some.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_pydict({"page_id": some.column("page_id"), "url": some.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
