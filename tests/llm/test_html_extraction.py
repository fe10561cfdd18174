"""Main text extraction on pages whose main text is known, and tree matching by brute force."""

import random

import numpy as np
import pytest

from tests.llm.helpers import prose
from tilepyramid.llm import html_extraction as x
from tilepyramid.llm import htmltree as t


def text_of(source):
    return " ".join(x.main_texts(t.parse(source)))


SAME = "<p>Read all our stories every morning.</p>"
LAYOUTS = [
    ("<html><head><title>T</title><style>p{{}}</style><script>var a='</p>'</script></head><body>"
     "<header>Site</header><nav><ul><li><a href=x>Home</a><li>News</ul></nav>{}"
     "<footer>&copy; us</footer></body></html>", "<article><h1>{}</h1>{}</article>"),
    ("<body><div class='site-header'>Site</div><div id=sidebar><p>links</div><main>{}"
     "<section id=comments><article class=comment>first!</article></section></main>"
     "<div class='cookie-notice'>We use cookies</div><form>mail <input></form></body>",
     "<article><header><h1>{}</h1></header>{}<div class=ad>Buy</div></article>"),
    ("<div class='menu-bar menu'>Menu</div><div class='page has sidebar'><div role=main>{}</div>"
     "</div><aside>more</aside><!-- hidden <p>x</p> --><p style='display: none'>no</p>",
     "<h2>{}</h2>{}<div hidden>no</div><noscript>no</noscript>"),
    ("{}", "<h1>{}</h1>{}"),
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_layouts(layout):
    page, content = LAYOUTS[layout]
    body = "<p>One &amp; two,\n  <b>bo</b>ld&nbsp;text<br>and caf&eacute; &#x41;.<p>Three<p>"
    assert text_of(page.format(content.format("Head line", body))) == \
        "Head line One & two, bold text and café A. Three"


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("a < b & c", "a < b & c"),
    ("<p>open <!-- never closed <p>gone", "open"), ("<p>x<script>y", "x"), ("<p>x<p", "x"),
    ("<ul><li>a<li>b</ul>c", "a b c"), ("<p>a</div>b", "ab"), ("<b><p>a</b>b</p>c", "ab c"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<div>a<div>b</div>c</div>", "a b c"),
    ("<p>a<![CDATA[x]]>b<?php y ?>c", "abc"), ("<span class=ad>x<span>y</span>z</span>w", "w"),
    ("<P CLASS='Nav'>x</P><DIV>y</DIV>", "y"), ("<a title='a > b'>t</a>", "t"),
    ("<article>a<article>reply</article></article>", "a"), ("&lt;p&gt; &copy 1", "<p> © 1")])
def test_markup(source, want):
    assert text_of(source) == want


def naive(a, b, i, j):
    """Value of the best match below two nodes."""
    xs, ys = a.below(i), b.below(j)
    table = np.zeros((len(xs) + 1, len(ys) + 1), dtype=int)
    for r, p in enumerate(xs):
        for k, q in enumerate(ys):
            w = 0
            if a.label[p] == b.label[q]:
                w = 1 + int(a.text[p] == b.text[q] != 0) + naive(a, b, p, q)
            table[r + 1, k + 1] = max(table[r, k + 1], table[r + 1, k], table[r, k] + w)
    return table[-1, -1]


@pytest.mark.parametrize("cells", [t.CELLS, 1, 6])
def test_simple_tree_matching_is_best(monkeypatch, cells):
    monkeypatch.setattr(t, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        a, b = (t.Tree(t.packed(t.Page(
            [-1, *[rng.randrange(-1, k) for k in range(1, n)]],
            [rng.choice("xyz") for _ in range(n)], [rng.choice(["", "s", "t"]) for _ in range(n)])))
            for n in (rng.randrange(1, 14), rng.randrange(1, 14)))
        found = t.aligned(a, b)
        worth = sum(1 + int(a.text[i] == b.text[j] != 0) for i, j in found)
        assert all(a.label[i] == b.label[j] for i, j in found)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert worth == naive(a, b, -1, -1)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows],
                                 "page_id long, url string, html string, seed string, host long")


def article(k, extra=""):
    return f"<h1>Title {k}</h1><p>{prose(k, 30)}</p>{extra}<p>{prose(k + 500, 20)}</p>"


def plain(k):
    return f"Title {k} {prose(k, 30)} {prose(k + 500, 20)}"


def test_template_is_what_the_articles_of_a_host_share(spark):
    other = "<div><p>Our paper since 1950.</p></div>"
    rows = [(k, f"https://Site.example/{k}", f"<body>{other}<div>{article(k, SAME)}</div>{other}")
            for k in range(12)]
    rows += [(100 + k, f"http://few.example:80/{k}", f"<div>{article(k)}</div>{SAME}")
             for k in range(3)]  # too few to tell
    rows += [(200 + k, "http://copies.example/", f"<div>{article(7)}</div>") for k in range(40)]
    rows += [(300, None, article(1)), (301, "not a url", article(2)), (302, "http://x.example", None)]
    got = {r.page_id: r for r in x.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert (got[k].text, got[k].n_template) == (plain(k), 3)
    for k in range(3):
        assert got[100 + k].text == f"{plain(k)} Read all our stories every morning."
    assert {got[200 + k].text for k in range(40)} == {plain(7)}
    assert got[300].text == plain(1) and got[301].text == plain(2)
    assert (got[302].text, got[302].n_chars) == ("", 0)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_large_wrappers_are_joined_with_salt(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/", f"<div>{article(k, SAME)}</div>") for k in range(30)]
    whole = sorted(map(tuple, x.extract(pages(spark, rows)).collect()))
    monkeypatch.setattr(x, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, x.extract(pages(spark, rows)).collect())) == whole
    assert all(r[4] == 1 for r in whole)


def test_long_and_empty(spark):
    long = "".join(f"<p>{prose(k, 5)}</p>" for k in range(3000))
    rows = [(k, "http://long.example/", f"<div>{long}</div><p>{k}</p>{SAME}") for k in range(6)]
    got = x.extract(pages(spark, rows)).collect()
    assert [(r.text, r.n_template) for r in got] == [(str(r.page_id), 3001) for r in got]
    assert x.extract(pages(spark, rows).limit(0)).count() == 0
