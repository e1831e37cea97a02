"""Page trees, exact marginals against enumeration, and main texts of labelled pages."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicframe.llm import htmltext
from omicframe.llm.dom import parsed


def texts(page):
    t = parsed(page)
    return [(x, t.tag[t.parent[k]]) for k, x in enumerate(t.text) if x]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("  plain &amp; simple\n text ", [("plain & simple text", "html")]),
        ("<p>a<b>b</b> c<p>d<br>e", [("ab c", "p"), ("d", "p"), ("e", "p")]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", [("a", "li"), ("b", "li"), ("c", "li"), ("d", "li"), ("e", "html")]),
        ("<div>a</p></span>b</div></div>c", [("a", "div"), ("b", "div"), ("c", "html")]),
        ("a<script>if (a<b) '</p>'</script>b<style>x{}</style>c<!-- <p>no -->d", [("abcd", "html")]),
        ("<script>never closed <p>x", []),
        ("<!-- never closed <p>x", []),
        ("<p title='a>b'>x</p><p class=\"q", [("x", "p"), ('<p class="q', "html")]),
        ("1 < 2 &lt; 3 &copy; &#8212; &bogus;", [("1 < 2 < 3 © — &bogus;", "html")]),
        ("<textarea>t</textarea><select><option>o</select><p>x", [("x", "p")]),
        ("<![CDATA[raw]]><P CLASS=A>up</P>", [("raw", "html"), ("up", "p")]),
    ],
)
def test_trees(page, want):
    assert texts(page) == want


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    unary, edges, kind = rng.normal(size=8), rng.normal(size=(2, 2, 2)), rng.integers(0, 2, 8)
    weight, total, pairs = np.zeros(8), 0.0, np.zeros((8, 2, 2))
    for y in itertools.product((0, 1), repeat=8):
        s = sum(unary[i] * y[i] for i in range(8)) + sum(edges[kind[i], y[parent[i]], y[i]] for i in range(8) if parent[i] >= 0)
        total += np.exp(s)
        weight += np.exp(s) * np.array(y)
        for i in range(8):
            if parent[i] >= 0:
                pairs[i, y[parent[i]], y[i]] += np.exp(s)
    p, pair = htmltext.marginals(unary, edges, kind, parent, depth)
    assert np.allclose(p, weight / total) and np.allclose(pair, pairs / total)


def test_held_out_pages():
    """Pages of the same make that were not learnt from; blocks, not whole pages, as some pages are ambiguous."""
    model, wrong, n = htmltext.trained(), 0, 0
    for page, labels in htmltext.labelled_pages(150, seed=5):
        t = parsed(page)
        want = " ".join(x for x, y in zip(t.text, labels) if x and y)
        wrong += htmltext.contents([page], model)[0] != want
        n += 1
    assert wrong <= 0.1 * n


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph,
with a line break.</p><p><b>Bold start.<br><p>Second paragraph with a <a href="#">link</a> in it.</article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li></ul></aside>
<form><input name="q"><button>Search</button></form>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked reading this article very much, thank you.</p></div></section>
<footer>&copy; Site &middot; All rights reserved.</footer></body></html>"""
TEXT = "A title & more First paragraph, with a line break. Bold start. Second paragraph with a link in it."


def test_main_text_column(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<html><body><article>" + "<p>word word.</p>" * 20_000 + "</article>"), (5, "<div>" * 3000 + "deep"), (1, PAGE)]
    df = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    got = {r.page_id: r.t for r in df.select("page_id", htmltext.main_text(F.col("html")).alias("t")).collect()}
    assert got[1] == TEXT and got[2] == got[3] == ""
    assert got[4] == " ".join(["word word."] * 20_000)
    assert df.limit(0).select(htmltext.main_text(F.col("html"))).count() == 0


def test_training_is_repeatable():
    pages = htmltext.labelled_pages(30, seed=3)
    a, b = (htmltext.fitted([parsed(p) for p, _ in pages], [y for _, y in pages], steps=20) for _ in range(2))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
