import re
from html import unescape

import compare
import numpy as np
import pytest

from tidemark.llm import html, queries


@pytest.fixture(scope="module")
def model(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def by_template(page):
    """The main text of a page of the fixtures' template, by cutting it out."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
    found = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body))
    return "\n".join(x for x in found if x)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_cutting(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op9_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == by_template(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])


def test_blocks():
    page = "<title>t</title><div class='a b' id=c>one <b>two</b>&amp;&nbsp;three<p>four<p>five<br>six<ul><li>x<li><a href='>'>y</a> z</ul><script>if(a<b){}</script><!-- no --><style>p</style>tail</div>end"
    assert [(b.path, b.text) for b in html.blocks(page)] == [("div a b c", "one two& three"), ("div a b c/p", "four"), ("div a b c/p", "five six"), ("div a b c/ul/li", "x"), ("div a b c/ul/li", "y z"), ("div a b c", "tail"), ("", "end")]
    assert [b.text for b in html.blocks("a < b <p>c</p> <!-- open")] == ["a < b", "c"]
    assert html.blocks("") == [] and html.blocks("<script>x") == [] and [b.text for b in html.blocks("<p title=\"<p>\">q</p")] == ["q"]


def test_other_layouts(spark, model):
    r, wrong, total = np.random.default_rng(123), 0, 0
    for row in spark.read.parquet(f"{compare.SF}/pages.parquet").collect():
        page = html.blocks(row["html"])
        labels = [html.by_structure(b) for b in page]
        new, want = html.laid_out([b for b, c in zip(page, labels) if c], [b for b, c in zip(page, labels) if not c], r)
        got = model.label([html.vectors(new)])[0]
        wrong, total = wrong + int((got != np.array(want)).sum()), total + len(want)
    assert wrong <= 0.02 * total


def test_hand_made_page(model):
    p = "".join(f"<p>Sentence number {i} of the story goes on, with some words and a stop.</p>" for i in range(4))
    page = f"<body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><main><article><h1>A title</h1>{p}<div class='share'>Share this</div></article></main><aside class=sidebar><p>Also read this long line of text, please.</p></aside><section class='comments'><p>I liked the story a lot, and so did my friends.</p></section><div class='cookie-notice'>We use cookies.</div><footer>&copy; me</footer>"
    blocks = html.blocks(page)
    kept = [b.text for b, k in zip(blocks, model.label([html.vectors(blocks)])[0]) if k]
    assert kept == ["A title", *(f"Sentence number {i} of the story goes on, with some words and a stop." for i in range(4))]


def test_gradients_match_differences():
    r = np.random.default_rng(2)
    m = html.Labeller.fresh()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, lengths = html.padded([r.standard_normal((n, html.DIM)) * 0.3 for n in (4, 2)])
    x = x.astype(np.float64)
    y, weight = r.integers(0, 2, x.shape[:2]).astype(float), (np.arange(4)[:, None] < lengths).astype(float)

    def loss():
        z = m.forward(x, lengths)[0]
        return float(((np.logaddexp(0, z) - y * z) * weight).sum())

    grads = m.gradients(x, lengths, y, weight)
    for k, w in m.p.items():
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)]:
            keep, step = w[at], 1e-4
            w[at] = keep + step
            up = loss()
            w[at] = keep - step
            slope = (up - loss()) / (2 * step)
            w[at] = keep
            assert abs(slope - grads[k][at]) < 1e-3 + 0.02 * abs(slope), (k, at, slope, grads[k][at])


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (None, "u", "<p>" + "word " * 60_000), (3, "u", "plain"), (4, "u", "<article>" + "<p>a b.</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html.extract(pages, model).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html.extract(pages.where("false"), model).count() == 0
    assert html.extract(pages, html.train(pages.where("false"))).count() == 6
