from __future__ import annotations

import html
import re

import pytest

from dipwatch.llm import extraction as X
from dipwatch.llm.dom import parse
from tests.llm.data import SF


def _forest(pages):
    forest = X.Forest(X.trained()[0], False)
    for i, page in enumerate(pages):
        forest.page(i, page)
    forest.ready()
    return forest


def test_messages_equal_enumeration():
    """Marginals of a small tree by summing over all states."""
    import itertools

    import numpy as np

    names, unary, pair = X.trained()
    forest = _forest(["<body><div><p>some words here.</p><p>more</p></div></body>"])
    n = len(forest.parent)
    p, both, z = forest.marginals(unary, pair)
    weight = np.zeros(2 ** n)
    own = np.bincount(forest.of, unary[forest.feature], n)
    states = list(itertools.product((0, 1), repeat=n))
    for k, y in enumerate(states):
        weight[k] = sum(own[i] * y[i] for i in range(n)) + sum(pair[forest.edge[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
    total = np.logaddexp.reduce(weight)
    assert z == pytest.approx(total)
    for i in range(n):
        assert p[i] == pytest.approx(sum(np.exp(w - total) for w, y in zip(weight, states) if y[i]))


def test_labelled_pages_are_learned():
    forest = _forest(X.labelled_pages())
    state = X.observed(forest)
    p = forest.marginals(*X.trained()[1:])[0]
    at = [a for _, a, _ in forest.texts]
    assert ((p[at] >= 0.5) == state[at]).mean() > 0.99


PAGES = {
    "semantic": ("<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></ul></nav><main><h1>A title</h1>"
                 "<p>First &amp; foremost,\n  a paragraph with <b>bold</b> words.<p>Second&nbsp;paragraph, not closed."
                 "<ul><li>first point of the list<li>second point of the list</ul></main><aside><p>Buy our new things today.</p></aside>"
                 "<form><p>Please leave your address here.</p></form><footer>&copy; 2020 Someone</footer></body></html>",
                 "A title\nFirst & foremost, a paragraph with bold words.\nSecond paragraph, not closed.\nfirst point of the list\nsecond point of the list"),
    "names": ("<body><div class='cookie-notice'><p>We use cookies for a better service.</p></div><div id=menu><a href=1>One</a> <a href=2>Two</a></div>"
              "<div class='post'><h2>Heading of it</h2><p>The text of the article goes on for a while, and then it ends.</p>"
              "<div class='ad'>Cheap watches, only today.</div><p>Its last words.</p></div><div class='comments'><p>I like this article very much!</p></div>"
              "<div class='sidebar'><p>Other articles that you may like to read.</p></div><script>if (a < b) document.write('<p>no</p>')</script></body>",
              "Heading of it\nThe text of the article goes on for a while, and then it ends.\nIts last words."),
    "hidden": ("<article><p>Shown text of the page, a sentence.</p><p style='display: none'>Hidden text of the page.</p><!-- <p>No.</p> --><p hidden>Neither.</p>"
               "<style>p { }</style><noscript>Turn it on.</noscript></article>", "Shown text of the page, a sentence."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert X.extract([page]) == [want]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<!-- open", "</p></div>", "<script>never closed", "&#0;&#xD800;&bogus;", "<a href='x", "<table><tr><td>" * 300,
                                  "<div>" * 2000 + "deep" + "</div>" * 10, "<p>" * 3000])
def test_broken_markup(page):
    (text,) = X.extract([page])
    assert text == text.strip() and "<p" not in text


def test_blocks_and_space():
    texts = [n.text for n in parse("<p>a\t b<br>c</p> tail <div>d<span> e</span></div>") if n.tag == "#text"]
    assert texts == ["a b c", "tail", "d e"]


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in X.op3_main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?p>|</?h1>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = "<article>" + "<p>words and more words, again and again.</p>" * 30_000 + "</article>"
    rows = [(1, None, None, "x", "x"), (2, "u", "", "x", "x"), (None, "u", "<article><p>Some text in an article, long enough.</p></article>", "x", "x"), (4, "u", long, "x", "x")]
    rows += [(5, "u", "<article><p>The same row, twice in the table.</p></article>", "x", "x")] * 2
    got = sorted(((r["page_id"], r["n_chars"]) for r in X.op3_main_text(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (None, 37), (4, 38 * 30_000 + 29_999), (5, 33), (5, 33)], key=repr)
    assert X.op3_main_text(spark.createDataFrame([], schema)).count() == 0
