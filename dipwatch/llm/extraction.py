"""Main text of web pages by a tree-structured graphical model over the page's blocks.

Every block element and every run of inline text is a node with two states: it holds main text, or not. Potentials of single nodes
come from tag, the words of class, id and role, text length, share of links and punctuation; potentials of a parent and its child
depend on both states and on the kind of the child. Sum-product messages, upward and then downward, give each node's marginal.
A text node belongs to the result if its marginal is at least one half. All pages of a chunk are one forest, and messages of one
depth are passed together.

The weights maximise the likelihood of labelled pages (gradient: observed minus expected features, by the same messages): the
layouts in ``labelled_pages``, filled with words of varying number. The fit is the same everywhere and takes about a second.

Scripts, styles, hidden elements and comments in the markup are no text and are not nodes.

Defined results: null and empty html give an empty text; broken markup is read as far as it goes; repeated rows give repeated
results; text without any element counts as a block of its own; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dipwatch.llm.dom import HIDDEN, Node, parse
from dipwatch.llm.labelled_pages import labelled_pages
from dipwatch.llm.words import scan

# Words of class, id, role and label that tell the use of a block.
MAIN = frozenset(
    "article articlebody body bodytext content contents entry hentry main mainbody post postbody posttext prose story storybody text page"
    " blog longform paragraph paragraphs copy".split())
ASIDE = frozenset(
    "nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs crumbs skip masthead header banner footer foot colophon"
    " copyright legal sidebar side aside rail widget widgets related recommended recommendations more trending popular teaser promo"
    " promotion promoted ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors cookie cookies"
    " consent gdpr notice notices notification alert popup modal overlay toast banner newsletter subscribe subscription signup login"
    " signin register form search share sharing social follow tags tagcloud pager pagination byline meta metadata toc hidden tooltip"
    " contentinfo complementary privacy disclaimer paywall links".split())
REPLIES = frozenset(
    "comment comments commentlist commenttext reply replies respond discussion disqus responses reader readers feedback review reviews"
    " guestbook forum thread".split())
KINDS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "h1": "h1", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "blockquote": "quote", "pre": "pre", "figure": "figure", "figcaption": "caption", "table": "table", "thead": "table", "tbody": "table",
    "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "fieldset": "form", "menu": "nav", "body": "root", "html": "root", "#page": "root", "#text": "text",
}
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Kinds of a child that have an own potential with their parent.
EDGES = ("plain", "text", "main", "aside", "replies", "heading")
STEPS, RATE, DECAY = 250, 0.2, 0.003


def invisible(node: Node) -> bool:
    a = node.attributes
    return node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or bool(a.get("style") and _STYLE.search(a["style"]))


def _uses(node: Node) -> tuple[bool, bool, bool]:
    """Whether its names speak for main text, for something beside it, for replies of readers."""
    names = " ".join(v for k, v in node.attributes.items() if k in ("class", "id", "role", "aria-label", "itemprop", "data-component"))
    if not names:
        return False, False, False
    words = {w.lower() for w in _SPLIT.split(names) if w}
    return bool(words & MAIN), bool(words & ASIDE), bool(words & REPLIES)


class Forest:
    """Nodes of several pages with their features (index lists), parents and edge kinds."""

    def __init__(self, names: dict[str, int], grow: bool):
        self.names, self.grow = names, grow
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.edge: list[int] = []
        self.of: list[int] = []
        self.feature: list[int] = []
        self.texts: list[tuple[int, int, str]] = []
        self.nodes: list[Node] = []

    def _add(self, node: int, *features: str) -> None:
        for name in features:
            index = self.names.setdefault(name, len(self.names)) if self.grow else self.names.get(name)
            if index is not None:
                self.of.append(node)
                self.feature.append(index)

    def page(self, number: int, source: str) -> None:
        nodes, place, inside = parse(source), {}, {}
        for i, n in enumerate(nodes):
            if i and n.parent not in place or invisible(n):
                continue
            at = place[i] = len(self.parent)
            kind = KINDS.get(n.tag, "other")
            main, aside, replies = _uses(n)
            above = inside.get(n.parent, frozenset())
            inside[i] = above | {k for k, on in (("main", main or kind in ("article", "main")), ("replies", replies)) if on}
            self.parent.append(place.get(n.parent, -1) if i else -1)
            self.depth.append(0 if not i else self.depth[place[n.parent]] + 1)
            self.nodes.append(n)
            strong = kind in ("nav", "footer", "aside", "form") or aside
            self.edge.append(EDGES.index(
                "text" if kind == "text" else "replies" if replies else "aside" if strong else "main" if main or kind in ("article", "main")
                else "heading" if kind in ("h1", "heading") else "plain"))
            self._add(at, "any", f"kind {kind}", *(k for k, on in (("main", main), ("aside", aside and not main), ("both", aside and main),
                                                                      ("replies", replies)) if on))
            if kind == "header":
                self._add(at, "header in main" if "main" in above else "header of page")
            if kind == "text":
                words, up = n.text.count(" ") + 1, KINDS.get(nodes[n.parent].tag, "other")
                share = min(1.0, n.linked / max(1, len(n.text)))
                size = "short" if words < 4 else "line" if words < 12 else "sentence" if words < 30 else "paragraph"
                ends = "stop" if re.search(r"[.!?:;…。\"'”’)]$", n.text) else "open"
                self._add(at, f"in {up}", f"{size} {ends}", f"size {size}", f"{size} in {up}", "links" if share > 0.5 else "some links" if share > 0.15 else "plain",
                          "in main" if "main" in above else "outside")
                self.texts.append((number, at, n.text))

    def ready(self) -> None:
        self.parent, self.depth, self.edge = np.array(self.parent, int), np.array(self.depth, int), np.array(self.edge, int)
        self.of, self.feature = np.array(self.of, int), np.array(self.feature, int)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2 if len(order) else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state 1) of the nodes, P(parent state, state) with their parents, and the log of the partition function.

        ``unary``: weight of each feature for state 1. ``pair``: edge kind x parent state x state.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.of, unary[self.feature], n)
        edge = pair[self.edge]
        up, sent = own.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp(edge[level, :, 0] + up[level, :1], edge[level, :, 1] + up[level, 1:])
            np.add.at(up, self.parent[level], sent[level])
        down = up.copy()  # what a node knows from its side and, below, from all others
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            rest = down[self.parent[level]] - sent[level]
            joint = rest[:, :, None] + edge[level] + up[level][:, None, :]
            down[level] = up[level] + np.logaddexp(rest[:, :1] + edge[level, 0], rest[:, 1:] + edge[level, 1])
            joint -= joint.max((1, 2), keepdims=True)
            both[level] = np.exp(joint)
            both[level] /= both[level].sum((1, 2), keepdims=True)
        roots = self.levels[0] if self.levels else np.zeros(0, int)
        z = float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())
        return 1 / (1 + np.exp(np.clip(down[:, 0] - down[:, 1], -500, 500))), both, z


def observed(forest: Forest) -> np.ndarray:
    """States of a labelled forest: a text node inside a ``data-main`` block holds main text, and so do the nodes above it."""
    state = np.zeros(len(forest.parent), int)
    for _, at, _ in forest.texts:
        i = forest.parent[at]
        while i >= 0 and not {"data-main", "data-rest"} & set(forest.nodes[i].attributes):
            i = forest.parent[i]
        if i >= 0 and "data-main" in forest.nodes[i].attributes:
            i = at
            while i >= 0:
                state[i] = 1
                i = forest.parent[i]
    return state


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, their weights, and the edge potentials."""
    forest = Forest({}, True)
    for number, page in enumerate(labelled_pages()):
        forest.page(number, page)
    forest.ready()
    state, pages = observed(forest), len(set(t[0] for t in forest.texts))
    has_up = forest.parent >= 0
    seen = np.bincount(forest.feature, state[forest.of], len(forest.names))
    seen_pair = np.zeros((len(EDGES), 2, 2))
    np.add.at(seen_pair, (forest.edge[has_up], state[forest.parent[has_up]], state[has_up]), 1)
    unary, pair = np.zeros(len(forest.names)), np.zeros((len(EDGES), 2, 2))
    moments = [np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(unary), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):
        p, both, _ = forest.marginals(unary, pair)
        expected_pair = np.zeros_like(pair)
        np.add.at(expected_pair, forest.edge[has_up], both[has_up])
        grads = ((seen - np.bincount(forest.feature, p[forest.of], len(unary))) / pages - DECAY * unary,
                 (seen_pair - expected_pair) / pages - DECAY * pair)
        for i, (weight, grad) in enumerate(zip((unary, pair), grads)):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * grad * grad
            weight += RATE * moments[i] / (1 - 0.9 ** step) / (np.sqrt(moments[i + 2] / (1 - 0.99 ** step)) + 1e-6)
    return forest.names, unary, pair


def extract(pages: list[str]) -> list[str]:
    names, unary, pair = trained()
    forest = Forest(names, False)
    for number, page in enumerate(pages):
        forest.page(number, page)
    forest.ready()
    p = forest.marginals(unary, pair)[0]
    out: list[list[str]] = [[] for _ in pages]
    for number, at, text in forest.texts:
        if p[at] >= 0.5:
            out[number].append(text)
    return ["\n".join(blocks) for blocks in out]


def op3_main_text(pages: DataFrame) -> DataFrame:
    trained()

    def make():
        def step(rows: dict) -> pa.Table:
            texts = extract([(h or b"").decode("utf-8", "replace") for h in rows["html"]])
            return pa.table({"page_id": pa.array(rows["page_id"], pa.int64()), "url": pa.array(rows["url"], pa.string()),
                             "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

        return step

    return scan(pages, ["page_id", "url", "html"], make, "page_id long, url string, text string, n_chars long")
