"""Block trees of web pages: elements and the runs of inline text between block boundaries."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed values of the HTML language.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
HIDDEN = frozenset(
    "head script style noscript template iframe object svg math canvas audio video map select datalist button textarea dialog".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
    "body": {"head"},
}
#: Boundaries that an implied end tag does not cross.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": {"html"}}
WHOLE_TEXT_OF_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol p pre section table ul".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    #: Characters of the text inside links.
    linked: int = 0


def attributes_of(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def parse(page: str) -> list[Node]:
    """Nodes in page order, a parent before its children; node 0 is the page. A text node has the tag ``#text``."""
    nodes = [Node("#page", -1, 0)]
    stack = [0]
    run: list[str] = []
    linked: list[str] = []
    link_at = 0  # height of the stack when a link was opened

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            in_links = len(" ".join(entities.unescape(" ".join(linked)).split()))
            nodes.append(Node("#text", stack[-1], len(stack), {}, text, in_links))
        run.clear()
        linked.clear()

    def pop_to(height: int) -> None:
        nonlocal link_at
        flush()
        del stack[height:]
        if link_at and link_at > len(stack):
            link_at = 0

    def close(tag: str, stop: frozenset | set = frozenset()) -> None:
        for height in range(len(stack) - 1, 0, -1):
            name = nodes[stack[height]].tag
            if name == tag:
                pop_to(height)
                return
            if name in stop:
                return

    at = 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text:
            run.append(text)
            if link_at:
                linked.append(text)
        if not found:
            break
        at = found.end()
        ended, opened = found[1], found[2]
        if ended:
            tag = ended.lower()
            if tag == "a":
                link_at = 0
            elif tag == "p" and not any(nodes[i].tag == "p" for i in stack):
                flush()
            elif tag not in INLINE:
                close(tag)
        elif opened:
            tag = opened.lower()
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                link_at = len(stack)
            elif tag in VOID:
                if tag == "hr":
                    close("p", {"button", "td", "th"})
                    flush()
            elif tag not in INLINE:
                if tag in WHOLE_TEXT_OF_P:
                    close("p", {"button", "td", "th", "blockquote", "div", "section", "article"})
                for name in CLOSES.get(tag, ()):
                    close(name, SCOPES[tag])
                flush()
                nodes.append(Node(tag, stack[-1], len(stack), attributes_of(found[3])))
                if not found[3].endswith("/") or tag not in HIDDEN:
                    stack.append(len(nodes) - 1)
                    if tag in RAW:
                        end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                        at = end.start() if end else len(page)
    flush()
    return nodes
