"""Labelled pages: layouts in which ``data-main`` marks main text and ``data-rest`` marks what lies inside it but is none.

``{P}`` is a paragraph, ``{S}`` a sentence, ``{L}`` a line of few words, ``{W}`` one or two words, ``{A}`` a link of few words.
Words are drawn from a fixed generator, since nothing in the model looks at single words of the text.
"""

from __future__ import annotations

import random
import re

_NAV = "<nav><ul><li>{A}</li><li>{A}</li><li>{A}</li><li>{A}</li></ul></nav>"
_FOOT = "<footer>&copy; {W} &middot; {S}</footer>"

LAYOUTS = [
    # plain semantic pages
    "<body>" + _NAV + "<div class='ad'>{S}</div><article data-main><h1>{L}</h1><p>{P}</p><p>{P}</p><p>{S}</p><p>{P}</p></article>" + _FOOT + "</body>",
    "<body>" + _NAV + "<div class='ad'>{L}.</div><article data-main><h1>{L}</h1><p>{S}</p></article>" + _FOOT + "</body>",
    "<body>" + _NAV + "<div class='ad'>{P}</div><article data-main><h1>{L}</h1><p>{W}.</p></article><footer>&copy; {W} {L}</footer></body>",
    "<body><header><div class='logo'>{W}</div>" + _NAV + "</header><main data-main><h1>{L}</h1><p>{P}</p><h2>{L}</h2><p>{P}</p><ul><li>{S}</li>"
    "<li>{L}</li></ul><blockquote><p>{S}</p></blockquote><pre>{L}</pre></main><aside><h3>{L}</h3><ul><li>{A}</li><li>{A}</li></ul></aside>" + _FOOT + "</body>",
    "<body><header><h1>{L}</h1><p>{S}</p></header><main><article data-main><header><h1>{L}</h1></header><p>{P}</p><figure><figcaption>{S}"
    "</figcaption></figure><p>{P}</p><aside data-rest class='related'><p>{S}</p></aside><p>{P}</p><footer data-rest>{L}</footer></article></main>"
    "<section class='comments'><h2>{W}</h2><div class='comment'><p>{P}</p></div><div class='comment'><p>{S}</p></div></section>" + _FOOT + "</body>",
    # divisions with names
    "<body><div id='header'><div>{W}</div></div><div id='menu'><a href='#'>{W}</a> <a href='#'>{W}</a> <a href='#'>{W}</a></div><div id='content' data-main>"
    "<h2>{L}</h2><p>{P}</p><p>{P}</p><p>{S}</p></div><div id='sidebar'><p>{S}</p><ul><li>{A}</li><li>{A}</li></ul></div><div id='footer'><p>{S}</p></div></body>",
    "<body><div class='cookie-banner'><p>{S} {S}</p><button>{W}</button></div><div class='wrapper'><div class='post' data-main><h1>{L}</h1><div class='entry-content'>"
    "<p>{P}</p><div class='advert' data-rest>{S}</div><p>{P}</p><p>{S}</p><div class='share' data-rest>{A} {A}</div></div></div><div id='comments'>"
    "<ol><li class='comment'><p>{P}</p></li><li class='comment'><p>{S}</p></li></ol><form><label>{W}</label><p>{S}</p></form></div></div><div class='footer'>{L}</div></body>",
    "<body><div class='topbar'>{A} {A} {A}</div><div class='notice'><p>{S}</p></div><div><div data-main><p>{P}</p><p>{P}</p><p>{P}</p></div></div><div>{A} {A} {A}</div></body>",
    "<body><div><a href='/'>{W}</a> <a href='/'>{W}</a> <a href='/'>{W}</a> <a href='/'>{W}</a></div><div data-main><h1>{L}</h1><div>{P}</div><div>{P}</div><div>{S}</div></div>"
    "<div>&copy; {L}</div></body>",
    "<body><div role='navigation'><ul><li>{A}</li><li>{A}</li></ul></div><div role='main' data-main><h1>{L}</h1><p>{P} {A} {S}</p><table><tr><th>{W}</th><th>{W}</th></tr>"
    "<tr><td>{W}</td><td>{L}</td></tr></table><p>{P}</p></div><div role='complementary'><p>{S}</p></div><div role='contentinfo'>{S}</div></body>",
    "<body><nav>{A} {A}</nav><section class='hero banner'><h2>{L}</h2><p>{S}</p></section><section class='story' data-main><h1>{L}</h1><p>{S}</p><p>{P}</p><p>{P}</p>"
    "<form data-rest class='newsletter'><p>{S}</p></form><p>{P}</p></section><section class='related'><h3>{L}</h3><p>{S}</p><p>{S}</p></section>" + _FOOT + "</body>",
    "<body><table><tr><td class='nav'>{A}<br>{A}<br>{A}</td><td data-main><p>{P}</p><p>{P}</p><p>{S}</p></td></tr></table><p class='copyright'>{L}</p></body>",
    "<body><form class='search'><label>{W}</label></form><div class='alert'>{S}</div><main><div class='article-body' data-main><h1>{L}</h1><p>{P}</p><ol><li>{S}</li><li>{P}</li></ol>"
    "<h3>{L}</h3><p>{S}</p></div><div class='sponsored'><p>{P}</p></div><div class='reader-comments'><h3>{L}</h3><p>{P}</p><p>{S}</p><p>{P}</p></div></main>" + _FOOT + "</body>",
    "<body><article data-main><p>{P}</p><p>{P}</p></article><article class='comment'><p>{P}</p></article><article class='comment'><p>{S}</p></article></body>",
    "<body><div class='page'><div class='page-header'><h1>{W}</h1><p>{L}</p></div><div class='text' data-main><p>{S}</p><p>{P}</p></div><aside>{P}</aside><div class='disclaimer'><p>{P}</p></div></div></body>",
    "<body data-main><h1>{L}</h1><p>{P}</p><p>{P}</p><p>{S}</p></body>",
    "<body data-main>{P}</body>",
    "<body>" + _NAV + "<article data-main><h1>{L}</h1><p>{P}</p><div data-rest class='promo'><p>{S}</p></div><h2>{L}</h2><p>{P}</p><nav data-rest><ul><li>{A}</li><li>{A}</li></ul></nav>"
    "<p>{L}</p><section data-rest id='replies'><p>{P}</p><p>{S}</p></section></article><aside><p>{P}</p></aside>" + _FOOT + "</body>",
]
VARIANTS = 6
_SLOT = re.compile(r"\{([PSLWA])\}")


def _words(draw: random.Random, low: int, high: int) -> str:
    return " ".join("x" * draw.randint(1, 9) for _ in range(draw.randint(low, high)))


def _fill(draw: random.Random, slot: str) -> str:
    if slot == "P":
        return ". ".join(_words(draw, 5, 25) for _ in range(draw.randint(2, 8))) + "."
    if slot == "S":
        return _words(draw, 5, 22) + "."
    if slot == "A":
        return f"<a href='/'>{_words(draw, 1, 4)}</a>"
    return _words(draw, 3, 10) if slot == "L" else _words(draw, 1, 2)


def labelled_pages() -> list[str]:
    draw = random.Random(7)
    return [_SLOT.sub(lambda m: _fill(draw, m[1]), layout) for layout in LAYOUTS for _ in range(VARIANTS)]
