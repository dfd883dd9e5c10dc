"""Labelled sample pages for the block classifier; ``data-main`` marks the main text.  Written for this purpose."""

from __future__ import annotations

_LONG = (
    "The river rose early that spring, and the people of the lower town moved their boats up to the meadow before the first "
    "rain came. Nobody had seen the water stand so high against the old bridge since the year of the great fire."
)
_MIDDLE = "Two of the carpenters stayed behind to watch the mill, while the others walked to the market."
_SHORT = "They waited."
_TITLE = "A high spring"
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Music", "About", "Contact"))
_LINK_LINE = '<a href="/a">Earlier reports</a> | <a href="/b">More from this town</a> | <a href="/c">All about rivers</a>'


def _article(*paragraphs: str) -> str:
    return "".join(f"<p>{p}</p>" for p in paragraphs)


def _cut(*sizes: int) -> list[str]:
    """Passages of given numbers of words."""
    words = (_LONG + " " + _MIDDLE).split()
    return [" ".join((words * 4)[at : at + size]) for at, size in enumerate(sizes)]


def _plain(*sizes: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{x}</{tag}>" for x in _cut(*sizes))


PAGES = [
    # Text in unnamed divisions, paragraphs of all lengths, the last ones short.
    f"<body><div data-main><h1>{_TITLE}</h1>{_plain(30, 12, 45, 9)}</div><div><ul>{_LINKS}</ul></div>",
    f"<body><div><ul>{_LINKS}</ul></div><div data-main><h2>{_SHORT}</h2>{_plain(60, 22, 18, 11, 34)}</div>",
    f"<body data-main>{_plain(25, 40, 16, 70, 20)}</body>",
    f"<body><div data-main>{_plain(80, 35, 50, tag='div')}</div><div>{_LINK_LINE}</div>",
    f"<div data-main>{_cut(28)[0]}</div>",
    f"<body><div>{_LINK_LINE}</div><div data-main><h1>{_TITLE}</h1>{_plain(15, 33, 27, 13)}</div><div>{_SHORT}</div><div>{_LINK_LINE}</div>",
    f"<body><table><tr><td><ul>{_LINKS}</ul></td><td data-main>{_plain(44, 19, 26)}</td></tr></table><p>{_LINK_LINE}</p><p>{_SHORT}</p>",
    # Named content, with a list of links at its end that has no name.
    f"<body><div class='post-content'><div data-main><h1>{_TITLE}</h1>{_plain(8, 25, 4, 14)}</div><ul>{_LINKS}</ul></div><div>{_LINK_LINE}</div>",
    f"<body><div id='content'><ul>{_LINKS}</ul><div data-main>{_plain(5, 6, 31)}<ul><li>{_MIDDLE}</li><li>{_SHORT}</li></ul></div></div>",
    f"<body><main><p>{_LINK_LINE}</p><div data-main><h1>{_SHORT}</h1>{_plain(3, 10, 2)}</div><p>{_LINK_LINE}</p><ul>{_LINKS}</ul></main>",
    f"<body><article data-main><h1>{_TITLE}</h1><p>{_LONG} <a href='/y'>{_MIDDLE}</a></p><p>{_SHORT} <a href='/z'>Yes.</a></p></article>",
    # An article between a menu, an advert and a footer; unclosed elements.
    f"<html><head><title>{_TITLE}</title></head><body><nav><ul>{_LINKS}</ul></nav><div class='ad'>{_MIDDLE}</div>"
    f"<article data-main><h1>{_TITLE}</h1><p><b>{_SHORT}<br><p>{_LONG}</p><p>{_MIDDLE}</p><p>{_SHORT}</p></article>"
    f"<footer>&copy; 2020 The town paper. All rights reserved.</footer></body></html>",
    # One short paragraph, and adverts of about its length.
    f"<body><ul class='menu'>{_LINKS}</ul><div class='ad'>{_SHORT}</div><article data-main><h1>{_SHORT}</h1><p>{_SHORT}</p></article>"
    f"<div class='advert'>{_MIDDLE}</div><footer>{_SHORT}</footer>",
    # A header, a sidebar, a notice, a form and reader comments.
    f"<body><header><h2>The town paper</h2><p>{_MIDDLE}</p></header><div id='cookie-notice'><p>We use cookies. {_LONG}</p></div>"
    f"<main data-main><h1>{_TITLE}</h1><p>{_LONG}</p><h2>{_SHORT}</h2><p>{_MIDDLE}</p><ul><li>{_MIDDLE}</li><li>{_SHORT}</li></ul></main>"
    f"<aside class='sidebar'><h3>Related</h3><p>{_LONG}</p><p>{_LINK_LINE}</p></aside><form><p>{_MIDDLE}</p><label>Name</label></form>"
    f"<section id='comments'><h3>Comments</h3><div class='comment'><p>{_LONG}</p></div><div class='comment'><p>{_SHORT}</p></div></section>",
    # No article element: long text in plain divisions among lists of links.
    f"<body><div><ul>{_LINKS}</ul></div><div data-main><h1>{_TITLE}</h1><div>{_LONG}</div><div>{_LONG}</div><div>{_MIDDLE}</div></div>"
    f"<div>{_LINK_LINE}</div><div><ul>{_LINKS}</ul></div><div class='footer'>Imprint and contact of the paper</div>",
    f"<body><table><tr><td>{_LINK_LINE}</td></tr><tr><td data-main>{_LONG}</td></tr><tr><td data-main>{_LONG}</td></tr>"
    f"<tr><td>{_LINK_LINE}</td></tr></table>",
    # Links inside the text, and asides within the article.
    f"<body><nav>{_LINK_LINE}</nav><article><div data-main><h1>{_TITLE}</h1><p>{_LONG} <a href='/x'>The bridge</a> held.</p><p>{_SHORT}</p></div>"
    f"<div class='share'>Tell others about this</div><div data-main><p>{_MIDDLE}</p><blockquote>{_MIDDLE}</blockquote><pre>{_SHORT}</pre></div>"
    f"<aside><p>{_MIDDLE}</p></aside><div class='newsletter'><p>Get our letter. {_MIDDLE}</p></div></article>"
    f"<div class='related'><p>{_LONG}</p></div><div role='contentinfo'>{_SHORT}</div>",
    # Comments that are articles themselves, a hidden notice.
    f"<body><div hidden>{_LONG}</div><article data-main><h1>{_TITLE}</h1><p>{_LONG}</p><p>{_LONG}</p><p>{_MIDDLE}</p></article>"
    f"<section class='comments'><article class='comment'><p>{_LONG}</p></article><article class='comment'><p>{_MIDDLE}</p></article></section>"
    f"<footer><p>{_LONG}</p><ul>{_LINKS}</ul></footer>",
    # A page of links alone has no main text.
    f"<body><ul>{_LINKS}</ul><div>{_LINK_LINE}</div><p>{_LINK_LINE}</p><div>{_LINK_LINE}</div><footer>{_SHORT}</footer>",
]
