"""Labelled pages for the block model, made by rule: the layouts of articles, with what surrounds and interrupts them.

A page is a list of (html, is main text) pieces; words are made of random syllables, so that no language is preferred.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba be co da de el en er et fa ga he in is ka le li ma mo na ne on or pa ra re sa se ta te to un va ve zu ár ün ço".split()
#: What an article stands in: element, attributes.
_MAIN = [("article", ""), ("main", ""), ("div", 'id="content"'), ("div", 'class="post-content"'), ("section", 'class="article-body"'), ("div", 'class="entry"'), ("div", 'class="story text"'), ("div", 'role="main"'), ("article", 'class="post"'), ("div", "")]
#: Attributes of what is no main text, by its kind.
_KINDS = {
    "nav": ['class="menu"', 'id="nav"', 'class="navbar navigation"', 'class="breadcrumbs"', 'class="pagination"', 'role="navigation"', 'class="tabs"'],
    "header": ['class="header"', 'id="masthead"', 'class="site-header top"', 'class="logo"', 'role="banner"'],
    "footer": ['class="footer"', 'id="colophon"', 'class="copyright"', 'class="site-footer bottom"', 'class="legal imprint"'],
    "aside": ['class="sidebar"', 'id="rail"', 'class="widget"', 'class="related links"', 'class="recommended more popular trending"', 'class="tags"', 'class="author bio"'],
    "ad": ['class="ad"', 'class="ads"', 'class="advert"', 'class="advertisement"', 'class="sponsored"', 'class="promo"', 'id="banner"', 'class="ad-slot sponsor"', 'class="promotion teaser"'],
    "notice": ['class="cookie-notice"', 'class="notice"', 'id="consent"', 'class="gdpr banner"', 'class="alert"', 'class="popup modal overlay"', 'class="paywall subscribe"', 'role="alert"', 'role="dialog"'],
    "comment": ['class="comments"', 'id="comments"', 'class="comment"', 'id="disqus"', 'class="replies discussion"', 'class="responses"', 'class="reader-comments"'],
    "form": ['class="search"', 'class="newsletter signup"', 'class="contact"', 'class="login"', 'role="search"'],
    "share": ['class="share"', 'class="social"', 'class="sharing buttons follow"'],
}
_ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


def _sentence(rnd: random.Random, low: int = 3, high: int = 16) -> str:
    words = ["".join(rnd.choices(_SYLLABLES, k=rnd.randint(1, 4))) for _ in range(rnd.randint(low, high))]
    return " ".join(words).capitalize() + rnd.choice("....?!")


def _varied(rnd: random.Random, attributes: str) -> str:
    """Some of the class and id words in compounds, as pages have them."""
    if not attributes or rnd.random() < 0.5:
        return attributes
    key, _, value = attributes.partition("=")
    add = lambda w: rnd.choice([w + x for x in ("list", "box", "area", "wrap", "-inner", "_1", "Block", "s")] + ["my" + w, rnd.choice(_SYLLABLES) + "-" + w]) if len(w) > 3 and rnd.random() < 0.6 else w
    return f'{key}="' + " ".join(add(w) for w in value.strip('"').split()) + '"'


def _links(rnd: random.Random) -> str:
    return "".join(f'<li><a href="/{i}">{_sentence(rnd, 1, 3)[:-1]}</a></li>' for i in range(rnd.randint(2, 8)))


def _aside(rnd: random.Random, kind: str) -> str:
    """Some piece of a kind, in its own element or in a plain one with telling attributes."""
    attributes = _varied(rnd, rnd.choice(_KINDS[kind]))
    element = _ELEMENTS.get(kind, "div")
    if kind in ("ad", "notice", "comment", "share", "aside") and rnd.random() < 0.3:
        element = rnd.choice(["section", "aside", "div"])
    if kind in _ELEMENTS and kind != "form" and rnd.random() < 0.4:
        element = "div"
    elif kind in _ELEMENTS and rnd.random() < 0.6:
        attributes = ""
    inner = {
        "nav": lambda: f"<ul>{_links(rnd)}</ul>",
        "header": lambda: f"<h1>{_sentence(rnd, 1, 4)[:-1]}</h1><p>{_sentence(rnd, 3, 8)}</p>" if rnd.random() < 0.5 else f'<a href="/">{_sentence(rnd, 1, 3)[:-1]}</a>',
        "footer": lambda: f"&copy; {_sentence(rnd, 2, 8)}" if rnd.random() < 0.5 else f"<p>&copy; 20{rnd.randint(10, 30)} {_sentence(rnd, 2, 8)}</p><ul>{_links(rnd)}</ul>",
        "aside": lambda: f"<h3>{_sentence(rnd, 1, 4)[:-1]}</h3>" + (f"<ul>{_links(rnd)}</ul>" if rnd.random() < 0.5 else f"<p>{_sentence(rnd)}</p>"),
        "ad": lambda: _sentence(rnd) if rnd.random() < 0.6 else f"<p>{_sentence(rnd)}</p><a href='#'>{_sentence(rnd, 1, 3)}</a>",
        "notice": lambda: f"<p>{_sentence(rnd)} {_sentence(rnd)}</p><button>{_sentence(rnd, 1, 2)[:-1]}</button>" if rnd.random() < 0.6 else _sentence(rnd),
        "comment": lambda: f"<h2>{_sentence(rnd, 1, 3)[:-1]}</h2>" + "".join(f"<div class='{rnd.choice(['comment', 'reply', 'item', ''])}'><b>{_sentence(rnd, 1, 2)[:-1]}</b><p>{' '.join(_sentence(rnd) for _ in range(rnd.randint(1, 4)))}</p></div>" for _ in range(rnd.randint(1, 4))),
        "form": lambda: f"<label>{_sentence(rnd, 1, 4)[:-1]}</label><input name=q><button>{_sentence(rnd, 1, 2)[:-1]}</button>" + (f"<p>{_sentence(rnd)}</p>" if rnd.random() < 0.5 else ""),
        "share": lambda: f"<ul>{_links(rnd)}</ul>" if rnd.random() < 0.5 else f"<a href='#'>{_sentence(rnd, 1, 1)}</a> <a href='#'>{_sentence(rnd, 1, 1)}</a>",
    }[kind]()
    return f"<{element} {attributes}>{inner}</{element}>"


def _main_piece(rnd: random.Random) -> str:
    body = " ".join(_sentence(rnd) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])))
    if rnd.random() < 0.08:
        body = _sentence(rnd, 1, 2)
    if rnd.random() < 0.2:
        words = body.split(" ")
        words[0] = f"<a href='/x'>{words[0]}</a>"
        body = " ".join(words)
    return rnd.choices(
        [f"<p>{body}</p>", f"<p><b>{body}<br>", f"<h2>{_sentence(rnd, 1, 6)[:-1]}</h2>", f"<ul><li>{_sentence(rnd)}</li><li>{_sentence(rnd, 1, 4)}</li></ul>", f"<blockquote>{body}</blockquote>", f"<table><tr><td>{_sentence(rnd, 1, 3)}</td><td>{_sentence(rnd, 1, 3)}</td></tr></table>", f"<pre>{body}</pre>", f"<figure><figcaption>{_sentence(rnd)}</figcaption></figure>", f"<div>{body}</div>", f"<dl><dt>{_sentence(rnd, 1, 3)[:-1]}</dt><dd>{_sentence(rnd, 1, 8)[:-1]}</dd></dl>"],
        [60, 8, 8, 4, 3, 2, 2, 2, 4, 3],
    )[0]


def labelled_page(rnd: random.Random) -> list[tuple[str, bool]]:
    title = _sentence(rnd, 2, 10)
    page = [(f"<html><head><title>{title}</title></head><body>", False)]
    for kind in rnd.sample(["nav", "header", "ad", "notice", "form"], rnd.randint(1, 4)):
        page.append((_aside(rnd, kind), False))
    outer = rnd.random() < 0.3
    if outer:
        page.append((rnd.choice(["<div class='wrapper'>", "<div id='page'>", "<div class='container'>", "<main>"]), False))
    if rnd.random() < 0.3:
        page.append((_aside(rnd, "aside"), False))
    element, attributes = rnd.choice(_MAIN)
    attributes = _varied(rnd, attributes)
    page.append((f"<{element} {attributes}>", False))
    if rnd.random() < 0.8:
        page.append((f"<h1>{title}</h1>", True))
    for _ in range(rnd.randint(1, 14)):
        page.append((_main_piece(rnd), True))
        if rnd.random() < 0.12:
            page.append((_aside(rnd, rnd.choice(["ad", "aside", "form", "notice", "share", "comment"])), False))
    if rnd.random() < 0.15:
        page.append((_aside(rnd, "comment"), False))
    page.append((f"</{element}>", False))
    for kind in rnd.sample(["aside", "comment", "ad", "share", "form"], rnd.randint(0, 3)):
        page.append((_aside(rnd, kind), False))
    if outer:
        page.append(("</div>", False))
    page.append((_aside(rnd, "footer"), False))
    if rnd.random() < 0.2:
        page.append((_aside(rnd, "notice"), False))
    return page


def labelled_pages(n: int, seed: int) -> list[list[tuple[str, bool]]]:
    rnd = random.Random(seed)
    return [labelled_page(rnd) for _ in range(n)]
