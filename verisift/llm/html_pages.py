"""Labelled pages for training the HTML model: made by rule, with a label on every element.

Each page mixes layouts that are common on the web (menus, banners, notices, adverts, sidebars, forms, reader comments
and footers around or inside an article). The attribute data-y says whether an element is content; the parser
hands it out as the label and never as a feature.
"""

from __future__ import annotations

import random


def _word(r: random.Random) -> str:
    return "".join(r.choice("aeiou") + r.choice("bcdfghlmnprst") for _ in range(r.randint(1, 4)))


def _text(r: random.Random, lo: int, hi: int) -> str:
    words = [_word(r) for _ in range(r.randint(lo, max(lo, hi)))]
    out, at = [], 0
    while at < len(words):
        n = r.randint(4, 18)
        out.append(" ".join(words[at : at + n]).capitalize() + r.choice("....,?!"))
        at += n
    return " ".join(out)


def _menu(r: random.Random, n: int) -> str:
    return "".join(f'<li data-y=0><a href="/{_word(r)}">{_text(r, 1, 2)}</a></li>' for _ in range(n))


def _div(r: random.Random, names: list[str], inner: str, tags: tuple[str, ...] = ("div",)) -> str:
    tag = r.choice(tags)
    key = r.choice(("class", "id")) if tag in ("div", "section", "p") else r.choice(("class", "id", ""))
    name = r.choice(names) + r.choice(("", "", "-wrap", "-box", "-1"))
    attr = f' {key}="{name}"' if key else ""
    return f"<{tag}{attr} data-y=0>{inner}</{tag}>"


def _paras(r: random.Random, n: int, y: int, lo: int = 8, hi: int = 90) -> str:
    return "".join(f"<p data-y={y}>{_text(r, lo, hi)}</p>" for _ in range(n))


def _boiler(r: random.Random) -> list:
    return [
        lambda: f"<nav data-y=0><ul data-y=0>{_menu(r, r.randint(3, 9))}</ul></nav>",
        lambda: _div(r, ["menu", "navbar", "nav", "breadcrumbs", "topbar"], f"<ul data-y=0>{_menu(r, r.randint(2, 8))}</ul>"),
        lambda: _div(r, ["ad", "ads", "advert", "banner", "sponsored", "promo"], _text(r, 3, 30), ("div", "div", "aside")),
        lambda: _div(r, ["ad", "advert", "promo"], _paras(r, 1, 0, 4, 25)),
        lambda: _div(r, ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr"], _paras(r, 1, 0, 6, 40)),
        lambda: _div(r, ["sidebar", "related", "recommended", "widget", "trending"], f"<h3 data-y=0>{_text(r, 1, 3)}</h3>" + _paras(r, r.randint(0, 2), 0, 5, 30) + f"<ul data-y=0>{_menu(r, r.randint(2, 6))}</ul>", ("div", "aside")),
        lambda: _div(r, ["share", "social", "tags", "byline-links", "pagination", "pager"], "".join(f'<a href="#">{_word(r)}</a> ' for _ in range(r.randint(2, 6)))),
        lambda: f'<form data-y=0 action="/s">{_text(r, 2, 8)}<label data-y=0>{_text(r, 1, 3)}</label><input name=q><button data-y=0>{_word(r)}</button></form>',
        lambda: _div(r, ["newsletter", "subscribe", "signup", "login"], f"<p data-y=0>{_text(r, 4, 20)}</p><form data-y=0><input><button data-y=0>{_word(r)}</button></form>"),
    ]


def _comments(r: random.Random) -> str:
    """Reader comments: named one by one, or plain paragraphs and list items under a name."""
    one = lambda: _div(r, ["comment", "comment-body", "reply"], f"<p data-y=0>{_text(r, 3, 45)}</p>", ("div", "li", "article"))
    plain = lambda: r.choice((f"<p data-y=0>{_text(r, 3, 60)}</p>", f"<li data-y=0>{_text(r, 3, 45)}</li>", f"<div data-y=0><p data-y=0>{_text(r, 3, 45)}</p></div>"))
    make = r.choice((one, plain))
    head = f"<{(t := r.choice(('h2', 'h2', 'h3')))} data-y=0>{_text(r, 1, 3)}</{t}>" if r.random() < 0.85 else ""
    return _div(r, ["comments", "comments", "comment-list", "disqus", "responses", "respond"], head + "".join(make() for _ in range(r.randint(1, 5))), ("div", "section", "section"))


def _title(r: random.Random) -> str:
    """The heading of an article, on its own or in a header of the article with a line below."""
    h = f"<h1 data-y=1>{_text(r, 1, 10)}</h1>"
    if r.random() < 0.35:
        return f"<header data-y=1>{h}{r.choice(('', f'<p data-y=1>{_text(r, 2, 20)}</p>'))}</header>"
    return h


def _wrapped(r: random.Random, body: str) -> str:
    """An article in one of the elements that hold one."""
    x = r.random()
    if x < 0.55:
        return f"<article data-y=1{r.choice(('', '', ' class=post', ' class=entry', ' class=story'))}>{body}</article>"
    if x < 0.7:
        return f"<main data-y=1>{body}</main>"
    if x < 0.82:
        return f"<{(t := r.choice(('div', 'section')))} data-y=1>{body}</{t}>"
    return f'<{(t := r.choice(("div", "div", "main", "section")))} data-y=1 {r.choice(("class", "id"))}="{r.choice(("content", "post", "entry-content", "article-body", "story", "main-text", "body-copy"))}">{body}</{t}>'


def _article(r: random.Random) -> str:
    rich = [
        lambda: f"<h2 data-y=1>{_text(r, 1, 7)}</h2>",
        lambda: f"<ul data-y=1>{''.join(f'<li data-y=1>{_text(r, 2, 25)}</li>' for _ in range(r.randint(2, 5)))}</ul>",
        lambda: f"<blockquote data-y=1>{_text(r, 4, 40)}</blockquote>",
        lambda: f"<pre data-y=1>{_text(r, 4, 30)}</pre>",
        lambda: f"<table data-y=1><tr data-y=1><td data-y=1>{_text(r, 1, 6)}</td><td data-y=1>{_text(r, 1, 6)}</td></tr></table>",
        lambda: f"<figure data-y=1><figcaption data-y=1>{_text(r, 3, 15)}</figcaption></figure>",
        lambda: f"<div data-y=1>{_text(r, 5, 60)}</div>",
        lambda: f"<section data-y=1><h3 data-y=1>{_text(r, 1, 5)}</h3>{_paras(r, r.randint(1, 3), 1)}</section>",
    ]
    parts = [_title(r)] if r.random() < 0.75 else []
    for _ in range(r.randint(1, 9)):
        x = r.random()
        if x < 0.68:
            parts.append(f"<p data-y=1>{r.choice(('', '', '<b>'))}{_text(r, r.choice((1, 3, 20)), r.choice((6, 60, 160)))}{r.choice(('', '<br>'))}" + r.choice(("</p>", "")))
        elif x < 0.9:
            parts.append(r.choice(rich)())
        else:
            parts.append(r.choice(_boiler(r))())
    if r.random() < 0.2:
        parts.append(_comments(r))
    return _wrapped(r, "".join(parts))


def _short(r: random.Random) -> str:
    """An article of a few words or sentences, with a heading or without."""
    paras = "".join(f"<p data-y=1>{r.choice(('', '', '<b>'))}{_text(r, 1, r.choice((6, 6, 20, 40)))}</p>" for _ in range(r.randint(1, 3)))
    end = _comments(r) if r.random() < 0.15 else ""
    return _wrapped(r, (_title(r) if r.random() < 0.5 else "") + paras + end)


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    out = []
    for k in range(n):
        if k % 12 == 5:  # hardly any structure
            page = _paras(r, r.randint(1, 6), 1, *r.choice(((8, 90), (200, 900))))
            page = page if r.random() < 0.3 else f"<html data-y=1><body data-y=1>{page}</body></html>"
            out.append(page if k % 24 == 5 else page.translate({ord(c): None for c in ".,?!"}))
            continue
        before = "".join(r.choice(_boiler(r))() for _ in range(r.randint(0, 4)))
        after = "".join(r.choice(_boiler(r))() for _ in range(r.randint(0, 3)))
        if r.random() < 0.35:
            after = _comments(r) + after
        head = f"<header data-y=0>{r.choice(('<h1 data-y=0>', '<p data-y=0>', '<div data-y=0>'))}{_text(r, 1, 5)}" + r.choice(("", "</h1>", "</div>")) + "</header>" if r.random() < 0.4 else ""
        foot = r.choice((f"<footer data-y=0>&copy; {_text(r, 1, 20)}</footer>", _div(r, ["footer", "copyright", "legal"], _paras(r, 1, 0, 3, 25)), ""))
        core = _article(r) if k % 3 else _short(r)
        if k % 40 == 7:  # a page of menus, forms and notices alone
            core = ""
        if r.random() < 0.4:
            core = f"<{(t := r.choice(('div', 'main')))} data-y=0 class={r.choice(('page', 'wrapper', 'container', 'layout'))}>{core}{after}</{t}>"
            after = ""
        out.append(f"<!DOCTYPE html><html data-y=0><head><title>{_text(r, 2, 8)}</title><style>p{{}}</style></head><body data-y=0>{head}{before}{core}{after}{foot}</body></html>")
    return out
