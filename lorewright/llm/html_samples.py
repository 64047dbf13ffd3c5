"""Labelled pages for fitting the extractor's weights: made from templates, so the main blocks are known."""

from __future__ import annotations

import random

#: Names that site templates give to their regions.
AROUND = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "pager"],
    "head": ["header", "masthead", "topbar", "logo", "branding", "site", "toolbar", "search"],
    "foot": ["footer", "copyright", "colophon", "bottom", "legal", "imprint"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "more", "popular", "trending", "tags", "archive", "rail", "teaser"],
    "note": ["cookie", "notice", "banner", "alert", "consent", "gdpr", "popup", "modal", "overlay", "disclaimer", "message", "privacy"],
    "ads": ["ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "commercial"],
    "form": ["form", "login", "signup", "subscribe", "newsletter", "feedback", "contact", "register"],
    "talk": ["comments", "comment", "respond", "replies", "reply", "discussion", "disqus", "thread"],
    "share": ["share", "social", "sharing", "follow", "likes"],
}
INSIDE = ["content", "article", "post", "entry", "story", "main", "body", "text", "page", "blog", "prose"]
WORDS = "the of and in to a is was for on with as by that it from at his her an be this which or are but not had have one been their has were all when she who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()


#: How a page holds its text: as parts with elements of their own, as bare text in boxes, between line breaks, in sections.
SHAPES = ["parts", "boxes", "breaks", "sections"]


def labelled_page(rng: random.Random, shape: str | None = None, form: bool | None = None, tagged: bool | None = None) -> tuple[str, list[str]]:
    """(html, main blocks); shape, form around the page and html tags are drawn where they are not given."""
    shape = shape or rng.choices(SHAPES, weights=[7, 1, 1, 1])[0]
    form = rng.random() < 0.15 if form is None else form
    tagged = rng.random() < 0.7 if tagged is None else tagged
    text = lambda low, high: " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))
    name = lambda kind: rng.choice(AROUND[kind])

    def around(kind: str) -> str:
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        tag = tag if rng.random() < 0.5 else rng.choice(["div", "section", "ul"] if kind in ("nav", "side", "share") else ["div", "section"])
        mark = rng.choice(["class", "id"])
        inner = rng.choice(
            [
                "".join(f'<li><a href="#">{text(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))),
                f"<p>{text(3, 40)}</p>" * rng.randint(1, 3),
                f"<h3>{text(1, 4)}</h3><p>{text(5, 60)}</p>",
                text(3, 25),
                f'<a href="#">{text(1, 4)}</a> | <a href="#">{text(1, 4)}</a>',
            ]
        )
        return f'<{tag} {mark}="{name(kind)}">{inner}</{tag}>'

    blocks: list[str] = []

    def keep(x: str) -> str:
        blocks.append(x)
        return x

    parts = [f"<h1>{keep(text(2, 10))}</h1>"] if rng.random() < (0.9 if shape == "parts" else 0.5) else []
    if shape == "boxes":
        parts += [f"<div>{keep(text(30, 90))}</div>" for _ in range(rng.randint(1, 4))]
    elif shape == "breaks":
        said = [text(20, 70) for _ in range(rng.randint(1, 4))]
        keep(" ".join(said))
        parts.append(f"<div>{rng.choice(['<br>', '<br><br>', '<br/>']).join(said)}</div>")
    elif shape == "sections":
        for _ in range(rng.randint(1, 3)):
            parts.append("<section>" + "".join(f"<p>{keep(text(15, 80))}</p>" for _ in range(rng.randint(1, 3))) + "</section>")
    for _ in range(rng.randint(1, 9) if shape == "parts" else 0):
        kind = rng.random()
        if kind < 0.6:
            parts.append(f"<p>{keep(text(1, 90))}</p>")
        elif kind < 0.7:
            parts.append(f"<h2>{keep(text(1, 7))}</h2>")
        elif kind < 0.78:
            parts.append("<ul>" + "".join(f"<li>{keep(text(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.84:
            parts.append(f"<blockquote>{keep(text(4, 40))}</blockquote>")
        elif kind < 0.87:
            parts.append("<table>" + "".join(f"<tr><td>{keep(text(1, 5))}</td><td>{keep(text(1, 5))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
        elif kind < 0.92:
            a, b, c = text(1, 20), text(1, 4), text(1, 20)
            keep(f"{a} {b} {c}")
            parts.append(f'<p>{a} <a href="#">{b}</a> {c}</p>')
        else:
            parts.append(around(rng.choice(["ads", "side", "share", "note", "form"])))
    if shape == "parts" and rng.random() < 0.5 and len(parts) > 2:  # parts of an article in boxes without a telling name
        cut = rng.randint(1, len(parts) - 1)
        box = rng.choice(["section", "div", 'div class="row"', 'section id="s1"', "figure"])
        parts = [*parts[:cut], f"<{box}>", *parts[cut:], f"</{box.split()[0]}>"]
    if rng.random() < 0.3:
        parts.append(around("talk"))
    place = rng.random() if shape == "parts" else rng.uniform(0.4, 1.2)
    body = "".join(parts)
    if place < 0.5:
        body = f"<article>{body}</article>"
    elif place < 0.75:
        body = f'<div class="{rng.choice(INSIDE)}">{body}</div>'
    if rng.random() < (0.4 if shape == "parts" else 0.1):
        body = f"<main>{body}</main>" if rng.random() < 0.6 else f'<div id="{rng.choice(INSIDE)}">{body}</div>'
    before = "".join(around(k) for k in ("head", "nav", "note", "ads") if rng.random() < 0.6)
    after = "".join(around(k) for k in ("talk", "side", "share", "form", "note", "foot") if rng.random() < 0.6)
    if rng.random() < 0.3:
        body = f"<div>{body}</div>"
    page = f"{before}{body}{after}"
    if form:
        page = f'<form id="{rng.choice(["aspnetForm", "form1", "page"])}"><div>{page}</div></form>'
    return (f"<html><head><title>{text(2, 6)}</title></head><body>{page}</body></html>" if tagged else page), blocks


def labelled_pages(n: int = 700, seed: int = 20, **given) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [labelled_page(rng, **given) for _ in range(n)]
