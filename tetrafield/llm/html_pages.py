"""Seeded web pages of made-up words with known main text, to train the extractor on and to test it.

A page is put together from parts that may each be there or not, under names drawn from what sites commonly use, or
under none. Every block of main text starts with the sign ①; no other block has it.
"""

from __future__ import annotations

import numpy as np

SYLLABLES = "an be co da el fi go ha in ju ka lo me no op pa qua re si ta un vo we xi ya zo ing ter tion ment ver ach ung eau oir dad".split()
# Names of parts as sites use them, fixed values.
CONTENT = ["content", "post-content", "entry-content", "article-body", "main-content", "story", "post", "entry", "text", "body-copy", "c1", "x7", ""]
MENU = ["nav", "navbar", "main-menu", "menu", "site-nav", "topnav", "breadcrumbs", "nav-links", "m1", ""]
SIDE = ["sidebar", "side", "widget-area", "rail", "related", "recommended", "popular-posts", "right-col", ""]
ADVERT = ["ad", "ads", "advert", "ad-slot", "banner-ad", "sponsored", "promo", "advertisement", "ad-container"]
NOTICE = ["cookie-notice", "notice", "consent-banner", "alert", "newsletter", "subscribe-box", "gdpr", "site-message", "warning"]
COMMENT = ["comments", "comment-list", "discussion", "respond", "disqus_thread", "reader-comments", "replies", "comment-section"]
FOOT = ["footer", "site-footer", "bottom", "colophon", "copyright", ""]
HEAD = ["header", "masthead", "site-header", "top", "branding", ""]


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.broken = rng.random() < 0.5

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, among: list) -> str:
        return among[int(self.rng.integers(len(among)))]

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high))))

    def sentences(self, low: int, high: int) -> str:
        made = []
        for _ in range(int(self.rng.integers(low, high))):
            s = self.words(2, 18).capitalize()
            if self.chance(0.3):
                s = s.replace(" ", ", ", 1)
            made.append(s + self.pick([".", ".", ".", "!", "?"]))
        return " ".join(made)

    def named(self, tag: str, names: list[str], inner: str, plain: float = 0.3) -> str:
        """The part under its own tag or as a div, with a name or without."""
        name = self.pick(names)
        if self.chance(plain) or tag == "div":
            return f"<{tag}{self.attribute(name) if self.chance(0.6) or tag == 'div' else ''}>{inner}</{tag}>"
        return f"<div{self.attribute(name)}>{inner}</div>"

    def attribute(self, name: str) -> str:
        if not name:
            return ""
        return f' {self.pick(["class", "id", "class"])}="{name}{self.pick(["", "", " box", " wrap"])}"'

    def links(self, low: int, high: int) -> str:
        made = [f'<a href="/{self.word()}">{self.words(1, 4).capitalize()}</a>' for _ in range(int(self.rng.integers(low, high)))]
        if self.chance(0.6):
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return self.pick([" | ", " ", " &middot; "]).join(made)

    def paragraph(self, mark: str) -> str:
        text = mark + self.sentences(1, 9)
        if self.chance(0.15):
            text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.words(1, 6)}.'
        shape = self.rng.random()
        if self.broken and shape < 0.25:
            return f"<p><b>{text}<br>"
        if self.broken and shape < 0.4:
            return f"<p>{text}"
        if shape < 0.5:
            return f"<p><em>{text}</em></p>"
        return f"<p>{text}</p>"

    def main(self) -> str:
        parts = []
        head = f"<h{self.pick([1, 1, 2])}>①{self.words(1, 12).capitalize()}"
        head += f"</h{head[2]}>"
        if self.chance(0.9):
            parts.append(f"<header>{head}</header>" if self.chance(0.15) else head)
        loose = self.chance(0.1)
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.75:
                parts.append(f"<div>①{self.sentences(1, 8)}</div>" if loose else self.paragraph("①"))
            elif kind < 0.82:
                parts.append(f"<h{self.pick([2, 3])}>①{self.words(1, 7).capitalize()}</h2>".replace("</h2>", "</h2>" if "<h2" in parts[-1:] else "</h3>"))
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>①{self.words(2, 14).capitalize()}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>①{self.sentences(1, 4)}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>①{self.words(1, 3)}</td><td>①{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<figure><img src='a.png'><figcaption>①{self.words(3, 10)}</figcaption></figure>")
            if self.chance(0.06):
                parts.append(self.part("advert"))
            if self.chance(0.03):
                parts.append(self.part(self.pick(["notice", "share", "side"])))
        return "".join(parts)

    def part(self, kind: str) -> str:
        if kind == "menu":
            return self.named("nav", MENU, self.links(2, 9), 0.7)
        if kind == "head":
            return self.named("header", HEAD, self.pick([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 8)}</p>"]) + (self.part("menu") if self.chance(0.4) else ""), 0.7)
        if kind == "foot":
            inner = self.pick([f"&copy; {self.word()}.example.com &middot; {self.sentences(1, 3)}", f"<p>Copyright {self.words(2, 6)}</p>", self.links(2, 7), f"<p>© 2020 {self.sentences(1, 2)}</p>{self.links(2, 5)}"])
            return self.named("footer", FOOT, inner, 0.8)
        if kind == "advert":
            return self.named("div", ADVERT, self.pick([self.sentences(1, 3), f"<p>{self.sentences(1, 4)}</p>", f'<a href="/x">{self.words(2, 9)}</a>', f"<h3>{self.words(2, 5)}</h3><p>{self.sentences(1, 2)}</p>"]))
        if kind == "notice":
            return self.named(self.pick(["div", "section", "aside"]), NOTICE, f"<p>{self.sentences(1, 4)}</p>" + self.pick(["", "<button>OK</button>", '<a href="/p">more</a>']))
        if kind == "side":
            inner = "".join(self.pick([f"<h3>{self.words(1, 4)}</h3>", "", f"<p>{self.sentences(1, 3)}</p>", self.links(2, 7)]) for _ in range(3)) or self.links(2, 4)
            return self.named("aside", SIDE, inner, 0.6)
        if kind == "form":
            return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><p>{self.words(2, 9)}</p><button>{self.word()}</button></form>'
        if kind == "share":
            return f'<div class="{self.pick(["share", "social", "share-buttons", "follow"])}">{self.links(2, 5)}</div>'
        shape, many = self.rng.random(), int(self.rng.integers(1, 7))
        one = lambda: f"<p>{self.sentences(1, 5)}</p>" if self.chance(0.7) else self.sentences(1, 4)
        if shape < 0.35:
            inner = "<ol>" + "".join(f"<li><b>{self.word()}</b> {one()}</li>" for _ in range(many)) + "</ol>"
        elif shape < 0.7:
            inner = "".join(f'<div class="comment"><span>{self.word()}</span>{one()}</div>' for _ in range(many))
        else:
            inner = "".join(f"<article><h4>{self.word()}</h4>{one()}</article>" for _ in range(many))
        head = self.pick(["", f"<h2>{self.words(1, 3)}</h2>", "<h3>Comments</h3>"])
        return self.named("section", COMMENT, head + inner + (self.part("form") if self.chance(0.4) else ""), 0.5) if self.chance(0.9) else f'<section id="comments">{head}{inner}</section>'


def page(rng: np.random.Generator) -> str:
    w = _Writer(rng)
    main, shape = w.main(), rng.random()
    if shape < 0.45:
        main = f"<article>{main}</article>"
    elif shape < 0.6:
        main = f"<main>{main}</main>"
    else:
        tag = w.pick(["div", "div", "section", "article"])
        main = f"<{tag}{w.attribute(w.pick(CONTENT))}>{main}</{tag}>"
    if w.chance(0.3):
        main = f"<main>{main}</main>" if w.chance(0.5) else f'<div class="{w.pick(["wrapper", "container", "row", "page"])}">{main}</div>'
    before = [k for k, p in (("head", 0.5), ("menu", 0.75), ("notice", 0.2), ("form", 0.15), ("advert", 0.35), ("side", 0.15)) if w.chance(p)]
    after = [k for k, p in (("share", 0.2), ("comments", 0.4), ("side", 0.4), ("advert", 0.3), ("form", 0.15), ("notice", 0.15), ("menu", 0.1)) if w.chance(p)]
    rng.shuffle(after)
    if w.chance(0.85):
        after.append("foot")
    body = "".join(map(w.part, before)) + main + "".join(map(w.part, after))
    if w.chance(0.2):
        body = f'<div id="{w.pick(["page", "wrap", "root", "app"])}">{body}</div>'
    head = f'<head><meta charset="utf-8"><title>{w.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";track(3);</script></head>'
    if w.chance(0.1):
        return body
    return f'<!DOCTYPE html><html lang="en">{head}<body>{body}' + ("</body></html>" if w.chance(0.9) else "")
