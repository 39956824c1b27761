"""Labelled pages to learn from: made-up sites of many layouts, whose elements say whether they are the article's.

``data-label="content"`` marks an element whose text is main text, and
``data-label="other"`` one inside it whose text is not.
"""

from __future__ import annotations

import random

SYLLABLES = "ba be ci da de fo ga hi ka la le mi na no pe ra ri so ta te to un ver wi".split()
#: Class or id words by what sites use them for.
NAMES = {
    "content": "article article-body body-text content entry entry-content main main-content post post-body post-content story story-body text".split(),
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs site-nav tabs".split(),
    "header": "header masthead site-header top topbar branding logo".split(),
    "footer": "footer site-footer bottom copyright colophon legal footer-links".split(),
    "aside": "sidebar aside widget rail related related-posts popular most-read recommended right-column promo-box".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr popup modal newsletter-notice paywall".split(),
    "advert": "ad ads advert advertisement banner sponsored promo promotion adsense".split(),
    "form": "search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment comment-list reader-comments replies discussion responses".split(),
    "share": "share social share-buttons follow tags meta-tags toolbar".split(),
}


class Writer:
    """Random pages of one generator."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.junk = False
        self.lexicon = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(600)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.lexicon, k=self.rng.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        if self.junk:
            # words over and over, hardly a full stop
            return " ".join(w for w in self.words(2, 6).split() for _ in range(self.rng.randint(1, 9))).capitalize() + self.rng.choice(("", "", "", "."))
        marks = self.rng.choice(("", "", "", "%%%", "&amp;&amp;", "###", ","))
        return " ".join(w + (marks if self.rng.random() < 0.3 else "") for w in self.words(low, high).split()).capitalize() + self.rng.choice(("", ".", ".", ".", "!", "?"))

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.choice(self.lexicon)}">{self.words(low, high)}</a>'

    def named(self, kind: str) -> str:
        """An attribute with one of a kind's words, or none."""
        if self.rng.random() < 0.2:
            return ""
        return f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(NAMES[kind])}"'

    def element(self, tags: str, kind: str, inner: str, label: str = "", plain: bool = False) -> str:
        tag = self.rng.choice(tags.split())
        named = "" if plain else self.named(kind)
        if tag in ("div", "section") and not named and not plain:
            named = f' class="{self.rng.choice(NAMES[kind])}"'
        return f"<{tag}{named}{label}>{inner}</{tag}>"

    # --- the article ----------------------------------------------------------
    def paragraph(self) -> str:
        inner = self.prose()
        if self.rng.random() < 0.25:
            inner += f" {self.link()} {self.sentence()}"
        if self.rng.random() < 0.15:
            inner = f"<b>{inner}" + self.rng.choice(("</b>", "<br>", ""))
        elif self.rng.random() < 0.15:
            inner = f"<em>{self.words(1, 4)}</em> {inner}"
        return self.rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>")).format(inner)

    def passage(self) -> str:
        kind = self.rng.random()
        if kind < 0.7:
            return self.paragraph()
        if kind < 0.78:
            return f"<h2>{self.sentence(2, 7)}</h2>{self.paragraph()}"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if kind < 0.94:
            rows = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.97:
            return f'<figure><img src="x.png"><figcaption>{self.sentence(3, 8)}</figcaption></figure>'
        return f"<pre>{self.words(3, 20)}</pre>"

    def inside(self) -> str:
        """Something within the article's element that is not the article's."""
        part = self.rng.choice((self.advert, self.share, self.form, self.aside, self.comments, self.notice))()
        return part

    def article(self) -> str:
        title = f"<h1>{self.sentence(1, 9)}</h1>" if self.rng.random() < 0.85 else ""
        if title and self.rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [self.passage() for _ in range(self.rng.choice((0, 1, 1, 2, 3, 5, 8, 14)))]
        if not parts and not title:
            parts = [self.paragraph()]
        if self.rng.random() < 0.25:
            parts.insert(self.rng.randint(0, len(parts)), self.inside())
        inner = title + "".join(parts)
        label = ' data-label="content"'
        frame = self.rng.random()
        if frame < 0.5:
            return f"<article{self.named('content') if self.rng.random() < 0.5 else ''}{label}>{inner}</article>"
        if frame < 0.65:
            return self.element("main section", "content", inner, label)
        if frame < 0.95:
            return self.element("div", "content", inner, label)
        return f"<div{label}>{inner}</div>"

    # --- everything else --------------------------------------------------------
    def _other(self, tags: str, kind: str, inner: str, plain: bool = False) -> str:
        return self.element(tags, kind, inner, ' data-label="other"', plain)

    def menu(self) -> str:
        links = [self.link() for _ in range(self.rng.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.rng.random() < 0.7 else " | ".join(links)
        return self._other("nav nav div ul", "menu", inner)

    def header(self) -> str:
        inner = self.rng.choice((f"<h1>{self.words(1, 3)}</h1>", self.link(), f"<p>{self.sentence(2, 8)}</p>", self.words(1, 4)))
        return self._other("header header div", "header", inner + (self.menu() if self.rng.random() < 0.4 else ""))

    def footer(self) -> str:
        inner = self.rng.choice((f"&copy; 2024 {self.words(1, 3)}", f"<p>&copy; {self.sentence()}</p>", f"&copy; {self.rng.choice(self.lexicon)}.example.com &middot; {self.prose(2)}", " ".join(self.link() for _ in range(4)), self.prose(2)))
        return self._other("footer footer div", "footer", inner)

    def aside(self) -> str:
        inner = self.rng.choice((f"<h3>{self.words(1, 3)}</h3><ul>" + "".join(f"<li>{self.link(2, 8)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>", f"<p>{self.prose(2)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.sentence()} {self.link()}</p>"))
        return self._other("aside aside div section", "aside", inner)

    def notice(self) -> str:
        inner = self.rng.choice((f"<p>{self.prose(2)}</p>", self.prose(2))) + self.rng.choice(("", "<button>OK</button>", self.link()))
        return self._other("div div section dialog", "notice", inner)

    def advert(self) -> str:
        return self._other("div div aside section", "advert", self.rng.choice((self.sentence(), f"<p>{self.sentence()}</p>", self.link(2, 8), self.prose(2), f"<h3>{self.words(1, 4)}</h3>{self.sentence()}")))

    def form(self) -> str:
        inner = self.rng.choice((f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 1)}</button>", f"<p>{self.sentence()}</p><input>", f"<h3>{self.words(1, 4)}</h3><p>{self.prose(2)}</p><select><option>{self.words(1, 2)}</option></select>"))
        return f'<form{self.named("form")} data-label="other">{inner}</form>' if self.rng.random() < 0.8 else self._other("div section", "form", f"<form>{inner}</form>")

    def share(self) -> str:
        return self._other("div div ul p", "share", " ".join(self.rng.choice((self.link(1, 2), self.words(1, 2))) for _ in range(self.rng.randint(1, 5))))

    def comments(self) -> str:
        one = "<{0} class=\"comment\"><b>{1}</b><p>{2}</p></{0}>"
        listed = [one.format(self.rng.choice(("div", "li", "article")), self.words(1, 2), self.prose(4)) for _ in range(self.rng.randint(1, 6))]
        head = f"<h3>{self.words(1, 3)}</h3>" if self.rng.random() < 0.6 else ""
        return self._other("section div ol", "comments", head + "".join(listed))

    def page(self) -> str:
        if self.rng.random() < 0.03:
            return f'<div data-label="content">{self.prose()}</div>' if self.rng.random() < 0.5 else f'<p data-label="content">{self.prose()}</p><p data-label="content">{self.prose()}</p>'
        before = [part() for part, chance in ((self.header, 0.5), (self.menu, 0.8), (self.notice, 0.2), (self.advert, 0.5), (self.form, 0.1), (self.aside, 0.2)) if self.rng.random() < chance]
        after = [part() for part, chance in ((self.share, 0.2), (self.comments, 0.35), (self.aside, 0.3), (self.advert, 0.3), (self.form, 0.2), (self.menu, 0.1), (self.footer, 0.85), (self.notice, 0.1)) if self.rng.random() < chance]
        self.junk = self.rng.random() < 0.12
        middle = self.article()
        if self.rng.random() < 0.15:
            middle = "".join(f'<p data-label="content">{self.prose()}</p>' for _ in range(self.rng.randint(1, 6)))
            if self.rng.random() < 0.6:
                middle = f'<h1 data-label="content">{self.sentence(2, 8)}</h1>' + middle
        self.junk = False
        body = "".join((*before, middle, *after))
        if self.rng.random() < 0.3:
            body = f"<div{self.rng.choice(('', ' id=\"page\"', ' class=\"wrapper\"', ' class=\"container\"'))}>{body}</div>"
        head = f"<head><meta charset=\"utf-8\"><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>track(0);</script></head>"
        end = self.rng.choice(("</body></html>", "</body></html>", ""))
        return f"<!DOCTYPE html><html>{head}<body>{body}{end}"


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    """So many labelled pages; the same seed gives the same pages."""
    writer = Writer(seed)
    return [writer.page() for _ in range(count)]
