"""Labelled pages, made by rule, on which the classifier of html_extract is fitted."""

from __future__ import annotations

import random

#: Pages in the sample: its bound.
PAGES = 600

_SYLLABLES = "an be ca do el fi go ha in jo ka lo me na or pa re si tu va we yo".split()
_LINKS = ("Home", "News", "About us", "Contact", "Sport", "Privacy policy", "Log in", "Read more", "Share this", "Next page")
_SAID = (
    "We use cookies to make this site better for you and for everyone else, accept them to go on", "All rights reserved", "Subscribe to our newsletter and get the best stories of the week by mail", "Terms of use",
    "Advertisement", "Follow us", "Sign up now, it is free", "Copyright 2020 the owners of this site", "Skip to content", "Sponsored",
)
_OUTER_NAMES = ("sidebar", "widget-area", "nav", "menu", "cookie-notice", "banner", "advert", "promo box", "newsletter-signup", "related", "share-buttons", "footer", "popup", "breadcrumbs")
_HOSTILE_NAMES = ("content-sidebar-wrap", "has-sidebar", "page-with-widget", "entry-content legal", "notice-of-event", "post share-story", "story related-topic", "no-banner", "comments-open", "post comments-closed", "article-with-ads", "popular-science")
_CONTENT_NAMES = ("content", "article-body", "post", "entry-content", "main", "story-text", "prose")
_COMMENT_NAMES = ("comments", "comment-list", "comments open", "respond", "replies", "disqus")


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.labels = rng, [], {}

    def words(self, a: int, b: int) -> str:
        r = self.rng
        told = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        for k in range(6, len(told), 7):
            told[k] += r.choice((",", ",", ".", ""))
        return " ".join(told).capitalize()

    def block(self, tag: str, text: str, label: bool, link: float = 0.0, attrs: str = "") -> None:
        """A block whose first words are a link, as much of it as link says."""
        text = " ".join(text.split())
        if self.labels.get(text, label) != label:
            return
        self.labels[text] = label
        n = round(len(text) * link)
        shown = f"<a href='/x'>{text[:n]}</a>{text[n:]}" if n else text
        self.out.append(f"<{tag}{attrs}>{shown}</{tag}>" if tag else shown)

    def open(self, tag: str, names: str = "") -> str:
        self.out.append(f"<{tag} {self.rng.choice(('class', 'class', 'id'))}='{names}'>" if names else f"<{tag}>")
        return f"</{tag}>"

    def list_of_links(self, label: bool, n: int, words: tuple[int, int] = (1, 4)) -> None:
        self.out.append("<ul>")
        for _ in range(n):
            self.block("li", self.rng.choice(_LINKS) if not label and self.rng.random() < 0.3 else self.words(*words), label, self.rng.choice((1.0, 1.0, 0.8)))
        self.out.append("</ul>")

    def prose(self, label: bool, n: int) -> None:
        for _ in range(n):
            long = self.rng.random() < 0.7
            if label and self.rng.random() < 0.06:  # what is usually boilerplate, said in an article
                self.block("p", self.rng.choice(_SAID) + ".", True)
                continue
            self.block("p", self.words(*((18, 70) if long else (2, 14))) + self.rng.choice((".", ".", ".", "", "!")), label, self.rng.choice((0, 0, 0, 0, 0.1, 0.3, 0.9 if not long else 0)))

    def content(self) -> None:
        r = self.rng
        if r.random() < 0.8:
            self.block("h1", self.words(2, 10), True)
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            if kind < 0.6:
                self.prose(True, r.randint(1, 4))
            elif kind < 0.66:
                for _ in range(r.randint(2, 9)):
                    self.block("p", self.words(1, 5) + r.choice((".", "")), True)
            elif kind < 0.72:
                self.block(r.choice(("h2", "h3")), self.words(1, 8), True)
            elif kind < 0.8:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.words(1, 20), True, r.choice((0, 0, 0, 0.5, 1.0)))
                self.out.append("</ul>")
            elif kind < 0.86:
                self.list_of_links(True, r.randint(2, 5), (3, 12))
            elif kind < 0.92:
                self.block(r.choice(("blockquote", "pre", "td", "figcaption")), self.words(4, 30), True)
            else:
                self.boilerplate(inside=True)

    def boilerplate(self, inside: bool = False) -> None:
        r = self.rng
        kind = r.choice(("named", "aside", "form", "links", "named")) if inside else r.choice(("named", "named", "nav", "aside", "header", "footer", "comments", "comments", "form", "links", "bare"))
        if kind == "named":
            end = self.open("div", r.choice(_OUTER_NAMES))
            if r.random() < 0.5:
                self.block(r.choice(("p", "div", "")), r.choice(_SAID) + r.choice((".", "", " " + self.words(1, 9))), False)
            else:
                self.block("p", self.words(3, 40) + ".", False, r.choice((0, 0.2, 1.0)))
            if r.random() < 0.3:
                self.list_of_links(False, r.randint(1, 5))
        elif kind == "nav":
            end = self.open("nav")
            self.list_of_links(False, r.randint(2, 9))
        elif kind == "aside":
            end = self.open("aside")
            self.block(r.choice(("h3", "p")), self.words(1, 4), False)
            self.block("p", self.words(2, 40) + ".", False, r.choice((0, 0.5, 1.0)))
        elif kind in ("header", "footer"):
            end = self.open(kind)
            self.block(r.choice(("p", "div")), r.choice((*_SAID, self.words(1, 12))), False, r.choice((0, 0.5, 1.0)))
            if r.random() < 0.5:
                self.list_of_links(False, r.randint(1, 4))
        elif kind == "comments":
            end = self.open(r.choice(("section", "div", "ol")), r.choice(_COMMENT_NAMES))
            for _ in range(r.randint(1, 4)):
                tag = r.choice(("article", "li", "div"))
                inner = self.open(tag, r.choice(("comment", "comment", "")))
                self.block("p", self.words(2, 60) + r.choice((".", "!", "")), False)
                self.out.append(inner)
        elif kind == "form":
            end = self.open("form")
            self.block("label", r.choice((*_SAID, self.words(1, 5))), False)
        elif kind == "links":
            end = self.open("div")
            self.list_of_links(False, r.randint(2, 8))
        else:
            end = self.open("div")
            self.block("p", r.choice(_SAID) + " " + self.words(1, 5), False, r.choice((0, 0.5)))
        self.out.append(end)

    def edge(self, top: bool) -> None:
        """What stands above or below the text where nothing is named: links in a row or a list, a line of the owner's."""
        r = self.rng
        end = self.open(r.choice(("div", "div", "p", "table", "center")))
        kind = r.random()
        if kind < (0.5 if top else 0.2):
            told = [r.choice(_LINKS) if r.random() < 0.6 else self.words(1, 2) for _ in range(r.randint(2, 7))]
            text = r.choice((" ", " | ", " - ")).join(told)
            if text not in self.labels:
                self.labels[text] = False
                self.out.append(r.choice((" ", " | ", " - ")).join(f"<a href='/x'>{x}</a>" for x in told) if " | " not in text and " - " not in text else text.replace(told[0], f"<a href='/x'>{told[0]}</a>", 1))
        elif kind < (0.8 if top else 0.4):
            self.list_of_links(False, r.randint(2, 7), (1, 3))
        else:
            self.block(r.choice(("", "div", "p", "td")), r.choice((f"© {r.randint(1999, 2024)} {self.words(1, 3)}, all rights reserved", f"Copyright {self.words(1, 3)}", f"{self.words(1, 4)} - {r.choice(_LINKS)}", *_SAID)), False, r.choice((0, 0, 0.4)))
        self.out.append(end)

    def plain(self) -> tuple[str, dict[str, bool]]:
        """A page without landmarks or telling names."""
        r = self.rng
        for _ in range(r.randint(0, 2)):
            self.edge(True)
        if r.random() < 0.6:
            self.block(r.choice(("h1", "h2", "h1")), self.words(2, 8), True)
        end = self.open(r.choice(("div", "td", "center"))) if r.random() < 0.5 else ""
        for _ in range(r.randint(1, 4)):
            self.prose(True, r.randint(1, 3))
            self.block("p", self.words(18, 60) + ".", True, r.choice((0, 0, 0.1)))
        self.out.append(end)
        for _ in range(r.randint(0, 2)):
            self.edge(False)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{''.join(self.out)}</body></html>", self.labels

    def make(self) -> tuple[str, dict[str, bool]]:
        r = self.rng
        if r.random() < 0.2:
            return self.plain()
        end = [self.open("div", r.choice(_HOSTILE_NAMES))] if r.random() < 0.3 else []
        for _ in range(r.randint(0, 4)):
            self.boilerplate()
        kind = r.random()
        tag = "article" if kind < 0.4 else "main" if kind < 0.55 else r.choice(("div", "section"))
        names = r.choice(_HOSTILE_NAMES) if r.random() < 0.35 else r.choice(_CONTENT_NAMES) if r.random() < 0.6 else ""
        close = self.open(tag, names)
        self.content()
        self.out.append(close)
        for _ in range(r.randint(0, 5)):
            self.boilerplate()
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{''.join([*self.out, *end])}</body></html>", self.labels


def pages(n: int = PAGES, seed: int = 0) -> list[tuple[str, dict[str, bool]]]:
    """Pages, and whether each of their texts is main text."""
    rng = random.Random(seed)
    return [_Page(rng).make() for _ in range(n)]
