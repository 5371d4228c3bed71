"""Main text of HTML pages by minimum cut.

A scanner splits a page into blocks. A logistic regression over structure, wording, names and link density, fitted on a
labelled sample of bounded size (html_sample.PAGES pages, made by rule; or any labelled pages given to fit()), gives each
block the cost of calling it boilerplate (capacity from the source) or content (capacity to the sink), at most MOST. Blocks
that follow one another, that share a container, or that are next but one in it are joined by smoothness edges, weak across
the border of a region (a landmark, a form, a named box, comments). The minimum cut is the labelling of least cost in total;
the source's side is the text. No element, name or phrase decides by itself: an edge or another trait can overrule it. Only
what is no text is left out beforehand.

The whole html is read; a null or empty one gives an empty text. Scripts, styles, form controls and comments of the markup
aren't text. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
feed. An inline element (a span) that is named as an advert or the like is left out with all it holds. Markup may be broken: what isn't closed ends with its container, an unclosed comment or script with the page.
Columns other than those asked for aren't touched, rows that repeat give rows that repeat.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_sample
from .common import lean

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul head".split())
#: Elements whose content is no text of the page; the scanner goes on behind their end.
SILENT = frozenset("script style noscript template svg iframe object title textarea select button canvas audio video map datalist noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

COMMENTS = frozenset("comment comments commentlist commentary respond disqus replies reply discussion".split())
BOILERPLATE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav widget widgets footer foot masthead banner ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations trending popular tagcloud "
    "pagination pager paging copyright legal disclaimer toolbar search contentinfo complementary dialog skip outbrain taboola teaser teasers".split()
)
#: Words that make a name say something about a part, not that it is one.
ABOUT = frozenset("no has with without open closed of wrap wrapper page".split())
CONTENT = frozenset("article content post entry story main text prose markdown body".split())
PHRASES = re.compile(r"©|\(c\) *\d{4}|all rights reserved|\bcookies?\b|subscribe|newsletter|sign (?:up|in)|log ?in\b|share (?:this|on)|follow us|read more|click here|advertisement|sponsored|terms of (?:use|service)|privacy policy|skip to", re.I)

_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_LANDMARK = re.compile(r"<(?:main|article|h1)(?=[\s/>])", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in SILENT}

#: What the containers of a block say of it, as bits: inside the article, inside an element or role that isn't main text, a
#: form, a header; named in full or in part as boilerplate or as comments; named as content.
ARTICLE, OUT, FORM, HEADER, BOX, BOX_PART, TALK, TALK_PART, NAMED = (1 << k for k in range(9))


def named(attrs: str) -> tuple[int, str]:
    """What an element's class and id say of it, and its role."""
    told, role = 0, ""
    for kind, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            role = value.strip()
            continue
        for token in value.split():
            words = set(_WORD.findall(token))
            whole = len(words) == 1
            if "header" in words and not words & CONTENT:
                told |= HEADER
            if words & COMMENTS:
                told |= TALK if whole or not words & ABOUT else TALK_PART
            elif words & BOILERPLATE:
                told |= BOX if whole or not words & (CONTENT | ABOUT) else BOX_PART
            if words & CONTENT:
                told |= NAMED
    return told, role


def region(tag: str, attrs: str, above: int) -> int:
    """What holds inside an element, given what holds around it."""
    told, role = named(attrs) if attrs else (0, "")
    if tag in ("body", "html"):
        return above
    if tag in ("nav", "aside", "footer", "menu", "dialog", "search") or role in ("navigation", "complementary", "contentinfo", "dialog", "alert", "search"):
        told |= OUT
    elif tag == "form":
        told |= FORM
    elif tag == "header" or role == "banner":
        told |= HEADER
    elif tag in ("main", "article") or role in ("main", "article"):
        if tag == "main" or role == "main":
            return ARTICLE | told & NAMED
        if not above & (OUT | TALK) and not told & TALK:
            # the names around an article are those of its page; in a box it is an article in part
            return told & NAMED | (above & ~BOX | BOX_PART if above & BOX else ARTICLE)
    return above | told


class Block:
    __slots__ = ("text", "tag", "region", "container", "links", "depth")

    def __init__(self, text: str, tag: str, region: int, container: int, links: int, depth: int) -> None:
        self.text, self.tag, self.region, self.container, self.links, self.depth = text, tag, region, container, links, depth


def _end(html: str, tag: str, at: int, marks: dict[str, dict[int, int]]) -> int | None:
    """Where the inline element ends whose content begins at `at`, others of its kind inside it included. The elements of
    a kind are matched in one pass over the page."""
    if tag not in marks:
        open_at: list[int] = []
        ends = marks[tag] = {}
        for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", html, re.I):
            if not m[1]:
                open_at.append(m.end())
            elif open_at:
                ends[open_at.pop()] = m.start()
    return marks[tag].get(at)


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, boilerplate included."""
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    in_link = False
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, region, number
    number = at = 0
    size = len(html)
    missing: set[str] = set()  # ends that don't come again
    marks: dict[str, dict[int, int]] = {}  # by inline element: where each begins and ends
    mark = 0  # the next landmark

    def flush() -> None:
        nonlocal links, in_link
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tag, inside, _ = stack[-1]
                # a paragraph's container is the element around it, an item's the one around its list
                up = 1 if tag in ("div", "section", "article", "main", "body", "td", "") else 3 if tag in ("li", "dt", "dd") else 2
                home = stack[-min(up, len(stack))][2]
                out.append(Block(text, tag, inside, home, min(links, len(text)), len(stack)))
            parts.clear()
        links = 0

    def close(tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = html[at:lt]
            parts.append(piece)
            if in_link:
                links += len(piece)
        if lt == size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("</", lt)
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                parts.append("<")
                at = lt + 1
            continue
        tag = name.group().lower()
        gt = html.find(">", name.end()) if ">" not in missing else -1
        if gt < 0:
            missing.add(">")
            break
        for quote in ('"', "'"):  # a > inside a quoted value doesn't end the tag
            inside = html.count(quote, name.end(), gt)
            if inside % 2 and html[html.rfind(quote, name.end(), gt) - 1] == "=" and quote not in missing:
                far = html.find(quote, gt)
                if far < 0:
                    missing.add(quote)
                    continue
                end = html.find(">", far)
                gt = end if end >= 0 else gt
        attrs = html[name.end() : gt]
        at = gt + 1
        if tag in SILENT:
            if not closing and not attrs.endswith("/"):
                end = _ENDS[tag].search(html, at) if tag not in missing else None
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    missing.add(tag)
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCK:
            flush()
            in_link = False
            if closing:
                close((tag,), frozenset())
            elif tag != "hr":
                if tag == "li":
                    close(("li",), frozenset(("ul", "ol", "menu", "dir")))
                elif tag in ("dt", "dd"):
                    close(("dt", "dd"), frozenset(("dl",)))
                elif tag in ("td", "th"):
                    close(("td", "th"), frozenset(("table", "tr")))
                elif tag == "tr":
                    close(("tr",), frozenset(("table",)))
                while len(stack) > 1 and stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
                number += 1
                stack.append((tag, region(tag, attrs, stack[-1][1]), number))
        elif tag not in VOID and attrs and not closing and (" class" in attrs or " id" in attrs) and named(attrs)[0] & (BOX | TALK):
            # an inline advert or the like; one that holds the page's landmarks was never closed
            end = _end(html, tag, at, marks)
            if mark < at:
                found = _LANDMARK.search(html, at)
                mark = found.start() if found else size + 1
            if end is not None and end < mark:
                at = end
    flush()
    return out


_PROSE, _ITEMS = frozenset("p pre blockquote".split()), frozenset("li dt dd td th legend label figcaption".split())
#: The largest cost of a label, and the capacities of edges: in one container, in one region, across a border, next but one.
MOST, NEAR, FAR, BORDER, SECOND = 6.0, 2.4, 1.0, 0.1, 0.8


def body(found: list[Block]) -> tuple[int, int]:
    """The first and the last block with a paragraph's length that is mostly no links; the ends if there is none."""
    long = [k for k, b in enumerate(found) if b.text.count(" ") >= 14 and 2 * b.links < len(b.text)]
    return (long[0], long[-1]) if long else (0, len(found) - 1)


def features(found: list[Block]) -> list[list[float]]:
    """The traits of each block of a page."""
    has_article = any(b.region & ARTICLE for b in found)
    first, last = body(found)
    words = [b.text.count(" ") + 1 for b in found]
    out = []
    for k, (b, n) in enumerate(zip(found, words, strict=True)):
        density = b.links / len(b.text)
        around = [words[j] for j in (k - 1, k + 1) if 0 <= j < len(found) and found[j].region == b.region]
        inside = bool(b.region & ARTICLE)
        traits = [1.0, min(log2(n + 1), 7.0), n < 5, n >= 20, b.text[-1] in ".!?:;”\"»)…", ", " in b.text, density, density > 0.75 and n < 15, b.tag in _PROSE, b.tag in HEADINGS, b.tag == "h1", b.tag in _ITEMS]
        traits += [n < 40 and PHRASES.search(b.text) is not None, inside, has_article and not inside, bool(b.region & NAMED), log2(b.depth), log2(1 + sum(around)) if around else 0.0]
        outer = (k < first or k > last) and b.tag not in HEADINGS
        traits += [outer and inside, outer and not has_article and not b.region, outer and not has_article and not b.region and (b.links > 0 or "|" in b.text), outer and not has_article and bool(b.region)]
        traits += [bool(b.region & x) for x in (OUT, FORM, HEADER, BOX, BOX_PART, TALK, TALK_PART)]
        out.append([float(x) for x in traits])
    return out


def fit(sample: list[tuple[str, dict[str, bool]]], ridge: float = 1.0, rounds: int = 25) -> list[float]:
    """Weights of a logistic regression on labelled pages (html, and whether each block's text is main text), by Newton's
    method. The sample is held in memory; its size is the caller's bound."""
    x, y = [], []
    for html, labels in sample:
        found = blocks(html)
        for b, row in zip(found, features(found) if found else [], strict=True):
            if b.text in labels:
                x.append(row)
                y.append(labels[b.text])
    a, t = np.array(x), np.array(y, float)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (t - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(v), 6) for v in w]


@lru_cache(1)
def weights() -> tuple[float, ...]:
    return tuple(fit(html_sample.pages()))


def costs(found: list[Block], w: tuple[float, ...]) -> list[float]:
    """The classifier's log-odds that each block is main text, within MOST."""
    return [max(-MOST, min(MOST, sum(a * b for a, b in zip(row, w, strict=True)))) for row in features(found)]


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    first, last = body(found)
    for i in range(1, len(found)):
        a, b = found[i - 1], found[i]
        # what comes before the first paragraph, or behind the last, in another container
        border = a.region != b.region or a.container != b.container and (i == first or i == last + 1) and a.tag not in HEADINGS
        out.append((i - 1, i, BORDER if border else NEAR if a.container == b.container else FAR))
        if i > 1 and found[i - 2].container == b.container and found[i - 2].region == b.region:
            out.append((i - 2, i, SECOND))
    return out


def minimum_cut(terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut. terminal: capacity from the source if positive, to the
    sink if negative. links: undirected edges with their capacities.

    Where edges reach no farther than BAND nodes, as a page's do, a cut is a sequence of labels in which each pays for its
    last two only, and the least is found in one pass, in time that grows with the page. Any other graph: nodes whose
    terminal outweighs all their open edges have their label in some minimum cut whatever the rest (they are fixed first,
    and their edges become terminals of their neighbours); the rest is solved by augmenting paths. By duality both find
    what the maximum flow saturates.
    """
    if all(abs(a - b) <= BAND for a, b, _ in links):
        return _band_cut(terminal, links)
    return _flow_cut(terminal, links)


#: How far the edges of a page reach.
BAND = 2


def _band_cut(terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    n = len(terminal)
    one, two = [0.0] * n, [0.0] * n  # capacities to the node before, and to the one before that
    for a, b, w in links:
        if a != b:
            (one if abs(a - b) == 1 else two)[max(a, b)] += w
    # least costs by the labels of the last two nodes, (before, last): 00, 01, 10, 11
    best = (0.0, 0.0, 0.0, 0.0)
    came: list[tuple[bool, bool, bool, bool]] = []
    for i in range(n):
        t, w, u = terminal[i], one[i], two[i]
        off, on = max(t, 0.0), max(-t, 0.0)
        s00, s01, s10, s11 = best
        # the label two before is 0 or 1; ties leave it out of the source's side
        a, b = s00, s10 + u
        c, d = s01, s11 + u
        e, f = s00 + u, s10
        g, h = s01 + u, s11
        came.append((b < a, f < e, d < c, h < g))  # for 00, 01, 10, 11
        best = (min(a, b) + off, min(e, f) + w + on, min(c, d) + w + off, min(g, h) + on)
    side = [False] * n
    if n:
        state = min(range(4), key=lambda k: (best[k], (0, 2, 1, 3)[k]))
        for i in range(n - 1, -1, -1):
            before, last = state >> 1, state & 1
            side[i] = bool(last)
            state = 2 * came[i][state] + before
    return side


def _flow_cut(terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    n = len(terminal)
    net = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    total = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(net[i]) >= total[i]]
    while todo:
        i = todo.pop()
        if side[i] is not None:
            continue
        side[i] = net[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                net[j] += w if side[i] else -w
                total[j] -= w
                if abs(net[j]) >= total[j] - 1e-12:
                    todo.append(j)
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return [bool(x) for x in side]
    rest = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in free}
    excess = {i: net[i] for i in free}
    while True:
        came: dict[int, int] = {i: -1 for i in free if excess[i] > 1e-9}
        queue = deque(came)
        end = None
        while queue and end is None:
            i = queue.popleft()
            for j, w in rest[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    if excess[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            for i in free:
                side[i] = i in came
            return [bool(x) for x in side]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(-excess[end], excess[path[-1]], *(rest[b][a] for a, b in zip(path, path[1:], strict=False)))
        excess[end] += flow
        excess[path[-1]] -= flow
        for a, b in zip(path, path[1:], strict=False):
            rest[b][a] -= flow
            rest[a][b] += flow


def main_text(html: str | None, w: tuple[float, ...] | None = None) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    keep = minimum_cut(costs(found, w or weights()), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _run(w: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), w) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, sample: list[tuple[str, dict[str, bool]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points): a row for each row of pages. sample: labelled pages to fit on instead of
    those made by rule; the weights are fitted once, here, so that all tasks agree."""
    lean(pages.sparkSession)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_run(weights() if sample is None else tuple(fit(sample))), "page_id long, url string, text string, n_chars long")
