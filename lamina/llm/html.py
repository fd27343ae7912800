"""Main text of web pages by tree scoring.

Every paragraph passes points, for its length and its commas, to its ancestors: all to the parent, half to the
grandparent, ever less above, discounted by the share of link text. The best container, or the article around it,
is kept with those siblings that hold paragraphs or headings with few links; menus, adverts, forms and the like are
cut out of it. The tree is flat arrays in document order, and the open elements are kept by name, so that the cost is
linear in the page, however deep its nesting.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import table
from . import textvec as V

_TOKEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->|$)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag closes an open element of these names, unless one of the names after the bar is nearer.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
P_ENDS = ("p", "article section div td th table body button")
PARAGRAPH = frozenset("p pre td blockquote li dd div section article main figcaption".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas dialog menu head title noembed noframes xmp audio video map fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in class or id that mark what is no part of an article.
DROPPED_WORDS = frozenset("ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notification overlay pager pagination popup promo promoted promotion recommended recommendations replies reply respond share sharing sidebar signup skip sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
#: Words that an article's own parts bear as well: they mark what has many links or little prose.
WEAK_WORDS = frozenset("discussion legal notice notices related search social".split())
#: Characters outside links from which a block with a weak word counts as prose.
PROSE = 100
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADER_WORDS = frozenset(("header",))


def _unlikely(tag: str, attrs: dict[str, str]) -> int:
    """0: likely a part of an article, 1: not, 2: only with prose."""
    if tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return 1
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return 1
    words = _WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    if tag in ("body", "html") or not words:
        return 0
    return 1 if any(w in DROPPED_WORDS for w in words) else 2 * any(w in WEAK_WORDS for w in words)


class Page:
    """The tree: for each node its tag, parent and whether it is unlikely; texts and breaks in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.unlikely, self.site_header = ["#"], [-1], [0], [False]
        self.content: list[tuple[int, str]] = []  # (node, text); a break is a blank
        stack, at, content = [0], 0, self.content
        self.places: dict[str, list[int]] = collections.defaultdict(list)  # of the open elements in the stack, by tag
        raw_end: dict[str, re.Pattern] = {}
        while at < len(html):
            m = _TOKEN.search(html, at)
            if m is None:
                content.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                content.append((stack[-1], html[at : m.start()]))
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                content.append((stack[-1], " "))
            if m.group(1):
                if places := self.places.get(tag):
                    self._cut(stack, places[-1])
                if tag not in INLINE:
                    content.append((stack[-1], " "))
                continue
            self._implied_ends(stack, tag)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(m.group(3))} if m.group(3).strip() else {}
            self.unlikely.append(_unlikely(tag, attrs))
            inside = bool(self.places.get("article") or self.places.get("main"))
            self.site_header.append(not inside and (tag == "header" or bool(_HEADER_WORDS & set(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())))))
            if tag in RAW:
                end = raw_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>?", re.I))
                close = end.search(html, at)
                at = close.end() if close else len(html)
            elif tag not in VOID:  # a slash at the end of a start tag has no meaning
                self.places[tag].append(len(stack))
                stack.append(node)

    def _cut(self, stack: list[int], k: int) -> None:
        """Close the k-th open element and all in it."""
        for node in stack[k:]:
            self.places[self.tag[node]].pop()
        del stack[k:]

    def _implied_ends(self, stack: list[int], tag: str) -> None:
        for names, walls in ([CLOSES[tag]] if tag in CLOSES else []) + ([P_ENDS] if tag in CLOSES_P else []):
            nearest = lambda tags: max((self.places[t][-1] for t in tags.split() if self.places.get(t)), default=0)
            k = nearest(names)
            if k > nearest(walls):
                self._cut(stack, k)

    def main_text(self) -> str:
        n = len(self.tag)
        texts = [(node, unescape(text)) if text != " " else (node, text) for node, text in self.content]
        length, links, commas = [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, text in texts:
            size = len(text.strip())
            length[node] += size
            commas[node] += text.count(",") + text.count("،") + text.count("，") + text.count("、")
            if in_link[node]:
                links[node] += size
        own = length[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            links[p] += links[i]
            commas[p] += commas[i] if self.tag[i] in INLINE else 0
        # An unlikely element that holds most of the page's text without links is a wrapper with an odd name.
        total = max(1, length[0] - links[0])
        cut = [False] * n
        for i in range(1, n):
            bad = self.unlikely[i] == 1 or self.site_header[i]
            if self.unlikely[i] == 2:
                bad = links[i] > 0.3 * length[i] or length[i] - links[i] < PROSE and self.tag[i] not in HEADINGS
            if bad and self.tag[i] not in DROPPED and length[i] - links[i] > 0.6 * total:
                bad = False
            if not bad and self.tag[i] in ("ul", "ol", "table", "div", "section") and length[i] and links[i] > 0.8 * length[i]:
                bad = True
            cut[i] = cut[self.parent[i]] or bad
        score: dict[int, float] = {}
        for i in range(1, n):
            if cut[i] or self.tag[i] not in PARAGRAPH:
                continue
            size = length[i] if self.tag[i] in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") else own[i]
            if size < 25:
                continue
            points = (1 + commas[i] + min(size / 100, 3)) * (1 - links[i] / max(1, length[i]))
            up, share = (self.parent[i] if self.tag[i] not in ("div", "section", "article", "main") else i), 1.0
            for level in range(1, 6):
                if up <= 0:
                    break
                score[up] = score.get(up, 0.0) + points * share
                share = 0.5 if level == 1 else 1 / (3 * level)
                up = self.parent[up]
        if score:
            for i in score:
                score[i] *= 1 - links[i] / max(1, length[i])
            best = max(score, key=lambda i: (score[i], -i))
            chosen = self._around(best, score, length, links, cut)
        else:
            chosen = {next((i for i in range(1, n) if self.tag[i] in ("article", "main")), 0)}
        kept = [False] * n
        for i in range(n):
            kept[i] = not cut[i] and (i in chosen or (i > 0 and kept[self.parent[i]]))
        return " ".join("".join(text for node, text in texts if kept[node]).split())

    def _around(self, best: int, score: dict[int, float], length: list[int], links: list[int], cut: list[bool]) -> set[int]:
        """The article around the best container, or the container with its good siblings."""
        up = best
        while up > 0:
            if self.tag[up] in ("article", "main") and not cut[up]:
                return {up}
            up = self.parent[up]
        # A wrapper of nothing else stands for what it wraps.
        texts: dict[int, int] = {}
        for i in range(1, len(self.tag)):
            if length[i] and not cut[i]:
                texts[self.parent[i]] = texts.get(self.parent[i], 0) + 1
        while self.tag[best] not in ("body", "html") and self.parent[best] > 0 and texts.get(self.parent[best]) == 1 and length[self.parent[best]] - links[self.parent[best]] > 0:
            best = self.parent[best]
        if self.tag[best] in ("body", "html"):
            return {best}
        titled = [t in HEADINGS and not c for t, c in zip(self.tag, cut, strict=True)]
        for i in range(len(self.tag) - 1, 0, -1):
            titled[self.parent[i]] |= titled[i]
        out = {best}
        for i in range(1, len(self.tag)):
            if i == best or cut[i] or self.parent[i] != self.parent[best]:
                continue
            # Of the best container's siblings, all with paragraphs or a heading of few links, however short.
            if links[i] / max(1, length[i]) < 0.3 and (score.get(i, 0.0) > 0 or titled[i] or self.tag[i] in ("p", "pre", "blockquote") and length[i] > 0):
                out.add(i)
        return out


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, *, html_column: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """Add `text`, the main text of each page, to page_id and the columns in `carry`.

    Character references are decoded, white space in a block is one space, blocks are joined in page order by one
    space. Edge cases: a null or empty page, or one without text, gives an empty text; cut-off or badly nested
    markup is closed where a browser would close it; a page without paragraphs gives its article or its whole body
    without menus and the like; repeated rows are read one by one; an empty table gives an empty result; other
    columns play no part, and a carried column named `text` gives way to the result. The whole page is read.
    """
    pages = V.chosen(pages, "page_id", html_column, carry, ("text",) if html_column != "text" else ())
    rest = [f for f in pages.schema if f.name != html_column]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, html_column):
            texts = [main_text(h) for h in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in rest} | {"text": pa.array(texts, pa.string())})

    return pages.mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string"]))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    out = extract(table(spark, sf_dir, "pages"), carry=("url",))
    return out.selectExpr("page_id", "url", "text", "cast(length(text) as long) AS n_chars")
