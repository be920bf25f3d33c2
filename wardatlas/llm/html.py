"""Main text of web pages: parser events, text-to-tag ratio per block, Gaussian smoothing and a threshold.

The page streams through the standard library's parser. Text gathers in blocks, which end at tags that begin or end a block of
layout; of each block the parser counts code points, tags, and those inside links. A block's text-to-tag ratio is its code points outside links over its tags
(at least one). The ratios are smoothed along the page by a Gaussian. Blocks over a threshold, a share of the standard deviation of the smoothed
ratios, form content regions if they are not mostly links, and so do all blocks between two of them, short ones and links too. A region
grows at its ends over blocks that are not mostly links and stand in the same element as one of its blocks, or in an element of that one.

Markup that names its role is followed first: text in navigation, headers, footers, asides, scripts, styles and the like, and hidden text
never counts. Forms and elements whose class or id names an advert, menu, notice, sidebar or comment do not count either, unless they hold
most of the page's text or the page's only article (see `Reader._needs`); compounds that speak of the layout, as no-sidebar or page-header,
are no such names, nor inside an article those of its subject, as legal-analysis. The ratio decides on every page.
Marks of content (article, main, role=main) scale the smoothed ratios: those of marked blocks by the share of the page's text that is
marked, the others by the rest. Where half of the text or more is marked, the threshold bounds the ratios of marked blocks from below, so
that headings and short paragraphs of an article stay; a teaser or card that is marked beside plain text has no such bound. Regions are filled
with blocks of the side, marked or not, that holds the most text: the others stand apart from it by the page's own word.

Defined results: a null or empty page, or one without content, gives an empty text; broken and unclosed markup is read as the parser
reads it; every row gives one row, so repeated rows give equal rows; an empty table gives none; other columns pass unchanged, whatever their
names, but a column named as the new one is an error; a page is held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .frames import with_column

# The HTML standard's elements by their role here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
APART = {"nav", "header", "footer", "aside", "menu", "dialog", "script", "style", "noscript", "template", "iframe", "object", "svg", "math",
         "canvas", "button", "select", "textarea", "datalist", "head", "title", "video", "audio", "map", "noframes", "applet"}
CONTENT = {"article", "main"}
ROLES_APART = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "status", "toolbar"}
#: Words in a class or id that name something other than the article.
NAMES_APART = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
               "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "side", "rail", "widget", "widgets", "footer", "foot", "header", "masthead", "topbar",
               "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
               "login", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations",
               "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer", "search", "tags"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1",
             "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
#: Names of text of its own kind beside an article; the others may also name the element around the article.
NAMES_BESIDE = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
                "popup", "newsletter", "subscribe", "subscription", "signup", "comment", "comments", "disqus", "respond", "reply", "replies", "recommended",
                "recommendations"}
#: Compounds that say how a page is laid out: no-sidebar, sidebar-layout, page-header.
_LAYOUT_BEFORE = {"no", "non", "has", "have", "with", "without"}
_LAYOUT_AFTER = {"layout", "open", "closed", "enabled", "disabled"}
_HEADED = {"page", "article", "post", "entry", "content", "story", "section"}
#: Names that inside an article speak of its subject (legal-analysis, search-results, side-note) unless a part of a page follows.
_SUBJECTS = {"side", "legal", "search"}
_PARTS = {"bar", "box", "form", "panel", "field", "column", "col", "area", "block", "links", "info", "text", "line"}
#: Words for what readers write, if one of the readers stands before: user-discussion.
_TALK = {"discussion", "discussions", "opinions", "feedback", "reactions", "posts"}
_READERS = {"user", "users", "reader", "readers", "community", "visitor", "visitors", "guest", "guests"}
_UNMARKED, _SHUT = -1, 1 << 60
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "tags", "linked", "marked", "inside")

    def __init__(self, text: str, tags: int, linked: int, marked: bool, inside: tuple[int, int] = (0, 0)):
        self.text, self.tags, self.linked, self.marked, self.inside = text, tags, linked, marked, inside

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)


def _names(value: str, inside_content: bool = False) -> set[str]:
    """Words of a class or id that name something other than the article, without those that speak of the layout or, inside an
    article, of its subject."""
    found = set()
    for token in value.split():
        words = _WORD.findall(token)
        for i, word in enumerate(words):
            before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
            if inside_content and word in _SUBJECTS and len(words) > 1 and after not in _PARTS:
                continue
            if word in _TALK and before in _READERS:
                found.add("comments")
            if word in NAMES_APART and before not in _LAYOUT_BEFORE and after not in _LAYOUT_AFTER and not (word == "header" and before in _HEADED):
                found.add(word)
    return found


def _apart(tag: str, attrs: list[tuple[str, str | None]], inside_content: bool) -> tuple[bool, bool, bool]:
    """(never counts, is apart by its name or as a form, is beside the article by its name)."""
    if tag == "header" and inside_content:
        pass                                                    # an article's own header holds its title
    elif tag in APART:
        return True, False, False
    form, names = tag == "form", set()
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False, False
        if name == "role" and value in ROLES_APART:
            return True, False, False
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, False, False
        form = form or name == "role" and value == "form"
        if name in ("class", "id") and tag not in CONTENT and tag not in ("html", "body"):
            names |= _names(value, inside_content)
    return False, form or bool(names), bool(names & NAMES_BESIDE)


class Reader(HTMLParser):
    """Turns parser events into blocks. A stack of open elements says what the text at hand belongs to.

    An element that is apart by its name or as a form opens a zone. Zone 0 is the page; whether the text of another counts is known at
    the end of the page, when the sizes of all are. A mark is an open article, main or the like, known by the zone it stands in.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int]] = []   # (tag, inside something that never counts, zone, mark, number)
        self.elements = 0
        self.zones: list[tuple[int, int, bool, bool]] = [(0, 0, False, False)]      # (parent, depth, beside, inside marked content)
        self.marks: list[int] = []                              # zone of each mark
        self.raw: list[tuple[list[tuple[str, bool, int, int]], int, tuple[int, int]]] = []  # (pieces of text, tags, elements around) of each block
        self.around = (0, 0)                                    # of the block at hand: the elements around its own, nearest first
        self.parts: list[tuple[str, bool, int, int]] = []       # (text, inside a link, zone, mark)
        self.tags = self.links = 0

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:4] if self.open else (False, 0, _UNMARKED)

    def _end_block(self) -> None:
        if any(not x[0].isspace() for x in self.parts):
            self.raw.append((self.parts, self.tags, self.around))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_block()
        if tag in _CLOSES_P:
            self._close("p", {"article", "main", "div", "section", "td", "th", "li", "body", "blockquote", "button", "table"})
        elif tag == "li":
            self._close("li", {"ul", "ol", "menu"})
        elif tag in ("td", "th", "tr"):
            self._close(tag, {"table", "tr"} - {tag})
        if tag in VOID:
            return
        never, zone, mark = self._state()
        if not never:
            never, apart, beside = _apart(tag, attrs, mark != _UNMARKED)
            if apart and not never:
                self.zones.append((zone, self.zones[zone][1] + 1, beside, mark != _UNMARKED))
                zone = len(self.zones) - 1
            if tag in CONTENT or any(k == "role" and v == "main" or k == "itemprop" and v == "articleBody" for k, v in attrs):
                self.marks.append(zone)
                mark = len(self.marks) - 1
        self.elements += 1
        self.open.append((tag, never, zone, mark, self.elements if tag not in ("html", "body") else 0))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:                                                   # the slash has no meaning on other elements
            self.handle_starttag(tag, attrs)

    def _close(self, tag: str, bound: set[str]) -> None:
        """Close the nearest open `tag`, with what is open inside it, unless a bounding element stands between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.links -= sum(x[0] == "a" for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in bound:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_block()
        if tag == "a" and self.links or tag != "a":
            self._close(tag, CONTENT | {"body", "table"} if tag in INLINE or tag == "p" else {"body"} - {tag})

    def handle_data(self, data: str) -> None:
        never, zone, mark = self._state()
        if not never:
            if not self.parts or self.parts[-1][0].isspace():
                blocks = [x[4] for x in self.open[-12:] if x[0] not in INLINE]
                self.around = tuple((blocks[-2:-4:-1] + [0, 0])[:2])
            self.parts.append((data, self.links > 0, zone, mark))

    def _needs(self) -> list[int]:
        """For each zone the depth of zone in which a mark must stand for marked text in the zone to count; 0 if all of it counts.

        Zones are judged from the outer to the inner. All of a zone counts if it holds most of the page's text, and is inside marked
        content, holds marked content or the page has none that counts. Otherwise only the marked content in it counts, if the page has
        no other that counts. What is beside an article by its name, as comments, speaks for no zone around it, and counts only where
        nothing marked does and it holds one mark, with most of the page's text in it.
        """
        n = len(self.zones)
        text, under, tops = [0] * n, [0] * n, [-1] * n           # code points; those with a mark from the zone; deepest mark of the zone's own
        holders: list[set[int]] = [set() for _ in range(n)]      # marks with text that stand in the zone itself
        for parts, *_ in self.raw:
            for data, linked, zone, mark in parts:
                size = 0 if linked else len(data.strip())
                text[zone] += size
                if mark != _UNMARKED and size:
                    under[self.marks[mark]] += size
                    holders[self.marks[mark]].add(mark)
                    tops[zone] = max(tops[zone], self.zones[self.marks[mark]][1])
        count = [len(x) for x in holders]
        for zone in range(n - 1, 0, -1):                         # a zone follows its parent
            parent = self.zones[zone][0]
            text[parent] += text[zone]
            if not self.zones[zone][2]:
                under[parent] += under[zone]
                count[parent] += count[zone]
        need, seen = [0] * n, tops[0] >= 0
        for depth, level in groupby(sorted(range(1, n), key=lambda z: self.zones[z][1]), key=lambda z: self.zones[z][1]):
            level = list(level)
            for zone in level:
                parent, _, beside, inside = self.zones[zone]
                most = 2 * text[zone] > text[0]
                if need[parent] == _SHUT:
                    need[zone] = _SHUT
                elif beside:
                    need[zone] = depth if count[zone] == 1 and 2 * under[zone] > text[0] and not seen else _SHUT
                elif most and (under[zone] or inside or not seen):
                    need[zone] = need[parent]
                else:
                    need[zone] = depth if under[zone] and not seen else _SHUT
            seen = seen or any(tops[z] >= need[z] for z in level)
        return need

    def finish(self) -> list[Block]:
        self.close()
        self._end_block()
        need, blocks, tags = self._needs(), [], 0
        for parts, own, around in self.raw:
            kept = [x for x in parts if (self.zones[self.marks[x[3]]][1] if x[3] != _UNMARKED else 0 if not need[x[2]] else -1) >= need[x[2]]]
            text = _SPACE.sub(" ", "".join(x[0] for x in kept)).strip()
            tags += own
            if text:
                blocks.append(Block(text, tags, sum(len(x[0]) for x in kept if x[1]), any(x[3] != _UNMARKED for x in kept), around))
                tags = 0
        return blocks


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian cut at three sigma; at the ends over what is there."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[reach:reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def held(blocks: list[Block]) -> float:
    """Share of the text outside links, or of all text if there is no other, that stands in marked blocks."""
    sizes = np.array([max(0, len(b.text) - b.linked) for b in blocks])
    if not sizes.sum():
        sizes = np.array([len(b.text) for b in blocks])
    return float(sizes[[b.marked for b in blocks]].sum() / sizes.sum())


def content(blocks: list[Block], sigma: float = 1.0, share: float = 0.5) -> list[str]:
    """Texts of the blocks in content regions, in page order."""
    if not blocks:
        return []
    marked, holds = np.array([b.marked for b in blocks]), held(blocks)
    ratios = smoothed(np.array([b.ratio for b in blocks]), sigma) * np.where(marked, holds, 1 - holds)
    over = ratios >= min(share * ratios.std(), ratios.max()) if len(blocks) > 1 else np.ones(1, dtype=bool)
    over &= np.array([b.linked * 2 <= len(b.text) for b in blocks])
    most = marked if holds >= 0.5 else ~marked
    if holds >= 0.5:
        over |= marked                                          # the bound: never under the threshold
    found = np.flatnonzero(over & most)
    if len(found):
        first, last = int(found[0]), int(found[-1])
        parents = {b.inside[0] for b, on in zip(blocks, over & most) if on} - {0}
        beside = lambda i: most[i] and not parents.isdisjoint(blocks[i].inside) and blocks[i].linked * 2 <= len(blocks[i].text)
        while first and beside(first - 1):
            first -= 1
        while last + 1 < len(blocks) and beside(last + 1):
            last += 1
        over[first:last + 1] |= most[first:last + 1]
    return [b.text for b, on in zip(blocks, over) if on]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    reader = Reader()
    reader.feed(page)
    return " ".join(content(reader.finish()))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns of the pages and the main text of each."""
    schema = with_column(pages.schema, out_col, StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.string())], names=[*batch.schema.names, out_col])

    return pages.mapInArrow(task, schema)
