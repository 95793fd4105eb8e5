"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block; what the markup itself marks as outside the article
(menus, adverts, ...) leaves blank lines, and so do forms and elements that are named so, whatever
their length, if there is an article, a heading or a surge outside them.  Text lengths, links counted
inside articles alone, are summed over sliding windows of lines.  Where a sum rises from zero a
stretch begins, where it falls to zero it ends; stretches with a surge are main text, and everything
between the outer points is kept, but for lists of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import text_of

#: Lines of a window, and the characters in one that make a surge.
WINDOW, SURGE = 2, 80

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = set(
    "head title script style noscript template iframe object svg math canvas nav header footer aside select button textarea dialog menu audio video".split())
_ENDS_AT_ARTICLE = {"nav", "header", "head", "form", "aside", "footer"}
_ARTICLE = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|cookies?|consent|gdpr|notices?|popup|modal|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"masthead|comments?|commentary|comment-?list|disqus|respond|responses|discussion|opinions|repl(?:y|ies)|share|sharing|social|related|recommended|promo|sponsored|sponsor|newsletter|subscribe|signup|login|search)(?:[\s_-]|$)")


#: Names that tell what a page has around the element, not what it is.
_LAYOUT = re.compile(r"(?i)(?:no|has|with|without|hide|show)[_-]")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Unclosed(HTMLParser):
    """Places of start tags of menus, headers and the like that nothing closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: dict[str, list[tuple[int, int]]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_AT_ARTICLE:
            self.open.setdefault(tag, []).append(self.getpos())

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.open[tag].pop()


class _Lines(HTMLParser):
    """lines: (text, characters outside links, whether in an article, innermost named element, whether a list item); an empty text is a blank line.

    named: [element around, whether the name is its own, text without links, whether it has a heading or article of its own]; the first is the page.
    """

    def __init__(self, unclosed: frozenset[tuple[int, int]] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.articles = self.items = 0
        self.skipped: str | None = None
        self.heading: str | None = None
        self.depth = 0
        self.named: list[list] = [[0, False, 0, False]]
        self.inside: list[tuple[str, int, int, int]] = []  # tag, its number of open elements of that tag, named element, articles around
        self.open: dict[str, int] = {}
        self.by_tag: dict[str, list[int]] = {}  # places in ``inside``

    def _here(self) -> int:
        return self.inside[-1][2] if self.inside else 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            n = max(0, len(text) - self.linked)
            self.lines.append((text, n, self.articles > 0, self._here(), self.items > 0))
            self.named[self._here()][2] += n
        self.parts, self.linked = [], 0

    def _gap(self) -> None:
        self._flush()
        self.lines += [("", 0, False, 0, False)] * WINDOW

    def _outside(self, tag: str, told: dict[str, str | None]) -> bool:
        if tag in _OUTSIDE:
            return self.getpos() not in self.unclosed
        if tag in _ARTICLE and not self.articles or tag in ("html", "body"):
            return False
        return "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in (told.get("style") or "").replace(" ", "").lower()

    def _name(self, tag: str, told: dict[str, str | None]) -> str:
        """"own" if its whole name says that the element is outside, "part" if a part of it does."""
        words = [w for w in f"{told.get('class') or ''} {told.get('id') or ''}".split() if not _LAYOUT.match(w)]
        if tag in ("html", "body"):
            return ""
        if tag == "form" or told.get("role", "") in _ROLES or any(_NAMES.fullmatch(w) for w in words):
            return "own"
        first = tag in _ARTICLE and not self.articles
        return "part" if not first and any(_NAMES.search(w) for w in words) else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            if tag == self.skipped:
                self.depth += 1
            elif self.skipped in _ENDS_AT_ARTICLE and tag in _ARTICLE | {"body"}:
                self.skipped = self.heading = None
            elif self.skipped == "header" and self.articles and tag in _HEADINGS:
                self.heading = tag
            if self.skipped:
                return
        told = dict(attrs)
        if tag not in _VOID and self._outside(tag, told):
            self._flush() if self.articles else self._gap()
            self.skipped, self.depth = tag, 1
            return
        if tag in _ARTICLE | {"body"} and self.inside and self.inside[-1][0] == "form":
            self._gap()
            self._leave(len(self.inside) - 1)
        if tag not in _VOID:
            self.open[tag] = self.open.get(tag, 0) + 1
            if name := self._name(tag, told):
                self._flush()
                self.named.append([self._here(), name == "own", 0, False])
                self.by_tag.setdefault(tag, []).append(len(self.inside))
                self.inside.append((tag, self.open[tag], len(self.named) - 1, self.articles))
        if tag == "a":
            self.links += 1
        if tag == "li":
            self.items += 1
        if tag in _ARTICLE:
            self._flush() if self.articles else self._gap()
            self.articles += 1
        elif tag not in _INLINE:
            self._flush()
        if tag == "h1" or tag in _ARTICLE:
            self.named[self._here()][3] = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.skipped and tag not in _INLINE:
            self._flush()

    def _leave(self, place: int) -> None:
        """Named elements from this place on end; what is left open inside ends with them."""
        self._flush()
        while len(self.inside) > place:
            tag, number, _, _ = self.inside.pop()
            self.by_tag[tag].pop()
            self.open[tag] = number - 1

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if self.heading == tag:
                self._flush()
                self.heading = None
            if tag == self.skipped:
                self.depth -= 1
                if not self.depth:
                    self._flush()
                    self.skipped = self.heading = None
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag == "li":
            self._flush()
            self.items = max(0, self.items - 1)
        if tag in _ARTICLE and self.articles:
            self._flush()
            self.articles -= 1
            if not self.articles:
                self._gap()
        elif tag not in _INLINE:
            self._flush()
        if self.open.get(tag):
            self.open[tag] -= 1
            if self.by_tag.get(tag) and self.open[tag] < self.inside[self.by_tag[tag][-1]][1]:
                self._leave(self.by_tag[tag][-1])

    def kept(self, surge: int) -> list[tuple[str, int, bool, bool]]:
        """The lines, with blank ones for named elements; inside an article these leave none.

        While nothing outside the named elements is an article, a heading or a surge, the one that most
        looks like the article's wrapper counts as not named: with an article or heading of its own,
        then named by a part of its name only, then with most text.
        """
        around = [x[0] for x in self.named]
        text, own = [x[2] for x in self.named], [x[3] for x in self.named]
        for k in range(len(around) - 1, 0, -1):
            text[around[k]] += text[k]
            own[around[k]] = own[around[k]] or own[k]
        free = [k == 0 for k in range(len(around))]
        under: dict[int, list[int]] = {}
        for k in range(1, len(around)):
            under.setdefault(around[k], []).append(k)
        edge = list(under.get(0, ()))  # named elements right inside what is free
        while edge and not self._settled(free, surge):
            k = max(edge, key=lambda k: (own[k], not self.named[k][1], text[k], -k))
            free[k] = True
            edge.remove(k)
            edge += under.get(k, ())
        out: list[tuple[str, int, bool, bool]] = []
        for line, n, article, of, item in self.lines:
            if free[of]:
                out.append((line, n, article, item))
            elif not article:
                out += [("", 0, False, False)] * WINDOW
        return out

    def _settled(self, free: list[bool], surge: int) -> bool:
        if any(x[3] and f for x, f in zip(self.named, free)):
            return True
        lengths = [n if free[of] else 0 for _, n, _, of, _ in self.lines]
        return any(sum(lengths[i:i + WINDOW]) >= surge for i in range(len(lengths)))

    def handle_data(self, data: str) -> None:
        if not self.skipped or self.heading:
            self.parts.append(data)
            if self.links and not self.skipped:
                self.linked += len(" ".join(data.split()))


def stretches(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, end, highest window sum) between points where the window sum rises from and falls to zero."""
    if not len(lengths):
        return []
    padded = np.concatenate([np.zeros(window), lengths, np.zeros(window)])
    sums = np.convolve(padded, np.ones(window))[window - 1:len(padded)]  # sums[i]: lines i - window .. i - 1
    on = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    out = []
    for rise, fall in zip(edges[::2], edges[1::2]):
        last = np.flatnonzero(lengths[max(0, rise - window):fall])
        first = max(0, rise - window) + last[0]
        out.append((int(first), int(max(0, rise - window) + last[-1] + 1), int(sums[rise:fall].max())))
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Blocks of the main text in page order, joined by one space; empty if there is none."""
    html = _OPEN_COMMENT.sub("", html or "")
    reader = _parsed(html, _Lines())
    if reader.skipped in _ENDS_AT_ARTICLE:  # left open up to the end: what nothing closes is no element
        unclosed = _parsed(html, _Unclosed())
        reader = _parsed(html, _Lines(frozenset(place for places in unclosed.open.values() for place in places)))
    reader._flush()
    lines = reader.kept(surge)
    found = stretches(np.array([len(text) if article else n for text, n, article, _ in lines], float), window)
    if not found:
        return ""
    main = [x for x in found if x[2] >= surge] or [max(found, key=lambda x: x[2])]
    return " ".join(text for text, n, article, item in lines[main[0][0]:main[-1][1]] if text and (n or article or not item))


#: A comment that nothing ends.
_OPEN_COMMENT = re.compile("<!--(?!.*?--)", re.DOTALL)


def _parsed(html: str, reader: HTMLParser):
    reader.feed(html)
    reader.close()
    return reader


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty html, or one without text, gives an empty text.  Unclosed elements end with the
    page; a menu, form or header left open ends where an article begins, and is no element if none does.
    A comment left open is only its opening mark.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h).encode("utf-8", "replace").decode() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), text_of("html").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
