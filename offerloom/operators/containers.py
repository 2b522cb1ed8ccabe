"""Stored HTML pages to rows, one per element an offer may come from.

Only the nesting of tags needs Python; it runs once per page inside ``mapInPandas`` and hands back
flat rows.  Which of them are offers is decided by column expressions afterwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from offerloom.sources.profiles import PAGES, PageProfile, Selector

ROWS = (
    "source string, url string, slug string, heading string, title string, kind string, pos long, "
    "attrs map<string,string>, text string, description string"
)

#: Rows handed to Arrow at once; keeps the memory of a worker flat on pages with many cards.
FLUSH_ROWS = 2_000

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
#: Start tag -> (open tags it ends, tags that stop the search).
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


class _Outline(HTMLParser):
    """Nodes of a page in document order; a node's text is a slice of the page text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.begin = ["#page"], [{}], [-1], [0]
        self.end: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self._open, self._parts, self._size = [0], [], 0
        self.feed(html)
        self.close()
        while self._open:
            self._pop()
        self.text = "".join(self._parts)

    def _pop(self) -> None:
        node = self._open.pop()
        self.end[node], self.last[node] = self._size, len(self.tag)

    def _end_open(self, tags, stops) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in tags:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._end_open(("p",), ("button", "table"))
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        self.tag.append(tag)
        self.attrs.append({name: value or "" for name, value in attrs})
        self.parent.append(self._open[-1])
        self.begin.append(self._size)
        self._open.append(len(self.tag) - 1)
        if tag in _VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end_open((tag,), ())

    def handle_data(self, data):
        self._parts.append(data)
        self._size += len(data)

    def matches(self, node: int, selector: Selector) -> bool:
        css = self.attrs[node].get("class")
        return self.tag[node] in selector.tags or bool(css and any(part in css for part in selector.classes))

    def all(self, selector: Selector) -> list[int]:
        if not (selector.tags or selector.classes):
            return []
        return [node for node in range(1, len(self.tag)) if self.matches(node, selector)]

    def content(self, node: int) -> str:
        return self.text[self.begin[node] : self.end[node]]

    def closest(self, node: int, selector: Selector) -> int | None:
        while node > 0 and not self.matches(node, selector):
            node = self.parent[node]
        return node if node > 0 else None

    def first_inside(self, node: int | None, candidates: list[int]) -> str:
        """Text of the first candidate below ``node``, or ''."""
        if node is None:
            return ""
        at = bisect_right(candidates, node)
        found = at < len(candidates) and candidates[at] < self.last[node]
        return self.content(candidates[at]) if found else ""


def _page_rows(html: str, profile: PageProfile) -> Iterator[tuple]:
    page = _Outline(html)
    notes = page.all(profile.description)
    headings, titles = page.all(profile.heading), page.all(Selector(("title",)))
    heading = page.content(headings[0]) if headings else None
    title = page.content(titles[0]) if titles else ""

    def row(kind, node, attrs, text, scope):
        return heading, title, kind, node, attrs, text, page.first_inside(scope, notes)

    yield row("page", 0, {}, None, None)
    if profile.attributes:
        for node, attrs in enumerate(page.attrs):
            named = {name: attrs[name] for name in profile.attributes if name in attrs} if attrs else None
            if named:
                yield row("attribute", node, named, None, page.closest(node, profile.attribute_card))
    for node in page.all(profile.card):
        yield row("card", node, {}, page.content(node), node)
    for node in page.all(profile.button):
        yield row("button", node, {}, page.content(node), page.closest(node, profile.button_card))
    for node in page.all(profile.sibling):
        parent = page.parent[node]
        spans = [n for n in range(parent + 1, page.last[parent]) if page.tag[n] == "span"]
        text = page.content(spans[-1]) if spans else ""
        yield row("sibling", node, {}, text, max(page.parent[parent], 0))


def _page_or_fault(html: str, profile: PageProfile) -> list[tuple]:
    """All rows of a page, or its error row: a page counts whole or not at all."""
    try:
        return list(_page_rows(html, profile))
    except Exception as fault:  # whatever a parser raises is this page's own
        return [(None, None, "error", 0, {}, str(fault) or type(fault).__name__, None)]


def page_elements(captures: DataFrame, profiles: dict[str, PageProfile] = PAGES) -> DataFrame:
    """Rows of ``kind`` page, attribute, card, button or sibling for captures (source, url, slug, html).

    A page that cannot be parsed gives one row of kind ``error`` whose text says why, and no other; the pages beside it
    are not touched.
    """

    names = [column.split(" ")[0] for column in ROWS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for source, url, slug, html in batch.itertuples(index=False, name=None):
                if html is not None and source in profiles:
                    found = _page_or_fault(html, profiles[source])
                    rows.extend((source, url, slug, *element) for element in found)
                if len(rows) >= FLUSH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return captures.select("source", "url", "slug", "html").mapInPandas(parse, ROWS)
