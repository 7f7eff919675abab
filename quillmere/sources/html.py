"""HTML pages as elements: a reader for ``mapInPandas`` built on the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Tag to element category.
CATEGORIES = {"title": "Title", "h1": "Title", "h2": "Header", "h3": "Header", "p": "NarrativeText", "li": "ListItem", "td": "Table", "th": "Table", "footer": "Footer"}
_SKIP = {"script", "style"}


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.parts, self.skip = None, [], 0

    def _end(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.kind or "UncategorizedText", text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in CATEGORIES or tag in ("div", "body", "nav", "article"):
            self._end()
            self.kind = CATEGORIES.get(tag)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in CATEGORIES:
            self._end()
            self.kind = None

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def elements(html: str) -> list[tuple[str, str]]:
    parser = _Elements()
    parser.feed(html)
    parser.close()
    parser._end()
    return parser.out


def read_elements(pages: DataFrame) -> DataFrame:
    """(page_id, position, category, text) from (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, c, t) for p, h in zip(frame["page_id"], frame["html"], strict=True) for i, (c, t) in enumerate(elements(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "category", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, category string, text string")
