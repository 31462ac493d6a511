"""Text of HTML pages as a parser gives it, over batches of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

#: Elements whose content is not text of the page.
SILENT = ("script", "style", "noscript")
#: What may be a reference, and what stands for its first character where it is none: no text has a lone surrogate.
REFERENCE, PLAIN = re.compile("&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?"), "\udc00"


class _Text(HTMLParser):
    """Gathers what stands between tags. Comments, declarations, quoted attributes and raw text of scripts are told apart
    by the parser's states; references, numbered and named, become their characters."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent: list[str] = []

    def _apart(self) -> None:
        if not self.silent:
            self.parts.append(" ")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._apart()
        if tag in SILENT:
            self.silent.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:  # with what was left open inside it
            del self.silent[self.silent.index(tag) :]
        self._apart()

    def handle_comment(self, data: str) -> None:
        self._apart()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def _closed(found: re.Match) -> str:
    name = found[1] or ""
    return found[0] if name.startswith("#") or name in html5 else PLAIN + name


def page_text(html: str, closed: bool = False) -> str:
    """The text of a page, a space where tags and comments stand, white space squeezed. What a page leaves open ends with
    it. As in browsers, some names are references without their semicolon (`&amp`); closed: none is, they stay as written."""
    parser = _Text()
    parser.feed(REFERENCE.sub(_closed, html) if closed else html)
    parser.close()
    return " ".join("".join(parser.parts).replace(PLAIN, "&").split())


def html_document(html: Column, closed: bool = False) -> Column:
    """page_text() of each page; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else page_text(x, closed) for x in s], index=s.index, dtype=object)

    return run(html)
