"""Pages as blocks of text with their links: headings and paragraphs in order, links as spans of code points."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that end a block, and those whose content isn't text.
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "table", "tr", "td", "th", "section", "article", "header", "footer", "nav", "main", "aside", "figure", "figcaption", "br", "hr", "pre", "body", "html", "title"}
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "button", "svg", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What part of a page an element makes of what it holds.
AREAS = {"article": "main", "main": "main", "blockquote": "quote", "table": "table", "nav": "chrome", "header": "chrome", "footer": "chrome", "aside": "chrome"}
#: Pages that are parsed before their blocks are handed on.
PAGES = 64


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str, list[tuple[str, int, int, str]]]] = []
        self.parts, self.size, self.kind, self.skip = [], 0, "paragraph", 0
        self.areas: list[str] = []
        self.href: str | None = None
        self.began, self.first, self.alt = 0, 0, ""
        self.spans: list[tuple[str, int, int, str]] = []

    def _close(self) -> None:
        self._end_link()
        text = "".join(self.parts)
        if text.strip() or self.spans:
            self.blocks.append((self.kind, AREAS[self.areas[-1]] if self.areas else "body", text.rstrip(), self.spans))
        self.parts, self.size, self.kind, self.spans = [], 0, "paragraph", []

    def _end_link(self) -> None:
        if self.href is not None:
            own = "".join(self.parts[self.first :])
            anchor = own.strip() or self.alt
            self.spans.append((self.href, self.began, self.began + len(own.rstrip()) if own.strip() else self.began, anchor))
        self.href, self.alt = None, ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self._close()
            if tag in AREAS:
                self.areas.append(tag)
            self.kind = "heading" if tag in HEADINGS else "title" if tag == "title" else "paragraph"
        elif tag == "a":
            self._end_link()
            self.href, self.began, self.first = dict(attrs).get("href") or "", self.size, len(self.parts)
        elif tag == "img" and self.href is not None:
            self.alt = self.alt or (dict(attrs).get("alt") or "").strip()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self._close()
            if tag in self.areas:  # unclosed ones inside end with it
                del self.areas[len(self.areas) - 1 - self.areas[::-1].index(tag) :]
        elif tag == "a":
            self._end_link()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            words = " ".join(data.split())
            lead = " " if data[:1].isspace() and self.parts and not self.parts[-1].endswith(" ") else ""
            piece = lead + words + (" " if words and data[-1:].isspace() else "")
            if piece:
                self.parts.append(piece)
                self.size += len(piece)


SCHEMA = "page_id long, block int, kind string, area string, text string, links array<struct<href: string, s: int, e: int, anchor: string>>"
_LINK = pa.struct([("href", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("anchor", pa.string())])
_TYPES = {"page_id": pa.int64(), "block": pa.int32(), "kind": pa.string(), "area": pa.string(), "text": pa.string(), "links": pa.list_(_LINK)}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):  # few pages at once are Python objects, however many a batch has
            out = []
            for page, html in zip(*(c.to_pylist() for c in batch.slice(at, PAGES).columns), strict=True):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser._close()
                out += [(page, i, kind, area, text, [{"href": h, "s": s, "e": e, "anchor": a} for h, s, e, a in spans]) for i, (kind, area, text, spans) in enumerate(parser.blocks)]
            columns = zip(*out, strict=True) if out else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values(), strict=True)], list(_TYPES))


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block (from 0), kind (title, heading or paragraph), area (of its innermost section: main, quote, table, chrome or body), text, links (href, s, e, anchor): nested markup is joined, an image's alt stands in for an empty anchor, an unclosed link ends with its block."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_extract, SCHEMA)


def scoped(found: DataFrame, headings: bool = True, quotes: bool = True, tables: bool = True) -> DataFrame:
    """Blocks within what is to be read: never navigation and the like, headings, quotes and tables as asked."""
    wanted = found.where("area <> 'chrome'")
    for keep, out in ((headings, "kind = 'heading'"), (quotes, "area = 'quote'"), (tables, "area = 'table'")):
        wanted = wanted if keep else wanted.where(f"NOT ({out})")
    return wanted
