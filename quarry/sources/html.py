"""Blocks of an HTML filing: titles, texts and tables in order, without page furniture.

The block types are our own reading of the markup: tables are tables (a table whose cells point into the document is
a contents list and dropped), headings and short bold paragraphs are titles, page numbers and empty elements are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_row

_BREAKS = {"p", "div", "br", "li", "tr", "hr", "section", "article", "ul", "ol", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
_PAGE = re.compile(r"^(?:page\s+)?(?:[A-Z]-)?[ivxlc\d]{1,4}$", re.I)


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.depth = self.bold = self.skip = self.links = 0
        self.heading = False
        self.text: list[str] = []
        self.bold_chars = 0

    def close_text(self) -> None:
        raw = "".join(self.text)
        text = " ".join(raw.split())
        strong = self.heading or (self.bold_chars >= 0.9 * max(1, len(re.sub(r"\s", "", raw))))
        if text and not _PAGE.match(text):
            self.blocks.append({"text": text, "is_title": strong and len(text.split()) <= 100, "rows": None})
        self.text, self.bold_chars = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            if not self.depth:
                self.close_text()
                self.rows, self.links = [], 0
            self.depth += 1
        elif self.depth:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
            elif tag == "a" and any(k == "href" and (v or "").startswith("#") for k, v in attrs):
                self.links += 1
        elif tag in _BREAKS:
            self.close_text()
            self.heading = tag[0] == "h" and tag[1:].isdigit()
        elif tag in ("b", "strong"):
            self.bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth and self.rows:
                if not self.links or self.links < len(self.rows) / 2:
                    self.blocks.append({"text": None, "is_title": None, "rows": [r for r in self.rows if r]})
                self.rows = None
        elif self.depth:
            if tag in ("td", "th") and self.cell is not None:
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append("".join(self.cell).strip())
                self.cell = None
        elif tag in _BREAKS:
            self.close_text()
            self.heading = False
        elif tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.depth:
            if self.cell is not None:
                self.cell.append(data.strip())
        else:
            self.text.append(data)
            self.bold_chars += len(re.sub(r"\s", "", data)) if self.bold else 0


def blocks_of(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.close_text()
    return p.blocks


def parse(filings: DataFrame) -> DataFrame:
    """(filing_stem, block_index, text, is_title, rows) of filings (filing_stem, html); rows are cleaned in the JVM, and empty tables dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = blocks_of(html)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stem] * len(b), pa.string()), pa.array(range(len(b)), pa.int32()), pa.array([x["text"] for x in b], pa.string()), pa.array([x["is_title"] for x in b], pa.bool_()), pa.array([x["rows"] for x in b], pa.list_(pa.list_(pa.string())))],
                    names=["filing_stem", "block_index", "text", "is_title", "rows"],
                )

    out = filings.select("filing_stem", "html").mapInArrow(run, "filing_stem string, block_index int, text string, is_title boolean, rows array<array<string>>")
    rows = F.filter(F.transform("rows", clean_row), lambda r: F.size(r) > 0)
    return out.withColumn("rows", F.when(F.col("rows").isNotNull(), rows)).where("rows IS NULL OR size(rows) > 0")
