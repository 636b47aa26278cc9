"""Tables in web pages, by the standard library's parser within each task."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_frames, in_small_batches

CELLS = "page_id long, table_index int, row int, col int, header boolean, text string"


class _Tables(HTMLParser):
    """Rows of cells (text, is header, column span, row span) of each table, the outer ones first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[int] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(len(self.tables))
            self.tables.append([])
        elif self.open and tag == "tr":
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            spans = {k: int(v) if (v or "").isdigit() else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = ["", tag == "th", max(1, spans.get("colspan", 1)), max(1, spans.get("rowspan", 1))]
            rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def cells_of(html: str | None) -> list[tuple[int, int, int, bool, str]]:
    """(table, row, column, header, text), spans filled out."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for i, rows in enumerate(parser.tables):
        taken: dict[tuple[int, int], tuple[bool, str]] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, header, cols, span in row:
                while (r, c) in taken:
                    c += 1
                for down in range(min(span, len(rows) - r)):
                    for across in range(min(cols, 1000)):
                        taken.setdefault((r + down, c + across), (header, " ".join(text.split())))
                c += cols
        out += [(i, r, c, header, text) for (r, c), (header, text) in sorted(taken.items())]
    return out


def distinct_headers(names: list[str]) -> list[str]:
    """Repeated or blank header names get a number."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def page_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((i, *cell) for i, html in zip(batch["id"], batch["html"]) for cell in cells_of(html))
            yield from in_frames(rows, [c.split()[0] for c in CELLS.split(", ")])

    return in_small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).filter("id IS NOT NULL").mapInPandas(run, CELLS)
