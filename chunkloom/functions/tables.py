"""HTML tables: cells by an Arrow function over the table rows only, search text in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P
from .text import col, non_empty, strip, token_estimate


class _Events(HTMLParser):
    """Flat list of (kind, value) events of one HTML text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag))

    def handle_endtag(self, tag):
        self.events.append(("close", tag))

    def handle_data(self, data):
        self.events.append(("text", data))

    def parse_marked_section(self, i, report=1):
        """End of a section ``<![...``; one that is unknown or not closed is a comment up to the next ``>``."""
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:  # a section the reader does not know
            end = -1
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or -1


# More digits than Python reads as a number.
LONG_REFERENCE = re.compile(r"&#([0-9]{4000,})")


def _events(html: str) -> list[tuple[str, str]]:
    """Events of the whole HTML. Whatever fails beyond the mark-up repaired here fails the task."""
    reader = _Events()
    # Eight digits are beyond all characters already.
    reader.feed(LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))
    # The reader holds back a last text that may end in part of a reference, and a last "<".
    rest = reader.rawdata
    if rest and not reader.cdata_elem and (rest == "<" or not rest.startswith("<")):
        reader.handle_data(unescape(rest))
    return reader.events


# Tables of closed cells without attributes, references and markup inside, which most are.
PLAIN_TABLE = re.compile(r"<table>(?:<tr>(?:<td>[^<&]*+</td>|<th>[^<&]*+</th>)*+</tr>)*+</table>")
PLAIN_CELL = re.compile(r"<t[dh]>([^<]*)")


def _cells(html: str | None) -> list[list[str]]:
    """Rows of cell texts. Cells and rows without a closing tag are not counted."""
    if html and PLAIN_TABLE.fullmatch(html):
        found = ([" ".join(c.split()) for c in PLAIN_CELL.findall(row)] for row in html.split("</tr>"))
        return [row for row in found if row]
    return _read_cells(html)


def _read_cells(html: str | None) -> list[list[str]]:
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] | None = None
    held: list[str] = []
    for kind, value in _events(html) if html else ():
        if kind == "text":
            if cell is not None:
                cell.append(value)
        elif value in ("td", "th"):
            if kind == "open":
                cell = held = []
            else:
                row.append(" ".join("".join(held).split()))
                cell = None
        elif value == "tr":
            if kind == "open":
                row = []
            elif row:
                rows.append(row)
    return rows


SLICE_ROWS = 64


def in_slices(batches: Iterator[pd.Series], fn: Callable) -> Iterator[pd.Series]:
    """``fn`` of every value, a few rows at a time, so that what a worker holds does not follow the size of a batch."""
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[at : at + SLICE_ROWS].map(fn)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rows of an HTML table, each an array of cell texts."""
    yield from in_slices(html, _cells)


def table_search_text(
    html: Column | str,
    rows: Column | str,
    caption: Column | str,
    footnote: Column | str,
    max_tokens: int = P.CHILD_BUDGET,
) -> Column:
    """Searchable summary of a table: caption, column names, the first data rows that fit the budget, footnote.

    ``rows`` is ``table_rows(html)``, computed once as its own column.
    """
    no_lines = F.array().cast("array<string>")
    r = F.coalesce(col(rows), F.array().cast("array<array<string>>"))
    cap, note = non_empty(caption), non_empty(footnote)
    mark = P.TABLE_MARK
    head = F.array(F.coalesce(F.concat(F.lit(f"[{mark}: "), cap, F.lit("]")), F.lit(f"[{mark}]")))
    tail = F.coalesce(F.array(F.concat(F.lit(f"({P.FOOTNOTE_LABEL}: "), note, F.lit(")"))), no_lines)

    def shown(row: Column) -> Column:
        return F.array_join(F.slice(row, 1, P.TABLE_COLUMNS), " | ", "")

    columns = F.array(F.concat(F.lit(P.TABLE_COLUMNS_LABEL), shown(F.get(r, F.lit(0)))))
    above = F.concat(head, columns, F.array(F.lit(P.TABLE_ROWS_LABEL)))
    candidates = F.transform(F.slice(r, 2, P.TABLE_ROWS), lambda row: F.concat(F.lit("- "), shown(row)))

    # Take rows while the whole text, footnote included, stays within the budget.
    start = F.struct(above.alias("lines"), F.lit(True).alias("open"))

    def take(acc: Column, line: Column) -> Column:
        lines = F.concat(acc["lines"], F.array(line))
        fits = acc["open"] & (token_estimate(F.array_join(F.concat(lines, tail), "\n")) <= max_tokens)
        return F.struct(F.when(fits, lines).otherwise(acc["lines"]).alias("lines"), fits.alias("open"))

    with_data = F.aggregate(candidates, start, take, lambda acc: acc["lines"])
    # No text has more words than half its characters, so one of few characters fits without counting its words.
    everything = F.concat(above, candidates)
    chars = F.length(F.array_join(F.concat(everything, tail), "\n"))
    with_data = F.when((chars + 1) * 1.1 <= max_tokens, everything).otherwise(with_data)
    body = (
        F.when(F.size(r) > 1, with_data)
        .when(F.size(r) == 1, F.concat(head, columns))
        .when(
            non_empty(html).isNotNull(),
            F.concat(
                head,
                F.array(
                    F.concat(
                        F.lit(P.TABLE_SUMMARY_LABEL),
                        F.substring(
                            strip(F.regexp_replace(F.regexp_replace(col(html), "<[^>]+>", " "), P.SPACE_RUN, " ")),
                            1,
                            P.TABLE_SUMMARY_CHARS,
                        ),
                    )
                ),
            ),
        )
        .otherwise(head)
    )
    return strip(F.array_join(F.concat(body, tail), "\n"))


ENDS_TABLE = ("p", "div", "section", "article", "ul", "ol", "blockquote", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6")
HEAD_ELEMENTS = ("base", "link", "meta", "noscript", "script", "style", "template", "title")


def _page_blocks(html: str | None) -> list[dict]:
    """Headings, paragraphs, list items and tables of one HTML page, in order."""
    blocks: list[dict] = []
    text: list[str] = []
    state = {"kind": "paragraph", "level": None}
    hidden = depth = 0

    def close(kind: str = "paragraph", level: int | None = None) -> None:
        joined = "\n".join(" ".join(line.split()) for line in "".join(text).split("\n")).strip()
        if joined:
            blocks.append({"block_type": state["kind"], "level": state["level"], "text": joined, "html": None})
        text.clear()
        state.update(kind=kind, level=level)

    table: list[str] = []
    in_head = in_cell = False
    for kind, value in _events(html) if html else ():
        if kind != "text" and value == "head":
            in_head = kind == "open"
            continue
        if in_head and kind == "open" and value not in HEAD_ELEMENTS:  # a head without its end tag
            in_head = False
        if value in ("script", "style") and kind != "text":
            hidden = max(0, hidden + (1 if kind == "open" else -1))
            continue
        if in_head or hidden:
            continue
        if value in ("td", "th", "tr") and kind != "text":
            in_cell = kind == "open" and value != "tr"
        elif depth and not in_cell and kind == "open" and value in ENDS_TABLE:  # a table without its end tag
            table.append("</table>" * depth)
            blocks.append({"block_type": "table", "level": None, "text": None, "html": "".join(table)})
            table.clear()
            depth = 0
        if kind != "text" and value == "table":
            if kind == "open":
                if depth == 0:
                    close()
                depth += 1
                table.append("<table>")
            elif depth:
                depth -= 1
                table.append("</table>")
                if depth == 0:
                    blocks.append({"block_type": "table", "level": None, "text": None, "html": "".join(table)})
                    table.clear()
        elif depth:
            table.append(value if kind == "text" else f"<{'/' if kind == 'close' else ''}{value}>")
        elif kind == "text":
            text.append(value.replace("\n", " "))
        elif value == "br":
            text.append("\n")
        elif len(value) == 2 and value[0] == "h" and value[1] in "123456":
            close(*(("title", int(value[1])) if kind == "open" else ()))
        elif value in ("p", "li", "div", "ul", "ol", "section", "article", "nav", "body", "tr", "blockquote", "footer"):
            close(*(("list",) if (value == "li" and kind == "open") else ()))
    if depth:  # a table without its end tag goes to the end of the page
        blocks.append({"block_type": "table", "level": None, "text": None, "html": "".join(table) + "</table>" * depth})
    close()
    return blocks


def only_references(html: Column | str, *names: str) -> Column:
    """HTML of which a reader decodes only the named references closed by a semicolon; all others stay as written."""
    return F.regexp_replace(col(html), rf"&(?!(?:{'|'.join(names)});)", "&amp;")


PAGE_BLOCK = (
    T.StructType()
    .add("block_type", T.StringType())
    .add("level", T.IntegerType())
    .add("text", T.StringType())
    .add("html", T.StringType())
)


@F.pandas_udf(T.ArrayType(PAGE_BLOCK))
def page_blocks(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Blocks of an HTML page: type, heading level, text, table HTML."""
    yield from in_slices(html, _page_blocks)
