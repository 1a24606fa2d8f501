"""Tables of HTML documents as arrays: rows, cells, headers, spans."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "struct<cells: array<string>, heads: array<boolean>, marks: array<string>>"
TABLES = f"array<struct<names: array<string>, rows: array<{ROW}>>>"
#: The largest spans that the HTML standard allows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
_TABLE = re.compile("<table", re.I)
#: A tag without anything that a parser has to decide on: an end tag, or a start tag and its attributes.
_ATTRIBUTE = r"""[ \t\n\r\f]+([A-Za-z][A-Za-z0-9-]*)(?:=(?:"([^"<>&]*)"|'([^'<>&]*)'|([^\x00-\x20\x7F-\U0010FFFF"'`=<>&/]+)))?"""
_TAG = re.compile(rf"<(?:/([A-Za-z][A-Za-z0-9]*)|([A-Za-z][A-Za-z0-9]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \t\n\r\f]*)>")
_ATTRIBUTE = re.compile(_ATTRIBUTE)
#: Tags whose text is not parsed as usual.
_OTHER = frozenset(("script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript", "svg", "math"))


class _Table:
    def __init__(self):
        self.rows, self.row, self.cell = [], None, None


class _Reader:
    """A stack of open tables; a cell takes the text up to its end, but none of a table inside it nor of scripts."""

    def __init__(self, text: str):
        self.tables, self.open, self.hidden = [], [], 0
        if not self._plain(text):
            _Parser(self, text)
        while self.open:
            self._end_table()

    def _plain(self, text: str) -> bool:
        """Reads a text of plain tags, whose tokens one split gives; False, with nothing read, if there is anything else in it: comments, scripts, odd tags or attributes."""
        first, *tokens = _TAG.split(text)  # then end tag, start tag, attributes, text, ...
        if text.count("<") != len(tokens) // 4 or not _OTHER.isdisjoint(t.lower() for t in set(tokens[1::4]) if t):
            return False
        for ended, tag, attrs, data in zip(*[iter([None, None, None, first, *tokens])] * 4, strict=True):
            if ended:
                self.handle_endtag(ended.lower())
            elif tag:
                self.handle_starttag(tag.lower(), [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attrs)] if attrs else ())
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
        return True

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "table":
            self.open.append(_Table())
            self.tables.append(self.open[-1])
            return
        if not self.open:
            return
        t, a = self.open[-1], {k: v or "" for k, v in attrs} if attrs else None
        if tag == "tr":
            self._end_row(t)
            t.row = ([], [])
        elif tag in ("td", "th"):
            self._end_cell(t)
            t.row = t.row or ([], [])
            t.cell = ([], tag == "th", _span(a.get("colspan"), MAX_COLSPAN), _span(a.get("rowspan"), MAX_ROWSPAN, zero=MAX_ROWSPAN)) if a else ([], tag == "th", 1, 1)
        elif tag == "br" and t.cell:
            t.cell[0].append(" ")
        if a and t.row:
            t.row[1].extend(v for v in a.values() if v)

    def handle_data(self, data):
        if self.open and self.open[-1].cell and not self.hidden:
            self.open[-1].cell[0].append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            if self.open:
                self._end_cell(self.open[-1])
            return
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if not self.open:
            return
        if tag == "tr":
            self._end_row(self.open[-1])
        elif tag == "table":
            self._end_table()

    def _end_cell(self, t):
        if t.cell:
            parts, head, wide, deep = t.cell
            t.row[0].append((" ".join("".join(parts).split()), head, wide, deep))
            t.cell = None

    def _end_row(self, t):
        self._end_cell(t)
        if t.row:
            t.rows.append(t.row)
            t.row = None

    def _end_table(self):
        self._end_row(self.open.pop())


class _Parser(HTMLParser):
    """Any text, tag by tag, for a reader."""

    def __init__(self, reader: _Reader, text: str):
        super().__init__(convert_charrefs=True)
        self.handle_starttag, self.handle_endtag, self.handle_data = reader.handle_starttag, reader.handle_endtag, reader.handle_data
        self.feed(text)
        self.close()


def _span(value: str | None, most: int, zero: int = 1) -> int:
    if not value or not value.strip().isdecimal():
        return 1
    return min(int(value), most) or zero


def _spread(rows: list) -> list:
    """Rows whose spanning cells stand in every place that they cover."""
    out, down = [], {}  # down: place -> (rows left, text, head)
    for cells, marks in rows:
        if not down and all(wide == deep == 1 for _, _, wide, deep in cells):
            out.append(([c[:2] for c in cells], marks))
            continue
        line, todo = [], list(reversed(cells))
        while todo or len(line) in down:
            if len(line) in down:
                left, text, head = down.pop(len(line))
                if left > 1:
                    down[len(line)] = (left - 1, text, head)
                line.append((text, head))
                continue
            text, head, wide, deep = todo.pop()
            for _ in range(wide):
                if deep > 1:
                    down[len(line)] = (deep - 1, text, head)
                line.append((text, head))
        out.append((line, marks))
    return out


def _names(rows: list) -> list[str]:
    """Names of columns: the leading rows of header cells alone, their different texts joined from above."""
    leading = []
    for line, _ in rows:
        if not line or not all(head for _, head in line):
            break
        leading.append([text for text, _ in line])
    width = max(map(len, leading), default=0)
    return [" ".join(dict.fromkeys(r[i] for r in leading if i < len(r) and r[i])) for i in range(width)]


def _tables(text: str | None, spread: bool) -> list[dict] | None:
    if text is None:
        return None
    start, found = _TABLE.search(text), []
    for t in _Reader(text[start.start() :]).tables if start else ():
        rows = _spread(t.rows) if spread else [([c[:2] for c in cells], marks) for cells, marks in t.rows]
        found.append({"names": _names(rows), "rows": [{"cells": [c for c, _ in line], "heads": [h for _, h in line], "marks": marks} for line, marks in rows]})
    return found


def tables(raw: Column, spread: bool = True) -> Column:
    """All tables of a document in the order of their opening tags.

    A table has the names of its columns (from the leading rows of header cells) and its rows, each with its cells, whether they are header cells and
    the values of all attributes in it.  Blanks in a cell are collapsed.  End tags of cells and rows may be missing; a table inside a cell is a table of its own and no text of
    the cell.  ``spread`` repeats a cell in the places that its spans cover.  Null gives null, a text without tables an empty array.
    """

    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: _tables(x, spread))

    return F.pandas_udf(read, TABLES)(raw)


def cell(name: str, names: str = "names", cells: str = "cells") -> Column:
    """The cell of a row under a column's name; null where the table has no such column or the row is too short."""
    at = F.array_position(names, F.lit(name))
    return F.when(at > 0, F.get(cells, (at - 1).cast("int")))


def table_rows(documents: DataFrame, raw: str = "raw", spread: bool = True) -> DataFrame:
    """A row for each table row behind the header, with the document's other columns, table_no and row_no (from 0), names, cells and marks."""
    keep = [c for c in documents.columns if c != raw]
    t = documents.select(*keep, F.posexplode(tables(F.col(raw), spread)).alias("table_no", "t"))
    r = t.select(*keep, "table_no", F.col("t.names").alias("names"), F.posexplode("t.rows").alias("row_no", "r"))
    return r.where(~F.forall("r.heads", lambda h: h)).select(*keep, "table_no", "row_no", "names", F.col("r.cells").alias("cells"), F.col("r.marks").alias("marks"))
