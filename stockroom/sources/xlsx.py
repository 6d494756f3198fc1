"""Rows of a workbook's first sheet, for uploads in ``.xlsx``.

A workbook is a zip of XML parts and cannot be split, so one task reads one file; the
sheet is streamed from the zip and leaves the task in blocks of rows.  Everything is
text, as in a CSV upload: whole numbers without a point, dates as ISO dates.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd

ROWS = 10_000       # rows handed on together
# Number formats that stand for dates and times, by their built-in number.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """The elements of one name of a part, one at a time; none if there is no such part."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) == name:
                yield e
                e.clear()


def _text(e: ElementTree.Element) -> str:
    """All text of a string item, without its reading aids."""
    if _local(e.tag) == "rPh":
        return ""
    return (e.text or "") if _local(e.tag) == "t" else "".join(map(_text, e))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose numbers are dates."""
    part = "xl/styles.xml"
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
           for e in _elements(book, part, "numFmt")}
    dated = DATE_FORMATS | {i for i, code in own.items() if re.search("[dmyhs]", code, re.I)}
    for xfs in _elements(book, part, "cellXfs"):
        return {i for i, x in enumerate(xfs) if int(x.get("numFmtId", 0)) in dated}
    return set()


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the first sheet."""
    name = next((next(v for k, v in e.attrib.items() if _local(k) == "id" and "}" in k)
                 for e in _elements(book, "xl/workbook.xml", "sheet")), None)
    for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if e.get("Id") == name:
            return posixpath.normpath(posixpath.join("/xl", e.get("Target"))).lstrip("/")
    raise ValueError("the workbook has no sheet")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _number(text: str, is_date: bool, epoch: dt.datetime) -> str:
    value = float(text)
    if is_date:
        at = epoch + dt.timedelta(seconds=round(value * 86400))
        return at.strftime("%Y-%m-%d" if at.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows that hold a value, cells in place, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        late = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
        for row in _elements(book, _first_sheet(book), "row"):
            cells: list[str | None] = []
            for at, c in enumerate(x for x in row if _local(x.tag) == "c"):
                kind, place = c.get("t", "n"), _column(c.get("r")) if c.get("r") else at
                raw = next((x.text for x in c if _local(x.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(_text(x) for x in c if _local(x.tag) == "is")
                elif raw is None or kind == "e":        # empty, or an error such as #N/A
                    value = None
                elif kind == "s":
                    value = shared[int(raw)]
                elif kind == "b":
                    value = "True" if raw == "1" else "False"
                else:
                    value = _number(raw, int(c.get("s", 0)) in dates, epoch) if kind == "n" else raw
                cells += [None] * (place + 1 - len(cells))
                cells[place] = value
            if any(c is not None for c in cells):
                yield cells


def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, content) rows -> file, pos, fields.  A file that is no workbook has no rows."""
    def frame(file: str, rows: list, first: int) -> pd.DataFrame:
        return pd.DataFrame({"file": [file] * len(rows), "pos": range(first, first + len(rows)), "fields": rows})
    for batch in batches:
        for file, content in batch[["file", "content"]].itertuples(index=False):
            held, n = [], 0
            try:
                for cells in sheet_rows(content):
                    held.append(cells)
                    if len(held) == ROWS:
                        yield frame(file, held, n)
                        n += len(held)
                        held = []
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError):
                held = []
                if n:
                    raise
            if held:
                yield frame(file, held, n)
