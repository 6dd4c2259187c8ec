"""Reads workbooks back to check what the sink wrote: a standard ZIP and XML parse per file.

The XML parser goes over the whole sheet, but without a call for each cell: rows in the form that
the sink gives them are taken from the text by one pattern for many rows at once, if every tag in
that text is accounted for. Rows in any other form come from the parser's events.
"""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator, Sequence
from xml.parsers import expat
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haulage.session import ship_package
from haulage.sinks.archive import _SHEET_HEAD, _SHEET_TAIL, _col_letters, published

READ_BYTES = 1 << 22
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")
_DIGITS = "0123456789"
_ROW_END = b"</row>"
_MARKS = re.compile(r'<row r="\d+">|<c r="([A-Z]+)\d+"(?: t="(inlineStr)"><is><t xml:space="preserve">([^<]*)</t></is></c>|><v>([^<]*)</v></c>)')
_OTHER_ENTITY = re.compile("&(?!amp;|lt;|gt;)")


def _place(letters: str) -> int:
    at = 0
    for c in letters:
        at = at * 26 + ord(c) - 64
    return at - 1


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)


def _by_events(xml: str | bytes, n: int) -> list[list[str | None]]:
    """Rows of a sheet in any form."""
    row_tag, cell_tag, texts = f"{_SHEET}row", f"{_SHEET}c", (f"{_SHEET}t", f"{_SHEET}v")
    rows: list[list[str | None]] = []
    parts: list[str] = []
    at, inline, inside, found = 0, False, False, False

    def begin(tag, attributes):
        nonlocal at, inline, inside, found
        if tag in texts:
            inside = found = True
        elif tag == cell_tag:
            at, inline, found = _place(attributes["r"].rstrip(_DIGITS)), attributes.get("t") == "inlineStr", False
            parts.clear()
        elif tag == row_tag:
            rows.append([None] * n)

    def end(tag):
        nonlocal inside
        if tag in texts:
            inside = False
        elif tag == cell_tag and found:
            rows[-1][at] = _plain("".join(parts)) if inline else "".join(parts)

    def characters(text):
        if inside:
            parts.append(text)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, characters
    parser.Parse(xml, True)
    return rows


def _by_pattern(text: str, letters: list[str]) -> list[list[str | None]] | None:
    """Columns of whole rows in the sink's form; None if there is anything else among them."""
    if "\r" in text or _OTHER_ENTITY.search(text):
        return None
    marks = _MARKS.findall(text)
    kinds = [m[0] for m in marks]
    n_rows, n_inline = kinds.count(""), sum(1 for m in marks if m[1])
    if text.count("<") != 2 * n_rows + 6 * n_inline + 4 * (len(marks) - n_rows - n_inline):
        return None
    values: list[str | None] = [m[2] or m[3] for m in marks]
    if "&" in text:
        values = [unescape(v) if "&" in v else v for v in values]
    if "_x" in text:
        values = [_plain(v) if m[1] and "_x" in v else v for m, v in zip(marks, values)]
    width = len(letters) + 1
    if kinds == ["", *letters] * n_rows:
        return [values[i::width] for i in range(1, width)]
    columns: list[list[str | None]] = [[None] * n_rows for _ in letters]
    place, row = {c: i for i, c in enumerate(letters)}, -1
    for kind, value in zip(kinds, values):
        if kind:
            columns[place[kind]][row] = value
        else:
            row += 1
    return columns


def _columns(content: bytes, n: int, read_bytes: int = READ_BYTES) -> Iterator[list[list[str | None]]]:
    """Columns of the sheet's rows behind its header, some rows at a time."""
    letters, head, tail = _col_letters(n), _SHEET_HEAD.encode(), _SHEET_TAIL.encode()
    turned = lambda rows: [list(c) for c in zip(*rows)] if rows else [[] for _ in letters]
    with zipfile.ZipFile(io.BytesIO(content)) as book, book.open("xl/worksheets/sheet1.xml") as sheet:
        held = sheet.read(max(read_bytes, len(head)))
        if not held.startswith(head):
            yield turned(_by_events(held + sheet.read(), n)[1:])
            return
        checked = expat.ParserCreate(namespace_separator="}")
        checked.Parse(held)
        held, skip = held[len(head):], 1       # the header row
        while True:
            cut = held.rfind(_ROW_END) + len(_ROW_END)
            if cut >= len(_ROW_END):
                columns = _by_pattern(held[:cut].decode(), letters)
                if columns is None:
                    columns = turned(_by_events(head + held[:cut] + tail, n))
                if columns[0]:
                    yield [c[skip:] for c in columns]
                    skip = 0
                held = held[cut:]
            piece = sheet.read(read_bytes)
            if not piece:
                break
            checked.Parse(piece)
            held += piece
    checked.Parse(b"", True)
    if b"<row" in held:
        yield turned(_by_events(head + held, n)[skip:])


def read_sheets(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the published workbooks under ``path`` as text; a workbook is one task's work (its
    size is bounded by the rows a sheet can hold)."""
    ship_package(spark)
    columns = list(columns)
    files = [p for p in published(path) if p.endswith(".xlsx")]

    def parse(batches):
        kinds = pa.schema([pa.field(c, pa.string()) for c in columns])
        for batch in batches:
            for content in batch.column("content"):
                for found in _columns(content.as_py(), len(columns)):
                    arrays = [pa.array(v, pa.string()) for v in found]
                    yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return (spark.read.format("binaryFile").load(files).select("content")
            .mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns)))
