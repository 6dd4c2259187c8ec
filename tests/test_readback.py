"""The workbook reader: its pattern and the parser's events give the same rows."""

import io
import zipfile

import pytest

from haulage.plans import readback as RB
from haulage.sinks.archive import _SHEET_HEAD, _SHEET_TAIL

HEADER = '<row r="1"><c r="A1" t="inlineStr"><is><t xml:space="preserve">a</t></is></c><c r="B1" t="inlineStr"><is><t xml:space="preserve">b</t></is></c></row>'
INLINE = '<c r="{}" t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'


def book(*rows, head=_SHEET_HEAD, tail=_SHEET_TAIL):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zf:
        zf.writestr("xl/worksheets/sheet1.xml", head + HEADER + "".join(rows) + tail)
    return out.getvalue()


def rows_of(content, size=RB.READ_BYTES):
    return [r for found in RB._columns(content, 2, size) for r in zip(*found)]


AWKWARD = ['<row r="2"><c r="A2"><v>1</v></c>' + INLINE.format("B2", "&lt;row r=\"9\"&gt; &amp;amp; é") + "</row>", '<row r="3"></row>',
           '<row r="4">' + INLINE.format("B4", "") + "</row>", '<row r="5">' + INLINE.format("A5", "_x000D__x005F_x0041_") + '<c r="B5"><v>_x0041_</v></c></row>']
WANT = [("1", '<row r="9"> &amp; é'), (None, None), (None, ""), ("\r_x0041_", "_x0041_")]


@pytest.mark.parametrize("size", [1, 50, 300, RB.READ_BYTES])
def test_sheets_of_the_sink_need_no_event_for_a_cell(monkeypatch, size):
    monkeypatch.setattr(RB, "_by_events", None)
    assert rows_of(book(*AWKWARD), size) == WANT and rows_of(book(), size) == []


@pytest.mark.parametrize("odd, want", [
    ('<row r="6"/>', (None, None)), ("<row r='6'><c r='B6' t='inlineStr'><is><t>x</t></is></c></row>", (None, "x")),
    ('<row r="6"><c r="A6" t="inlineStr"><is><r><t>a</t></r><r><t>&#98;</t></r></is></c><!-- <v>2</v> --></row>', ("ab", None)),
    ('<row r="6">' + INLINE.format("A6", "x\r\ny") + "</row>", ("x\ny", None)), ('<row r="6">' + INLINE.format("A6", "<![CDATA[<v>]]>") + "</row>", ("<v>", None))])
def test_other_forms_come_from_the_parser(odd, want):
    for size in (40, RB.READ_BYTES):
        assert rows_of(book(*AWKWARD, odd, AWKWARD[0]), size) == [*WANT, want, WANT[0]]
        assert rows_of(book(*AWKWARD, odd), size) == [*WANT, want]
        assert rows_of(book(*AWKWARD, odd, head=_SHEET_HEAD.replace('"', "'")), size) == [*WANT, want]


def test_broken_sheets_are_errors():
    for tail in ("</sheetData>", "</worksheet>", "</sheetData></worksheet><x/>"):
        with pytest.raises(Exception, match="element|tag|token|junk"):
            rows_of(book(*AWKWARD, tail=tail))
