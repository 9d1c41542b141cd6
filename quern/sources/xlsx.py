"""The first sheet of a workbook as rows of text, from the zip and its XML; and a writer for small sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in tree.iter(f"{_NS}numFmt")}
    out = set()
    xfs = tree.find(f"{_NS}cellXfs")
    for i, xf in enumerate(xfs if xfs is not None else []):
        n = int(xf.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, ""))
        if n in _DATE_FORMATS or re.search(r"[ymdhs]", code, re.I):
            out.add(i)
    return out


def _number(text: str, is_date: bool) -> str:
    """A whole number without a point; a date as ISO text."""
    x = float(text)
    if is_date:
        at = datetime(1899, 12, 30) + timedelta(milliseconds=round(x * 86_400_000))
        return at.date().isoformat() if at.time() == at.time().min else at.isoformat(sep=" ")
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def read_sheet(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet in order, empty rows included; an empty cell is null. Raises ValueError on what isn't a workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first.get(_REL)].lstrip("/")
        sheet = book.read(target if target.startswith("xl/") else f"xl/{target}")
        dates = _date_styles(book)
        at = 0
        for row in ElementTree.fromstring(sheet).iter(f"{_NS}row"):
            number = int(row.get("r", at + 1))
            while at + 1 < number:
                at += 1
                yield []
            at = number
            cells: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_NS}c")):
                k = _column(c.get("r", "")) if c.get("r") else i
                kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                elif kind in ("str", "d", "e"):
                    value = v.text
                else:
                    value = _number(v.text, int(c.get("s", 0)) in dates)
                cells += [None] * (k + 1 - len(cells))
                cells[k] = value
            yield cells
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, IndexError) as exc:
        raise ValueError(f"not a readable workbook: {exc}") from exc


def write_sheet(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet: numbers, booleans and text."""

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = _NS[1:-1]
    sheet = f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
