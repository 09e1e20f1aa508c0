"""Workbooks without further libraries: a reader for sheets and a small styled writer, on the standard library's zip and XML."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
FILLS = {"exact": "FFC6EFCE", "mid": "FFFFEB9C", "low": "FFFFC7CE", "head": "FFD9E1F2"}


def _sheet_files(z: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
        target = targets[s.get(_R)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def list_sheets(path: str | Path) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return list(_sheet_files(z))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(item) -> str:
    """A string item's text, plain or in runs, without the phonetic guides beside it."""
    return "".join(t.text or "" for part in item if part.tag != f"{_M}rPh" for t in part.iter(f"{_M}t"))


def read_rows(path: str | Path, sheet: str, limit: int | None = None) -> list[list]:
    """Cell values by row: text, float, bool, date or None. Formulas give their stored values."""
    with zipfile.ZipFile(path) as z:
        files = _sheet_files(z)
        if sheet not in files:
            raise KeyError(sheet)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        dates = _date_styles(z)
        rows: list[list] = []
        for row in ET.fromstring(z.read(files[sheet])).iter(f"{_M}row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at - len(rows) + 1)]
            for cell in row.iter(f"{_M}c"):
                k = _column(cell.get("r")) if cell.get("r") else len(rows[at])
                rows[at] += [None] * (k + 1 - len(rows[at]))
                rows[at][k] = _value(cell, shared, dates)
            if limit is not None and len(rows) >= limit:
                break
        return rows


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_M}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    cells = root.find(f"{_M}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}


def _value(cell: ET.Element, shared: list[str], dates: set[int]):
    kind, v = cell.get("t", "n"), cell.find(f"{_M}v")
    if kind == "inlineStr":
        return "".join(map(_text, cell.iter(f"{_M}is")))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "e"):
        return v.text
    if kind == "b":
        return v.text == "1"
    x = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return dt.datetime(1899, 12, 30) + dt.timedelta(days=x)
    return x


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(path: str | Path, sheets: dict[str, tuple[list[str], Iterable[tuple]]], style_of=None) -> dict[str, int]:
    """Write sheets of (header, rows) with a frozen, filtered header; ``style_of(sheet, row)`` names a fill of FILLS or gives None. Returns row counts."""
    fills = list(FILLS)
    counts: dict[str, int] = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, (name, (header, rows)) in enumerate(sheets.items(), 1):
            body, widths, count = [], [len(h) * 2 + 4 for h in header], 0
            for r, values in enumerate([tuple(header), *rows], 1):
                key = "head" if r == 1 else style_of(name, dict(zip(header, values))) if style_of else None
                s = fills.index(key) + 1 if key else 0
                cells = []
                for k, x in enumerate(values):
                    ref = f'{_letters(k)}{r}" s="{s}'
                    if x is None:
                        continue
                    if isinstance(x, bool) or not isinstance(x, (int, float)):
                        text = escape("".join(c for c in str(x) if c >= " " or c in "\t\n"))
                        widths[k] = min(60, max(widths[k], len(str(x)) + 4))
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
                    else:
                        cells.append(f'<c r="{ref}"><v>{x!r}</v></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
                count = r - 1
            last = f"{_letters(max(len(header) - 1, 0))}{count + 1}"
            cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", (
                '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0">'
                f'<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{"".join(body)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'
            ))
            counts[name] = count
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        type_of = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        listed = "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId0" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in FILLS.values())
        xfs = '<xf fillId="0"/>' + "".join(f'<xf fillId="{k + 2}" applyFill="1"/>' for k in range(len(FILLS)))
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FILLS) + 1}">{xfs}</cellXfs></styleSheet>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{type_of}.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{type_of}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{type_of}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    return counts
