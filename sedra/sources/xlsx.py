"""Workbooks to text: sheets in their order, a line a row, cells between tabs. XML is read as a stream, a row at a time."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each dropped once it was used, with what stands before it."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        path = []
        for event, node in events:
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if node.tag == tag:
                yield node
                if path:
                    path[-1].clear()


def _string(node: ElementTree.Element) -> str:
    """The text of a shared or inline string: its runs, without phonetic readings."""
    return "".join(t.text or "" for part in ([node], node.findall(f"{_MAIN}r")) for own in part for t in own.findall(f"{_MAIN}t"))


def _sheets(z: zipfile.ZipFile) -> list[str]:
    """The sheets' parts, in the workbook's order."""
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [posixpath.normpath(posixpath.join("/xl", parts[s.get(_LINK)])).lstrip("/") for s in sheets]


def _column(reference: str | None, following: int) -> int:
    """The column (from 0) of a cell's reference, or the following one if it has none."""
    letters = re.match("[A-Z]+", reference or "")
    number = 0
    for c in letters[0] if letters else "":
        number = 26 * number + ord(c) - 64
    return number - 1 if letters else following


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        own = cell.find(f"{_MAIN}is")
        return "" if own is None else _string(own)
    text = "" if v is None else v.text or ""
    if kind == "s" and text:
        return shared[int(text)]
    return {"0": "FALSE", "1": "TRUE"}.get(text, text) if kind == "b" else text


def text_of(content: bytes) -> str:
    """The text of a workbook: cells as they are stored (a formula's last value, a date's number), empty rows left out, a blank line between sheets. Line ends and tabs within a cell are spaces."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_string(s) for s in _elements(z, "xl/sharedStrings.xml", f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for sheet in _sheets(z):
            lines = []
            for row in _elements(z, sheet, f"{_MAIN}row"):
                cells: list[str] = []
                for cell in row.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r"), len(cells))
                    cells += [""] * (at - len(cells)) + [re.sub(r"[\t\r\n]", " ", _value(cell, shared))]
                if any(cells):
                    lines.append("\t".join(cells) + "\n")
            out.append("".join(lines))
        return "\n".join(x for x in out if x)
