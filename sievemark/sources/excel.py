"""Excel workbooks: every sheet's cells, read from binaryFile in the executors with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.sources.documents import header, parsed

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_S}numFmt") if re.search("[ymdhs]", bare(f.get("formatCode", "")), re.I)}
    styles = root.find(f"{_S}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    return {"0": "false", "1": "true"}.get(v.text, v.text) if kind == "b" else None if kind == "e" else v.text


def _cells(content: bytes) -> Iterator[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    read = lambda part: ElementTree.fromstring(z.read(part))
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in read("xl/sharedStrings.xml").iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    dates = _date_styles(z)
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target").removeprefix("/xl/"))) for r in read("xl/_rels/workbook.xml.rels")}
    for sheet in read("xl/workbook.xml").iter(f"{_S}sheet"):
        part = targets.get(sheet.get(f"{_R}id"))
        if part not in names:
            continue
        rows: list[dict[int, tuple[str, bool]]] = []
        for row in read(part).iter(f"{_S}row"):
            held: dict[int, tuple[str, bool]] = {}
            for k, c in enumerate(row.iter(f"{_S}c")):
                if (text := _value(c, shared)) is not None:
                    held[_column(c.get("r", "")) if c.get("r") else k] = (text, c.get("t", "n") == "n" and int(c.get("s", 0)) in dates)
            rows.append(held)
        if not rows:
            continue
        width = 1 + max((k for r in rows for k in r), default=-1)
        titles = header([rows[0].get(k, ("", False))[0] for k in range(width)])
        for i, r in enumerate(rows[1:]):
            for k, (text, is_date) in sorted(r.items()):
                yield sheet.get("name"), i, titles[k], text, is_date


def excel_cells(rows: DataFrame) -> DataFrame:
    """path, sheet, row_id, col, text, val, at of each filled cell of all sheets; the first row names the columns.

    val is the number of a cell that isn't a date, at the time of one that is. A file that is no
    workbook gives no rows; sheets of a header alone give none.
    """
    cells = parsed(rows, _cells, "sheet string, row_id long, col string, text string, is_date boolean")
    number = F.col("text").try_cast("double")
    # Day 1 is 1 January 1900, and day 60 the 29 February that year didn't have.
    at = F.timestamp_seconds((number - 25569) * 86400)
    return cells.select("path", "sheet", "row_id", "col", "text", F.when(~F.col("is_date"), number).alias("val"), F.when(F.col("is_date"), at).alias("at"))
