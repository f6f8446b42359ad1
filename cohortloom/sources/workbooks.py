"""Workbooks (xlsx) read without further packages, row by row, on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """Place of a cell reference such as AB12, from 0."""
    n = 0
    for ch in re.match("[A-Z]*", reference).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | int = 0, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells as text) of a sheet by name or place; of wanted rows only, and no further than the last of them."""
    want = None if wanted is None else set(wanted)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(_REL)) for s in book.iter(f"{_NS}sheet")]
        at = sheet if isinstance(sheet, int) else [n for n, _ in sheets].index(sheet)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[sheets[at][1]].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            place = -1
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                place = int(row.get("r")) - 1 if row.get("r") else place + 1
                if want is not None and place > max(want, default=-1):
                    return
                if want is None or place in want:
                    cells: list[str | None] = []
                    for c in row.iter(f"{_NS}c"):
                        k = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (k + 1 - len(cells))
                        v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                        if inline is not None:
                            cells[k] = "".join(t.text or "" for t in inline.iter(f"{_NS}t"))
                        elif v is not None and v.text is not None:
                            cells[k] = shared[int(v.text)] if c.get("t") == "s" else v.text
                    yield place, cells
                row.clear()


def read_sheets(spark: SparkSession, path: str, sheet: str | int = 0, rows: list[int] | None = None) -> DataFrame:
    """Rows of a sheet of every workbook of a path or glob: ``file, row_no, cells``. A workbook is read whole by one
    task, as its format has it; several are read side by side."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                got = list(sheet_rows(bytes(data), sheet, rows))
                yield pd.DataFrame({"file": [name] * len(got), "row_no": [i for i, _ in got], "cells": [c for _, c in got]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row_no int, cells array<string>")


def sheet_table(spark: SparkSession, path: str, names: list[str], sheet: str | int = 0, header: int = 0) -> DataFrame:
    """The rows below the header row, cells by place under the given names, missing ones null."""
    x = read_sheets(spark, path, sheet).where(F.col("row_no") > header)
    return x.select("file", "row_no", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def write_sheet(path, rows: list[list], sheet: str = "Sheet1") -> None:
    """A small workbook of one sheet with inline text and numbers, for exchange and tests."""
    from xml.sax.saxutils import escape

    cell = lambda v: "" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join("<row>" + "".join(cell(v) or "<c/>" for v in r) + "</row>" for r in rows)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{kind}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
