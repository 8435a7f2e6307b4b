"""Workbooks of several tables: a sheet per table, written row by row and read back on Spark."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators.relational import require
from cohortal.sources.binary import opened

# Limits and names of the format.
MOST_ROWS, MOST_COLUMNS, LONGEST_NAME = 1_048_576, 16_384, 31
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def cell(v) -> str:
    """A cell: numbers and booleans as such, null as an empty one, all else as text."""
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int) and abs(v) < 1 << 53 or isinstance(v, float) and math.isfinite(v):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(FORBIDDEN.sub("", str(v)))}</t></is></c>'


def write_workbook(tables: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """Write a sheet per table, with a header; returns the rows of each.

    A workbook is one file, so its rows pass the driver, one part of a table at a time, and go straight
    into the file. A table with more rows or columns than a sheet holds, and names that no sheet can
    have, raise before or while it is written: no row is left out. The file is put in its place when
    it is whole.
    """
    names = list(tables)
    require(bool(names), "a workbook needs a sheet")
    bad = [n for n in names if not n or len(n) > LONGEST_NAME or re.search(r"[\[\]:*?/\\]", n)]
    require(not bad, f"no names of sheets: {bad}")
    require(len({n.lower() for n in names}) == len(names), f"names of sheets repeat: {names}")
    wide = [n for n, t in tables.items() if len(t.columns) > MOST_COLUMNS]
    require(not wide, f"more than {MOST_COLUMNS} columns: {wide}")
    system, inside = opened(path)
    counts: dict[str, int] = {}
    part = f"{inside}.part"
    with system.open_output_stream(part) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, t) in enumerate(tables.items(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                out = io.TextIOWrapper(f, "utf-8", write_through=False)
                out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData><row>{"".join(map(cell, t.columns))}</row>')
                n = 0
                for r in t.toLocalIterator():
                    n += 1
                    require(n < MOST_ROWS, f"{name}: more than {MOST_ROWS - 1} rows")
                    out.write(f"<row>{''.join(map(cell, r))}</row>")
                out.write("</sheetData></worksheet>")
                out.flush()
                out.detach()
            counts[name] = n
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>')
        each = "".join(f'<Relationship Id="rId{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{each}</Relationships>')
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{parts}</Types>',
        )
    system.move(part, inside)
    return counts


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """``sheet, row, cells`` of a workbook whose texts stand in their cells, in order; row 0 is the header."""
    tag = lambda name: f"{{{MAIN}}}{name}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(tag("sheet")):
            target = links[sheet.get(f"{{{LINKS}}}id")]
            n = 0
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == tag("row"):
                        cells = []
                        for c in e.iter(tag("c")):
                            v = c.find(tag("v"))
                            text = "".join(t.text or "" for t in c.iter(tag("t"))) if c.get("t") == "inlineStr" else None if v is None else v.text
                            cells.append(text if c.get("t") != "b" else {"1": "true", "0": "false"}[text])
                        yield sheet.get("name"), n, cells
                        n += 1
                        e.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row, cells, error`` of workbooks, a task per file; one that cannot be read is a row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "row", "cells", "error"]
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                held: list[tuple] = []
                try:
                    for row in sheet_rows(bytes(content)):
                        held.append((p, *row, None))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except Exception as e:
                    held.append((p, None, None, None, f"{type(e).__name__}: {e}"))
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return files.mapInPandas(run, "path string, sheet string, row long, cells array<string>, error string")


def sheet_table(rows: DataFrame, sheet: str, schema: Mapping[str, str]) -> DataFrame:
    """One sheet as a table of the columns that ``schema`` names, cast to its types; a header without one of them raises."""
    own = rows.where((F.col("sheet") == sheet) & F.col("error").isNull())
    header = own.where("row = 0").first()
    require(header is not None, f"no sheet {sheet}")
    missing = [c for c in schema if c not in header.cells]
    require(not missing, f"{sheet} lacks {', '.join(missing)}")
    return own.where("row > 0").select(*[F.get("cells", F.lit(header.cells.index(c))).cast(t).alias(c) for c, t in schema.items()])
