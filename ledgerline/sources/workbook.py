"""Folders of workbooks (S4): every task reads whole files with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_PER_BATCH = 10_000


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _sheet_path(book: zipfile.ZipFile, sheet_index: int) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    if not 0 <= sheet_index < len(sheets):
        raise ValueError(f"sheet index {sheet_index} is outside of {len(sheets)} sheets")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    target = targets[sheets[sheet_index].get(REL_ID)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    return value if kind in ("str", "e", "d") else str(float(value))


def sheet_rows(content: bytes, sheet_index: int) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number and the texts of its filled cells by column, row after row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        with book.open(_sheet_path(book, sheet_index)) as sheet:
            at = -1
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                at = int(row.get("r", at + 2)) - 1
                cells, col = {}, -1
                for cell in row.findall(f"{MAIN}c"):
                    col = _column_index(cell.get("r")) if cell.get("r") else col + 1
                    text = _cell_text(cell, shared)
                    if text is not None:
                        cells[col] = text
                yield at, cells
                row.clear()


def workbook_rows(spark: SparkSession, path: str, names: list[str], sheet_index: int = 0,
                  header_row: int = 0, pattern: str = "*.xlsx") -> DataFrame:
    """Text columns ``names`` of every workbook under ``path``, found by header, with file and row."""
    schema = "file string, row_ord long, " + ", ".join(f"`{n}` string" for n in names)

    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                header, rows = {}, []
                for at, cells in sheet_rows(content, sheet_index):
                    if at == header_row:
                        header = {text.strip(): col for col, text in cells.items() if text.strip()}
                    elif at > header_row and cells:
                        rows.append([file, at, *[cells.get(header.get(n, -1)) for n in names]])
                    if len(rows) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["file", "row_ord", *names])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "row_ord", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path"), F.col("content")).mapInPandas(read, schema)


def workbook_header(spark: SparkSession, path: str, sheet_index: int = 0, header_row: int = 0,
                    pattern: str = "*.xlsx") -> DataFrame:
    """S5 for workbooks: the header texts of every file, all of them text columns."""
    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                cells = next((c for at, c in sheet_rows(content, sheet_index) if at == header_row), {})
                found = [[file, col, text.strip()] for col, text in sorted(cells.items()) if text.strip()]
                yield pd.DataFrame(found, columns=["file", "col", "name"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(read, "file string, col long, name string")
