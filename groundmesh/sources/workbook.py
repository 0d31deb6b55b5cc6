"""Workbooks (.xlsx) without a spreadsheet library: a zip folder of XML documents, read as streams.

``WorkbookSource`` is a data source, ``spark.read.format("xlsx").load(path)`` once registered, for files that executors can open; a sheet is a
partition. ``parse_workbooks`` takes the bytes of workbooks from any store (``binaryFile``) or column, a task a workbook.

Rows come as file, sheet, sheet_number, row_number, cells. The first row with a filled cell is the header; the rows after it that hold a value are numbered from 2. Cells are
named by their header (clean text); columns without a name go, and of columns that share a name the last one counts. Values are as they are
stored: numbers without a fraction as whole ones, True and False, dates as ``YYYY-MM-DD hh:mm:ss``, formulas by their last result.
"""

from __future__ import annotations

import glob
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from pathlib import PurePosixPath
from typing import IO
from xml.etree import ElementTree
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from groundmesh.functions.text import clean_text

ROWS = "file string, sheet string, sheet_number int, row_number int, cells map<string,string>"
#: Rows of one Arrow batch.
BATCH = 5_000
#: Number formats that mean dates and times; spaces of any kind, and marks of no width.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
BLANK = re.compile(r"\s+")
NO_WIDTH = re.compile(r"[\u200b-\u200d\ufeff]")
LITERAL = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def header_name(value: str | None) -> str:
    return BLANK.sub(" ", NO_WIDTH.sub("", value or "")).strip()


def text_of(element: ElementTree.Element) -> str:
    """The text of a string item: its own and that of its runs, without phonetic hints."""
    out = []
    for child in element:
        if local(child.tag) == "t":
            out.append(child.text or "")
        elif local(child.tag) == "r":
            out += [t.text or "" for t in child if local(t.tag) == "t"]
    return "".join(out)


def elements(source: IO[bytes], name: str) -> Iterator[ElementTree.Element]:
    """Each whole element of this name; what was read is let go of."""
    path: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if local(element.tag) == name:
            yield element
            element.clear()
            if path:
                path[-1].remove(element)


@dataclass(frozen=True)
class Sheet:
    name: str
    number: int
    member: str


class Workbook:
    """An open workbook: its sheets, strings and date formats."""

    def __init__(self, source: IO[bytes]) -> None:
        self.zip = ZipFile(source)
        self.names = set(self.zip.namelist())
        self.book = "xl/workbook.xml"
        if "_rels/.rels" in self.names:
            found = [r for r in self.relations("_rels/.rels", "") if r[1].endswith("/officeDocument")]
            self.book = found[0][2] if found else self.book
        folder = PurePosixPath(self.book).parent
        self.related = self.relations(f"{folder}/_rels/{PurePosixPath(self.book).name}.rels", str(folder))

    def relations(self, member: str, folder: str) -> list[tuple[str, str, str]]:
        """id, kind and member of every relation of a document."""
        out = []
        with self.zip.open(member) as f:
            for r in elements(f, "Relationship"):
                target = r.get("Target", "")
                whole = target[1:] if target.startswith("/") else str(PurePosixPath(folder) / target)
                out.append((r.get("Id", ""), r.get("Type", ""), whole))
        return out

    def member(self, kind: str) -> str | None:
        return next((m for _, k, m in self.related if k.endswith(f"/{kind}") and m in self.names), None)

    def sheets(self) -> list[Sheet]:
        """Worksheets in the order of the workbook; chart sheets are none."""
        where = {i: m for i, kind, m in self.related if kind.endswith("/worksheet")}
        out = []
        with self.zip.open(self.book) as f:
            for s in elements(f, "sheet"):
                at = next((v for k, v in s.attrib.items() if local(k) == "id"), "")
                if at in where:
                    out.append(Sheet(s.get("name", ""), len(out) + 1, where[at]))
        return out

    def strings(self) -> list[str]:
        if not (member := self.member("sharedStrings")):
            return []
        with self.zip.open(member) as f:
            return [text_of(si) for si in elements(f, "si")]

    def epoch(self) -> datetime:
        with self.zip.open(self.book) as f:
            late = any(p.get("date1904") in ("1", "true") for p in elements(f, "workbookPr"))
        return datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

    def date_styles(self) -> set[str]:
        """Numbers of the cell styles that show dates or times."""
        if not (member := self.member("styles")):
            return set()
        own: set[int] = set()
        out: set[str] = set()
        with self.zip.open(member) as f:
            for styles in elements(f, "styleSheet"):
                for part in styles:
                    if local(part.tag) == "numFmts":
                        own = {int(x.get("numFmtId", "0")) for x in part if re.search(r"[dmyhs]", LITERAL.sub("", x.get("formatCode", "")).lower())}
                    if local(part.tag) == "cellXfs":
                        out = {str(n) for n, x in enumerate(part) if int(x.get("numFmtId", "0")) in DATE_FORMATS | own}
        return out

    def rows(self, sheet: Sheet) -> Iterator[list[str | None]]:
        """The cells of each row, as text; None: nothing there."""
        strings, dates, epoch = self.strings(), self.date_styles(), self.epoch()
        with self.zip.open(sheet.member) as f:
            for row in elements(f, "row"):
                out: list[str | None] = []
                for cell in row:
                    if local(cell.tag) != "c":
                        continue
                    at = column_of(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    out[at] = value_of(cell, strings, dates, epoch)
                yield out


def column_of(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def value_of(cell: ElementTree.Element, strings: list[str], dates: set[str], epoch: datetime) -> str | None:
    kind, raw = cell.get("t", "n"), None
    for child in cell:
        if local(child.tag) == "v":
            raw = child.text
        elif local(child.tag) == "is":
            return text_of(child)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(bool(int(raw)))
    if kind == "n":
        if cell.get("s") in dates:
            return dated(float(raw), epoch)
        return str(float(raw)) if re.search(r"[.eE]", raw) else str(int(raw))
    return raw


def dated(days: float, epoch: datetime) -> str:
    """A date with its time, or a time alone below one day."""
    if epoch.year == 1899 and days < 60:
        days += days >= 1  # this calendar has a 29 February 1900
    moment = epoch + timedelta(milliseconds=round(days * 86_400_000))
    return str(moment) if not 0 <= days < 1 else str(moment.time())


def sheet_rows(book: Workbook, file: str, sheet: Sheet) -> Iterator[tuple[str, str, int, int, dict[str, str]]]:
    names: list[str] | None = None
    number = 1
    for cells in book.rows(sheet):
        if all(c is None for c in cells):
            continue
        if names is None:
            names = [header_name(c) for c in cells]
            continue
        number += 1
        cells += [None] * (len(names) - len(cells))
        yield file, sheet.name, sheet.number, number, {n: c or "" for n, c in zip(names, cells) if n}  # a later column of a name takes its place


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        columns[4] = [list(c.items()) for c in columns[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "sheet", "sheet_number", "row_number", "cells"])

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


@dataclass
class SheetPartition(InputPartition):
    path: str
    number: int


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        scheme = re.match(r"([A-Za-z][\w+.-]+):", path)
        if scheme and scheme[1] != "file":
            raise ValueError("executors cannot open this path themselves: read it with binaryFile and parse_workbooks")
        self.path = re.sub(r"^file:/*", "/", path)

    def partitions(self) -> list[SheetPartition]:
        """A partition for each sheet of each file that the path names (a folder: its .xlsx files)."""
        files = sorted(glob.glob(f"{self.path}/*.xlsx") or glob.glob(self.path))
        if not files:
            raise FileNotFoundError(self.path)
        out = []
        for file in files:
            with open(file, "rb") as f:
                out += [SheetPartition(file, s.number) for s in Workbook(f).sheets()]
        return out

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            book = Workbook(f)
            yield from batches_of(sheet_rows(book, PurePosixPath(partition.path).name, book.sheets()[partition.number - 1]))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def parse_workbooks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """ROWS of workbooks held as bytes: as ``spark.read.format("binaryFile").load(...)`` gives them, from any store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                if data.is_valid:
                    book = Workbook(io.BytesIO(data.as_buffer().to_pybytes()))
                    name = PurePosixPath(file or "").name
                    for sheet in book.sheets():
                        yield from batches_of(sheet_rows(book, name, sheet))

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, ROWS)


def workbook_sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of one workbook as a DataFrame for each sheet: row_number and a column for each name, cells cleaned, as ``workbook_relations`` takes them."""
    named = rows.select("sheet", F.explode(F.map_keys("cells")).alias("name")).distinct().collect()  # the header cells
    columns: dict[str, list[str]] = {}
    for r in sorted(named):
        columns.setdefault(r["sheet"], []).append(r["name"])
    return {s: rows.where(F.col("sheet") == s).select("row_number", *(clean_text(F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))).alias(n) for n in names)) for s, names in columns.items()}


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of one workbook by their names, from any store."""
    return workbook_sheets(parse_workbooks(spark.read.format("binaryFile").load(path)))
