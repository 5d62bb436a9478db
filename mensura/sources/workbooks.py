"""Catalog workbooks: the active sheet's rows as texts, read by one task a workbook, and a Spark data source over them.

Cells are printed as a spreadsheet library for Python prints its values: whole numbers without a point, others as floats,
dates and times by their cell's number format (2024-01-15 00:00:00), booleans as True; what is empty, zero or false is
the empty string.
"""

from __future__ import annotations

import datetime
import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOCUMENT = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Fixed values of the format: built-in number formats that show a date or a time, and those that show a duration.
DATE_FORMATS, DURATION_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47]), frozenset([46])
_EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', re.I)


class Workbook:
    """The parts of a workbook that its active sheet needs."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        book = self._part("xl/workbook.xml")
        properties, view = book.find(f"{_MAIN}workbookPr"), book.find(f".//{_MAIN}workbookView")
        self.epoch = _EPOCHS[properties is not None and properties.get("date1904") in ("1", "true")]
        self.epoch_1900 = self.epoch.year == 1899
        # the active tab counts sheets in the workbook's order; relationships name their files
        self.sheet = self._sheets(book)[int(view.get("activeTab", 0)) if view is not None else 0]
        self.shared = [_text(e) for e in self._part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.names else []
        self.shown = self._shown()

    def _part(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _sheets(self, book: ElementTree.Element) -> list[str]:
        """The files of the sheets in the workbook's order; by their numbers where it lists none."""
        listed = [s.get(f"{_DOCUMENT}id") for s in book.iter(f"{_MAIN}sheet")]
        if not listed:
            return sorted((n for n in self.names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        targets = {r.get("Id"): r.get("Target") for r in self._part("xl/_rels/workbook.xml.rels")}
        return [posixpath.normpath(posixpath.join("/xl", targets[i])).lstrip("/") for i in listed]

    def _shown(self) -> list[str]:
        """How each cell style shows numbers: as a date, a duration or plainly."""
        if "xl/styles.xml" not in self.names:
            return []
        styles = self._part("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_MAIN}numFmt")}
        formats = [int(x.get("numFmtId", 0)) for e in styles.iter(f"{_MAIN}cellXfs") for x in e.iter(f"{_MAIN}xf")]
        return [_kind_of(own[n]) if n in own else "date" if n in DATE_FORMATS else "duration" if n in DURATION_FORMATS else "number" for n in formats]

    def rows(self) -> Iterator[tuple[int, dict[int, object]]]:
        """(row number from 1, values by column from 0) of the rows that the sheet stores, in order."""
        number = 0
        with self.zip.open(self.sheet) as stream:
            for _, e in ElementTree.iterparse(stream):
                if e.tag == f"{_MAIN}row":
                    number = int(e.get("r", number + 1))
                    values, at = {}, -1
                    for c in e.iter(f"{_MAIN}c"):
                        letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                        at = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else at + 1
                        values[at] = self._value(c)
                    yield number, values
                    e.clear()

    def _value(self, c: ElementTree.Element) -> object:
        kind, stored = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            inside = c.find(f"{_MAIN}is")
            return None if inside is None else _text(inside)
        if stored is None:
            return None
        if kind == "s":
            return self.shared[int(stored)]
        if kind == "b":
            return stored not in ("0", "false")
        if kind == "d":
            return _iso(stored)
        if kind != "n":
            return stored
        number = float(stored) if re.search(r"[.eE]", stored) else int(stored)
        style = int(c.get("s", 0))
        shown = self.shown[style] if style < len(self.shown) else "number"
        return number if shown == "number" else self._moment(number, shown)

    def _moment(self, value: float, shown: str) -> object:
        day, part = divmod(value, 1)
        within = datetime.timedelta(milliseconds=round(part * 86_400_000))
        if shown == "duration":
            return datetime.timedelta(days=day) + within
        if 0 <= value < 1 and within.days == 0:
            return (datetime.datetime.min + within).time()
        if 0 < value < 60 and self.epoch_1900:  # the format counts a 29th of February 1900
            day += 1
        try:
            return self.epoch + datetime.timedelta(days=day) + within
        except OverflowError:
            return "#VALUE!"


def _text(e: ElementTree.Element) -> str:
    """A string's plain text or its runs; readings of the runs are left out."""
    return "".join(t.text or "" for t in [*e.findall(f"{_MAIN}t"), *e.findall(f"{_MAIN}r/{_MAIN}t")])


def _kind_of(code: str) -> str:
    first = _LITERAL.sub("", code.split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", first, re.I):
        return "duration"
    return "date" if re.search(r"[dmhys]", first, re.I) else "number"


def _iso(text: str) -> object:
    for kind in (datetime.time, datetime.date, datetime.datetime):
        try:
            return kind.fromisoformat(text.removesuffix("Z"))
        except ValueError:
            continue
    return text


def workbook_rows(content: bytes) -> tuple[list[str], list[dict[str, str]]]:
    """The names of a workbook's first row, and a dict for each row from the second to the last one stored, empty ones too."""
    names: dict[int, str] = {}
    out: list[dict[str, str]] = []
    for number, values in Workbook(content).rows():
        if number == 1:
            names = {k: str(v).strip() for k, v in sorted(values.items()) if v and str(v).strip()}
            continue
        blank = dict.fromkeys(names.values(), "")
        out += [dict(blank) for _ in range(number - 2 - len(out))]
        out.append(blank | {n: str(v).strip() if (v := values.get(k)) else "" for k, n in names.items()})
    return list(dict.fromkeys(names.values())), out


class WorkbookSource(DataSource):
    """spark.read.format("catalog_workbooks").load(path): a row for each row of each workbook below a folder, a partition a
    workbook.  Without a schema: file, row, header, cells (row 1 stands for the header and has no cells); with one, `file`, `row`
    and the columns of those names as texts, empty where a workbook does not have them.  The path is read by pyarrow's file
    systems; read_catalog_xlsx reads what only Spark reaches."""

    @classmethod
    def name(cls) -> str:
        return "catalog_workbooks"

    def schema(self) -> str:
        return "file string, row long, header array<string>, cells map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema.fieldNames())


class WorkbookFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _opened(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[WorkbookFile]:
        from pyarrow import fs

        system, path = self._opened()
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [WorkbookFile(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx")]

    def read(self, partition: WorkbookFile) -> Iterator[tuple]:
        system, _ = self._opened()
        with system.open_input_file(partition.path) as stream:
            names, rows = workbook_rows(stream.read())
        file = partition.path.rsplit("/", 1)[-1]
        if self.columns == ["file", "row", "header", "cells"]:
            yield file, 1, names, None
            yield from ((file, k, names, cells) for k, cells in enumerate(rows, 2))
        else:
            for k, cells in enumerate(rows, 2):
                own = {"file": file, "row": k}
                yield tuple(own[c] if c in own else cells.get(c, "") for c in self.columns)
