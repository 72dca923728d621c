"""Spreadsheets (.xlsx): tables written by executors, a file for each, and read back by cells.

Tasks write into a folder of their own beside the files; the driver moves these to their
places when all tasks have ended well, and deletes them otherwise. The format needs no more
than zip and XML of the standard library; rows stream through both ways.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from routeloom.sources.map_extract import store_of

FORMAT = "xlsx"
SCHEMA = "file string, sheet string, row int, cells array<string>"
#: Names and parts of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets><sheet name="Table" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: What XML can't hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_name(n: int) -> str:
    """A, B, ... Z, AA, ... of a column's number from 0."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def write_book(stream, rows: Iterator[tuple[int, list[str | None]]]) -> None:
    """A book of one sheet; rows (number from 0, cells) come in order, empty cells are left out."""
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, _HEAD + text)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for n, cells in rows:
                own = "".join(f'<c r="{column_name(i)}{n + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", c))}</t></is></c>' for i, c in enumerate(cells) if c is not None)
                sheet.write(f'<row r="{n + 1}">{own}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")


def read_book(stream) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a book, rows and columns from 0; cells that a row doesn't have are null."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(stream) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if tag(e) == "si":
                        shared.append("".join(t.text or "" for t in e.iter() if tag(t) == "t"))
                        e.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
            target = targets[s.get(f"{{{_RELATIONS}}}id")]
            place = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            with z.open(place) as f:
                row = -1
                for _, e in ElementTree.iterparse(f):
                    if tag(e) != "row":
                        continue
                    row = int(e.get("r") or row + 2) - 1
                    cells: list[str | None] = []
                    for c in e:
                        at = column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = next((v.text or "" for v in c if tag(v) == "v"), None)
                        if c.get("t") == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
                        else:
                            cells[at] = shared[int(value)] if c.get("t") == "s" and value is not None else value
                    yield s.get("name"), row, cells
                    e.clear()


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, name = store_of(self.path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.path.lower().endswith(".xlsx") and "/_writing-" not in f.path)
        return [_File(self.path.rstrip("/") + f[len(name.rstrip("/")) :]) for f in found] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            store, name = store_of(partition.path)
            with store.open_input_file(name) as f:
                for sheet, row, cells in read_book(f):
                    yield posixpath.basename(name), sheet, row, cells


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.folder = path, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        own = f"{self.folder}/{uuid.uuid4().hex}"
        store, name = store_of(self.path)
        names: list[str] = []
        rows = iter(iterator)
        row = next(rows, None)
        while row is not None:
            table, last = row["file"], row

            def of_table() -> Iterator[tuple[int, list[str | None]]]:
                nonlocal row
                while row is not None and row["file"] == table:
                    yield row["row"], row["cells"] or []
                    row = next(rows, None)

            store.create_dir(f"{name}/{own}", recursive=True)
            with store.open_output_stream(f"{name}/{own}/{table}.xlsx") as f:
                write_book(f, of_table())
            names.append(f"{last['file']}.xlsx")
        return _Written(own, names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, name = store_of(self.path)
        store.create_dir(name, recursive=True)
        for m in messages:
            for x in m.names if m else []:
                store.move(f"{name}/{m.folder}/{x}", f"{name}/{x}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, name = store_of(self.path)
        if store.get_file_info(f"{name}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{name}/{self.folder}")


class Xlsx(DataSource):
    """spark.read.format("xlsx").load(path): SCHEMA; a write takes rows of it that stand together by file, in order of row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of a book, or of all books beneath a folder; all cells are text, rows and columns count from 0."""
    spark.dataSource.register(Xlsx)
    return spark.read.format(FORMAT).load(path)


def write_sheets(tables: DataFrame, path: str) -> None:
    """A book for each table of (file, row, cells), named by it, in the folder path; rows of one table go to one task, in order. A table without rows has no book; null cells are left out, and signs that XML can't hold."""
    tables.sparkSession.dataSource.register(Xlsx)
    own = tables.select("file", F.lit("Table").alias("sheet"), F.col("row").cast("int").alias("row"), F.col("cells").cast("array<string>").alias("cells"))
    own.repartition("file").sortWithinPartitions("file", "row").write.format(FORMAT).mode("append").save(path)
