"""Spreadsheets (zipped XML): rows of sheets as a table, a table as sheets."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one file that is written, and letters of a cell: a sheet's own limits are a little over a million rows and 32,767 letters.
ROWS, LETTERS = 100_000, 32_767
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Fixed texts of the format.
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{0}" sheetId="1" r:id="rId1"/></sheets></workbook>'
PARTS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
#: What XML can't hold, and what would be read as such an escape, are written as _xHHHH_.
ODD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def column_of(place: str) -> int:
    """The number of a cell's column, from 0: A, ..., Z, AA, ..."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def place_of(column: int, row: int) -> str:
    letters, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row}"


def plain(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a file's sheets in order. Cells are texts as they are stored: numbers as written, true and false for logical
    ones; empty ones are null. A sheet is parsed as it is read; only its shared texts are held."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{MAIN}si":
                        shared.append(plain("".join(t.text or "" for t in e.iter(f"{MAIN}t"))))
                        e.clear()
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = links.get(sheet.get(f"{LINKS}id"), "")
            at = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if at not in names:
                continue
            number = 0
            with z.open(at) as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{MAIN}row":
                        continue
                    number = int(e.get("r") or number + 1)
                    cells: dict[int, str] = {}
                    for i, c in enumerate(e.iter(f"{MAIN}c")):
                        kind, value = c.get("t"), c.findtext(f"{MAIN}v")
                        if kind == "inlineStr":
                            value = plain("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                        elif value is not None:
                            value = shared[int(value)] if kind == "s" else ("true" if value == "1" else "false") if kind == "b" else plain(value)
                        if value not in (None, ""):
                            cells[column_of(c.get("r")) if c.get("r") else i] = value
                    yield sheet.get("name"), number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    e.clear()


def sheet_file(header: list[str], rows: list[tuple], name: str = "Sheet1") -> bytes:
    """A file of one sheet. Numbers and logical values are cells of their kind, all else is text, cut at what a cell can hold; nulls are empty."""

    def cell(v: object, column: int, row: int) -> str:
        at = place_of(column, row)
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int) and abs(v) < 10**15 or isinstance(v, float) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)[:LETTERS])
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for at, text in (("[Content_Types].xml", TYPES), ("_rels/.rels", ROOT), ("xl/workbook.xml", BOOK.format(escape(name[:31], {'"': "&quot;"}))), ("xl/_rels/workbook.xml.rels", PARTS)):
            z.writestr(at, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for i, row in enumerate([tuple(header), *rows], 1):
                f.write(f'<row r="{i}">{"".join(cell(v, j, i) for j, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


CELLS = "path string, sheet string, row long, cells array<string>, reason string"


def told(path: str, data: bytes) -> Iterator[tuple]:
    """A file's rows as CELLS has them; where it can't be read further, a row that says why."""
    try:
        for sheet, number, cells in sheet_rows(data):
            yield path, sheet, number, cells, None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
        yield path, None, None, None, f"{type(e).__name__}: {e}"


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet, row, cells, reason) of the spreadsheets below a folder, a task for each few files. A file that can't be read gives one row that
    says why, with null cells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(folder)

    kinds = [("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("reason", pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = told(path, data)
                while held := list(islice(rows, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return files.select("path", "content").mapInArrow(work, CELLS)


def table_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(path, sheet, row) and the named columns out of read_sheets' rows: each sheet's first row names its columns. A sheet that lacks one
    gives null for it; names are compared trimmed and in lower case."""
    heads = rows.where("reason is null").groupBy("path", "sheet").agg(F.min(F.struct("row", "cells")).alias("h")).select("path", "sheet", F.col("h.row").alias("_first"), F.transform("h.cells", lambda c: F.lower(F.trim(c))).alias("_names"))
    seen = rows.where("reason is null").join(heads, ["path", "sheet"]).where(F.col("row") > F.col("_first"))
    place = lambda c: F.array_position("_names", F.lit(c.strip().lower()))
    return seen.select("path", "sheet", "row", *[F.when(place(c) > 0, F.get("cells", (place(c) - 1).cast("int"))).alias(c) for c in columns])


class SheetPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[SheetPartition]:
        store, at = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        return [SheetPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(".xlsx")] or [SheetPartition("")]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            data = f.read()
        for row in told(partition.path, data):
            yield row


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class SheetWriter(DataSourceArrowWriter):
    """Tasks write their files into a folder of this write; the commit moves those of the tasks that count, an abort removes all."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, name: str):
        self.path, self.header, self.overwrite, self.name = path, schema.names, overwrite, name
        self.own = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{at}/{self.own}", recursive=True)
        names, held = [], []

        def put(rows: list[tuple]) -> None:
            names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):03d}.xlsx")
            with store.open_output_stream(f"{at}/{self.own}/{names[-1]}") as f:
                f.write(sheet_file(self.header, rows, self.name))

        for batch in iterator:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= ROWS:
                put(held[:ROWS])
                held = held[ROWS:]
        if held:
            put(held)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{at}/{self.own}", recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        if not names:
            names = ["part-00000.xlsx"]
            with store.open_output_stream(f"{at}/{self.own}/{names[0]}") as f:
                f.write(sheet_file(self.header, [], self.name))
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(at)):
                if x.is_file and x.path.endswith(".xlsx"):
                    store.delete_file(x.path)
        for n in names:
            store.move(f"{at}/{self.own}/{n}", f"{at}/{n}")
        store.delete_dir(f"{at}/{self.own}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{at}/{self.own}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.own}")


class Sheets(DataSource):
    """spark.read.format("sheets").load(folder) and rows.write.format("sheets").option("sheet", name).save(folder), for stores that
    Arrow opens; read_sheets reads from any store that Spark does."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], schema, overwrite, self.options.get("sheet", "Sheet1"))


def write_sheets(rows: DataFrame, path: str, name: str = "Sheet1") -> None:
    """rows as spreadsheet files of at most ROWS rows below path, in place of those there, written by the tasks. Lists and structs are written as JSON,
    dates and times as text; a table without rows gives one file of its header."""
    rows.sparkSession.dataSource.register(Sheets)
    plain_kinds = ("string", "boolean", "byte", "short", "integer", "long", "float", "double")
    cell = lambda f: F.col(f.name) if f.dataType.typeName() in plain_kinds else F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")
    flat = rows.select(*[cell(f).alias(f.name) for f in rows.schema.fields])
    flat.write.format("sheets").mode("overwrite").option("sheet", name).save(path)
