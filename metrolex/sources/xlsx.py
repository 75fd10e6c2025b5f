"""Workbooks as a Spark data source, format `xlsx`: every partition writes a workbook of its own, and reads come back one file a task.

A task writes below `_temporary/<job>`; when all are done the driver moves the files they named into the folder and
sets `_SUCCESS`. A task that fails or runs twice leaves nothing but files in that folder, which goes with the job. Modes `append` and `overwrite`.

A workbook has a header and up to 1,048,576 rows a sheet; more go to further sheets of it. Values: whole numbers beyond 2^53 and
decimals of over 15 digits are text, so that no digit is lost; times are UTC, as serial days from March 1900 to 2078 and ISO text outside;
NaN and infinities are text; null is an empty cell. Characters that XML lacks are written as _xHHHH_. Strings of over 32,767 UTF-16 units, nested
and binary columns don't fit the format and are errors.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 1 << 20, 1 << 14, 32767
_FLAT = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)
_DAY0 = dt.datetime(1899, 12, 30)
_FIRST, _LAST = dt.date(1900, 3, 1), dt.date(2078, 1, 1)
_ODD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODE = re.compile("_x([0-9A-Fa-f]{4})_")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Cell styles: plain, day, day and time.
_STYLES = f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def column_name(i: int) -> str:
    """A, B, ... Z, AA, ... of the column with index i."""
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(cell: str) -> int:
    """Index of the column of a cell such as AB12."""
    out = 0
    for c in cell:
        if not c.isalpha():
            break
        out = out * 26 + ord(c) - 64
    return out - 1


def written(s: str) -> str:
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", s))


def read_text(s: str) -> str:
    return _CODE.sub(lambda m: chr(int(m[1], 16)), s)


def _text(at: str, s: str) -> str:
    if len(s) > MOST_CHARS or len(s.encode("utf-16-le", "surrogatepass")) > 2 * MOST_CHARS:
        raise ValueError(f"a cell holds at most {MOST_CHARS} characters, {at} has {len(s)}")
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{written(s)}</t></is></c>'


def cell(at: str, v) -> str:
    """XML of a cell; none for null."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int):
        return f'<c r="{at}"><v>{v}</v></c>' if abs(v) <= 1 << 53 else _text(at, str(v))
    if isinstance(v, float):
        return f'<c r="{at}"><v>{v!r}</v></c>' if math.isfinite(v) else _text(at, "NaN" if v != v else "Infinity" if v > 0 else "-Infinity")
    if isinstance(v, decimal.Decimal):
        return f'<c r="{at}"><v>{v:f}</v></c>' if len(v.as_tuple().digits) <= 15 and abs(v.as_tuple().exponent) <= 15 else _text(at, f"{v:f}")
    if isinstance(v, dt.datetime):
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        if not _FIRST <= v.date() < _LAST:
            return _text(at, v.isoformat())
        d = v - _DAY0
        return f'<c r="{at}" s="2"><v>{d.days + (d.seconds * 10**6 + d.microseconds) / 864e8!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c r="{at}" s="1"><v>{(v - _DAY0.date()).days}</v></c>' if _FIRST <= v < _LAST else _text(at, v.isoformat())
    return _text(at, v)


def write_workbook(out, names: list[str], batches: Iterator[pa.RecordBatch], most_rows: int = MOST_ROWS) -> int:
    """Writes a workbook of the batches to a binary stream and tells its rows; only a batch is held."""
    letters = [column_name(i) for i in range(len(names))]
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    n, sheets, held = 0, 0, next(rows, None)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        while held is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{"".join(_text(f"{c}1", x) for c, x in zip(letters, names))}</row>'.encode())
                at = 2
                while held is not None and at <= most_rows:
                    sheet.write(f'<row r="{at}">{"".join(cell(f"{c}{at}", v) for c, v in zip(letters, held))}</row>'.encode())
                    at, n, held = at + 1, n + 1, next(rows, None)
                sheet.write(b"</sheetData></worksheet>")
        each = range(1, sheets + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{"".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each)}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{"".join(f'<sheet name="rows {i}" sheetId="{i}" r:id="rId{i}"/>' for i in each)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each)}<Relationship Id="rId{sheets + 1}" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
    return n


def read_workbook(stream) -> Iterator[dict[str, tuple[str, str]]]:
    """Rows of all sheets as name -> (kind of cell, text), named by each sheet's header; empty cells are missing."""
    tag = lambda x: f"{{{_MAIN}}}{x}"
    with zipfile.ZipFile(stream) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for _, si in ET.iterparse(f) if si.tag == tag("si")]
        for name in sorted((x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0])):
            header: dict[int, str] | None = None
            with z.open(name) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != tag("row"):
                        continue
                    cells = {}
                    for i, c in enumerate(row):
                        kind, v = c.get("t", "n"), c.find(tag("v"))
                        text = read_text("".join(t.text or "" for t in c.iter(tag("t")))) if kind == "inlineStr" else v.text if v is not None else None
                        if text is not None:
                            cells[column_index(c.get("r")) if c.get("r") else i] = ("s", read_text(shared[int(text)])) if kind == "s" else (kind, text)
                    row.clear()
                    if header is None:
                        header = {i: t for i, (_, t) in cells.items()}
                    else:
                        yield {header[i]: x for i, x in cells.items() if i in header}


def value(found: tuple[str, str] | None, kind: T.DataType):
    """A cell as a value of a Spark type."""
    if found is None:
        return None
    how, text = found
    if isinstance(kind, T.StringType):
        return text if how != "b" else ("true" if text == "1" else "false")
    if isinstance(kind, T.BooleanType):
        return text.lower() in ("1", "true")
    if isinstance(kind, T.IntegralType):
        return int(text) if re.fullmatch(r"-?\d+", text) else int(float(text))
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(text)
    if isinstance(kind, T.FractionalType):
        return float(text)
    if how == "n":
        days = float(text)
        at = _DAY0 + dt.timedelta(days=math.floor(days), microseconds=round((days - math.floor(days)) * 864e8))
    else:
        at = dt.datetime.fromisoformat(text)
    return at.date() if isinstance(kind, T.DateType) else at if isinstance(kind, T.TimestampNTZType) else at.replace(tzinfo=dt.timezone.utc)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class XlsxWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, overwrite: bool, most_rows: int):
        odd = [f.name for f in schema if not isinstance(f.dataType, _FLAT)]
        if odd:
            raise ValueError(f"xlsx has no cells for {', '.join(odd)}")
        if len(schema) > MOST_COLUMNS:
            raise ValueError(f"xlsx has at most {MOST_COLUMNS} columns")
        self.path, self.overwrite, self.names, self.most_rows, self.job = path, overwrite, schema.names, most_rows, uuid.uuid4().hex
        files, root = self._at()
        files.create_dir(f"{root}/_temporary/{self.job}")  # by the driver alone: a task that outlives the job finds it gone

    def _at(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        first = next((b for b in iterator if b.num_rows), None)
        if first is None and part:
            return Written(None, 0)

        def batches():
            if first is not None:
                yield first
            yield from iterator

        files, root = self._at()
        file = f"part-{part:05d}-{uuid.uuid4().hex}.xlsx"
        with files.open_output_stream(f"{root}/_temporary/{self.job}/{file}") as out:
            return Written(file, write_workbook(out, self.names, batches(), self.most_rows))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._at()
        files.create_dir(root)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(root)):
                if x.base_name != "_temporary":
                    files.delete_dir(x.path) if x.type == fs.FileType.Directory else files.delete_file(x.path)
        named = [m.file for m in messages if m is not None and m.file is not None]
        if any(m is not None and m.rows for m in messages):
            named = [m.file for m in messages if m is not None and m.file is not None and m.rows]  # the empty first partition has nothing to say
        for file in named:
            files.move(f"{root}/_temporary/{self.job}/{file}", f"{root}/{file}")
        self.abort(messages)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        files, root = self._at()
        for folder in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            for left in (3, 2, 1, 0):  # tasks may still be writing
                try:
                    info = files.get_file_info(folder)
                    if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not files.get_file_info(fs.FileSelector(folder))):
                        files.delete_dir(folder)
                    break
                except OSError:
                    if not left:
                        raise
                    time.sleep(0.2)


@dataclass
class Workbook(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self) -> list[Workbook]:
        return [Workbook(p) for p in workbooks(self.path)]

    def read(self, partition: Workbook) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.path) as stream:
            for row in read_workbook(stream):
                yield tuple(value(row.get(f.name), f.dataType) for f in self.schema)


def workbooks(path: str) -> list[str]:
    """The workbooks of a folder, or the one file."""
    files, root = fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [root]
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name.endswith(".xlsx") and x.base_name[0] not in "_.")


class XlsxDataSource(DataSource):
    """spark.read and df.write in format `xlsx`; option most_rows: rows of a sheet."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        """Without a given schema all columns of the first workbook's first sheet are text."""
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        found = workbooks(self.options["path"])
        if not found:
            raise ValueError(f"no workbook in {self.options['path']}")
        with files.open_input_file(found[0]) as stream, zipfile.ZipFile(stream) as z, z.open("xl/worksheets/sheet1.xml") as f:
            row = next(x for _, x in ET.iterparse(f) if x.tag == f"{{{_MAIN}}}row")
            return T.StructType([T.StructField(read_text("".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))), T.StringType()) for c in row])

    def writer(self, schema: T.StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, self.options["path"], overwrite, int(self.options.get("most_rows", MOST_ROWS)))

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(schema, self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)
