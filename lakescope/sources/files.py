"""CSV files and folders, and folders of Excel workbooks."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.session import cut_lineage
from lakescope.sources import records

DELIMITERS = [",", "\t", ";", "|"]
SNIFF_LINES = 50
TYPED = re.compile(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$|^\d{4}-\d{2}-\d{2}|^(true|false)$", re.IGNORECASE)


def table_name(path: str) -> str:
    """Sanitised base name of a file."""
    stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]
    return re.sub(r"[^a-zA-Z0-9_一-鿿]", "_", stem)


def whole_records(lines: list[str]) -> list[str]:
    """The lines up to the last one at which no quote is open."""
    quotes, end = 0, 0
    for i, line in enumerate(lines, 1):
        quotes += line.count('"')
        if quotes % 2 == 0:
            end = i
    return lines[:end]


def sniff(lines: list[str]) -> tuple[str | None, bool | None]:
    """Delimiter and presence of a header from whole records; None where they do not decide.

    A first record with an empty or typed cell is no header. Otherwise it is one if some
    column below it holds typed cells only.
    """
    found = []
    for d in DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d) if r]
        if rows and len({len(r) for r in rows}) == 1:
            found.append((len(rows[0]), d, rows))
    if not found:
        return None, None
    _, best, rows = max(found, key=lambda f: f[0])
    first, body = [c.strip() for c in rows[0]], [r for r in rows[1:] if r != rows[0]]  # each part may repeat the header
    if not all(first) or any(TYPED.match(c) for c in first):
        return best, False
    typed = any(all(TYPED.match(r[c].strip()) for r in body if r[c].strip()) and any(r[c].strip() for r in body) for c in range(len(first)))
    return best, True if typed else None


def _decide(spark: SparkSession, path: str, delimiter: str | None, header: bool | None) -> tuple[str, bool]:
    count = SNIFF_LINES
    while True:
        head = [r[0] for r in spark.read.text(path).limit(count).collect()]
        seen = sniff(whole_records(head))
        if None not in seen or len(head) < count or count > 100 * SNIFF_LINES:
            break
        count *= 10  # the first records are longer than what was read, or leave a doubt
    delimiter, header = delimiter or seen[0], seen[1] if header is None else header
    if delimiter is None or header is None:
        missing = "delimiter" if delimiter is None else "header"
        raise ValueError(f"{path}: its first records do not tell the {missing}; give {missing}=")
    return delimiter, header


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sampling: float = 1.0,
    multi_line: bool = True,
    delimiter: str | None = None,
    header: bool | None = None,
) -> DataFrame:
    """One CSV file (or a folder of parts of one table) as a typed frame.

    ``delimiter`` and ``header`` are read off the first records where they are not given;
    if those leave a doubt, an error asks for them. Without a schema the types are inferred
    from ``sampling`` of the rows, then the read uses them explicitly; give a schema or a
    small ratio at scale. Files are read in splits by many tasks; line breaks inside quotes are
    accepted (``records``). ``multi_line=False`` leaves out the step that looks for them.
    """
    if delimiter is None or header is None:
        delimiter, header = _decide(spark, path, delimiter, header)

    def reader(**options):
        return spark.read.options(sep=delimiter, quote='"', escape='"', **options)

    if not multi_line:
        if schema is None:
            schema = reader(header=header, inferSchema=True, samplingRatio=sampling).csv(path).schema
        return reader(header=header).schema(schema).csv(path)
    found = records.records(spark, path, delimiter)
    body = found.filter("NOT first") if header else found
    if schema is None:
        # every file begins with a header if one does; its names are those Spark gives
        heads = found.filter("first").limit(1) if header else None
        typed = records.parse(reader(inferSchema=True, samplingRatio=sampling), body).schema
        if header:
            row = heads.first()
            names = records.parse(reader(header=True), spark.createDataFrame([(row["record"],)], "record string")).columns if row else []
            body_fields = {f.name: f.dataType for f in typed}
            schema = T.StructType([T.StructField(n, body_fields.get(f"_c{i}", T.StringType())) for i, n in enumerate(names)])
        else:
            schema = typed
    if not schema:
        return spark.createDataFrame([], T.StructType([]))
    return records.parse(reader().schema(schema), body)


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Entries directly in a folder with the suffix, through the Hadoop file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in status if s.getPath().getName().endswith(suffix))


def _once(tables: dict, name: str, origin: str) -> str:
    if name in tables:
        raise ValueError(f'table "{name}" of {origin} is already read from another file')
    return name


def read_csv_folder(spark: SparkSession, folder: str, sampling: float = 1.0, **options) -> dict[str, DataFrame]:
    """Every ``*.csv`` directly in a folder as a table of its own; equal table names are an error."""
    out: dict[str, DataFrame] = {}
    for path in list_files(spark, folder):
        out[_once(out, table_name(path), path)] = read_csv(spark, path, sampling=sampling, **options)
    return out


# --- workbooks ---------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELL_ROWS = "path string, sheet string, row bigint, cells array<struct<col:int,kind:string,value:string>>"
CELL_NAMES = ["path", "sheet", "row", "cells"]
# Built-in number formats that show dates.
DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))
EPOCH = datetime(1899, 12, 30)
EMIT_ROWS = 10_000


def _column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iterfind(".//m:numFmts/m:numFmt", _NS)
        if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    formats = root.iterfind(".//m:cellXfs/m:xf", _NS)
    return {i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in DATE_FORMATS | custom}


def workbook_rows(path: str, content: bytes, sheets: list[str] | None) -> Iterator[tuple]:
    """Stream the cells of one workbook row by row: ``(path, sheet, row, cells)``."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.iterfind("m:si", _NS)]
        dates = _date_styles(book)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)
        for sheet in listed:
            name = sheet.get("name")
            if sheets and name not in sheets:
                continue
            part = rels[sheet.get(_REL)].lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            with book.open(part) as stream:
                for _, el in ElementTree.iterparse(stream):
                    if el.tag != f"{{{_NS['m']}}}row":
                        continue
                    yield path, name, int(el.get("r", 0)), [c for c in (_cell(x, shared, dates) for x in el) if c]
                    el.clear()


def _cell(el, shared: list[str], dates: set[int]) -> dict | None:
    kind, raw = el.get("t", "n"), el.findtext("m:v", None, _NS)
    if kind == "inlineStr":
        kind, raw = "s_", "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))
    elif kind == "s" and raw is not None:
        kind, raw = "s_", shared[int(raw)]
    if raw is None:
        return None
    col = _column_index(el.get("r", ""))
    if kind == "b":
        return {"col": col, "kind": "boolean", "value": "true" if raw == "1" else "false"}
    if kind == "n":
        if int(el.get("s", 0)) in dates:
            stamp = EPOCH + timedelta(seconds=round(float(raw) * 86_400))
            return {"col": col, "kind": "timestamp", "value": stamp.isoformat(sep=" ")}
        return {"col": col, "kind": "double", "value": raw}
    return {"col": col, "kind": "string", "value": raw}


def workbook_cells(books: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """Cells of many workbooks; ``books`` rows: ``path, content``. One task per book."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                block = []
                for row in workbook_rows(path, content, sheets):
                    block.append(row)
                    if len(block) == EMIT_ROWS:
                        yield pd.DataFrame(block, columns=CELL_NAMES)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=CELL_NAMES)

    return books.select("path", "content").mapInPandas(parse, CELL_ROWS)


def sheet_table(cells: DataFrame, sheet: str, path: str | None = None) -> DataFrame:
    """One typed table from a sheet of one workbook, or of all workbooks that hold it.

    The first row of each workbook names the columns: an empty name becomes
    ``column_<place>``, a repeated one gets its number behind it, and columns without any
    value stay. A column is typed when all its cells agree, otherwise it is text.
    """
    rows = cells.filter(F.col("sheet") == sheet)
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    columns = _sheet_columns(rows.select("path", F.lit("").alias("table"), "row", "cells"))
    kinds = columns.groupBy("name").agg(F.min("col").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _typed(rows, columns, kinds.orderBy("at", "name").collect())


def _bodies(rows: DataFrame) -> DataFrame:
    """Rows with the number of the first row of their sheet in ``first``."""
    firsts = rows.groupBy("path", "table").agg(F.min("row").alias("first"))
    return rows.join(firsts, ["path", "table"])


def _sheet_columns(rows: DataFrame) -> DataFrame:
    """``path, table, col, lo, hi, name`` of (path, table, row, cells): name, least and greatest kind of every column."""
    placed = _bodies(rows)
    keys = ["path", "table"]
    header = placed.filter("row = first").select(*keys, F.inline("cells")).select(*keys, "col", F.trim("value").alias("name"))
    body = placed.filter("row > first").select(*keys, "row", F.inline("cells"))
    # one row per column and workbook: bounded by the width of a sheet
    columns = body.groupBy(*keys, "col").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).join(header, [*keys, "col"], "full")
    name = F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("column_"), (F.col("col") + 1).cast("string"))).otherwise(F.col("name"))
    nth = F.row_number().over(Window.partitionBy(*keys, name).orderBy("col"))
    return columns.select(*keys, "col", "lo", "hi", F.when(nth == 1, name).otherwise(F.concat(name, F.lit("_"), nth.cast("string"))).alias("name"))


def _typed(rows: DataFrame, columns: DataFrame, kinds: list) -> DataFrame:
    """The rows below the first one, with the columns of ``kinds`` (name, lo, hi)."""
    body = _bodies(rows.withColumn("table", F.lit(""))).filter("row > first").select("path", "row", F.inline("cells"))
    plan = [(r["name"], r["lo"] if r["lo"] == r["hi"] and r["lo"] else "string") for r in kinds]
    values = F.map_from_entries(F.collect_list(F.struct("name", "value")))
    wide = body.join(columns.select("path", "col", "name"), ["path", "col"]).groupBy("path", "row").agg(values.alias("v"))
    return wide.select(*[F.col("v")[name].cast(kind).alias(name) for name, kind in plan])


def read_workbooks(spark: SparkSession, folder: str, sheets: list[str] | None = None) -> Mapping[str, DataFrame]:
    """Every sheet of every workbook directly in a folder as a table ``<file>_<sheet>``."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    return workbook_tables(workbook_cells(books, sheets))


def workbook_tables(cells: DataFrame) -> Mapping[str, DataFrame]:
    """A table per workbook and sheet of ``cells``; equal table names are an error."""
    # the columns of all sheets at once; a table is planned from them without a job of its own
    cells = cut_lineage(cells)
    columns = cut_lineage(_sheet_columns(cells.select("path", F.col("sheet").alias("table"), "row", "cells")))
    kinds: dict[tuple, list] = {(r["path"], r["sheet"]): [] for r in cells.select("path", "sheet").distinct().orderBy("path", "sheet").collect()}
    for r in columns.orderBy("path", "table", "col", "name").collect():
        kinds[r["path"], r["table"]].append(r)
    places: dict[str, tuple[str, str]] = {}
    for path, sheet in kinds:
        name = table_name(f"{posixpath.splitext(posixpath.basename(path))[0]}_{sheet}.")
        places[_once(places, name, path)] = path, sheet
    return _Sheets(cells, columns, kinds, places)


class _Sheets(Mapping):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, cells: DataFrame, columns: DataFrame, kinds: dict[tuple, list], places: dict[str, tuple[str, str]]):
        self._cells, self._columns, self._kinds, self._places = cells, columns, kinds, places
        self._planned: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            path, sheet = self._places[name]
            rows = self._cells.filter((F.col("path") == path) & (F.col("sheet") == sheet))
            columns = self._columns.filter((F.col("path") == path) & (F.col("table") == sheet))
            self._planned[name] = _typed(rows, columns, self._kinds[path, sheet])
        return self._planned[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._places)

    def __len__(self) -> int:
        return len(self._places)
