"""Sources and sinks, round-tripped over whole tables."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from lakescope.functions import render, text
from lakescope.operators import sqlrun
from lakescope.plans.registry import query, table
from lakescope.session import cut_lineage, scratch_path
from lakescope.sources import files, register, sinks


def _to_csv(df, path):
    df.write.csv(path, header=True, quoteAll=False, escape='"')
    return path


@query("csv_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_scan(spark, sf_dir):
    """Whole texts with quotes and line breaks, through the library's own sink and reader."""
    path = scratch_path(spark, "documents")
    sinks.write_csv(table(spark, sf_dir, "documents"), path)
    return files.read_csv(spark, path)


@query(
    "csv_dir_scan",
    """SELECT 'orders' AS table_name, count(*) AS n, sum(o_orderkey) AS keys FROM orders
    UNION ALL SELECT 'part_list', count(*), sum(p_partkey) FROM part
    UNION ALL SELECT 'supplier', count(*), sum(s_suppkey) FROM supplier""",
)
def csv_dir_scan(spark, sf_dir):
    folder = scratch_path(spark, "folder")
    for t, name in (("orders", "orders"), ("part", "part list"), ("supplier", "supplier")):
        _to_csv(table(spark, sf_dir, t), f"{folder}/{name}.csv")
    keys = {"orders": "o_orderkey", "part_list": "p_partkey", "supplier": "s_suppkey"}
    found = files.read_csv_folder(spark, folder)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.sum(keys[name]).alias("keys")).select(F.lit(name).alias("table_name"), "n", "keys")
        for name, df in found.items()
    ]
    return sqlrun.union_by_name(*parts)


# Minimal workbook parts (fixed values of the file format).
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(sheets: dict) -> bytes:
    """A small workbook: ``{sheet: rows}`` with rows of numbers and texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        heads, links = [], []
        for i, (name, rows) in enumerate(sheets.items(), 1):
            heads.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>')
            links.append(f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>')
            lines = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, str):
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
                    else:
                        cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{"".join(heads)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{"".join(links)}</Relationships>')
    return out.getvalue()


_BOOK_ROWS = 500


@query(
    "excel_scan",
    """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_mktsegment AS column_3, CAST(NULL AS VARCHAR) AS nothing,
      CAST(c_nationkey AS DOUBLE) AS key, c_acctbal AS key_2, 'notes_of_book' AS other_table FROM customer""",
)
def excel_scan(spark, sf_dir):
    """Customers as workbooks of up to 500 rows, read back as one typed table.

    One header cell is blank, one repeats, one column has no values; each book's second
    sheet has the same name and becomes a table of its own.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        names = ["c_custkey", "c_name", "c_mktsegment", None, "c_nationkey", "c_acctbal"]
        head = ["c_custkey", "c_name", None, "nothing", "key", "key"]
        held = [[None] * len(group) if n is None else group[n].tolist() for n in names]
        rows = [head, *map(list, zip(*held, strict=True))]
        path = f"book{group['book'].iloc[0]}.xlsx"
        return pd.DataFrame({"path": [path], "content": [workbook_bytes({"customers": rows, "notes": [["a"], ["b"]]})]})

    cust = table(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / _BOOK_ROWS))
    books = cut_lineage(cust.groupBy("book").applyInPandas(build, "path string, content binary"))  # files are read, not made again
    notes = files.workbook_tables(files.workbook_cells(books, ["notes"]))
    assert len(notes) == books.count() and all(n.startswith("book") and n.endswith("_notes") for n in notes)
    return files.sheet_table(files.workbook_cells(books, ["customers"]), "customers").withColumn("other_table", F.lit("notes_of_book"))


@query(
    "register_tables",
    """SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL""",
)
def register_tables(spark, sf_dir):
    register.register(
        {
            "parquet:a": {"customer list": table(spark, sf_dir, "customer")},
            "parquet:b": {"nation-codes": table(spark, sf_dir, "nation")},
        }
    )
    return sqlrun.run_sql(
        spark,
        'SELECT n.n_name, count(*) AS n FROM "customer_list" c JOIN nation_codes n ON c.c_nationkey = n.n_nationkey GROUP BY ALL',
    )


@query(
    "cross_source_join",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def cross_source_join(spark, sf_dir):
    path = _to_csv(table(spark, sf_dir, "customer"), scratch_path(spark, "customer"))
    from_csv = files.read_csv(spark, path, multi_line=False)
    joined = table(spark, sf_dir, "orders").join(from_csv, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("sample_rows", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def sample_rows(spark, sf_dir):
    return sqlrun.sample_rows(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), "p_partkey"])


_CELLS = """CASE WHEN regexp_matches({0}, '[,"\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(
    "sink_csv",
    f"""SELECT event_id, event_id || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END
      || ',' || coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN user_id END AS VARCHAR), '') || ','
      || {_CELLS.format("props")} AS csv_line FROM events""",
)
def sink_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("user_id"), "props"
    )
    path = scratch_path(spark, "csv")
    sinks.write_csv(rows, path)
    lines = spark.read.text(path).filter("value <> 'event_id,ts,user_id,props'")
    return lines.select(F.split("value", ",")[0].cast("bigint").alias("event_id"), F.col("value").alias("csv_line"))


@query(
    "sink_json",
    """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","quality":'
      || coalesce(CAST(quality AS VARCHAR), 'null') || '}' AS json_line FROM documents LEFT JOIN labels USING (doc_id)""",
)
def sink_json(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    path = scratch_path(spark, "json")
    sinks.write_json(rows, path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), F.col("value").alias("json_line"))


@query(
    "sink_markdown",
    """SELECT '| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ' | '
      || coalesce(nullif(o_orderstatus, 'P'), '') || ' |' AS markdown FROM orders""",
)
def sink_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")
    )
    return rows.select(render.markdown_row(rows).alias("markdown"))


_DEAREST = "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def _dearest(spark, sf_dir):
    """What a user sees of a long result: its first 100 rows and how many there are."""
    rows = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return sqlrun.bounded(rows.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")), 100)


@query(
    "sink_json_document",
    f"""WITH r AS ({_DEAREST} LIMIT 100), j AS (SELECT row_number() OVER () AS n, '{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
      || ',"status":' || coalesce('"' || status || '"', 'null') || '}}' AS line FROM r)
    SELECT '{{"columns":["o_orderkey","o_custkey","status"],"rows":[' || string_agg(line, ',' ORDER BY n) || '],"rowCount":'
      || (SELECT count(*) FROM orders) || ',"truncated":' || CASE WHEN (SELECT count(*) FROM orders) > 100 THEN 'true' ELSE 'false' END || '}}' AS json FROM j""",
)
def sink_json_document(spark, sf_dir):
    return sinks.json_document(_dearest(spark, sf_dir))


@query(
    "sink_markdown_table",
    f"""WITH r AS ({_DEAREST} LIMIT 100), j AS (SELECT row_number() OVER () AS n, '| ' || o_orderkey || ' | ' || o_custkey || ' | ' || coalesce(status, '') || ' |' AS line FROM r)
    SELECT '| o_orderkey | o_custkey | status |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n)
      || CASE WHEN (SELECT count(*) FROM orders) > 100 THEN chr(10) || chr(10) || '_Showing 100 of ' || (SELECT count(*) FROM orders) || ' rows_' ELSE '' END AS markdown FROM j""",
)
def sink_markdown_table(spark, sf_dir):
    """Written as a file and read back."""
    path = scratch_path(spark, "markdown")
    shown = sinks.markdown_table(_dearest(spark, sf_dir))
    spark.createDataFrame([(shown,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\\n$", "").alias("markdown"))


@query(
    "sanitize_name",
    """SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_一-鿿]', '_', 'g') AS name FROM pages""",
)
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"))
