"""Write results as CSV, JSON or markdown; every task writes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.functions import render
from lakescope.operators.sqlrun import Bounded


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts, each with a header; quotes only where needed, null is empty, ISO dates."""
    texts = df.select(*[render.plain(f).alias(f.name) for f in df.schema.fields])
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.options(**options).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_markdown(df: DataFrame, path: str) -> None:
    df.select(render.markdown_row(df).alias("value")).write.mode("overwrite").text(path)


def markdown_table(result: Bounded) -> str:
    """A bounded result as a markdown table with a footer when it was cut."""
    columns = result.rows.columns
    if not columns:
        return "_No results_"
    rows = [r[0] for r in result.rows.select(render.markdown_row(result.rows)).collect()]
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |", *rows]
    if result.truncated:
        lines += ["", f"_Showing {len(rows)} of {result.total} rows_"]
    return "\n".join(lines)


def csv_text(result: Bounded) -> str:
    header = result.rows.sparkSession.range(1).select(F.concat_ws(",", *[render.csv_field(F.lit(c)) for c in result.rows.columns])).first()[0]
    return "\n".join([header, *[r[0] for r in result.rows.select(render.csv_line(result.rows)).collect()]])


def json_document(result: Bounded) -> DataFrame:
    """One row ``json`` with columns, rows, rowCount and truncated of a bounded result."""
    body = F.from_json(render.json_row(result.rows), result.rows.schema)
    rows = F.coalesce(F.collect_list(body), F.array())
    doc = F.struct(
        F.array(*[F.lit(c) for c in result.rows.columns]).alias("columns"),
        F.col("rows"),
        F.lit(result.total).alias("rowCount"),
        F.lit(result.truncated).alias("truncated"),
    )
    return result.rows.agg(rows.alias("rows")).select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
