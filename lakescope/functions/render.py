"""Render rows as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(field: T.StructField) -> Column:
    """Text of a value: null is empty, dates and timestamps are ISO."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.date_format(col, "SSSSSS")
        text = F.when(frac == "000000", whole).otherwise(F.concat(whole, F.lit("."), frac))
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_field(plain(f)) for f in df.schema.fields])


def markdown_row(df: DataFrame) -> Column:
    cells = F.concat_ws(" | ", *[plain(f) for f in df.schema.fields])
    return F.concat(F.lit("| "), cells, F.lit(" |"))


def json_row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
