"""Checks over a log of SQL texts: read-only verdict, tables used, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keywords a read-only statement must not contain, in checking order.
FORBIDDEN = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE",
    "REPLACE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL", "MERGE",
    "UPSERT", "LOAD", "COPY", "ATTACH", "DETACH", "PRAGMA", "SET", "VACUUM",
]

DATABASE_PREFIXES = ("mysql:", "postgresql:")
_BLANK = r"\s"


def _trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{_BLANK}+|{_BLANK}+$", "")


def _keyword(words: str) -> str:
    return rf"(?:^|;|{_BLANK})(?:{words})(?:{_BLANK}|\(|$)"


def verdict(sql: Column, literals_first: bool = False) -> Column:
    """Struct ``(safe, reason)`` of a statement.

    By default comments are removed before string literals. ``literals_first``
    blanks the literals first, so that ``'--'`` inside a string hides nothing.
    """
    text = _trim(sql)
    if literals_first:
        text = F.regexp_replace(F.regexp_replace(text, "'[^']*'", "''"), '"[^"]*"', '""')
    cleaned = _trim(F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"/\*[\s\S]*?\*/", ""))
    first = F.regexp_extract(F.upper(cleaned), r"^(\S+)", 1)
    bare = F.regexp_replace(F.regexp_replace(cleaned, "'[^']*'", "''"), '"[^"]*"', '""')
    upper = F.upper(bare)
    hit = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in FORBIDDEN:
        hit = hit.when(upper.rlike(_keyword(word)), F.lit(word))
    # one alternation decides for nearly all statements; the chain only names the word
    named = F.when(upper.rlike(_keyword("|".join(FORBIDDEN))), hit)
    statements = F.size(F.filter(F.split(bare, ";"), lambda s: _trim(s) != ""))
    reason = (
        F.when(sql.isNull() | (text == ""), F.lit("Empty SQL statement"))
        .when(cleaned == "", F.lit("Empty SQL after removing comments"))
        .when(~first.isin("SELECT", "WITH"), F.concat(F.lit("Only SELECT statements are allowed. Got: "), first))
        .when(named.isNotNull(), F.concat(F.lit("Forbidden keyword detected: "), named))
        .when(statements > 1, F.lit("Multiple statements are not allowed"))
    )
    return F.struct(reason.isNull().alias("safe"), reason.alias("reason"))


def safety(log: DataFrame, sql: str = "sql", literals_first: bool = False) -> DataFrame:
    """Add ``safe`` and ``reason`` to every statement of a log."""
    return log.withColumn("_v", verdict(F.col(sql), literals_first)).select("*", "_v.safe", "_v.reason").drop("_v")


def check(spark: SparkSession, sql: str, literals_first: bool = False) -> dict:
    """Verdict on a single statement."""
    one = spark.range(1).select(verdict(F.lit(sql), literals_first).alias("v"))
    row = one.select("v.safe", "v.reason").first()
    return {"safe": row["safe"], "reason": row["reason"]}


def tables_used(log: DataFrame, query_id: str = "query_id", sql: str = "sql") -> DataFrame:
    """Lower-cased names after FROM and JOIN, one row per mention."""
    names = F.regexp_extract_all(F.col(sql), F.lit(r'(?i)(?:FROM|JOIN)\s+[`"]?(\w+)[`"]?'), F.lit(1))
    return log.select(query_id, F.explode(names).alias("name")).select(query_id, F.lower("name").alias("table_name"))


def routing(log: DataFrame, tables: DataFrame, query_id: str = "query_id", sql: str = "sql") -> DataFrame:
    """The database source able to answer each query alone, else null.

    All mentioned tables must be known and belong to one database source.
    ``tables`` rows: ``source_id, table_name``; of equal names the greatest
    ``table_pos`` wins (registered last).
    """
    known = tables.groupBy(F.lower("table_name").alias("table_name")).agg(
        F.max_by("source_id", "table_pos").alias("source_id")
    )
    used = tables_used(log, query_id, sql).distinct()  # a text may repeat a name any number of times
    database = F.lit(False)
    for prefix in DATABASE_PREFIXES:
        database = database | F.col("source_id").startswith(prefix)
    found = used.join(known, "table_name", "left").groupBy(query_id).agg(
        F.bool_and(F.coalesce(database, F.lit(False))).alias("all_database"),
        F.min("source_id").alias("lo"),
        F.max("source_id").alias("hi"),
    )
    single = F.col("all_database") & (F.col("lo") == F.col("hi"))
    return log.select(query_id).join(found, query_id, "left").select(query_id, F.when(single, F.col("lo")).alias("source_id"))
