"""MySQL and PostgreSQL through Spark's JDBC source.

The drivers come with the cluster (``spark.jars``). Credentials are passed on
each call and never stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = {"mysql": 3306, "postgresql": 5432}
DEFAULT_SCHEMA = "public"
FETCH_ROWS = 10_000


def url(kind: str, host: str, database: str, port: int | None = None) -> str:
    if kind not in PORTS:
        raise ValueError(f"Unsupported source type: {kind}")
    return f"jdbc:{kind}://{host}:{port or PORTS[kind]}/{database}"


def source_id(kind: str, database: str) -> str:
    return f"{kind}:{database}"


def options(jdbc_url: str, username: str | None = None, password: str | None = None, **more: str) -> dict[str, str]:
    out = {"url": jdbc_url, "fetchsize": str(FETCH_ROWS), **more}
    if username is not None:
        out["user"] = username
    if password is not None:
        out["password"] = password
    return out


def qualified(table: str, schema: str | None = None) -> str:
    return f"{schema}.{table}" if schema else table


def read_table(
    spark: SparkSession,
    opts: dict[str, str],
    table: str,
    schema: str | None = None,
    partition_column: str | None = None,
    partitions: int = 64,
    bounds: tuple | None = None,
) -> DataFrame:
    """A table; filters and columns are pushed to the database.

    With ``partition_column`` the read is split into ``partitions`` ranges; the
    bounds come from the database unless given.
    """
    name = qualified(table, schema)
    reader = spark.read.format("jdbc").options(**opts)
    if partition_column is None:
        return reader.option("dbtable", name).load()
    if bounds is None:
        ask = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {name}"
        row = query(spark, opts, ask).first()
        bounds = (row[0], row[1])
    if bounds[0] is None:
        return reader.option("dbtable", name).load()
    return (
        reader.option("dbtable", name)
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(bounds[0]))
        .option("upperBound", str(bounds[1]))
        .option("numPartitions", str(partitions))
        .load()
    )


def query(spark: SparkSession, opts: dict[str, str], sql: str) -> DataFrame:
    """Run a whole statement in the database and read its result."""
    return spark.read.format("jdbc").options(**opts).option("query", sql.strip().rstrip(";")).load()


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def tables_sql(kind: str, schema: str) -> str:
    return (
        "SELECT table_name FROM information_schema.tables "
        f"WHERE table_schema = {_quoted(schema)} AND table_type = 'BASE TABLE'"
    )


def columns_sql(kind: str, schema: str) -> str:
    """Columns with type, nullability and comment of all tables of a schema."""
    head = (
        "SELECT c.table_name AS table_name, c.column_name AS column_name, c.data_type AS dtype, "
        "c.is_nullable AS is_nullable, c.ordinal_position AS ordinal, "
    )
    where = f"WHERE c.table_schema = {_quoted(schema)}"
    if kind == "mysql":
        return f"{head}c.column_comment AS column_comment FROM information_schema.columns c {where}"
    return (
        f"{head}d.description AS column_comment FROM information_schema.columns c "
        "LEFT JOIN pg_catalog.pg_namespace n ON n.nspname = c.table_schema "
        "LEFT JOIN pg_catalog.pg_class t ON t.relnamespace = n.oid AND t.relname = c.table_name "
        f"LEFT JOIN pg_catalog.pg_description d ON d.objoid = t.oid AND d.objsubid = c.ordinal_position {where}"
    )


def foreign_keys_sql(kind: str, schema: str) -> str:
    """Declared foreign keys of all tables of a schema."""
    if kind == "mysql":
        return (
            "SELECT table_name, column_name, referenced_table_name AS ref_table, referenced_column_name AS ref_column "
            f"FROM information_schema.key_column_usage WHERE table_schema = {_quoted(schema)} "
            "AND referenced_table_name IS NOT NULL"
        )
    return (
        "SELECT k.table_name AS table_name, k.column_name AS column_name, "
        "u.table_name AS ref_table, u.column_name AS ref_column "
        "FROM information_schema.referential_constraints r "
        "JOIN information_schema.key_column_usage k "
        "ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name "
        "JOIN information_schema.key_column_usage u "
        "ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name "
        "AND u.ordinal_position = k.position_in_unique_constraint "
        f"WHERE k.table_schema = {_quoted(schema)}"
    )


def column_rows(spark: SparkSession, opts: dict[str, str], kind: str, source: str, schema: str) -> DataFrame:
    """Catalog rows of all columns of a schema."""
    raw = query(spark, opts, columns_sql(kind, schema))
    low = raw.toDF(*[c.lower() for c in raw.columns])
    return low.select(
        F.lit(source).alias("source_id"),
        "table_name",
        (F.col("ordinal") - 1).cast("bigint").alias("ordinal"),
        "column_name",
        "dtype",
        (F.upper("is_nullable") == "YES").alias("nullable"),
        F.when(F.col("column_comment") != "", F.col("column_comment")).alias("comment"),
    )


def foreign_keys(spark: SparkSession, opts: dict[str, str], kind: str, source: str, schema: str) -> DataFrame:
    """Declared keys as ``source_id, table_name, column_name, references``."""
    raw = query(spark, opts, foreign_keys_sql(kind, schema))
    low = raw.toDF(*[c.lower() for c in raw.columns])
    return low.select(
        F.lit(source).alias("source_id"),
        "table_name",
        "column_name",
        F.concat("ref_table", F.lit("."), "ref_column").alias("references"),
    )
