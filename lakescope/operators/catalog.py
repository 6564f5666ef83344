"""Catalog rows of a source and their maintenance, all as DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

COLUMN_SCHEMA = (
    "source_id string, table_name string, table_pos bigint, ordinal bigint, column_name string, "
    "dtype string, nullable boolean, comment string"
)
SAMPLES = 5


def column_rows(spark: SparkSession, source_id: str, tables: Mapping[str, DataFrame], first_pos: int = 0) -> DataFrame:
    """One row per column from the table schemas; comments come from field metadata."""
    rows = [
        (source_id, name, first_pos + pos, i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for pos, (name, df) in enumerate(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_counts(source_id: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row and column counts of all tables in one job."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(source_id).alias("source_id"),
                F.lit(name).alias("table_name"),
                F.lit(pos).cast("bigint").alias("table_pos"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
            )
            for pos, (name, df) in enumerate(tables.items())
        ]
    )


def _as_text(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    return F.to_json(col) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")


def sample_values(source_id: str, tables: Mapping[str, DataFrame], k: int = SAMPLES) -> DataFrame:
    """Up to k distinct non-null values per column: the smallest ones as text."""
    long = _union(
        [
            df.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(f.name).alias("column_name"), _as_text(f).alias("value"))
                            for f in df.schema.fields
                        ]
                    )
                )
            ).select(F.lit(name).alias("table_name"), "column_name", "value")
            for name, df in tables.items()
        ]
    )
    w = Window.partitionBy("table_name", "column_name").orderBy("value")
    # equal values are combined before the shuffle, then each task keeps its first k of a column
    values = long.filter("value is not null").groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)))
    few = values.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return (
        few.groupBy("table_name", "column_name")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
        .select(F.lit(source_id).alias("source_id"), "table_name", "column_name", "sample_values")
    )


def collect_schema(spark: SparkSession, source_id: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column rows with sample values and the row count of their table."""
    keys = ["source_id", "table_name"]
    return (
        column_rows(spark, source_id, tables)
        .join(row_counts(source_id, tables).select(*keys, "row_count", "column_count"), keys)
        .join(sample_values(source_id, tables), [*keys, "column_name"], "left")
        .withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    )


def list_tables(tables: DataFrame, source_id: str | None = None) -> DataFrame:
    return tables if source_id is None else tables.filter(F.col("source_id") == source_id)


def overview(tables: DataFrame, indexed: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """Totals per source: tables, rows, columns, tables per status, indexed tables.

    ``totals`` adds a row over all sources, without a source and with their number.
    """
    rows = tables
    if indexed is None:
        rows = rows.withColumn("_indexed", F.lit(0))
    else:
        mark = indexed.select("source_id", "table_name").distinct().withColumn("_hit", F.lit(1))
        rows = rows.join(mark, ["source_id", "table_name"], "left").withColumn("_indexed", F.coalesce("_hit", F.lit(0)))
    status = F.col("semantic_status")
    grouped = rows.rollup("source_id") if totals else rows.groupBy("source_id")
    return grouped.agg(
        *([F.when(F.grouping("source_id") == 1, F.count_distinct("source_id")).alias("source_count")] if totals else []),
        F.count(F.lit(1)).alias("table_count"),
        F.sum("row_count").alias("row_count"),
        F.sum("column_count").alias("column_count"),
        F.count_if(status == "not_initialized").alias("not_initialized"),
        F.count_if(status == "inferred").alias("inferred"),
        F.count_if(status == "confirmed").alias("confirmed"),
        F.sum("_indexed").alias("indexed_tables"),
    )


def describe(columns: DataFrame, profile: DataFrame | None = None, sample: DataFrame | None = None) -> DataFrame:
    """Column metadata joined with stored statistics and with a few rows of the table.

    ``sample``: the rows to show, such as ``sqlrun.sample_rows`` gives them, with ``place`` for
    their order; each column gets its values of these rows as ``sample_row_values`` (null: no value).
    """
    out = columns
    if profile is not None:
        stats = profile.select("table_name", "column_name", "distinct_count", "null_rate", "min_value", "max_value")
        out = out.join(stats, ["table_name", "column_name"], "left")
    if sample is not None:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in sample.columns if c != "place"])
        long = sample.select("place", F.inline(cells))
        shown = long.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sample_row_values"))
        out = out.join(shown, "column_name", "left")
    return out


def strip_secrets(config_json: Column) -> Column:
    """Drop the password of a stored source configuration."""
    config = F.from_json(config_json, "map<string,string>")
    return F.to_json(F.map_filter(config, lambda k, v: k != "password"))


def latest_wins(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Insert or replace by key: the row with the greatest version wins.

    Updates beat base rows of equal version. ``keep`` names columns that retain
    the stored value of an existing row (status survives a re-scan).
    """
    cols = base.columns
    body = F.struct(*[F.col(c) for c in cols])
    rows = base.select("*", F.lit(0).alias("_fresh")).unionByName(updates.select(*cols, F.lit(1).alias("_fresh")))
    # max_by is combined before the shuffle, so many versions of one key stay cheap
    order = F.struct(*[F.col(v) for v in version], F.col("_fresh"))
    stored = F.when(F.col("_fresh") == 0, body)
    merged = rows.groupBy(*keys).agg(F.max_by(body, order).alias("w"), F.max_by(stored, F.when(F.col("_fresh") == 0, order)).alias("s"))
    pick = [
        (F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"w.{c}")) if c in keep else F.col(f"w.{c}")).alias(c)
        for c in cols
    ]
    return merged.select(*pick)


def delete_rows(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti")


def joined_sha16(entries: DataFrame, by: Sequence[str], entry: str, alias: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 over a group's sorted entries joined by ``|``.

    The entries are sorted by the shuffle and streamed through the digest, so a
    group of any size needs constant memory.
    """
    spark = entries.sparkSession
    schema = T.StructType([*[entries.schema[k] for k in by], T.StructField(alias, T.StringType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.select(*by, F.col(entry).alias("_e")).repartition(parts, *by).sortWithinPartitions(*by, "_e")
    shape = to_arrow_schema(schema)

    def listed(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in shape]
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, texts = list(zip(*(batch[c].to_pylist() for c in by), strict=True)), batch["_e"].to_pylist()
            new = np.zeros(len(texts), dtype=bool)
            for c in by if len(texts) > 1 else ():
                now, last = batch[c][1:], batch[c][:-1]
                changed = pc.or_kleene(pc.not_equal(now, last), pc.not_equal(pc.is_null(now), pc.is_null(last)))
                new[1:] |= changed.fill_null(False).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new).tolist(), len(texts)] if texts else []
            done = []
            for start, end in zip(starts, starts[1:], strict=False):
                text = texts[start] if end - start == 1 else "|".join(texts[start:end])
                if keys[start] == key:
                    sha.update(f"|{text}".encode())
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()[:16]))
                    key, sha = keys[start], hashlib.sha256(text.encode())
            yield listed(done)
        if key is not None:
            yield listed([(*key, sha.hexdigest()[:16])])

    return rows.mapInArrow(digest, schema)


def bucketed_sha16(entries: DataFrame, by: Sequence[str], entry: str, alias: str) -> DataFrame:
    """First 16 hex digits of a SHA-256 over a group's entries, in two levels.

    Entries are dealt to 256 buckets by their own SHA-256, each bucket's sorted entries are
    digested, and the digests of the buckets, in order, are digested again; so no task holds
    a whole group. Equal sets of entries give equal values.
    """
    named = entries.select(*by, F.substring(F.sha2(F.col(entry), 256), 1, 2).alias("_b"), F.col(entry).alias("_entry"))
    parts = joined_sha16(named, [*by, "_b"], "_entry", "_h")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), "|")
    return parts.groupBy(*by).agg(F.substring(F.sha2(whole, 256), 1, 16).alias(alias))


def fingerprints(columns: DataFrame) -> DataFrame:
    """Schema hash per source over its ``table.column:type`` entries."""
    entry = F.concat("table_name", F.lit("."), "column_name", F.lit(":"), "dtype")
    return bucketed_sha16(columns.select("source_id", entry.alias("entry")), ["source_id"], "entry", "schema_hash")


def cross_fingerprint(columns: DataFrame) -> DataFrame:
    """One schema hash over all sources, each entry prefixed by its source."""
    entry = F.concat("source_id", F.lit("|"), "table_name", F.lit("."), "column_name", F.lit(":"), "dtype")
    rows = columns.select(F.lit("__cross__").alias("source_id"), entry.alias("entry"))
    return bucketed_sha16(rows, ["source_id"], "entry", "schema_hash")


def stale_sources(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources whose derived results need a refresh, with the reason.

    ``cached`` rows: ``source_id, schema_hash, dirty``. Keep one cache per kind
    of result (joins, domains), so that refreshing one does not hide the other.
    """
    old = cached.select("source_id", F.col("schema_hash").alias("_old"), "dirty")
    reason = (
        F.when(F.col("_old").isNull(), "not cached")
        .when(F.col("dirty") == 1, "dirty")
        .when(F.col("_old") != F.col("schema_hash"), "schema changed")
    )
    return (
        current.join(old, "source_id", "left")
        .select("source_id", "schema_hash", reason.alias("reason"))
        .filter("reason is not null")
    )


def resolve_tables(names: DataFrame, tables: DataFrame) -> DataFrame:
    """Source of each table name: the first match, with the number of matches."""
    hits = tables.groupBy("table_name").agg(
        F.min_by("source_id", F.struct("table_pos", "source_id")).alias("source_id"),
        F.count_distinct("source_id").alias("sources"),
    )
    return names.join(hits, "table_name", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
