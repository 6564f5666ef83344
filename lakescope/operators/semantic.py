"""The semantic layer: table definitions, their search text and their metrics.

Definitions are rows with nested columns, relations and metrics. Metric and join
suggestions are text columns; ``run_metric`` executes a metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.functions.text import sha16
from lakescope.operators.catalog import latest_wins, resolve_tables
from lakescope.session import cut_lineage

COLUMN = (
    "struct<name:string,semantic:string,role:string,unit:string,aggregation:string,references:string,"
    "enum_values:map<string,string>,granularity:array<string>,confirmed:boolean>"
)
RELATION = "struct<target_table:string,join_condition:string,relation_type:string,confirmed:boolean>"
METRIC = "struct<name:string,expression:string,group_by:string,filter:string>"

# Input records may use snake_case or camelCase names.
INPUT_SCHEMA = (
    "table_name string, tableName string, source_id string, sourceId string, description string, "
    "business_domain string, businessDomain string, tags array<string>, "
    "columns array<struct<name:string,semantic:string,role:string,unit:string,aggregation:string,references:string,"
    "enum_values:map<string,string>,enumValues:map<string,string>,granularity:array<string>,confirmed:boolean>>, "
    "relations array<struct<target_table:string,targetTable:string,join_condition:string,joinCondition:string,"
    "relation_type:string,relationType:string,confirmed:boolean>>, "
    "metrics array<struct<name:string,expression:string,group_by:string,groupBy:string,filter:string>>"
)
DEFAULT_RELATION = "one_to_many"
STATUS_INFERRED = "inferred"
KEY = ["source_id", "table_name"]


def _either(snake: Column, camel: Column) -> Column:
    """The snake_case value unless it is missing or empty."""
    return F.coalesce(F.when(snake != "", snake), camel)


def parse(records: DataFrame) -> DataFrame:
    """Normalise input records (``INPUT_SCHEMA``) to definitions."""
    columns = F.transform(
        "columns",
        lambda c: F.struct(
            F.coalesce(c["name"], F.lit("")).alias("name"),
            *[c[f].alias(f) for f in ("semantic", "role", "unit", "aggregation", "references")],
            F.coalesce(c["enum_values"], c["enumValues"]).alias("enum_values"),
            c["granularity"].alias("granularity"),
            F.coalesce(c["confirmed"], F.lit(False)).alias("confirmed"),
        ),
    )
    relations = F.transform(
        "relations",
        lambda r: F.struct(
            F.coalesce(_either(r["target_table"], r["targetTable"]), F.lit("")).alias("target_table"),
            F.coalesce(_either(r["join_condition"], r["joinCondition"]), F.lit("")).alias("join_condition"),
            F.coalesce(_either(r["relation_type"], r["relationType"]), F.lit(DEFAULT_RELATION)).alias("relation_type"),
            F.coalesce(r["confirmed"], F.lit(False)).alias("confirmed"),
        ),
    )
    metrics = F.transform(
        "metrics",
        lambda m: F.struct(
            F.coalesce(m["name"], F.lit("")).alias("name"),
            F.coalesce(m["expression"], F.lit("")).alias("expression"),
            _either(m["group_by"], m["groupBy"]).alias("group_by"),
            m["filter"].alias("filter"),
        ),
    )
    return records.select(
        _either(F.col("source_id"), F.col("sourceId")).alias("source_id"),
        _either(F.col("table_name"), F.col("tableName")).alias("table_name"),
        "description",
        _either(F.col("business_domain"), F.col("businessDomain")).alias("business_domain"),
        "tags",
        F.coalesce(columns, F.array().cast(f"array<{COLUMN}>")).alias("columns"),
        F.when(F.size(relations) > 0, relations).alias("relations"),
        F.when(F.size(metrics) > 0, metrics).alias("metrics"),
    )


def parse_json(df: DataFrame, body: str) -> DataFrame:
    """Definitions from a column of JSON records."""
    parsed = df.select(F.from_json(body, INPUT_SCHEMA).alias("j"))
    return parse(parsed.select("j.*"))


def load(spark, path: str) -> DataFrame:
    """Definitions from JSON files holding ``{"tables": [...]}``."""
    raw = spark.read.schema(f"tables array<struct<{_as_struct(INPUT_SCHEMA)}>>").json(path, multiLine=True)
    return parse(raw.select(F.inline("tables")))


def _as_struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def update(stored: DataFrame, incoming: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace definitions; returns (definitions, tables, report).

    A record without a source takes the first catalog table of that name. The
    catalog status of updated tables becomes ``inferred``; the report has one row
    per record.
    """
    # numbered once and stored, so that both uses below see the same numbers
    named = cut_lineage(incoming.withColumn("_no", F.monotonically_increasing_id()))
    missing = named.filter("source_id is null").select("_no", "table_name")
    found = resolve_tables(missing, tables).select("_no", F.col("source_id").alias("_found"))
    located = named.join(found, "_no", "left").withColumn("source_id", F.coalesce("source_id", "_found")).drop("_found")
    status = (
        F.when(F.col("table_name").isNull(), "error: table_name is required")
        .when(
            F.col("source_id").isNull(),
            F.concat(F.lit('error: table "'), F.col("table_name"), F.lit('" not found in any connected source')),
        )
        .otherwise("updated")
    )
    judged = located.withColumn("status", status)
    good = judged.filter("status = 'updated'")
    # of several records for one table the last one stays
    fresh = latest_wins(good.drop("status").limit(0), good.drop("status"), KEY, ["_no"]).drop("_no")
    versioned = stored.withColumn("_v", F.lit(0))
    definitions = latest_wins(versioned, fresh.withColumn("_v", F.lit(1)), KEY, ["_v"]).drop("_v")
    touched = fresh.select(*KEY).withColumn("_hit", F.lit(True))
    marked = tables.join(touched, KEY, "left").withColumn(
        "semantic_status", F.when(F.col("_hit"), STATUS_INFERRED).otherwise(F.col("semantic_status"))
    )
    report = judged.select(F.coalesce("table_name", F.lit("unknown")).alias("table_name"), "status")
    return definitions, marked.drop("_hit"), report


def export(columns: DataFrame, tables: DataFrame, foreign_keys: DataFrame | None = None, source_id: str | None = None) -> DataFrame:
    """One row per table with nested columns (in order) and foreign keys."""
    if source_id is not None:
        columns, tables = columns.filter(F.col("source_id") == source_id), tables.filter(F.col("source_id") == source_id)
    fields = [c for c in ("column_name", "dtype", "nullable", "comment", "sample_values") if c in columns.columns]
    nested = columns.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("columns"))
    out = tables.join(nested, KEY, "left")
    if foreign_keys is not None:
        keys = foreign_keys.groupBy(*KEY).agg(
            F.array_sort(F.collect_list(F.struct("column_name", "references"))).alias("foreign_keys")
        )
        out = out.join(keys, KEY, "left")
    return out


def searchable_text(definitions: DataFrame) -> Column:
    """Everything worth finding in a definition; blank parts are dropped."""
    empty = F.array().cast("array<string>")
    per_column = F.transform(
        "columns",
        lambda c: F.concat(
            F.array(c["name"], c["semantic"], c["unit"]), F.coalesce(F.map_values(c["enum_values"]), empty)
        ),
    )
    parts = F.concat(
        F.array("table_name", "description"),
        F.coalesce("tags", empty),
        F.array("business_domain"),
        F.coalesce(F.flatten(per_column), empty),
        F.coalesce(F.transform("metrics", lambda m: m["name"]), empty),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & p.rlike(r"\S")), " ")


def build_index(definitions: DataFrame) -> DataFrame:
    return definitions.select(*KEY, searchable_text(definitions).alias("searchable_text"))


def maintain_index(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Upsert the text of changed definitions and drop removed tables."""
    merged = latest_wins(
        index.withColumn("_v", F.lit(0)), build_index(changed).withColumn("_v", F.lit(1)), KEY, ["_v"]
    ).drop("_v")
    return merged if removed is None else merged.join(removed.select(*KEY), KEY, "left_anti")


def stale_embeddings(index: DataFrame, stored: DataFrame, model_id: str) -> DataFrame:
    """Index rows to embed again: none stored, text changed, or another model."""
    held = stored.select(*KEY, F.col("content_hash").alias("_hash"), F.col("model_id").alias("_model"))
    reason = (
        F.when(F.col("_hash").isNull(), "missing")
        .when(F.col("_hash") != F.col("content_hash"), "text changed")
        .when(F.col("_model") != model_id, "model changed")
    )
    return (
        index.select(*KEY, sha16(F.col("searchable_text")).alias("content_hash"))
        .join(held, KEY, "left")
        .select(*KEY, "content_hash", reason.alias("reason"))
        .filter("reason is not null")
    )


def suggest_joins(definitions: DataFrame) -> DataFrame:
    """Join clauses from the relations of each definition."""
    clause = lambda r: F.concat(F.lit("JOIN "), r["target_table"], F.lit(" ON "), r["join_condition"])
    return definitions.withColumn(
        "suggested_joins", F.coalesce(F.transform("relations", clause), F.array().cast("array<string>"))
    )


def suggest_metric_sql(definitions: DataFrame, apply_filter: bool = True) -> DataFrame:
    """One runnable statement per metric.

    ``apply_filter=False`` leaves the metric's filter out of the statement.
    """
    rows = definitions.select(*KEY, F.explode("metrics").alias("m"))
    grouped = F.coalesce(F.col("m.group_by"), F.lit("")) != ""
    filtered = F.lit(apply_filter) & (F.coalesce(F.col("m.filter"), F.lit("")) != "")
    alias = F.when(F.col("m.name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("m.name")).otherwise(
        F.concat(F.lit('"'), F.col("m.name"), F.lit('"'))
    )
    sql = F.concat(
        F.lit("SELECT "),
        F.when(grouped, F.concat("m.group_by", F.lit(", "))).otherwise(""),
        F.col("m.expression"), F.lit(" AS "), alias, F.lit(" FROM "), F.col("table_name"),
        F.when(filtered, F.concat(F.lit(" WHERE "), "m.filter")).otherwise(""),
        F.when(grouped, F.concat(F.lit(" GROUP BY "), "m.group_by")).otherwise(""),
    )
    return rows.select(*KEY, F.col("m.name").alias("name"), sql.alias("sql"))


def run_metric(df: DataFrame, name: str, expression: str, group_by: str | None = None, where: str | None = None) -> DataFrame:
    """Execute a metric on its table."""
    rows = df.filter(F.expr(where)) if where else df
    value = F.expr(expression).alias(name)
    return rows.groupBy(F.expr(group_by).alias("group_key")).agg(value) if group_by else rows.agg(value)
