"""Catalog jobs: schemas with counts and samples, maintenance, fingerprints."""

from pyspark.sql import functions as F

from lakescope.operators import catalog, profile, sqlrun
from lakescope.plans.lake import ENTITY_LAKE_SQL, ORDER_LAKE_SQL, entity_lake, order_lake
from lakescope.plans.registry import TABLES, query, table
from lakescope.session import cut_lineage


def _frames(spark, sf_dir, names=TABLES):
    return {n: table(spark, sf_dir, n) for n in names}


# Spark's name of each stored type (fixed values).
_DTYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"""


def _counts_sql(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in names)


def _in(names):
    return ", ".join(f"'{n}'" for n in names)


_COLS = {
    t: names.split()
    for t, names in {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id embedding label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }.items()
}
_NESTED = "embedding"  # its numbers have other texts in other engines, so only their presence is compared


def _samples_sql(tables):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"(SELECT {'count(*)::VARCHAR' if c == _NESTED else "string_agg(v, '|' ORDER BY v)"} "
        f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values"
        for t in tables
        for c in _COLS[t]
    )


@query(
    "collect_schema",
    f"""WITH n AS ({_counts_sql(_COLS)}), s AS ({_samples_sql(_COLS)})
    SELECT 'sf' AS source_id, c.table_name, c.ordinal_position - 1 AS ordinal, c.column_name, {_DTYPE} AS dtype,
      n.row_count, s.sample_values
    FROM information_schema.columns c JOIN n USING (table_name) JOIN s USING (table_name, column_name)""",
)
def collect_schema(spark, sf_dir):
    out = catalog.collect_schema(spark, "sf", _frames(spark, sf_dir, tuple(_COLS)))
    return out.select("source_id", "table_name", "ordinal", "column_name", "dtype", "row_count", _shown_samples())


def _shown_samples():
    count = F.size("sample_values").cast("string")
    return F.when(F.col("column_name") == _NESTED, count).otherwise(F.array_join("sample_values", "|")).alias("sample_values")


@query("table_row_counts", _counts_sql(TABLES))
def table_row_counts(spark, sf_dir):
    return catalog.row_counts("sf", _frames(spark, sf_dir)).select("table_name", "row_count")


@query("column_sample_values", _samples_sql(_COLS))
def column_sample_values(spark, sf_dir):
    return catalog.sample_values("sf", _frames(spark, sf_dir)).select("table_name", "column_name", _shown_samples())


@query(
    "describe_table",
    f"""WITH s AS ({_samples_sql(("customer",))}), p AS (
      {" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, avg(CAST({c} IS NULL AS INT)) AS null_rate, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, count(*) AS row_count, "
        f"(SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) AS sample_row_values FROM customer"
        for c in _COLS["customer"])})
    SELECT 'customer' AS table_name, c.ordinal_position - 1 AS ordinal, column_name, {_DTYPE} AS dtype, row_count, sample_values,
      distinct_count, null_rate, min_value, max_value, sample_row_values
    FROM information_schema.columns c JOIN p USING (column_name) JOIN s USING (column_name) WHERE c.table_name = 'customer'""",
)
def describe_table(spark, sf_dir):
    frames = _frames(spark, sf_dir, ("customer",))
    cols = catalog.collect_schema(spark, "sf", frames)
    stats = profile.profile_table(frames["customer"], exact=True).withColumn("table_name", F.lit("customer"))
    first = sqlrun.sample_rows(frames["customer"], ["c_custkey"], 5).withColumn("place", F.col("c_custkey"))
    out = catalog.describe(cols, stats, first)
    return out.select(
        "table_name", "ordinal", "column_name", "dtype", "row_count",
        F.array_join("sample_values", "|").alias("sample_values"), "distinct_count", "null_rate", "min_value", "max_value",
        F.array_join("sample_row_values", "|").alias("sample_row_values"),
    )


@query("list_tables", f"""SELECT 'sf' AS source_id, table_name, row_count FROM ({_counts_sql(TABLES)})""")
def list_tables(spark, sf_dir):
    ours = catalog.row_counts("sf", _frames(spark, sf_dir))
    other = catalog.row_counts("texts", _frames(spark, sf_dir, ("documents", "pages")))
    return catalog.list_tables(ours.unionByName(other), "sf").select("source_id", "table_name", "row_count")


@query(
    "catalog_overview",
    f"""WITH {ORDER_LAKE_SQL}, t AS (
      SELECT source_id, table_name, count(*) AS column_count, count(comment) AS comments,
             (SELECT count(*) FROM lineitem WHERE l_orderkey = any_value(table_pos)) AS n_rows
      FROM olake GROUP BY ALL)
    SELECT source_id, CASE WHEN grouping(source_id) = 1 THEN count(DISTINCT source_id) END AS source_count, count(*) AS table_count, CAST(sum(n_rows) AS BIGINT) AS row_count, CAST(sum(column_count) AS BIGINT) AS column_count,
      count(*) FILTER (WHERE comments = 0) AS not_initialized, count(*) FILTER (WHERE comments > 0) AS inferred, 0 AS confirmed,
      CAST(sum(CASE WHEN column_count > 5 THEN 1 ELSE 0 END) AS BIGINT) AS indexed_tables
    FROM t GROUP BY ROLLUP (source_id)""",
)
def catalog_overview(spark, sf_dir):
    """Every source and all together; a table's rows are its order's line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_pos")).agg(F.count(F.lit(1)).alias("row_count"))
    tables = (
        order_lake(spark, sf_dir)
        .groupBy("source_id", "table_name")
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            F.first("table_pos").alias("table_pos"),
            F.when(F.count("comment") > 0, "inferred").otherwise("not_initialized").alias("semantic_status"),
        )
    )
    tables = cut_lineage(tables.join(lines, "table_pos", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0))))
    return catalog.overview(tables, tables.filter("column_count > 5"), totals=True)


@query(
    "catalog_upsert",
    """WITH u AS (SELECT l_orderkey AS k, max(l_shipdate) AS v, arg_max(CAST(l_quantity AS INT), (l_shipdate, l_linenumber, l_partkey)) AS n
               FROM lineitem GROUP BY 1)
    SELECT coalesce(o.o_orderkey, u.k) AS k, coalesce(u.n, -1) AS n,
      CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderstatus ELSE 'new' END AS status
    FROM orders o FULL JOIN u ON u.k = o.o_orderkey""",
)
def catalog_upsert(spark, sf_dir):
    """Orders as stored rows, line items as newer versions; the status is kept."""
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.lit(-1).alias("n"),
        F.col("o_orderstatus").alias("status"),
        F.struct(
            F.lit("1900-01-01").cast("timestamp_ntz").alias("d"),
            F.lit(0).alias("l"),
            F.lit(0).cast("bigint").alias("p"),
        ).alias("version"),
    )
    fresh = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_quantity").cast("int").alias("n"),
        F.lit("new").alias("status"),
        F.struct(
            F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p")
        ).alias("version"),
    )
    return catalog.latest_wins(stored, fresh, ["k"], ["version"], keep=["status"]).drop("version")


@query(
    "strip_secrets",
    """SELECT c_custkey, '{"type":"mysql","host":"' || c_name || '","port":"' || c_nationkey || '"}' AS config FROM customer""",
)
def strip_secrets(spark, sf_dir):
    config = F.to_json(
        F.struct(
            F.lit("mysql").alias("type"),
            F.col("c_name").alias("host"),
            F.concat(F.lit("pw"), F.col("c_custkey").cast("string")).alias("password"),
            F.col("c_nationkey").cast("string").alias("port"),
        )
    )
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.strip_secrets(config).alias("config"))


@query(
    "catalog_delete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def catalog_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.delete_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


def _hash_sql(entries: str) -> str:
    """The two-level hash of ``(source_id, e)`` rows: per bucket of the entries' own hashes, then over the buckets."""
    return f"""(SELECT source_id, left(sha256(string_agg(h, '|' ORDER BY b)), 16) AS schema_hash FROM (
      SELECT source_id, left(sha256(e), 2) AS b, left(sha256(string_agg(e, '|' ORDER BY e)), 16) AS h FROM ({entries}) GROUP BY 1, 2) GROUP BY 1)"""


_ENTRIES = "SELECT source_id, table_name || '.' || column_name || ':' || dtype AS e FROM olake"
_CROSS = "SELECT '__cross__' AS source_id, source_id || '|' || table_name || '.' || column_name || ':' || dtype AS e FROM elake"


@query(
    "schema_fingerprint",
    f"""WITH {ORDER_LAKE_SQL},
    {ENTITY_LAKE_SQL.replace("firsts AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY 1),", "")}
    SELECT * FROM {_hash_sql(_ENTRIES)} UNION ALL SELECT * FROM {_hash_sql(_CROSS)}""",
)
def schema_fingerprint(spark, sf_dir):
    per_source = catalog.fingerprints(order_lake(spark, sf_dir))
    return per_source.unionByName(catalog.cross_fingerprint(entity_lake(spark, sf_dir)))


@query(
    "stale_sources",
    f"""WITH {ORDER_LAKE_SQL}, f AS (
      SELECT *, CAST(substr(source_id, 5) AS BIGINT) AS n FROM {_hash_sql(_ENTRIES)})
    SELECT source_id, schema_hash, CASE n % 4 WHEN 0 THEN 'not cached' WHEN 1 THEN 'dirty' ELSE 'schema changed' END AS reason
    FROM f WHERE n % 4 < 3""",
)
def stale_sources(spark, sf_dir):
    now = cut_lineage(catalog.fingerprints(order_lake(spark, sf_dir)))  # also what the cache is made from
    kind = F.substring("source_id", 5, 20).cast("bigint") % 4
    cached = now.filter(kind > 0).select(
        "source_id",
        F.when(kind == 2, F.reverse("schema_hash")).otherwise(F.col("schema_hash")).alias("schema_hash"),
        F.when(kind == 1, 1).otherwise(0).alias("dirty"),
    )
    return catalog.stale_sources(now, cached)


@query(
    "resolve_table_source",
    """WITH t AS (SELECT source AS source_id, lang || (n_chars % 100) AS table_name, doc_id AS table_pos FROM documents)
    SELECT n.name AS table_name, arg_min(t.source_id, t.table_pos) AS source_id, count(DISTINCT t.source_id) AS sources
    FROM (SELECT 'en' || quality || toxic AS name, doc_id FROM labels) n LEFT JOIN t ON t.table_name = n.name GROUP BY n.name, n.doc_id""",
)
def resolve_table_source(spark, sf_dir):
    tables = table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"),
        F.concat("lang", (F.col("n_chars") % 100).cast("string")).alias("table_name"),
        F.col("doc_id").alias("table_pos"),
    )
    names = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("en"), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("table_name")
    )
    return catalog.resolve_tables(names, tables)
