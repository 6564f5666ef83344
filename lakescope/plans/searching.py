"""Search over documents and vectors, and the semantic layer over derived definitions."""

from pyspark.sql import functions as F

from lakescope.functions.text import sha16
from lakescope.operators import postings, search, semantic
from lakescope.plans.registry import query, table

_QUERY = "the Thon, nder éau; the 911"
_TOKENS = ["the", "thon", "nder", "éau", "the", "911"]
_KW = " + ".join(f"CAST(contains(lower({{0}}), '{t}') AS INT)" for t in _TOKENS)


@query(
    "keyword_search",
    f"""SELECT doc_id AS key, {_KW.format("text")} AS score FROM documents WHERE {_KW.format("text")} > 0
    ORDER BY score DESC, doc_id LIMIT 25""",
)
def keyword_search(spark, sf_dir):
    return search.keyword_search(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY, 25)


@query(
    "keyword_search_indexed",
    f"""SELECT doc_id AS key, {_KW.format("text")} AS score FROM documents WHERE {_KW.format("text")} > 0
    ORDER BY score DESC, doc_id LIMIT 25""",
)
def keyword_search_indexed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = postings.store(postings.postings(docs, "doc_id", "text"))
    return postings.keyword_search(docs, index, "doc_id", "text", _QUERY, 25)


def _query_vector(spark, sf_dir):
    """The vector of one known item stands for an embedded query."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 17").first()["embedding"]


_COS = """(SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
      (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 17)), 12) AS cos FROM embeddings)"""


@query("vector_topk", f"SELECT vec_id AS key, round(cos, 6) AS score FROM {_COS} ORDER BY cos DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    out = search.vector_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10)
    return out.withColumn("score", F.round("score", 6))


@query(
    "hybrid_rrf",
    f"""WITH kw AS (SELECT doc_id AS key, row_number() OVER (ORDER BY s DESC, doc_id) AS r
                   FROM (SELECT doc_id, {_KW.format("text")} AS s FROM documents) WHERE s > 0),
    v AS (SELECT vec_id AS key, row_number() OVER (ORDER BY cos DESC, vec_id) AS r FROM {_COS})
    SELECT key, round(coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 9) AS score
    FROM kw FULL JOIN v USING (key) ORDER BY round(score, 12) DESC, key LIMIT 10""",
)
def hybrid_rrf(spark, sf_dir):
    out = search.hybrid_rrf(
        table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY,
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10,
    )
    return out.withColumn("score", F.round("score", 9))


# --- definitions: one per document -------------------------------------------
# Odd documents write their record in camelCase; every fifth leaves the source out.


def records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 2 == 1
    key = F.col("doc_id").cast("string")
    name = F.concat(F.lit("doc"), key)
    source = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    no_str = F.lit(None).cast("string")
    no_map = F.lit(None).cast("map<string,string>")
    labels = F.create_map(F.lit("a"), F.concat(F.lit("label "), "lang"), F.lit("b"), F.lit(" "))

    def column(text, meaning, unit, snake, camel):
        return F.struct(
            text.alias("name"), meaning.alias("semantic"), F.lit("dimension").alias("role"), unit.alias("unit"),
            snake.alias("enum_values"), camel.alias("enumValues"),
        )

    columns = F.array(
        column(F.lit("text"), F.col("text"), no_str, F.when(~odd, labels), F.when(odd, labels)),
        column(F.concat(F.lit("size_"), "lang"), no_str, F.lit("chars"), no_map, no_map),
    )
    target = F.concat(F.lit("doc"), (F.col("doc_id") + 1).cast("string"))
    condition = F.concat(name, F.lit(".lang = "), target, F.lit(".lang"))
    relation = F.array(
        F.struct(
            F.when(~odd, target).alias("target_table"), F.when(odd, target).alias("targetTable"),
            F.when(~odd, condition).alias("join_condition"), F.when(odd, condition).alias("joinCondition"),
            F.when(F.col("doc_id") % 3 == 0, "many_to_one").alias("relation_type"),
        )
    )
    metric = F.array(
        F.struct(
            F.concat(F.lit("chars_"), "lang").alias("name"), F.lit("SUM(n_chars)").alias("expression"),
            F.when(~odd & (F.col("doc_id") % 4 == 0), "lang").alias("group_by"), F.when(odd, "source").alias("groupBy"),
            F.when(F.col("doc_id") % 3 == 0, "n_chars > 10").alias("filter"),
        )
    )
    record = F.struct(
        F.when(~odd, name).alias("table_name"), F.when(odd, name).alias("tableName"),
        F.when(~odd, source).alias("source_id"), F.when(odd, source).alias("sourceId"),
        F.col("text").alias("description"),
        F.when(~odd, F.col("lang")).alias("business_domain"), F.when(odd, F.col("lang")).alias("businessDomain"),
        F.array("source", "lang").alias("tags"), columns.alias("columns"),
        F.when(F.col("doc_id") % 7 != 0, relation).alias("relations"), metric.alias("metrics"),
    )
    return docs.select("doc_id", F.to_json(record).alias("body"))


def definitions(spark, sf_dir):
    return semantic.parse_json(records(spark, sf_dir), "body")


_DEFS = """
defs AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source END AS source_id, 'doc' || doc_id AS table_name,
  text AS description, lang AS business_domain, source, lang, text AS meaning,
  CASE WHEN doc_id % 7 <> 0 THEN 'doc' || (doc_id + 1) END AS target,
  'doc' || doc_id || '.lang = doc' || (doc_id + 1) || '.lang' AS cond,
  CASE WHEN doc_id % 3 = 0 THEN 'many_to_one' ELSE 'one_to_many' END AS kind,
  'chars_' || lang AS metric,
  CASE WHEN doc_id % 2 = 1 THEN 'source' WHEN doc_id % 4 = 0 THEN 'lang' END AS group_by,
  CASE WHEN doc_id % 3 = 0 THEN 'n_chars > 10' END AS filt
  FROM documents),
texts AS (SELECT *, concat_ws(' ', table_name, CASE WHEN regexp_matches(description, '\\S') THEN description END, source, lang, lang,
  'text', CASE WHEN regexp_matches(meaning, '\\S') THEN meaning END, 'label ' || lang, 'size_' || lang, 'chars', metric)
  AS searchable_text FROM defs)"""


@query(
    "semantic_load",
    f"""WITH {_DEFS} SELECT source_id, table_name, business_domain, 2 AS columns, target AS target_table,
      CASE WHEN target IS NOT NULL THEN cond END AS join_condition, CASE WHEN target IS NOT NULL THEN kind END AS relation_type,
      metric, group_by, filt AS filter, 'label ' || lang AS label, md5(description) AS description_md5 FROM defs""",
)
def semantic_load(spark, sf_dir):
    d = definitions(spark, sf_dir)
    rel, met = F.col("relations")[0], F.col("metrics")[0]
    return d.select(
        "source_id", "table_name", "business_domain", F.size("columns").alias("columns"),
        rel["target_table"].alias("target_table"), rel["join_condition"].alias("join_condition"),
        rel["relation_type"].alias("relation_type"), met["name"].alias("metric"), met["group_by"].alias("group_by"),
        met["filter"].alias("filter"), F.col("columns")[0]["enum_values"]["a"].alias("label"),
        F.md5("description").alias("description_md5"),
    )


def _known_tables(spark, sf_dir):
    """Catalog tables: the labelled documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return docs.select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("table_name"),
        F.col("doc_id").alias("table_pos"),
        F.lit("not_initialized").alias("semantic_status"),
    )


@query(
    "semantic_update",
    f"""WITH {_DEFS}, known AS (SELECT DISTINCT doc_id FROM labels)
    SELECT d.table_name, coalesce(d.source_id, CASE WHEN k.doc_id IS NOT NULL THEN d.source END) AS source_id,
      CASE WHEN d.source_id IS NULL AND k.doc_id IS NULL
           THEN 'error: table "' || d.table_name || '" not found in any connected source' ELSE 'updated' END AS status,
      CASE WHEN k.doc_id IS NOT NULL THEN 'inferred' END AS semantic_status
    FROM defs d LEFT JOIN known k USING (doc_id)""",
)
def semantic_update(spark, sf_dir):
    incoming = definitions(spark, sf_dir)
    stored, tables, report = semantic.update(incoming.limit(0), incoming, _known_tables(spark, sf_dir))
    return (
        report.join(stored.select("source_id", "table_name"), "table_name", "left")
        .join(tables.select("table_name", "semantic_status"), "table_name", "left")
        .select("table_name", "source_id", "status", "semantic_status")
    )


@query("searchable_text", f"WITH {_DEFS} SELECT table_name, searchable_text FROM texts")
def searchable_text(spark, sf_dir):
    return semantic.build_index(definitions(spark, sf_dir)).select("table_name", "searchable_text")


@query(
    "index_maintain",
    f"""WITH {_DEFS} SELECT coalesce(source_id, 'none') AS source_id, table_name,
      CASE WHEN doc_id % 2 = 0 THEN searchable_text ELSE 'old' END AS searchable_text
    FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def index_maintain(spark, sf_dir):
    defs = definitions(spark, sf_dir).withColumn("source_id", F.coalesce("source_id", F.lit("none")))
    old = defs.select("source_id", "table_name", F.lit("old").alias("searchable_text"))
    number = F.regexp_extract("table_name", r"(\d+)", 1).cast("bigint")
    changed = defs.filter(number % 2 == 0)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    gone = defs.select("source_id", "table_name", number.alias("doc_id")).join(toxic, "doc_id", "left_semi")
    return semantic.maintain_index(old, changed, gone)


@query(
    "search_tables",
    f"""WITH {_DEFS} SELECT coalesce(source_id, 'none') AS source_id, table_name, -({_KW.format("searchable_text")}) AS relevance_rank,
      business_domain, metric FROM texts WHERE {_KW.format("searchable_text")} > 0
    ORDER BY {_KW.format("searchable_text")} DESC, coalesce(source_id, 'none') || '::' || table_name LIMIT 15""",
)
def search_tables(spark, sf_dir):
    defs = definitions(spark, sf_dir).withColumn("source_id", F.coalesce("source_id", F.lit("none")))
    hits = search.search_tables(semantic.build_index(defs), defs, _QUERY, 15)
    return hits.select(
        "source_id", "table_name", "relevance_rank", "business_domain", F.col("metrics")[0]["name"].alias("metric")
    )


_TABLE_HITS = f"""SELECT coalesce(source_id, 'none') AS source_id, table_name, -({_KW.format("body")}) AS relevance_rank, business_domain
    FROM kept WHERE {_KW.format("body")} > 0
    ORDER BY {_KW.format("body")} DESC, coalesce(source_id, 'none') || '::' || table_name LIMIT 15"""


def _table_postings(spark, sf_dir):
    """Postings of old texts, brought up to date: even tables changed, toxic ones removed."""
    defs = definitions(spark, sf_dir).withColumn("source_id", F.coalesce("source_id", F.lit("none")))
    old = defs.select("source_id", "table_name", F.concat(F.lit("old text of the "), "table_name").alias("searchable_text"))
    number = F.regexp_extract("table_name", r"(\d+)", 1).cast("bigint")
    changed = defs.filter(number % 2 == 0)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    gone = defs.select("source_id", "table_name", number.alias("doc_id")).join(toxic, "doc_id", "left_semi")
    texts = semantic.maintain_index(old, changed, gone)
    held = postings.maintain(
        postings.store(postings.table_postings(old)),
        search.named(semantic.build_index(changed)), "key", "searchable_text", search.named(gone),
    )
    return defs, texts, postings.store(held)


_KEPT = f"""{_DEFS}, kept AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN searchable_text ELSE 'old text of the ' || table_name END AS body
    FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(
    "postings_maintain",
    f"""WITH {_KEPT}, points AS (SELECT regexp_extract_all(lower(body), '(?s).') AS p FROM kept),
    grams AS (SELECT unnest(list_distinct(list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2]))) AS gram FROM points)
    SELECT gram, count(*) AS n_texts FROM grams GROUP BY gram""",
)
def postings_maintain(spark, sf_dir):
    return _table_postings(spark, sf_dir)[2].groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"))


@query("search_tables_indexed", f"WITH {_KEPT} {_TABLE_HITS}")
def search_tables_indexed(spark, sf_dir):
    defs, texts, held = _table_postings(spark, sf_dir)
    hits = postings.search_tables(texts, held, defs, _QUERY, 15)
    return hits.select("source_id", "table_name", "relevance_rank", "business_domain")


@query(
    "suggest_joins",
    f"""WITH {_DEFS} SELECT table_name, CASE WHEN target IS NULL THEN ''
      ELSE 'JOIN ' || target || ' ON ' || cond END AS suggested_joins FROM defs""",
)
def suggest_joins(spark, sf_dir):
    out = semantic.suggest_joins(definitions(spark, sf_dir))
    return out.select("table_name", F.array_join("suggested_joins", "; ").alias("suggested_joins"))


_METRIC_SQL = """'SELECT ' || coalesce(group_by || ', ', '') || 'SUM(n_chars) AS ' || metric || ' FROM ' || table_name
  || {0} || coalesce(' GROUP BY ' || group_by, '')"""


@query(
    "suggest_metric_sql",
    f"""WITH {_DEFS} SELECT table_name, metric AS name, {_METRIC_SQL.format("coalesce(' WHERE ' || filt, '')")} AS sql,
      {_METRIC_SQL.format("''")} AS sql_unfiltered FROM defs""",
)
def suggest_metric_sql(spark, sf_dir):
    d = definitions(spark, sf_dir)
    plain = semantic.suggest_metric_sql(d, apply_filter=False).select("table_name", F.col("sql").alias("sql_unfiltered"))
    return semantic.suggest_metric_sql(d).join(plain, "table_name").select("table_name", "name", "sql", "sql_unfiltered")


@query(
    "metric_execute",
    """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS group_key,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS daily_revenue
    FROM lineitem WHERE l_returnflag <> 'R' GROUP BY CAST(l_shipdate AS DATE)""",
)
def metric_execute(spark, sf_dir):
    out = semantic.run_metric(
        table(spark, sf_dir, "lineitem"),
        "daily_revenue",
        "SUM(l_extendedprice * (1 - l_discount))",
        "DATE(l_shipdate)",
        "l_returnflag <> 'R'",
    )
    return out.select(F.col("group_key").cast("string").alias("group_key"), F.round("daily_revenue", 2).alias("daily_revenue"))


@query(
    "stale_embeddings",
    """SELECT source AS source_id, 'doc' || doc_id AS table_name, left(sha256(text), 16) AS content_hash,
      CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'text changed' ELSE 'model changed' END AS reason
    FROM documents WHERE doc_id % 5 < 3""",
)
def stale_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("table_name"),
        F.col("text").alias("searchable_text"),
    )
    case = F.col("doc_id") % 5
    stored = docs.filter(case > 0).select(
        "source_id",
        "table_name",
        sha16(F.concat("searchable_text", F.when(case == 1, "!").otherwise(""))).alias("content_hash"),
        F.when(case == 2, "old").otherwise("new").alias("model_id"),
    )
    return semantic.stale_embeddings(docs, stored, "new")


@query(
    "semantic_export",
    """WITH c AS (SELECT o_orderkey, list({'line': l_linenumber, 'qty': l_quantity, 'sample': l_returnflag || '/' || l_linestatus}
                        ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS columns,
                      string_agg(l_linenumber || '>part' || l_partkey || '.id', ',' ORDER BY CAST(l_linenumber AS VARCHAR), 'part' || l_partkey || '.id') AS keys
                 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT 'sales' AS source_id, 'order' || o.o_orderkey AS table_name, coalesce(len(c.columns), 0) AS row_count,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'confirmed' ELSE 'inferred' END AS semantic_status, len(c.columns) AS column_count,
      c.columns[1].line AS first_line, array_to_string(list_transform(c.columns, lambda x: CAST(x.qty AS VARCHAR)), '|') AS types,
      array_to_string(list_transform(c.columns, lambda x: x.sample), '|') AS samples, keys AS foreign_keys
    FROM orders o LEFT JOIN c USING (o_orderkey)""",
)
def semantic_export(spark, sf_dir):
    """Orders as tables, their line items as columns with sample values, parts as declared keys."""
    lines = table(spark, sf_dir, "lineitem")
    at = [F.lit("sales").alias("source_id"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("table_name")]
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("row_count"))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "confirmed").otherwise("inferred").alias("semantic_status")
    tables = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").select(
        F.lit("sales").alias("source_id"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("table_name"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        status,
    )
    columns = lines.select(
        *at,
        F.struct("l_linenumber", "l_quantity", "l_partkey", "l_suppkey").alias("ordinal"),
        F.col("l_linenumber").alias("column_name"),
        F.col("l_quantity").alias("dtype"),
        F.array("l_returnflag", "l_linestatus").alias("sample_values"),
    )
    part = F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit(".id"))
    keys = lines.select(*at, F.col("l_linenumber").cast("string").alias("column_name"), part.alias("references"))
    out = semantic.export(columns, tables, keys)
    return out.select(
        "source_id",
        "table_name",
        "row_count",
        "semantic_status",
        F.when(F.col("columns").isNotNull(), F.size("columns")).alias("column_count"),
        F.col("columns")[0]["column_name"].alias("first_line"),
        F.array_join(F.transform("columns", lambda c: c["dtype"].cast("string")), "|").alias("types"),
        F.array_join(F.transform("columns", lambda c: F.array_join(c["sample_values"], "/")), "|").alias("samples"),
        F.array_join(F.transform("foreign_keys", lambda k: F.concat(k["column_name"], F.lit(">"), k["references"])), ",").alias("foreign_keys"),
    )
