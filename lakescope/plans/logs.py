"""Query-log jobs over statements built from the document texts."""

from pyspark.sql import functions as F

from lakescope.operators import sqllog
from lakescope.plans.registry import query, table

# Every document becomes a statement; the whole text is part of it.
_FORMS = [
    "'SELECT * FROM orders WHERE note = ''' || t || ''''",
    "'SELECT a FROM ' || t",
    "'-- ' || t",
    "'/* ' || t || ' */ SELECT 1'",
    "t",
    "'WITH x AS (SELECT 1) SELECT * FROM x JOIN `Orders` ON true; DROP TABLE y /* ' || t || ' */'",
    "'select count(*) from documents -- drop ' || t",
    "'SELECT 1; SELECT ' || t",
    "'  '",
    "'SELECT f FROM src JOIN \"' || lang || '_docs\" USING (id) WHERE n > 1 and v = \"set\"'",
    "'INSERT INTO t SELECT ' || t",
]


def _case(text: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_FORMS))
    return f"CASE doc_id % {len(_FORMS)} {whens} END".replace("|| t", f"|| {text}").replace("THEN t ", f"THEN {text} ")


_TEXT = "replace(replace(text, '''', ' '), '\"', ' ')"
_LOG_SQL = f"log AS (SELECT doc_id AS query_id, {_case('txt')} AS sql FROM (SELECT doc_id, lang, {_TEXT} AS txt FROM documents))"


def _log(spark, sf_dir):
    clean = F.translate(F.translate("text", "'", " "), '"', " ")
    form = F.col("doc_id") % len(_FORMS)
    lit = F.lit
    cases = [
        F.concat(lit("SELECT * FROM orders WHERE note = '"), clean, lit("'")),
        F.concat(lit("SELECT a FROM "), clean),
        F.concat(lit("-- "), clean),
        F.concat(lit("/* "), clean, lit(" */ SELECT 1")),
        clean,
        F.concat(lit("WITH x AS (SELECT 1) SELECT * FROM x JOIN `Orders` ON true; DROP TABLE y /* "), clean, lit(" */")),
        F.concat(lit("select count(*) from documents -- drop "), clean),
        F.concat(lit("SELECT 1; SELECT "), clean),
        lit("  "),
        F.concat(lit('SELECT f FROM src JOIN "'), "lang", lit('_docs" USING (id) WHERE n > 1 and v = "set"')),
        F.concat(lit("INSERT INTO t SELECT "), clean),
    ]
    sql = F.when(form == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        sql = sql.when(form == i, c)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang", sql.alias("sql"))


_WORDS = " ".join(
    f"WHEN regexp_matches(up, '(^|;|\\s){w}(\\s|\\(|$)') THEN '{w}'" for w in sqllog.FORBIDDEN
)


@query(
    "sql_log_safety",
    f"""WITH {_LOG_SQL},
    a AS (SELECT query_id, regexp_replace(sql, '^\\s+|\\s+$', '', 'g') AS t FROM log),
    b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '--[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'),
                                   '^\\s+|\\s+$', '', 'g') AS cleaned FROM a),
    c AS (SELECT *, regexp_extract(upper(cleaned), '^(\\S+)', 1) AS first,
                 regexp_replace(regexp_replace(cleaned, '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g') AS bare FROM b),
    d AS (SELECT *, upper(bare) AS up FROM c),
    e AS (SELECT *, CASE {_WORDS} END AS word,
                 len(list_filter(string_split(bare, ';'), lambda s: regexp_matches(s, '\\S'))) AS parts FROM d)
    SELECT query_id, reason IS NULL AS safe, reason FROM (
      SELECT query_id, CASE WHEN t = '' THEN 'Empty SQL statement'
        WHEN cleaned = '' THEN 'Empty SQL after removing comments'
        WHEN first NOT IN ('SELECT', 'WITH') THEN 'Only SELECT statements are allowed. Got: ' || first
        WHEN word IS NOT NULL THEN 'Forbidden keyword detected: ' || word
        WHEN parts > 1 THEN 'Multiple statements are not allowed' END AS reason FROM e)""",
)
def log_safety(spark, sf_dir):
    return sqllog.safety(_log(spark, sf_dir)).select("query_id", "safe", "reason")


_USED = """used AS (SELECT query_id, lower(unnest(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\\s+[`"]?([0-9A-Za-z_]+)[`"]?', 1))) AS table_name
         FROM log)"""


@query("sql_log_tables", f"WITH {_LOG_SQL}, {_USED} SELECT query_id, table_name FROM used")
def log_tables(spark, sf_dir):
    return sqllog.tables_used(_log(spark, sf_dir))


@query(
    "sql_log_routing",
    f"""WITH {_LOG_SQL}, {_USED},
    known AS (SELECT lang || '_docs' AS table_name,
                     CASE WHEN lang IN ('en', 'fr') THEN 'mysql:web' ELSE 'csv:dump' END AS source_id
              FROM (SELECT DISTINCT lang FROM documents)
              UNION ALL SELECT 'src', 'mysql:web' UNION ALL SELECT 'orders', 'postgresql:shop'),
    f AS (SELECT query_id, bool_and(coalesce(source_id LIKE 'mysql:%' OR source_id LIKE 'postgresql:%', false)) AS ok,
                 min(source_id) AS lo, max(source_id) AS hi FROM used LEFT JOIN known USING (table_name) GROUP BY 1)
    SELECT query_id, CASE WHEN ok AND lo = hi THEN lo END AS source_id FROM log LEFT JOIN f USING (query_id)""",
)
def log_routing(spark, sf_dir):
    log = _log(spark, sf_dir)
    docs = log.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("lang").isin("en", "fr"), "mysql:web").otherwise("csv:dump").alias("source_id"),
        F.concat("lang", F.lit("_DOCS")).alias("table_name"),
        F.lit(1).alias("table_pos"),
    )
    fixed = spark.createDataFrame(
        [("mysql:web", "src", 2), ("postgresql:shop", "orders", 3)], "source_id string, table_name string, table_pos int"
    )
    return sqllog.routing(log, docs.unionByName(fixed))
