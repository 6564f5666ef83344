"""Join-path discovery over the derived catalogs.

The equivalents join the columns once per rule and let the first rule win; the Spark
side finds the same pairs by one matching key.
"""

from pyspark.sql import functions as F

from lakescope.functions import text
from lakescope.operators import joinpaths, pathclasses
from lakescope.plans.lake import ENTITY_LAKE_SQL, ORDER_LAKE_SQL, entity_lake, entity_vectors, order_lake
from lakescope.plans.registry import query, table

_CLASS = """CASE WHEN upper({0}) LIKE '%INT%' THEN 'INT'
  WHEN regexp_matches(upper({0}), 'VARCHAR|TEXT|CHAR|STRING') THEN 'STRING'
  WHEN regexp_matches(upper({0}), 'FLOAT|DOUBLE|DECIMAL|NUMERIC|REAL') THEN 'NUMERIC'
  WHEN regexp_matches(upper({0}), 'DATE|TIMESTAMP|TIME') THEN 'TEMPORAL'
  WHEN contains(upper({0}), 'BOOL') THEN 'BOOL' ELSE upper({0}) END"""


def _keyed(lake: str) -> str:
    return f"""keyed AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, {_CLASS.format("dtype")} AS cls, lower(column_name) AS low,
         lower(regexp_replace(column_name, '[_-]?(id|key|code)$', '', 'i')) AS stem,
         lower(regexp_replace(table_name, 's$', '')) || '_id' AS own
  FROM {lake})"""


def _pairs_sql(same_source: bool) -> str:
    """Candidates as one key join per rule; the first rule that holds for a column pair wins."""
    scope = "a.source_id = b.source_id" if same_source else "a.table_name <> b.table_name"
    source = "a.source_id" if same_source else "'__cross__'"
    ends = " OR ".join(f"{x}.low LIKE '%\\_{e}' ESCAPE '\\'" for x in "ab" for e in ("id", "key"))
    rules = (
        (1, "a.low = b.own", "b.low IN ('id', b.own)"),
        (1, "b.low = a.own", "a.low IN ('id', a.own)"),
        (2, "a.low = b.low", "a.low <> 'id'"),
        (3, "a.stem = b.stem", f"a.stem <> '' AND a.low <> b.low AND ({ends})"),
    )
    each = " UNION ALL ".join(
        f"SELECT a.rid AS ra, b.rid AS rb, {n} AS rule FROM keyed a JOIN keyed b ON a.cls = b.cls AND {key} AND {scope} WHERE a.table_pos < b.table_pos AND {rest}"
        for n, key, rest in rules
    )
    return f"""ruled AS (SELECT ra, rb, min(rule) AS rule FROM ({each}) GROUP BY ALL),
cands AS (
  SELECT {source} AS source_id, a.source_id AS sa, b.source_id AS sb, a.table_name AS ta, b.table_name AS tb,
         a.table_pos AS pa, b.table_pos AS pb, a.ordinal AS oa, b.ordinal AS ob,
         a.table_name || '.' || a.column_name || ' = ' || b.table_name || '.' || b.column_name AS cond,
         CASE rule WHEN 1 THEN 'name_pattern:fk_id' WHEN 2 THEN 'name_pattern:exact_match' ELSE 'name_pattern:stripped_suffix' END AS sig,
         CASE rule WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS conf
  FROM ruled JOIN keyed a ON a.rid = ra JOIN keyed b ON b.rid = rb)"""


def _fk_sql(lake: str, cross: bool) -> str:
    join = "JOIN" if cross else "LEFT JOIN"
    source = "'__cross__'" if cross else "c.source_id"
    return f"""fks AS (
  SELECT {source} AS source_id, c.source_id AS sa, c.source_id AS sb, c.table_name AS ta, c.rt AS tb,
         c.table_pos AS pa, k.table_pos AS pb, c.ordinal AS oa, NULL AS ob,
         c.table_name || '.' || c.column_name || ' = ' || c.rt || '.' || c.rc AS cond,
         'fk_constraint' AS sig, 1.0::DOUBLE AS conf
  FROM (SELECT *, regexp_extract(comment, '(?i)FK\\s*->\\s*(\\w+)\\.(\\w+)', 1) AS rt,
                  regexp_extract(comment, '(?i)FK\\s*->\\s*(\\w+)\\.(\\w+)', 2) AS rc
        FROM {lake} WHERE comment LIKE '%->%') c
  {join} (SELECT DISTINCT source_id, table_name, table_pos FROM {lake}) k
    ON k.source_id = c.source_id AND k.table_name = c.rt
  WHERE c.rt <> '')"""


_FUSE = """
everything AS (SELECT *, least(sa || '|' || ta, sb || '|' || tb) AS ka, greatest(sa || '|' || ta, sb || '|' || tb) AS kb
               FROM (SELECT * FROM fks UNION ALL SELECT * FROM cands)),
ranked AS (SELECT *, bool_or(sig = 'fk_constraint') OVER (PARTITION BY source_id, ka, kb) AS has_fk,
                  row_number() OVER (PARTITION BY source_id, ka, kb ORDER BY conf DESC, pa, pb, oa, ob) AS rn
           FROM everything WHERE conf >= 0.4),
direct AS MATERIALIZED (SELECT * FROM ranked WHERE CASE WHEN has_fk THEN sig = 'fk_constraint' ELSE rn <= 3 END)"""

_INDIRECT = """
edge AS MATERIALIZED (
  SELECT source_id, sa || '|' || ta AS x, ta AS xt, pa AS xp, sb || '|' || tb AS m, tb AS mt, cond, conf FROM direct WHERE rn = 1 AND conf * 0.8::DOUBLE >= 0.4
  UNION ALL
  SELECT source_id, sb || '|' || tb, tb, pb, sa || '|' || ta, ta, cond, conf FROM direct WHERE rn = 1 AND conf * 0.8::DOUBLE >= 0.4),
met AS MATERIALIZED (
  SELECT a.source_id, a.m, a.x, b.x AS y, least(a.x, b.x) AS ka, greatest(a.x, b.x) AS kb
  FROM edge a JOIN edge b ON a.source_id = b.source_id AND a.m = b.m AND a.xp < b.xp),
apart AS MATERIALIZED (SELECT * FROM met ANTI JOIN direct USING (source_id, ka, kb)),
hop AS (
  SELECT a.source_id, a.xt AS ta, b.xt AS tb, a.mt AS via, a.cond || ' AND ' || b.cond AS cond,
         least(a.conf, b.conf) * 0.8::DOUBLE AS conf,
         'SELECT * FROM ' || a.xt || ' JOIN ' || a.mt || ' ON ' || a.cond || ' JOIN ' || b.xt || ' ON ' || b.cond AS sql
  FROM apart h JOIN edge a ON a.source_id = h.source_id AND a.m = h.m AND a.x = h.x
               JOIN edge b ON b.source_id = h.source_id AND b.m = h.m AND b.x = h.y)"""

_PATHS = """
paths AS (
  SELECT left(sha256(source_id || '|' || ta || '|' || tb || '|' || cond), 16) AS path_id, source_id,
         ta AS table_a, tb AS table_b, 'INNER' AS join_type, cond AS join_condition, conf AS confidence,
         sig AS signal_source, 'SELECT * FROM ' || ta || ' JOIN ' || tb || ' ON ' || cond AS sql_template, 1 AS version
  FROM direct
  UNION ALL
  SELECT left(sha256(source_id || '|' || ta || '|' || tb || '|via:' || via), 16), source_id, ta, tb, 'INNER', cond, conf,
         'indirect:via_' || via, sql, 1 FROM hop)"""


def _flow(cross: bool, *more: str) -> str:
    lake_sql, lake = (ENTITY_LAKE_SQL, "elake") if cross else (ORDER_LAKE_SQL, "olake")
    return "WITH " + ",\n".join([lake_sql, _keyed(lake), _pairs_sql(not cross), _fk_sql(lake, cross), *more])


@query(
    "type_class",
    f"""WITH {ORDER_LAKE_SQL}, e AS (
      SELECT source_id, table_name, column_name, dtype, {_CLASS.format("dtype")} AS type_class FROM olake)
    SELECT dtype, type_class, count(*) AS n, min(table_name) AS first_table FROM e GROUP BY ALL""",
)
def type_class(spark, sf_dir):
    cols = order_lake(spark, sf_dir).select("table_name", "dtype", text.type_class(F.col("dtype")).alias("type_class"))
    return cols.groupBy("dtype", "type_class").agg(F.count(F.lit(1)).alias("n"), F.min("table_name").alias("first_table"))


@query(
    "strip_id_suffix",
    f"""WITH {ORDER_LAKE_SQL}
    SELECT source_id, table_name, column_name,
           lower(regexp_replace(column_name, '[_-]?(id|key|code)$', '', 'i')) AS stem FROM olake""",
)
def strip_id_suffix(spark, sf_dir):
    return order_lake(spark, sf_dir).select(
        "source_id", "table_name", "column_name", text.strip_id_suffix(F.col("column_name")).alias("stem")
    )


def _shown(df):
    return df.select(
        "source_id", "a_table_name", "b_table_name", "join_condition", F.round("confidence", 6).alias("confidence"), "signal_source"
    )


_SHOW = """SELECT source_id, ta AS a_table_name, tb AS b_table_name, cond AS join_condition,
  round(conf, 6) AS confidence, sig AS signal_source FROM """


@query("join_fk", _flow(False) + _SHOW + "fks")
def join_fk(spark, sf_dir):
    return _shown(joinpaths.fk_candidates(order_lake(spark, sf_dir)))


@query("join_fk_cross", _flow(True) + _SHOW + "fks")
def join_fk_cross(spark, sf_dir):
    return _shown(joinpaths.fk_candidates(entity_lake(spark, sf_dir), cross=True))


def _signal(name):
    def run(spark, sf_dir):
        found = joinpaths.name_candidates(order_lake(spark, sf_dir))
        return _shown(found.filter(F.col("signal_source") == name))

    return run


for _key, _sig in (
    ("join_name_fk_id", "name_pattern:fk_id"),
    ("join_name_exact", "name_pattern:exact_match"),
    ("join_name_suffix", "name_pattern:stripped_suffix"),
):
    query(_key, _flow(False) + _SHOW + f"cands WHERE sig = '{_sig}'")(_signal(_sig))


@query("join_name_candidates", _flow(True) + _SHOW + "cands")
def join_name_candidates(spark, sf_dir):
    return _shown(joinpaths.name_candidates(entity_lake(spark, sf_dir), cross=True))


# --- vectors: the data is random, so the similarity threshold is lowered -----
_THRESHOLD = 0.35
_SCORES = f"""
vec AS (SELECT 'crm|customer' || vec_id || 's' AS k, 'customer' || vec_id || 's' AS t, vec_id AS p,
               CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scores AS (SELECT a.t AS ta, b.t AS tb, least(a.k, b.k) AS ka, greatest(a.k, b.k) AS kb,
                  list_cosine_similarity(a.v, b.v) AS cos
           FROM vec a JOIN vec b ON a.p < b.p WHERE list_cosine_similarity(a.v, b.v) > {_THRESHOLD})"""
_EVERY = """
named AS (SELECT *, least(sa || '|' || ta, sb || '|' || tb) AS ka, greatest(sa || '|' || ta, sb || '|' || tb) AS kb
          FROM (SELECT * FROM fks UNION ALL SELECT * FROM cands))"""


@query(
    "join_embedding",
    _flow(True, _SCORES, _EVERY)
    + """SELECT ta AS a_table_name, tb AS b_table_name,
      '-- embedding similarity ' || format('{:.3f}', cos) || ', manual verification needed' AS join_condition,
      round(cos * 0.6, 6) AS confidence
    FROM scores s WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.ka = s.ka AND n.kb = s.kb)""",
)
def join_embedding(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    named = joinpaths.fk_candidates(cols, cross=True).unionByName(joinpaths.name_candidates(cols, cross=True))
    scores = joinpaths.vector_scores(entity_vectors(spark, sf_dir), cross=True, threshold=_THRESHOLD)
    return joinpaths.vector_candidates(scores, named).select(
        "a_table_name", "b_table_name", "join_condition", F.round("confidence", 6).alias("confidence")
    )


@query(
    "join_embedding_blend",
    _flow(True, _SCORES, _EVERY)
    + """SELECT n.ta AS a_table_name, n.tb AS b_table_name, n.cond AS join_condition,
      round(CASE WHEN s.cos IS NOT NULL AND n.sig LIKE 'name_pattern%' THEN 0.6 * n.conf + 0.4 * (0.6 * s.cos)
                 ELSE n.conf END, 6) AS confidence,
      CASE WHEN s.cos IS NOT NULL AND n.sig LIKE 'name_pattern%' THEN n.sig || '+embedding' ELSE n.sig END AS signal
    FROM named n LEFT JOIN scores s ON n.ka = s.ka AND n.kb = s.kb""",
)
def join_embedding_blend(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    named = joinpaths.fk_candidates(cols, cross=True).unionByName(joinpaths.name_candidates(cols, cross=True))
    scores = joinpaths.vector_scores(entity_vectors(spark, sf_dir), cross=True, threshold=_THRESHOLD)
    return joinpaths.blend_vectors(named, scores).select(
        "a_table_name",
        "b_table_name",
        "join_condition",
        F.round("confidence", 6).alias("confidence"),
        F.col("signal_source").alias("signal"),
    )


@query("join_fuse", _flow(False, _FUSE) + _SHOW + "direct")
def join_fuse(spark, sf_dir):
    return _shown(pathclasses.direct_rows(pathclasses.factored(order_lake(spark, sf_dir))))


_FINAL = """SELECT path_id, source_id, table_a, table_b, join_type, join_condition, round(confidence, 6) AS confidence,
  signal_source, sql_template, version FROM paths"""


def _final(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@query("join_indirect", _flow(True, _FUSE, _INDIRECT, _PATHS) + _FINAL + " WHERE signal_source LIKE 'indirect:%'")
def join_indirect(spark, sf_dir):
    found = joinpaths.discover(entity_lake(spark, sf_dir), cross=True)
    return _final(found.filter("signal_source like 'indirect:%'"))


@query("join_paths_source", _flow(False, _FUSE, _INDIRECT, _PATHS) + _FINAL)
def join_paths_source(spark, sf_dir):
    return _final(joinpaths.discover(order_lake(spark, sf_dir)))


@query("join_paths_cross", _flow(True, _FUSE, _INDIRECT, _PATHS) + _FINAL)
def join_paths_cross(spark, sf_dir):
    return _final(joinpaths.discover(entity_lake(spark, sf_dir), cross=True))


def _counts_sql(cross: bool) -> str:
    return (
        _flow(cross, _FUSE, _INDIRECT)
        + """SELECT source_id, sig AS signal_source, round(conf, 6) AS confidence, count(*) AS n_paths FROM direct GROUP BY ALL
    UNION ALL SELECT source_id, 'indirect', round(conf, 6), count(*) FROM hop GROUP BY ALL"""
    )


@query("join_path_counts", _counts_sql(False))
def join_path_counts(spark, sf_dir):
    """Paths per source, signal and confidence, counted per class of tables."""
    return _final(pathclasses.path_counts(pathclasses.factored(order_lake(spark, sf_dir))))


@query("join_path_counts_cross", _counts_sql(True))
def join_path_counts_cross(spark, sf_dir):
    return _final(pathclasses.path_counts(pathclasses.factored(entity_lake(spark, sf_dir), cross=True)))


def _groups_sql(cross: bool) -> str:
    key = "CASE WHEN {0}.stem = '' THEN '=' || {0}.low ELSE {0}.stem END"
    return (
        _flow(cross)
        + f"""SELECT {"'__cross__'" if cross else "a.source_id"} AS source_id, a.cls, CASE WHEN a.low = 'id' THEN {key.format("b")} ELSE {key.format("a")} END AS match_key,
      CASE rule WHEN 1 THEN 'name_pattern:fk_id' WHEN 2 THEN 'name_pattern:exact_match' ELSE 'name_pattern:stripped_suffix' END AS signal_source, count(*) AS n_pairs
    FROM ruled JOIN keyed a ON a.rid = ra JOIN keyed b ON b.rid = rb GROUP BY ALL"""
    )


@query("join_name_groups", _groups_sql(False))
def join_name_groups(spark, sf_dir):
    """Matching column pairs per key and rule, counted from the members of each key."""
    return pathclasses.name_groups(order_lake(spark, sf_dir))


@query("join_name_groups_cross", _groups_sql(True))
def join_name_groups_cross(spark, sf_dir):
    return pathclasses.name_groups(entity_lake(spark, sf_dir), cross=True)


@query(
    "join_path_render",
    _flow(True, _FUSE)
    + """SELECT left(sha256(source_id || '|' || ta || '|' || tb || '|' || cond), 16) AS path_id, cond AS join_condition,
      'SELECT * FROM ' || ta || ' JOIN ' || tb || ' ON ' || cond AS sql_template FROM direct""",
)
def join_path_render(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    fused = pathclasses.direct_rows(pathclasses.factored(cols, cross=True))
    return joinpaths.render_direct(fused).select("path_id", "join_condition", "sql_template")


_WANTED = """
wanted AS (SELECT 'order' || o_orderkey || 's' AS table_a,
                  CASE WHEN o_orderpriority = '5-LOW' THEN 'nowhere' || o_orderkey ELSE 'supplier' || lead_key || 's' END AS table_b
           FROM orders JOIN leads USING (o_custkey) WHERE o_orderpriority IN ('2-HIGH', '5-LOW')),
hit AS (SELECT w.*, p.source_id, p.join_condition, p.signal_source, p.sql_template, p.confidence,
               bool_or(p.confidence < 0.6) OVER (PARTITION BY w.table_a, w.table_b, p.source_id) AS low
        FROM wanted w LEFT JOIN paths p
          ON least(w.table_a, w.table_b) = least(p.table_a, p.table_b)
         AND greatest(w.table_a, w.table_b) = greatest(p.table_a, p.table_b))
SELECT source_id, table_a, table_b,
       CASE WHEN signal_source LIKE 'indirect:%' THEN 'indirect' WHEN signal_source IS NOT NULL THEN 'direct' END AS kind,
       CASE WHEN signal_source LIKE 'indirect:%' THEN replace(signal_source, 'indirect:via_', '') END AS via,
       round(confidence, 2) AS confidence, signal_source AS signal, join_condition, sql_template AS join_sql,
       CASE WHEN low THEN 'low confidence, manual verification recommended' END AS warning,
       CASE WHEN table_b LIKE 'nowhere%' THEN 'Table "' || table_b || '" not found in any connected source' END AS error
FROM hit"""


@query("join_path_lookup", _flow(True, _FUSE, _INDIRECT, _PATHS, _WANTED.lstrip()))
def join_path_lookup(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    # asked: each high-priority order with its customer's lead supplier; low-priority ones with an unknown table
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("2-HIGH", "5-LOW"))
    lead = cols.filter("source_id = 'crm' and ordinal = 1").select(
        F.regexp_extract("table_name", r"(\d+)", 1).cast("bigint").alias("o_custkey"),
        F.concat(F.regexp_replace("column_name", "_id$", ""), F.lit("s")).alias("lead"),
    )
    wanted = orders.join(lead, "o_custkey").select(
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("s")).alias("table_a"),
        F.when(
            F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("nowhere"), F.col("o_orderkey").cast("string"))
        )
        .otherwise(F.col("lead"))
        .alias("table_b"),
    )
    tables = cols.select("source_id", "table_name", "table_pos").distinct()
    names = wanted.select(F.explode(F.array("table_a", "table_b")).alias("table_name")).distinct()
    anchors = tables.join(names, "table_name", "left_semi").select("source_id", "table_name")
    paths = joinpaths.discover(cols, cross=True, anchors=anchors)
    return joinpaths.lookup(paths, wanted, tables)


@query(
    "join_path_apply",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def join_path_apply(spark, sf_dir):
    """Find the path orders - customer from the two schemas and run it."""
    from lakescope.operators.catalog import column_rows

    frames = {"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders")}
    cols = column_rows(spark, "files", frames)
    path = joinpaths.fuse(joinpaths.candidates(cols, normalise="^[a-z]{1,2}_")).filter("pair_rank = 1").first()
    joined = joinpaths.apply_path(
        frames[path["a_table_name"]], frames[path["b_table_name"]], path["a_column_name"], path["b_column_name"]
    )
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
