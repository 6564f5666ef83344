"""The relational surface: one query per construct, over whole tables."""

from pyspark.sql import functions as F

from lakescope.operators import segments, sqlrun
from lakescope.operators.profile import exact_quantiles
from lakescope.plans.registry import query, table
from lakescope.session import conf_set, cut_lineage


def _views(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def _sql(spark, sf_dir, text, *names):
    _views(spark, sf_dir, *names)
    return sqlrun.run_sql(spark, text)


def _same(key, text, *names):
    """A statement that both engines read alike."""
    query(key, text)(lambda spark, sf_dir: _sql(spark, sf_dir, text, *names))


def _pair(key, spark_text, oracle, *names):
    query(key, oracle)(lambda spark, sf_dir: _sql(spark, sf_dir, spark_text, *names))


_same(
    "run_sql",
    """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
    SELECT c_mktsegment AS "market segment", count(*) AS n, round(sum(o_totalprice), 2) AS revenue
    FROM big JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "orders",
    "customer",
)


@query(
    "bounded_query",
    """WITH r AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 100 AS truncated
    FROM r ORDER BY n DESC, o_custkey LIMIT 100""",
)
def bounded_query(spark, sf_dir):
    df = _sql(spark, sf_dir, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey", "orders")
    out = sqlrun.bounded(df, 100)
    return out.rows.withColumns({"total": F.lit(out.total), "truncated": F.lit(out.truncated)})


_same(
    "sql_project_filter",
    """SELECT o_orderkey AS "Order Key", o_totalprice * 0.1 AS tax, o_orderpriority FROM orders
    WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%URGENT'
      AND o_totalprice BETWEEN 100000 AND 300000""",
    "orders",
)
_same("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "lineitem")
_same(
    "sql_join_inner",
    """SELECT c_mktsegment, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment, l_returnflag""",
    "lineitem",
    "orders",
    "customer",
)
_same(
    "sql_join_outer",
    """SELECT d.doc_id, d.lang, l.quality, c.turns FROM documents d
    LEFT JOIN labels l ON d.doc_id = l.doc_id
    FULL JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id * 7""",
    "documents",
    "labels",
    "conversations",
)
_same(
    "sql_join_semi",
    """SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
      AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""",
    "customer",
    "orders",
    "nation",
)
_same(
    "sql_join_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS "
    "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "customer",
    "orders",
)


@query(
    "sql_join_theta",
    """SELECT s_suppkey, c_custkey, c_acctbal FROM supplier JOIN customer
       ON c_acctbal >= s_acctbal - 20 AND c_acctbal <= s_acctbal + 20""",
)
def join_theta(spark, sf_dir):
    bands = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") - 20).alias("lo"), (F.col("s_acctbal") + 20).alias("hi")
    )
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sqlrun.range_join(points, bands, "c_acctbal", "lo", "hi").select("s_suppkey", "c_custkey", "c_acctbal")


_same(
    "sql_join_natural",
    "SELECT lang, quality, count(*) AS n FROM documents NATURAL JOIN labels GROUP BY lang, quality",
    "documents",
    "labels",
)
_same(
    "sql_join_self",
    """SELECT b.conv_id, b.turn, a.role AS asked_by, b.role AS answered_by
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""",
    "conversations",
)


@query(
    "asof_join",
    """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT e.event_id, p.ts AS purchase_ts, p.purchase FROM events e
    ASOF JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""",
)
def asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    right = events.filter("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase")
    )
    left = events.filter("event_type = 'error'").drop("event_type")
    return segments.asof_join(left, right, ["user_id"], "ts", "purchase_ts", ["purchase"]).select(
        "event_id", "purchase_ts", "purchase"
    )


_same(
    "sql_lateral",
    """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top_price, t.n
    FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') t""",
    "customer",
    "orders",
)
_same(
    "sql_group_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
      round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS avg_disc,
      min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
    FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY l_returnflag, l_linestatus""",
    "lineitem",
)
_same(
    "sql_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_suppkey, l_linenumber)) AS tuples
    FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
_same(
    "sql_agg_filter",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
      round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM events GROUP BY user_id""",
    "events",
)
_same(
    "sql_grouping_sets",
    """SELECT 'sets' AS kind, lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())
    UNION ALL SELECT 'cube', lang, source, sum(n_chars) FROM documents GROUP BY CUBE (lang, source)
    UNION ALL SELECT 'rollup', lang, source, max(n_chars) FROM documents GROUP BY ROLLUP (lang, source)""",
    "documents",
)
_same(
    "sql_having",
    """SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey
    HAVING count(*) > 5 ORDER BY total DESC, c_nationkey LIMIT 3""",
    "customer",
)
@query(
    "sql_stat_aggs",
    """WITH m AS (SELECT event_type, props AS top_props FROM (
      SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, props) AS rn
      FROM events GROUP BY event_type, props) WHERE rn = 1),
    s AS (SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90,
      round(stddev_samp(value), 6) AS sd, round(corr(value, user_id), 6) AS corr FROM events GROUP BY event_type)
    SELECT * FROM s JOIN m USING (event_type)""",
)
def stat_aggs(spark, sf_dir):
    """Median and quantile from value counts, the mode from pre-aggregated counts."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("event_type", F.col("value").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    quants = exact_quantiles(counts, "event_type", [0.5, 0.9])
    freq = events.groupBy("event_type", "props").agg(F.count(F.lit(1)).alias("n"))
    modes = freq.groupBy("event_type").agg(F.min_by("props", F.struct(-F.col("n"), F.col("props"))).alias("top_props"))
    moments = events.groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.corr("value", "user_id"), 6).alias("corr")
    )
    return (
        moments.join(quants, "event_type")
        .join(modes, "event_type")
        .select("event_type", F.round("q50", 6).alias("med"), F.round("q90", 6).alias("p90"), "sd", "corr", "top_props")
    )


_pair(
    "sql_collect_aggs",
    """SELECT o_custkey, array_join(sort_array(collect_set(o_orderstatus)), '|') AS statuses,
      listagg(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey""",
    """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS statuses,
      string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""",
    "orders",
)


@query(
    "sql_window_rank",
    """SELECT event_id, row_number() OVER w AS row_number, rank() OVER (PARTITION BY event_type ORDER BY value) AS rank,
      dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS dense_rank, ntile(7) OVER w AS tile
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""",
)
def window_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = segments.ranks(rows, ["event_type"], "value", ["event_id"])
    return out.select("event_id", "row_number", "rank", "dense_rank", segments.ntile(7).alias("tile"))


@query(
    "sql_window_offset",
    """WITH e AS (SELECT event_id, event_type, ts, CASE WHEN value > 20 THEN value END AS v FROM events)
    SELECT event_id, lag(v) OVER w AS lag, lead(v) OVER w AS lead,
      first_value(v) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first,
      last_value(v) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
      last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_known
    FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def window_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", F.when(F.col("value") > 20, F.col("value")).alias("v")
    )
    out = segments.neighbours(rows, ["event_type"], "ts", ["event_id"], "v")
    return out.select("event_id", "lag", "lead", "first", "last", "last_known")


@query(
    "sql_window_frame",
    """SELECT o_orderkey,
      round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate
            RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), 2) AS week_total,
      round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
    FROM orders""",
)
def window_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    week = segments.trailing_sum(rows, ["o_orderstatus"], "o_orderdate", "o_totalprice", 7, "week_total")
    out = segments.running_sum(week, ["o_orderstatus"], "o_orderdate", ["o_orderkey"], "o_totalprice", "running")
    return out.select("o_orderkey", F.round("week_total", 2).alias("week_total"), F.round("running", 2).alias("running"))


@query(
    "top_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""",
)
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return sqlrun.top_per_group(rows, ["l_suppkey"], order, 3)


_pair(
    "sql_order_limit",
    """SELECT d.doc_id, l.quality, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ORDER BY l.quality ASC NULLS LAST, d.n_chars DESC NULLS LAST, d.doc_id LIMIT 20 OFFSET 5""",
    """SELECT d.doc_id, l.quality, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ORDER BY l.quality ASC, d.n_chars DESC, d.doc_id LIMIT 20 OFFSET 5""",
    "documents",
    "labels",
)
_same(
    "sql_set_ops",
    """SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect all', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'except all', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""",
    "customer",
    "supplier",
    "orders",
)


@query(
    "union_by_name",
    """SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name, s_nationkey AS nation FROM supplier""",
)
def union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS nation", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    s = table(spark, sf_dir, "supplier").selectExpr("s_acctbal AS balance", "s_name AS name", "s_nationkey AS nation")
    return sqlrun.union_by_name(c, s)


_CHAIN = """WITH RECURSIVE chain(conv_id, turn, depth) AS (
      SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0
      UNION ALL
      SELECT c.conv_id, c.turn, chain.depth + 1 FROM chain
      JOIN conversations c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1)
    SELECT depth, count(*) AS n FROM chain GROUP BY depth"""


@query("sql_cte_recursive", _CHAIN)
def cte_recursive(spark, sf_dir):
    # the defaults stop a recursion at a hundred levels or a million rows; both are read when the query runs
    with conf_set(spark, spark__sql__cteRecursionRowLimit="-1", spark__sql__cteRecursionLevelLimit="-1"):
        return cut_lineage(_sql(spark, sf_dir, _CHAIN, "conversations"))


_pair(
    "sql_pivot",
    """SELECT event_type, kind, n FROM (
      SELECT event_type, low, high FROM (SELECT event_type, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS band FROM events)
      PIVOT (count(*) FOR band IN ('low' AS low, 'high' AS high)))
    UNPIVOT (n FOR kind IN (low, high))""",
    """SELECT event_type, unnest(['low', 'high']) AS kind,
      unnest([count(*) FILTER (WHERE value < 50), count(*) FILTER (WHERE NOT value < 50)]) AS n FROM events GROUP BY event_type""",
    "events",
)


@query(
    "sql_sample",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, TRUE AS same_draw FROM lineitem",
)
def sample(spark, sf_dir):
    """Sampling by rows: the whole table at fraction 1, marked where two draws of a tenth with one seed agree."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]

    def draw(mark):
        return rows.sample(fraction=0.1, seed=7).groupBy(*keys).agg(F.count(F.lit(1)).alias(mark))

    both = rows.sample(fraction=1.0, seed=7).join(draw("one"), keys, "left").join(draw("two"), keys, "left")
    return both.select(*keys, F.col("one").eqNullSafe(F.col("two")).alias("same_draw"))


_pair(
    "sql_string_fns",
    r"""SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+', 0) AS capital, text RLIKE '[0-9]{3}' AS digits,
      left(text, 10) || '-' || upper(lang) AS head, length(replace(text, ' ', '')) AS dense, split_part(text, ' ', 2) AS second,
      text LIKE '%the%' AS has_the FROM documents""",
    r"""SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+') AS capital, regexp_matches(text, '[0-9]{3}') AS digits,
      left(text, 10) || '-' || upper(lang) AS head, length(replace(text, ' ', '')) AS dense, split_part(text, ' ', 2) AS second,
      text LIKE '%the%' AS has_the FROM documents""",
    "documents",
)
_pair(
    "sql_date_fns",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, extract(year FROM o_orderdate) AS year,
      dayofweek(CAST(o_orderdate AS DATE)) - 1 AS dow, date_format(o_orderdate, 'yyyy/MM') AS label,
      max(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE))) AS age,
      max(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)) AS next_month, count(*) AS n
    FROM orders GROUP BY 1, 2, 3, 4""",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, extract(year FROM o_orderdate) AS year,
      extract(dow FROM o_orderdate) AS dow, strftime(o_orderdate, '%Y/%m') AS label,
      max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS age,
      max(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)) AS next_month, count(*) AS n
    FROM orders GROUP BY 1, 2, 3, 4""",
    "orders",
)
_pair(
    "sql_math_fns",
    """SELECT l_orderkey, l_linenumber, l_partkey div 7 AS q, l_partkey % 7 AS r, round(pow(l_discount + 1, 2), 6) AS p,
      round(sqrt(l_quantity), 6) AS s, round(try_divide(l_quantity, l_tax), 6) AS ratio, ceil(l_extendedprice) AS c,
      round(ln(l_quantity + 1), 6) AS l FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, l_partkey % 7 AS r, round(pow(l_discount + 1, 2), 6) AS p,
      round(sqrt(l_quantity), 6) AS s, round(CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END, 6) AS ratio,
      ceil(l_extendedprice) AS c, round(ln(l_quantity + 1), 6) AS l FROM lineitem""",
    "lineitem",
)
_pair(
    "sql_array_map_fns",
    """SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive,
      round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 5) AS square,
      element_at(map('label', label, 'id', CAST(vec_id AS INT)), 'label') AS label,
      named_struct('a', label, 'b', size(embedding)).b AS dims, p AS place
    FROM embeddings LATERAL VIEW explode(sequence(0, 1)) t AS p""",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive,
      round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square, label,
      len(embedding) AS dims, p AS place FROM embeddings, (SELECT unnest([0, 1]) AS p) t""",
    "embeddings",
)
_pair(
    "sql_json_fns",
    """SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total,
      max(from_json(props, 'k INT').k) AS top, count(get_json_object(props, '$.missing')) AS missing
    FROM events GROUP BY event_type""",
    """SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS INT)) AS top,
      count(props->>'$.missing') AS missing FROM events GROUP BY event_type""",
    "events",
)
_pair(
    "sql_conditional_cast",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
      coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, greatest(o_custkey, o_orderkey) AS g,
      try_cast(left(o_orderpriority, 1) AS INT) AS level, try_cast(o_orderstatus AS INT) AS bad, least(o_totalprice, 5000) AS l
    FROM orders""",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
      coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, greatest(o_custkey, o_orderkey) AS g,
      try_cast(left(o_orderpriority, 1) AS INT) AS level, try_cast(o_orderstatus AS INT) AS bad, least(o_totalprice, 5000) AS l
    FROM orders""",
    "orders",
)
