"""Profile queries over whole tables."""

from lakescope.operators import profile
from lakescope.plans.registry import query, table

# --- per-column pieces the oracles repeat -----------------------------------
_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STR = ["l_returnflag", "l_linestatus"]
_TS = ["l_shipdate"]
_ALL = _NUM + _STR + _TS
_TYPES = {
    **{c: "bigint" for c in _NUM[:3]},
    "l_linenumber": "int",
    **{c: "double" for c in _NUM[4:]},
    **{c: "string" for c in _STR},
    "l_shipdate": "timestamp_ntz",
}


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_ALL):
        num, ts = c in _NUM, c in _TS
        v = f"CAST({c} AS DOUBLE)" if num else f"CAST(epoch_us({c}) AS DOUBLE)"
        quant = ", ".join(
            (f"round(quantile_cont({v}, {q / 100}), 4) AS q{q}" if num else f"CAST(NULL AS DOUBLE) AS q{q}")
            for q in (25, 50, 75)
        )
        moments = ", ".join(
            [f"make_timestamp(CAST(round(avg({v})) AS BIGINT)) AS avg_ts" if ts else "CAST(NULL AS TIMESTAMP) AS avg_ts"]
            + [
                (
                    f"make_timestamp(CAST(round(quantile_cont({v}, {q / 100})) AS BIGINT)) AS q{q}_ts"
                    if ts
                    else f"CAST(NULL AS TIMESTAMP) AS q{q}_ts"
                )
                for q in (25, 50, 75)
            ]
        )
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{_TYPES[c]}' AS column_type, "
            f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
            f"count(DISTINCT {c}) AS distinct_count, "
            + (f"round(avg({v}), 4) AS avg, round(stddev_samp({v}), 4) AS std, " if num else "CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS std, ")
            + f"{quant}, {moments}, count(*) AS row_count, "
            f"(count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_percentage, "
            f"(count(*) - count({c}))::DOUBLE / count(*) AS null_rate FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def _rounded(df, cols, places=4):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, places) for c in cols})


@query("profile_table", _profile_sql())
def profile_exact(spark, sf_dir):
    out = profile.profile_table(table(spark, sf_dir, "lineitem"), exact=True)
    return _rounded(out, ["avg", "std", "q25", "q50", "q75"])


@query("profile_table_sketch")
def profile_sketch(spark, sf_dir):
    return profile.profile_table(table(spark, sf_dir, "lineitem"))


@query(
    "profile_null_rate",
    # quality is missing for documents without a label
    """
    WITH t AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT column_name, round(rate * 100, 6) AS null_percentage, round(rate, 8) AS null_rate FROM (
      SELECT 'doc_id' AS column_name, avg(CAST(doc_id IS NULL AS INT)) AS rate FROM t
      UNION ALL SELECT 'lang', avg(CAST(lang IS NULL AS INT)) FROM t
      UNION ALL SELECT 'quality', avg(CAST(quality IS NULL AS INT)) FROM t
      UNION ALL SELECT 'toxic', avg(CAST(toxic IS NULL AS INT)) FROM t)
    """,
)
def null_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = profile.null_rates(joined)
    return _rounded(_rounded(out, ["null_percentage"], 6), ["null_rate"], 8)


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM orders" for c in _ORDERS
    ),
)
def distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "orders"), exact=True)


def _quartile_sql() -> str:
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"):
        ts = c == "o_orderdate"
        v = f"CAST(epoch_us({c}) AS DOUBLE)" if ts else f"CAST({c} AS DOUBLE)"
        nums = [
            f"CAST(NULL AS DOUBLE) AS q{q}" if ts else f"round(quantile_cont({v}, {q / 100}), 4) AS q{q}"
            for q in (25, 50, 75)
        ]
        times = [
            f"make_timestamp(CAST(round(quantile_cont({v}, {q / 100})) AS BIGINT)) AS q{q}_ts"
            if ts
            else f"CAST(NULL AS TIMESTAMP) AS q{q}_ts"
            for q in (25, 50, 75)
        ]
        parts.append(f"SELECT '{c}' AS column_name, {', '.join(nums + times)} FROM orders")
    return " UNION ALL ".join(parts)


@query("profile_quartiles", _quartile_sql())
def quartiles(spark, sf_dir):
    return _rounded(profile.quartiles(table(spark, sf_dir, "orders"), exact=True), ["q25", "q50", "q75"])


@query(
    "profile_top_values",
    """
    WITH v AS (
      SELECT 'event_type' AS column_name, event_type AS value FROM events
      UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
      UNION ALL SELECT 'props', props FROM events),
    c AS (SELECT column_name, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
    SELECT column_name, value, n, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 5
    """,
)
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"), ["event_type", "user_id", "props"])


@query(
    "profile_merge",
    """
    WITH base AS (SELECT o_custkey AS k, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi
                  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    fresh AS (SELECT o_custkey AS k, count(*) AS n,
                     CASE WHEN count(*) > 1 THEN min(o_totalprice) END AS lo, max(o_totalprice) AS hi
              FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT coalesce(b.k, f.k) AS k, coalesce(f.n, b.n) AS n, coalesce(f.lo, b.lo) AS lo, coalesce(f.hi, b.hi) AS hi
    FROM base b FULL JOIN fresh f ON b.k = f.k
    """,
)
def profile_merge(spark, sf_dir):
    from pyspark.sql import functions as F

    orders = table(spark, sf_dir, "orders")
    low = F.min("o_totalprice")
    aggs = [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi")]
    base = orders.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg(*aggs, low.alias("lo"))
    fresh = (
        orders.filter("o_orderstatus = 'P'")
        .groupBy(F.col("o_custkey").alias("k"))
        .agg(*aggs, F.when(F.count(F.lit(1)) > 1, low).alias("lo"))
    )
    return profile.merge_profiles(base, fresh, ["k"], ["n", "lo", "hi"])
