"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line; every query is run once to warm up, then timed as the
median of three runs (one run if that takes long).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakescope.session import build_session, scratch_scope  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LONG = 8.0  # seconds after which one timed run is enough

HEADLINE = [
    "profile_table_sketch",
    "profile_top_values",
    "sql_join_inner",
    "sql_group_agg",
    "top_per_group",
    "asof_join",
    "keyword_search",
    "vector_topk",
    "hybrid_rrf",
    "join_paths_source",
    "silhouette",
    "average_linkage",
]
# What DuckDB runs on the same files, next to ours.
BESIDE = {
    "profile_table_sketch": "SUMMARIZE lineitem",
    "sql_join_inner": None,
    "sql_group_agg": None,
    "keyword_search": None,
    "vector_topk": None,
}


def synthetic_catalog(spark, tables: int = 2_000, columns: int = 20):
    """A catalog of many tables: keys shared by a few tables each, own names otherwise."""
    from pyspark.sql import functions as F

    t = F.col("t").cast("string")
    shared = F.concat(F.lit("entity"), ((F.col("t") * 7 + F.col("c") * 131) % tables).cast("string"), F.lit("_id"))
    own = F.concat(F.lit("attr_"), t, F.lit("_"), F.col("c").cast("string"))
    name = F.when(F.col("c") == 0, F.concat(F.lit("entity"), t, F.lit("_id"))).when(F.col("c") < 4, shared).otherwise(own)
    rows = spark.range(tables).withColumnRenamed("id", "t").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return rows.select(
        F.lit("lake").alias("source_id"),
        F.concat(F.lit("entity"), t, F.lit("s")).alias("table_name"),
        F.col("t").alias("table_pos"),
        F.col("c").cast("bigint").alias("ordinal"),
        name.alias("column_name"),
        F.lit("bigint").alias("dtype"),
        F.lit(None).cast("string").alias("comment"),
    )


def hub_catalog(spark, tables: int = 50_000):
    """A catalog in which every table holds the same column name."""
    from pyspark.sql import functions as F

    t = F.col("t").cast("string")
    rows = spark.range(tables).withColumnRenamed("id", "t").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.when(F.col("c") == 0, F.lit("hub_id")).otherwise(F.concat(F.lit("own"), t))
    return rows.select(
        F.lit("lake").alias("source_id"),
        F.concat(F.lit("entity"), t, F.lit("s")).alias("table_name"),
        F.col("t").alias("table_pos"),
        F.col("c").cast("bigint").alias("ordinal"),
        name.alias("column_name"),
        F.lit("bigint").alias("dtype"),
        F.lit(None).cast("string").alias("comment"),
    )


def linkage(spark, tables: int):
    from lakescope.operators import clustering, domains

    feats, items = domains.features(synthetic_catalog(spark, tables))
    return clustering.average_linkage(feats, items)


def beside(name: str, sql: str | None) -> float:
    """Seconds of the equivalent in DuckDB, warm, median of three."""
    import duckdb
    from lakescope.plans import REGISTRY
    from lakescope.plans.registry import TABLES

    con = duckdb.connect()
    con.execute(f"SET threads={CPUS}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    seconds = []
    for _ in range(4):
        start = time.perf_counter()
        con.execute(sql or REGISTRY[name].oracle).fetchall()
        seconds.append(time.perf_counter() - start)
    return statistics.median(seconds[1:])


def main() -> None:
    from lakescope.operators import joinpaths
    from lakescope.plans import REGISTRY

    spark = build_session(
        f"local[{CPUS}]",
        "lakescope-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakescope-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: (lambda name=name: REGISTRY[name].run(spark, SF_DIR)) for name in HEADLINE}
    work["join_discovery_2000x20"] = lambda: joinpaths.discover(synthetic_catalog(spark))
    work["clustering_500"] = lambda: linkage(spark, 500)
    work["clustering_2000"] = lambda: linkage(spark, 2_000)
    asked = spark.createDataFrame([("lake", "entity7s")], "source_id string, table_name string")
    work["join_hub_50000_anchored"] = lambda: joinpaths.discover(hub_catalog(spark), anchors=asked)
    timings = {}
    for name, build in work.items():
        seconds = []
        for i in range(RUNS + 1):
            with scratch_scope(spark):
                start = time.perf_counter()
                build().write.format("noop").mode("overwrite").save()
                if i:
                    seconds.append(time.perf_counter() - start)
            if i and seconds[-1] > LONG:
                break
        timings[name] = round(statistics.median(seconds), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    duckdb = {name: round(beside(name, sql), 3) for name, sql in BESIDE.items()}
    ratios = {name: round(timings[name] / max(t, 0.001), 2) for name, t in duckdb.items()}
    total = round(sum(timings.values()), 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf, "duckdb": duckdb, "ratio_to_duckdb": ratios}))
    spark.stop()


if __name__ == "__main__":
    main()
