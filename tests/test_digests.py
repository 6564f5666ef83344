"""Digests of sorted entries, streamed through tasks."""

import hashlib

from lakescope.operators import catalog
from lakescope.plans import REGISTRY


def test_groups_across_batches_and_null_keys(spark):
    rows = [(k, f"e{i}") for k in (None, "a", "b") for i in range(7)] + [("c", "x")]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = catalog.joined_sha16(spark.createDataFrame(rows, "k string, e string"), ["k"], "e", "h").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {k: hashlib.sha256("|".join(sorted(e for x, e in rows if x == k)).encode()).hexdigest()[:16] for k, _ in rows}
    assert {r["k"]: r["h"] for r in found} == want and len(found) == len(want)


def test_stale_sources_digests_the_catalog_once(spark, sf):
    stale = REGISTRY["stale_sources"].run(spark, sf)
    assert "MapIn" not in stale._jdf.queryExecution().executedPlan().toString()
