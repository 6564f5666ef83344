"""Every registered query against its SQL equivalent on the smallest data."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare.mismatch(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_sketch_agrees_with_exact_profile(spark, sf):
    """The one query without an equivalent: sketches stay near the exact statistics."""
    from lakescope.operators.profile import profile_table

    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    near = {r["column_name"]: r for r in profile_table(table).collect()}
    for r in profile_table(table, exact=True).collect():
        got = near[r["column_name"]]
        assert (got["min_value"], got["max_value"], got["null_rate"]) == (r["min_value"], r["max_value"], r["null_rate"])
        assert abs(got["distinct_count"] - r["distinct_count"]) <= 0.1 * r["distinct_count"] + 1


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["column_name"] for r in rows} >= {"l_orderkey", "l_shipdate"}
