"""Small scopes, each worked out by one task: same paths as by classes, and nothing per path is shuffled."""

import pytest

from lakescope.operators import joinpaths, pathclasses, pathscopes
from tests.test_pathclasses import LAKE, plain, random_lake, rows_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [15, 40])
def test_large_and_small_scopes_together(spark, monkeypatch, most):
    rows = random_lake(2)
    columns = spark.createDataFrame(rows, LAKE)
    sizes = [sum(r[0] == s for r in rows) for s in {r[0] for r in rows}]
    monkeypatch.setattr(pathscopes, "SCOPE_COLUMNS", most)
    assert (max(sizes) > most) == (most == 15)
    assert rows_of(joinpaths.discover(columns)) == plain(rows, False)


def test_paths_of_small_scopes_are_not_shuffled(spark):
    columns = spark.createDataFrame(random_lake(3), LAKE)
    for found in (pathclasses.direct_rows(pathclasses.factored(columns)), joinpaths.discover(columns), joinpaths.name_candidates(columns)):
        assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)


def test_chunks_end_between_scopes(spark, monkeypatch):
    monkeypatch.setattr(pathscopes, "CHUNK_ROWS", 5)
    monkeypatch.setattr(pathscopes, "CHUNK_PAIRS", 3)
    rows = random_lake(4)
    assert rows_of(joinpaths.discover(spark.createDataFrame(rows, LAKE))) == plain(rows, False)


def test_counts_of_small_scopes_need_no_classes(spark):
    rows = random_lake(6)
    paths = pathclasses.factored(spark.createDataFrame(rows, LAKE))
    counted = pathclasses.path_counts(paths)
    assert paths.classes is None and "Join" not in plan(counted)
    want = plain(rows, False)
    assert sum(r["n_paths"] for r in counted.collect()) == len(want)


@pytest.mark.parametrize("signal", ["exact_match", "fk_id", "stripped_suffix"])
def test_a_signal_of_small_scopes_needs_one_shuffle(spark, signal):
    """join_name_exact, join_name_fk_id and join_name_suffix: all pairs of a rule, unfused."""
    rows = random_lake(7)
    found = joinpaths.name_candidates(spark.createDataFrame(rows, LAKE)).filter(f"signal_source = 'name_pattern:{signal}'")
    assert plan(found).count("Exchange") == 1
    whole = plain([(*r[:6], None) for r in rows], False)
    shown = {(r["source_id"], r["a_table_name"], r["b_table_name"], r["join_condition"]) for r in found.collect()}
    assert shown >= {r[:4] for r in whole if r[5] == f"name_pattern:{signal}"}


def test_groups_of_small_scopes_need_no_join(spark):
    columns = spark.createDataFrame(random_lake(8), LAKE)
    groups = pathclasses.name_groups(columns)
    assert "Join" not in plan(groups)
    pairs = {(r[0], r[1]): r[2] for r in joinpaths.name_candidates(columns).groupBy("source_id", "signal_source").count().collect()}
    got = {}
    for r in groups.collect():
        got[r["source_id"], r["signal_source"]] = got.get((r["source_id"], r["signal_source"]), 0) + r["n_pairs"]
    assert got == pairs
