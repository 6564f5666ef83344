"""Ordered and pairing operators on data where one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakescope.operators import pairs, segments, similarity, sqlrun
from lakescope.session import conf_set


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n)),
            "t": rng.integers(0, 60, n),
            "v": np.where(rng.random(n) < 0.3, None, rng.integers(0, 100, n).astype(object)),
        }
    )


def frame(spark, rows):
    data = [(int(r.id), int(r.k), int(r.t), None if r.v is None else int(r.v)) for r in rows.itertuples()]
    return spark.createDataFrame(data, "id bigint, k bigint, t bigint, v bigint")


def test_ranks(spark, rows):
    out = segments.ranks(frame(spark, rows), ["k"], "t", ["id"], segments=5).toPandas().set_index("id")
    g = rows.sort_values(["t", "id"]).groupby("k")
    want = pd.DataFrame(
        {
            "row_number": g.cumcount() + 1,
            "rank": g["t"].rank("min").astype(int),
            "dense_rank": g["t"].rank("dense").astype(int),
        }
    )
    want.index = rows.loc[want.index, "id"]
    for c in want:
        assert (out[c].sort_index() == want[c].sort_index()).all()


def test_neighbours_and_running(spark, rows):
    df = frame(spark, rows)
    got = segments.neighbours(df, ["k"], "t", ["id"], "v", segments=5).collect()
    run = {r["id"]: r["s"] for r in segments.running_sum(df, ["k"], "t", ["id"], "v", "s", segments=5).collect()}
    by = {r["id"]: r for r in got}
    for _, group in rows.sort_values(["t", "id"]).groupby("k"):
        vals, ids = list(group["v"]), list(group["id"])
        known, total = None, None
        for i, key in enumerate(ids):
            known = vals[i] if vals[i] is not None else known
            if vals[i] is not None:
                total = (total or 0) + vals[i]
            r = by[key]
            assert r["lag"] == (vals[i - 1] if i else None)
            assert r["lead"] == (vals[i + 1] if i + 1 < len(vals) else None)
            assert (r["first"], r["last"], r["last_known"]) == (vals[0], vals[-1], known)
            assert run[key] == total


def test_asof(spark, rows):
    left, right = rows[rows["id"] % 2 == 0], rows[rows["id"] % 2 == 1]
    r = frame(spark, right).select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    got = segments.asof_join(frame(spark, left).select("id", "k", "t"), r, ["k"], "t", "rt", ["rid"], how="left")
    got = {x["id"]: x["rid"] for x in got.collect()}
    for x in left.itertuples():
        hits = right[(right["k"] == x.k) & (right["t"] <= x.t)]
        want = None if hits.empty else hits.sort_values(["t", "id"])["id"].iloc[-1]
        assert got[x.id] == want


@pytest.mark.parametrize("block", [7, 1000])
def test_self_pairs(spark, rows, block):
    df = frame(spark, rows).select("id", "k")
    got = pairs.self_pairs(df, ["k"], ["id"], block=block).select("l.id", "r.id").toDF("a", "b").collect()
    seen = [tuple(sorted(p)) for p in got]
    want = {(a, b) for _, g in rows.groupby("k") for a in g["id"] for b in g["id"] if a < b}
    assert len(seen) == len(set(seen)) and set(seen) == want


@pytest.mark.parametrize("block", [16, 256])
def test_similar_pairs(spark, block):
    x = np.random.default_rng(3).normal(size=(70, 4))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(70)], "id bigint, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if (u @ u.T)[i, j] > 0.7}
    got = similarity.similar_pairs(df, "id", "v", 0.7, block=block).collect()
    assert {tuple(sorted((r["l"], r["r"]))) for r in got} == want and len(got) == len(want)


def test_range_join(spark, rows):
    ends = [(0, 5.0, 9.0), (1, 9.0, 40.0), (2, 50.0, 10.0), (3, -1e9, 1e9), (4, 59.0, 1e9), (5, -5.0, -1.0), (6, 17.0, 17.0), (7, 17.5, 17.6)]
    spans = spark.createDataFrame([*ends, (8, None, 3.0), (9, 1.0, None)], "s int, lo double, hi double")
    points = frame(spark, rows).select("id", "t")
    extra = spark.createDataFrame([(1000 + i, None if i % 9 == 0 else 17) for i in range(300)], "id bigint, t bigint")  # one value holds most rows
    with conf_set(spark, spark__sql__shuffle__partitions="13"):
        got = sqlrun.range_join(points.unionByName(extra), spans, "t", "lo", "hi")
        got = sorted((r["s"], r["id"]) for r in got.collect())
        assert sqlrun.range_join(points.limit(0), spans, "t", "lo", "hi").count() == 0
    known = [*zip(rows["id"], rows["t"]), *[(1000 + i, 17) for i in range(300) if i % 9]]
    assert got == sorted((s, i) for s, lo, hi in ends for i, t in known if lo <= t <= hi)


def test_asof_matches_no_nulls(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([(None, 1, 7), ("a", None, 8), (None, None, 9)], "k string, rt int, v int")
    assert segments.asof_join(left, right, ["k"], "t", "rt", ["v"]).count() == 0
    assert [r["v"] for r in segments.asof_join(left, right, ["k"], "t", "rt", ["v"], how="left").collect()] == [None] * 3


def test_string_order_with_nulls_and_ties(spark):
    """Order by a text column with few values: ranks equal the plain window however rows are cut."""
    from pyspark.sql import Window

    rows = [(i, "k" if i % 3 else None, [None, "b", "a", "b", "Z"][i % 5], i) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, o string, v int")
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select("id", F.row_number().over(w.orderBy("o", "id")).alias("row_number"), F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"))
    got = segments.ranks(df, ["k"], "o", ["id"], segments=7).select("id", "row_number", "rank", "dense_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_top_of_many_per_group(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("k"))
    assert sqlrun.top_per_group(df, ["k"], [F.desc("id")], 1500).agg(F.count("*"), F.min("id")).first()[:] == (3000, 2000)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_trailing_sum_of_a_hot_key(spark, kind):
    """One key with most rows inside one frame, repeated times, no times and no values."""
    rng = np.random.default_rng(8)
    n, day = 600, 86_400
    secs = np.where(rng.random(n) < 0.7, rng.integers(0, 40, n) * (day // 8), rng.integers(0, 60 * day, n))
    data = [
        (i, None if i % 50 == 7 else int(rng.integers(0, 2) * (i % 3)), None if i % 40 == 3 else int(t), None if rng.random() < 0.4 or t > 50 * day else int(rng.integers(0, 100)))
        for i, t in enumerate(secs)
    ]
    df = spark.createDataFrame(data, "id bigint, k bigint, s bigint, v bigint").withColumns({"v": F.col("v").cast(kind), "ts": F.timestamp_seconds("s")})
    got = {r["id"]: r["w"] for r in segments.trailing_sum(df, ["k"], "ts", "v", 3, "w").collect()}
    assert len(got) == n
    for i, k, s, v in data:
        frame = [x[3] for x in data if x[1] == k and (x[2] is None if s is None else x[2] is not None and s - 3 * day <= x[2] <= s) and x[3] is not None]
        assert got[i] == (sum(frame) if frame else None)


def test_trailing_sum_beside_a_large_total(spark):
    rows = [(i, i * 86_400, 1e15 if i < 4 else 0.125) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, s bigint, v double").withColumns({"ts": F.timestamp_seconds("s"), "k": F.lit(1)})
    got = segments.trailing_sum(df, ["k"], "ts", "v", 2, "w").filter("id >= 32").collect()
    assert {r["w"] for r in got} == {0.375}
