"""Join paths by classes of tables, held against the rules applied to every pair of columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakescope.operators import joinpaths, pathclasses

LAKE = "source_id string, table_name string, table_pos bigint, ordinal bigint, column_name string, dtype string, comment string"
NAMES = ["id", "orders_id", "order_id", "user_id", "USER_ID", "user_key", "user_code", "note", "note_id", "item_id", "_id", "paid", "created"]


def random_lake(seed, tables=26):
    rng, rows = random.Random(seed), []
    names = ["orders", "order", "users", "items", "notes", "x"]
    for t in range(tables):
        source, name = f"s{rng.randrange(3)}", rng.choice(names) if t % 3 == 0 else f"t{t}"
        if any((r[0], r[1]) == (source, name) for r in rows):
            name += f"{t}"
        picked = rng.sample(NAMES, rng.randrange(0, 3)) if t % 2 else NAMES[t % 4 : t % 4 + 2]
        for o, c in enumerate([*picked, f"own{t}"]):
            comment = f"FK -> {rng.choice(names + ['gone'])}.id" if rng.random() < 0.06 else None
            rows.append((source, name, t, o, c, rng.choice(["int", "int", "string"]) if t % 5 == 0 else "int", comment))
    return rows


def plain(rows, cross):
    """Direct and indirect paths of all pairs of tables by nested loops: {(scope, a, b, condition): (confidence, signal)}."""
    def stem(c):
        return re.sub(r"(?i)[_-]?(id|key|code)$", "", c).lower()

    def singular(t):
        return re.sub("s$", "", t).lower()

    tables = {}
    for s, t, p, o, c, d, note in rows:
        tables.setdefault((s, t, p), []).append((o, c, d, note))
    position = {(s, t): p for s, t, p in tables}
    found = {}  # (scope, pair) -> candidates
    for (s, t, p), cols in tables.items():
        for o, c, _, note in cols:
            m = re.match(r"FK -> (\w+)\.(\w+)", note or "")
            if m and (not cross or (s, m[1]) in position):
                scope = "__cross__" if cross else s
                pair = tuple(sorted([(s, t), (s, m[1])]))
                found.setdefault((scope, pair), []).append((1.0, (p, position.get((s, m[1])), o, None), (s, t), (s, m[1]), f"{t}.{c} = {m[1]}.{m[2]}", "fk_constraint"))
    keys = sorted(tables, key=lambda k: k[2])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a[1] == b[1]) if cross else (a[0] != b[0]):
                continue
            scope = "__cross__" if cross else a[0]
            own_a, own_b = singular(a[1]) + "_id", singular(b[1]) + "_id"
            for oa, ca, da, _ in tables[a]:
                for ob, cb, db, _ in tables[b]:
                    la, lb = ca.lower(), cb.lower()
                    if da != db:
                        continue
                    if (la == own_b and lb in ("id", own_b)) or (lb == own_a and la in ("id", own_a)):
                        conf, sig = 0.85, "name_pattern:fk_id"
                    elif la == lb and la != "id":
                        conf, sig = 0.65, "name_pattern:exact_match"
                    elif stem(ca) and stem(ca) == stem(cb) and any(x.endswith(e) for x in (la, lb) for e in ("_id", "_key")):
                        conf, sig = 0.5, "name_pattern:stripped_suffix"
                    else:
                        continue
                    pair = tuple(sorted([a[:2], b[:2]]))
                    found.setdefault((scope, pair), []).append((conf, (a[2], b[2], oa, ob), a[:2], b[:2], f"{a[1]}.{ca} = {b[1]}.{cb}", sig))
    out, edges = [], {}
    for (scope, pair), cands in found.items():
        fks = [c for c in cands if c[5] == "fk_constraint"]
        kept = sorted(fks or cands, key=lambda c: (-c[0], *[-1 if x is None else x for x in c[1]]))
        kept = kept if fks else kept[:3]
        out += [(scope, c[2][1], c[3][1], c[4], round(c[0], 6), c[5]) for c in kept]
        best = kept[0]
        if best[0] * 0.8 >= 0.4 and best[2] != best[3]:
            for end, mid in ((best[2], best[3]), (best[3], best[2])):
                if end in position:
                    edges.setdefault((scope, mid), []).append((position[end], end, best[4], best[0]))
    for (scope, mid), ends in edges.items():
        ends.sort()
        for i, x in enumerate(ends):
            for y in ends[i + 1 :]:
                if (scope, tuple(sorted([x[1], y[1]]))) not in found:
                    out.append((scope, x[1][1], y[1][1], f"{x[2]} AND {y[2]}", round(0.8 * min(x[3], y[3]), 6), f"indirect:via_{mid[1]}"))
    return sorted(out)


def rows_of(paths):
    return sorted((r["source_id"], r["table_a"], r["table_b"], r["join_condition"], round(r["confidence"], 6), r["signal_source"]) for r in paths.collect())


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("seed", [1])
def test_all_paths_against_nested_loops(spark, cross, seed):
    rows = random_lake(seed)
    columns = spark.createDataFrame(rows, LAKE)
    want = plain(rows, cross)
    assert any(r[5].startswith("indirect") for r in want)
    assert rows_of(joinpaths.discover(columns, cross=cross)) == want
    paths = pathclasses.factored(columns, cross)
    counts = {}
    for scope, *_, conf, sig in want:
        key = (scope, "indirect" if sig.startswith("indirect") else sig, conf)
        counts[key] = counts.get(key, 0) + 1
    assert {(r["source_id"], r["signal_source"], round(r["confidence"], 6)): r["n_paths"] for r in pathclasses.path_counts(paths).collect()} == counts


def test_asked_tables_only(spark, cross=True):
    columns = spark.createDataFrame(random_lake(4), LAKE)
    paths = pathclasses.factored(columns, cross)
    asked = columns.filter("table_pos % 4 < 2").select("source_id", "table_name").distinct()
    keys = asked.select(joinpaths.table_key(F.col("source_id"), F.col("table_name")).alias("tkey"))
    direct = pathclasses.direct_rows(paths, keys)
    got = joinpaths.render_direct(direct).unionByName(joinpaths.render(pathclasses.indirect_rows(paths, direct, keys)))
    assert rows_of(got) == rows_of(joinpaths.discover(columns, cross=cross, anchors=asked))


def test_vectors_and_declared_keys(spark, cross=True):
    rng, rows = random.Random(5), random_lake(5)
    columns = spark.createDataFrame(rows, LAKE)
    tables = sorted({r[:3] for r in rows}, key=lambda t: t[2])
    vectors = spark.createDataFrame([(*t, [rng.gauss(0, 1) for _ in range(3)]) for t in tables[::2]], "source_id string, table_name string, table_pos bigint, vector array<double>")
    keys = spark.createDataFrame([(r[0], r[1], r[4], "orders.id") for r in rows[::17]], "source_id string, table_name string, column_name string, references string")
    whole = rows_of(joinpaths.discover(columns, cross, vectors, keys, threshold=0.5))
    everyone = columns.select("source_id", "table_name").distinct()
    assert whole == rows_of(joinpaths.discover(columns, cross, vectors, keys, everyone, threshold=0.5))
    assert any("+embedding" in r[5] for r in whole) and any(r[5] == "embedding" for r in whole)


def test_name_groups_against_the_pairs(spark, cross=True):
    columns = spark.createDataFrame(random_lake(6, 40), LAKE)
    pairs = joinpaths.name_candidates(columns, cross)
    want = {(r[0], r[1]): r[2] for r in pairs.groupBy("source_id", "signal_source").count().collect()}
    groups = pathclasses.name_groups(columns, cross)
    got = {(r[0], r[1]): r[2] for r in groups.groupBy("source_id", "signal_source").agg(F.sum("n_pairs")).collect()}
    assert got == want


def test_hub_of_many_tables_stays_small(spark):
    """Fifty thousand tables: one column name in all of one half, a key of its own name to one hub in all of the other."""
    n = 50_000
    t = F.col("t").cast("string")
    rows = spark.range(n).withColumnRenamed("id", "t")
    half = F.col("t") % 2 == 0
    columns = rows.select(
        F.lit("lake").alias("source_id"), F.concat(F.lit("table"), t).alias("table_name"), F.col("t").alias("table_pos"), F.lit(0).cast("bigint").alias("ordinal"),
        F.when(half, "shared_id").otherwise(F.concat(F.lit("own"), t)).alias("column_name"), F.lit("int").alias("dtype"),
        F.when(~half, "FK -> table0.shared_id").alias("comment"),
    )
    paths = pathclasses.factored(columns)
    assert paths.classes.count() == 3 and paths.links.count() <= 4
    got = {(r["signal_source"], round(r["confidence"], 6)): r["n_paths"] for r in pathclasses.path_counts(paths).collect()}
    k = n // 2
    assert got == {
        ("name_pattern:exact_match", 0.65): k * (k - 1) // 2,
        ("fk_constraint", 1.0): k,
        ("indirect", 0.8): k * (k - 1) // 2,  # two tables with keys, through the hub
        ("indirect", 0.52): k * (k - 1),  # a table with a key and one with the shared name, through the hub
    }
    asked = spark.createDataFrame([("lake|table7",), ("lake|table8",)], "tkey string")
    direct = pathclasses.direct_rows(paths, asked)
    found = joinpaths.render(pathclasses.indirect_rows(paths, direct, asked)).collect()
    assert [(r["table_a"], r["table_b"], r["signal_source"]) for r in found] == [("table7", "table8", "indirect:via_table0")]
    assert direct.filter("a_tkey = 'lake|table7' OR b_tkey = 'lake|table7'").count() == 1
    assert pathclasses.name_groups(columns).collect()[0]["n_pairs"] == k * (k - 1) // 2
