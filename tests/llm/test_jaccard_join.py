import json
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakescope.llm import bitset, jaccard_join
from lakescope.llm.graph import components
from lakescope.llm.words import NONSPACE, Words
from lakescope.session import cut_lineage


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """(id, set size, smallest id of the component) by comparing all pairs."""
    sets, home = sets_of(rows), list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                home[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    """Chains of edits around the threshold, a large group, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for size in (5, 8, 12, 30, 60, 120):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(rng.choice((1, 3, 6))):
                texts.append(list(base))
                for _ in range(rng.choice((0, 1, 1, 2, 4))):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    for n in range(1, 40):
        texts.append(passage + [rng.choice(vocabulary) for _ in range(n % 9)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9001, ""), (9002, None), (9003, "a b"), (9004, "A  b"), (9005, "a b c d e"), (9006, "a b c d e f")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_small_sets_link_with_larger_ones(spark):
    """Texts of 1 to 12 words beside their extensions by a word in front, behind or both."""
    texts = []
    for size in range(1, 13):
        for end in ((0, 1), (1, 0), (1, 1)):
            base = [f"s{size}e{end[0]}{end[1]}w{i}" for i in range(size)]
            texts += [base, ["front"] * end[0] + base + ["behind"] * end[1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute(rows)
    assert [(i, n) for i, n, first in found if i != first][0][1] == 7  # 6 shingles of 9 words inside 7 of 10


def brute_by(rows, k, num, den):
    """(id, smallest id of the component) by comparing all pairs of sets of k-word shingles."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set() for w in words]
    first = {i: i for i, _ in rows}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = first[rows[i][0]], first[rows[j][0]]
                first = {d: min(x, y) if f in (x, y) else f for d, f in first.items()}
    return sorted(first.items())


@pytest.mark.parametrize("rule", [jaccard_join.NEAR, jaccard_join.Rule(2, 1, 2)])
def test_other_rules_against_brute_force(spark, rule):
    rows = corpus(3)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), rule=rule)
    assert sorted(tuple(r) for r in got.select("doc_id", "component_id").collect()) == brute_by(rows, *rule)


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, "quite another text with other words"), (None, text), (None, None), (5, "quite another text with other words")]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert found == sorted([(1, 4, 1), (1, 3, 1), (None, 4, 1), (None, 0, None), (5, 3, 1)], key=str)


def test_one_of_each_group(spark):
    rows = [(3, "a b c d e f g h"), (2, "A b c d e f g h"), (4, "z y x w v"), (5, ""), (6, "")]
    kept = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]


@pytest.mark.parametrize("hot", [0, 40])
def test_small_buckets_and_hot_shingles_against_brute_force(spark, monkeypatch, hot):
    """Many buckets and flushes; all shingles or the most frequent ones dealt out row by row."""
    for name, value in (("HOT", hot), ("BUCKET_ENTRIES", 50), ("FLUSH_ENTRIES", 100)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(4)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


SHUFFLED = """
import sys
sys.path.insert(0, sys.argv[1])
from lakescope.llm import jaccard_join
from lakescope.session import build_session
top = sys.argv[2]
conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.checkpoint.dir": top + "/shared", "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + top + "/events", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}
spark = build_session("local[4]", **conf)
getattr(jaccard_join, sys.argv[3])(spark.read.parquet(top + "/docs"), rule=jaccard_join.NEAR).write.parquet(top + "/out")
spark.stop()
"""


def shuffled(spark, folder, name):
    """(rows, result, bytes that the named function shuffles) where no table is small enough to be broadcast unasked."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(200))) for i in range(3000)]
    rows += [(5000 + i, f"{rows[i][1]} more") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/docs")
    (folder / "events").mkdir()
    subprocess.run([sys.executable, "-c", SHUFFLED, str(Path(__file__).resolve().parents[2]), str(folder), name], check=True, timeout=300)
    ended = [json.loads(x) for p in (folder / "events").iterdir() if p.is_file() for x in p.open() if x.startswith('{"Event":"SparkListenerTaskEnd"')]
    return rows, spark.read.parquet(f"{folder}/out"), sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in ended)


def test_texts_that_meet_nothing_are_not_shuffled(spark, tmp_path):
    rows, kept, moved = shuffled(spark, tmp_path, "one_of_each_group")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(3000))
    assert moved < sum(len(t) for _, t in rows)


def test_prefixes_are_shuffled_once(spark, tmp_path):
    """The entries of the prefixes, a fifth of all shingles, and what else is dealt out take less than 60 bytes an entry."""
    rows, found, moved = shuffled(spark, tmp_path, "similar_documents")
    assert found.filter("id <> first").count() == 20
    assert moved < 60 * len(rows) * jaccard_join.prefix_length(196, jaccard_join.NEAR)


def test_one_of_each_group_with_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, text), (3, f"{text} more"), (None, "no id"), (None, ""), (None, "")]
    kept = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = sorted((str(r["doc_id"]), r["text"] in ("", "no id")) for r in kept)
    assert kept in [sorted([("1", False), (i, False), ("None", True), ("None", True), ("None", True)]) for i in ("2", "3")]


def test_marked_leaves_no_row_out(spark):
    rows = spark.range(1000)
    among = spark.range(0, 1000, 50).withColumnRenamed("id", "asked")
    got = bitset.marked(rows, "id", among, "asked", bits=10).filter("marked")
    assert {r["id"] for r in got.collect()} >= set(range(0, 1000, 50))
    assert got.count() < 100 and bitset.marked(rows, "id", among, "asked", bits=10).count() == 1000
    assert bitset.marked(rows, "id", among.limit(0), "asked").filter("NOT marked").count() == 1000


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_prefixes_of_close_sets_meet():
    """Sets within the threshold share an element of their prefixes, for any common order."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(6, 200)
        a = rng.sample(range(1000), n)
        b = a[rng.randrange(0, 1 + n // 8) :] + rng.sample(range(1000, 2000), rng.randrange(0, 1 + n // 8))
        x, y = set(a), set(b)
        if 100 * len(x & y) >= 85 * len(x | y):
            assert set(sorted(x)[: jaccard_join.prefix_length(len(x))]) & set(sorted(y)[: jaccard_join.prefix_length(len(y))])


def test_word_hashes_do_not_depend_on_place():
    texts = ["a Bc  d", "", None, "bc a", "é x", "q" * 600_000 + " bc", " lead and trail "]
    w = Words(pa.array(texts, pa.string()), NONSPACE)
    assert w.counts.tolist() == [3, 0, 0, 2, 1, 2, 3]
    h = w.hashes
    assert h[0] == h[4] and h[1] == h[3] == h[7]
    assert len(np.unique(h)) == len(h) - 3


def test_outlines_bound_the_intersection():
    """Never below the true intersection; far below the smaller size for sets with little in common."""
    rng = np.random.default_rng(8)
    for n, both in [(1, 0), (5, 3), (70, 70), (200, 60), (200, 150), (3000, 0), (3000, 2400)]:
        x, y, z = (rng.integers(0, 1 << 64, m, dtype=np.uint64) for m in (both, n - both, n - both + n // 5))
        a, b = np.sort(np.concatenate([x, y])), np.sort(np.concatenate([x, z]))
        most = jaccard_join.most_common(jaccard_join.outline(a), jaccard_join.outline(b))
        assert both <= most <= both + 0.75 * (n - both) + 1
    full = np.arange(40, dtype=np.uint64)  # all in one range
    assert jaccard_join.most_common(jaccard_join.outline(full), jaccard_join.outline(full + np.uint64(20))) is None
    assert jaccard_join.most_common(jaccard_join.outline(full[:0]), jaccard_join.outline(full[:9])) == 0


def test_texts_of_pairs_with_little_in_common_are_not_compared(spark, monkeypatch):
    """Documents that share half their text meet in many regions, but only near copies have their texts shuffled."""
    rng = random.Random(9)
    passages = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(150)) for _ in range(8)]
    rows = [(100 * i + j, f"{passages[i]} {passages[j]}") for i in range(8) for j in range(i)]
    rows.append((9000, f"{rows[0][1]} more"))
    asked, verify = [], jaccard_join._verify

    def spy(*args):
        asked.extend((r["pivot"], r["id"]) for r in args[-2].select("pivot", "id").collect())
        return verify(*args)

    monkeypatch.setattr(jaccard_join, "_verify", spy)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), rule=jaccard_join.NEAR)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted((i, 100 if i == 9000 else i) for i, _ in rows)
    assert [sorted(p) for p in asked] == [[100, 9000]]


def test_written_tables_leave_no_shuffle_files(spark):
    """What a write shuffled goes at its end, not when the driver's garbage is collected."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}
    before = files()
    assert cut_lineage(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    rows = cut_lineage(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k"))
    for _ in range(40):
        left = {x.split("_")[1] for x in files() - before}
        if len(left) < 2:  # the count's own
            break
        time.sleep(0.25)
    assert len(left) < 2 and rows.count() == 1000
