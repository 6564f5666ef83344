import hashlib
import random

from lakescope.llm import exact_dedup
from lakescope.llm.exact_dedup import CuckooFilter, Shard


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_inserts_and_deletes():
    f = CuckooFilter(1000)
    assert all(f.insert(digest(i)) for i in range(1000))
    assert all(digest(i) in f for i in range(1000))
    for i in range(500):
        f.delete(digest(i))
    assert all(digest(i) in f for i in range(500, 1000))
    assert sum(digest(i) in f for i in range(500)) < 10
    again = CuckooFilter.load(f.dump())
    assert again.slots == f.slots


def test_overflow_resizes_from_the_stored_keys():
    shard = Shard({}, None)
    small = shard.filter.n_buckets
    for i in range(5000):
        shard.add(digest(i), i, 1)
    assert shard.filter.n_buckets > small
    assert all(digest(i) in shard.filter for i in range(5000)) and len(shard.content) == 5000


def plain(rows):
    """(id, keep, size, kept) by definition; repeated rows stay once."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not done))
            done = done or i == keep
    return sorted(out, key=str)


def seen(index):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.lookup(index).collect()), key=str)


def test_build_insert_delete(spark):
    rng = random.Random(3)
    texts = ["", None, "A b", "a B", "É", "é", "ſ", "s", "S", *[f"text {i}" for i in range(20)]]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "a b"), (None, "lonely"), (None, "lonely"), (7, "x"), (7, "x")]
    more = [(i, rng.choice(texts)) for i in range(200, 260)]
    schema = "doc_id bigint, text string"
    index = exact_dedup.build(spark.createDataFrame(rows, schema), n_shards=3)
    assert seen(index) == plain(rows)
    index = exact_dedup.insert(index, spark.createDataFrame(more, schema))
    assert seen(index) == plain(rows + more)
    gone = {i for i in range(0, 260, 3)} | {7}
    index = exact_dedup.delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    assert seen(index) == plain([r for r in rows + more if r[0] not in gone])


def test_drop_duplicates_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (4, None), (5, "")]
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r[0], r[1]) for r in kept) == [(2, "A"), (3, "b"), (5, "")]
