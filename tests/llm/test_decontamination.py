import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakescope.llm import bitset, decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    item = "Été one two-three four five six; seven eight NINE ten eleven twelve"
    items = [(1, item), (2, "short ITEM here"), (3, ""), (4, None), (10, item.upper()), (5, "one")]
    docs = [
        (1, f"before {item} after"), (2, "été one two three four five six seven eight nine"), (3, "one two three four five six seven eight nine"),
        (4, "a short item here and a Short, Item: here"), (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "one"), (7, "one"), (8, " ".join([item] * 30)),
    ]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    rows = got.select("doc_id", "n_words", F.expr(decontamination.covered("spans")), "items").collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in rows], key=str) == brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=10, max_size=60), st.integers(0, 40), st.integers(0, 40))
def test_a_shared_window_shares_a_fingerprint(shared, before, after):
    """Any run of WINDOW k-grams keeps the same fingerprints wherever it stands."""
    rng = np.random.default_rng(before * 41 + after)
    body = np.array(shared, dtype=np.uint64)
    one = np.concatenate((rng.integers(9, 99, before, dtype=np.uint64), body, rng.integers(9, 99, after, dtype=np.uint64)))
    from lakescope.llm.words import grams

    width = decontamination.WINDOW - decontamination.K + 1
    a, b = grams(body, decontamination.K), grams(one, decontamination.K)
    assert set(a[decontamination.winnow(a, width)].tolist()) & set(b[decontamination.winnow(b, width)].tolist())


def test_bitset_never_misses(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"))
    table = bitset.collect(rows, "h")
    held = np.array([r["h"] for r in rows.collect()], dtype=np.int64).view(np.uint64)
    assert bitset.holds(table, held).all()
    assert bitset.holds(table, np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)).mean() < 0.01


def test_items_without_id_mark_words(spark):
    items = spark.createDataFrame([(None, "only these words")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "see only these words here")], "doc_id int, text string")
    row = decontamination.contamination(docs, items).first()
    assert len(row["spans"]) == 1 and row["items"] == []


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 30])
def test_winnow_covers_every_window(n):
    h = np.random.default_rng(n).integers(0, 4, n, dtype=np.uint64)
    kept = set(decontamination.winnow(h, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(n - 5))
