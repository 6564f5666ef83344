"""Searches by way of the trigram index against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from lakescope.operators import postings, search

TEXTS = [
    "The quick brown fox", "quick QUICK thicket", "ab", "", None, "a\nb c quick", "brown", "the the the", "fOx browN",
    "naïve Éclair 😀😀x", "éclair", "qui ick uic quic k",  # all grams of "quick" but one, or scattered
    "uick quic", "x" * 5000 + " needle",
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    data = [(i, t) for i, t in enumerate(TEXTS + more)] + [(3, "another text of key three, quick"), (None, "quick fox")]
    return spark.createDataFrame(data, "id bigint, body string").cache()


@pytest.fixture(scope="module")
def index(rows):
    return postings.store(postings.postings(rows, "id", "body"))


@pytest.mark.parametrize("top_k", [1, 4, 500])
@pytest.mark.parametrize("query", ["quick", "the quick quick fox", "éclair 😀😀x", "abc cab bca", "needle", "zzz", "ab quick", "", "!?"])
def test_equals_a_scan(rows, index, query, top_k):
    want = search.keyword_search(rows.filter("id IS NOT NULL"), "id", "body", query, top_k)
    got = postings.keyword_search(rows, index, "id", "body", query, top_k)
    assert got.columns == want.columns
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_more_candidates_than_pushed_keys(rows, index, monkeypatch):
    monkeypatch.setattr(postings, "KEYS_PUSHED", 2)
    test_equals_a_scan(rows, index, "abc cab bca", 30)


def test_postings_are_the_grams(rows, index):
    want = set()
    for r in rows.collect():
        low = (r["body"] or "").lower()
        want |= {(low[i : i + 3], r["id"]) for i in range(len(low) - 2) if r["id"] is not None}
    got = [(r["gram"], r["key"]) for r in index.collect()]
    assert set(got) == want


def test_maintained_equals_built_anew(spark, rows, index):
    before = rows.filter("id <> 3")
    changed = spark.createDataFrame([(0, "new words"), (1, None), (900, "a new row"), (7, "changed and removed")], "id bigint, body string")
    removed = spark.createDataFrame([(7,), (5,), (12345,)], "id bigint")
    kept = postings.maintain(postings.postings(before, "id", "body"), changed, "id", "body", removed)
    now = before.join(changed.select("id"), "id", "left_anti").unionByName(changed).join(removed, "id", "left_anti")
    want = postings.postings(now, "id", "body")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


def test_few_texts_are_verified(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("common words "), F.sha2(F.col("id").cast("string"), 256)).alias("body"))
    rare = rows.filter("id = 1234").first()["body"].split()[-1][:10]
    cost = {r["measure"]: r["n"] for r in postings.search_cost(rows, postings.store(postings.postings(rows, "id", "body")), "id", "body", rare).collect()}
    assert cost["texts"] == 3000 and 1 <= cost["verified"] <= cost["candidates"] < 30


def test_empty(spark, rows):
    none = rows.filter(F.lit(False))
    index = postings.store(postings.postings(none, "id", "body"))
    assert index.count() == 0
    assert postings.keyword_search(none, index, "id", "body", "quick").count() == 0
