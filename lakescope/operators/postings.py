"""A trigram index for keyword search.

Postings are rows ``(gram, key)``: one per row key and distinct run of three code points
of its lower-cased text. A word of three characters or more can only be inside a text
that has all the word's grams, so a search reads the postings of a few grams, bounds
every candidate's score by them and verifies only candidates that can be among the best.
Results equal those of ``search.keyword_search``.

Postings are dealt by key and stored in order of gram, so a filter on grams skips all
other row groups, and a gram that nearly every text has is spread over all files. Rows without a
text or with fewer than three characters have no postings; rows without a key are not
indexed. A key that several rows share has the grams of all of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lakescope.functions import text
from lakescope.operators import search
from lakescope.session import cut_lineage, scratch_path

GRAM = 3
KEYS_PUSHED = 1_000  # so many keys to verify are pushed into the scan of the texts, more are joined


@F.pandas_udf(ArrayType(StringType()))
def _runs(low: pd.Series) -> pd.Series:
    def runs(body: str | None) -> list[str] | None:
        if body is None or len(body) < GRAM:
            return None
        points = np.frombuffer(body.encode("utf-32-le"), dtype=np.uint32)
        shifts = [points[i : len(points) - GRAM + 1 + i] for i in range(GRAM)]
        packed = np.unique(reduce(lambda high, p: (high << 21) | p, (s.astype(np.uint64) for s in shifts)))
        found = np.stack([(packed >> (21 * (GRAM - 1 - i))) & 0x1FFFFF for i in range(GRAM)], axis=1)
        joined = found.astype(np.uint32).tobytes().decode("utf-32-le")
        return [joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]

    return low.map(runs)


def grams(body: Column) -> Column:
    """Distinct runs of three code points of the lower-cased text; null for shorter texts."""
    return _runs(F.lower(body))


def word_grams(word: str) -> list[str]:
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


def postings(rows: DataFrame, key: str, body: str) -> DataFrame:
    keyed = rows.filter(F.col(key).isNotNull())
    return keyed.select(F.explode(grams(F.col(body))).alias("gram"), F.col(key).alias("key"))


def store(index: DataFrame, path: str | None = None) -> DataFrame:
    """Write postings dealt by key and in order of gram within each file, and read them back."""
    path = path or scratch_path(index.sparkSession, "postings")
    index.repartition("key").sortWithinPartitions("gram", "key").write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def maintain(index: DataFrame, changed: DataFrame, key: str, body: str, removed: DataFrame | None = None) -> DataFrame:
    """Replace the postings of changed rows and drop those of removed keys.

    A removed key is gone even if it is among the changed rows.
    """
    gone = changed.select(F.col(key).alias("key"))
    fresh = postings(changed, key, body)
    if removed is not None:
        dropped = removed.select(F.col(key).alias("key"))
        gone, fresh = gone.unionByName(dropped), fresh.join(dropped, "key", "left_anti").select("gram", "key")
    return index.join(gone.distinct(), "key", "left_anti").select("gram", "key").unionByName(fresh)


def _words(query: str) -> dict[str, int]:
    words = text.query_tokens(query)
    return {w: words.count(w) for w in words}


def candidates(index: DataFrame, query: str) -> DataFrame:
    """``(key, bound)``: rows whose grams allow at least one query word; the score is at most ``bound``.

    Only for queries whose words all have three characters or more.
    """
    words = {w: (n, word_grams(w)) for w, n in _words(query).items()}
    asked = sorted({g for _, held in words.values() for g in held})
    bound = F.lit(0)
    for n, held in words.values():
        # a key of several rows may count a gram twice, which only loosens the bound
        bound = bound + F.when(F.count_if(F.col("gram").isin(held)) >= len(held), n).otherwise(0)
    return index.filter(F.col("gram").isin(asked)).groupBy("key").agg(bound.alias("bound")).filter("bound > 0")


def _verified(rows: DataFrame, key: str, body: str, query: str, keys: DataFrame) -> DataFrame:
    few = [r["key"] for r in keys.limit(KEYS_PUSHED + 1).collect()]
    if len(few) <= KEYS_PUSHED:
        kept = rows.filter(F.col(key).isin(few))
    else:
        kept = rows.join(keys.select(F.col("key").alias(key)), key, "left_semi")
    scored = kept.select(F.col(key).alias("key"), search.keyword_score(query, F.col(body)).alias("score"))
    return scored.filter("score > 0")


def _to_verify(rows: DataFrame, index: DataFrame, key: str, body: str, query: str, top_k: int) -> tuple[DataFrame, DataFrame]:
    """All candidates, and those whose bound reaches the last score of the k that look best."""
    found = cut_lineage(candidates(index, query))
    best = found.orderBy(F.desc("bound"), "key").limit(top_k)
    scores = [r["score"] for r in search.best(_verified(rows, key, body, query, best), top_k).collect()]
    least = min(scores) if len(scores) == top_k else 1
    return found, found.filter(F.col("bound") >= least)


def keyword_search(rows: DataFrame, index: DataFrame, key: str, body: str, query: str, top_k: int = search.TOP_K) -> DataFrame:
    """The rows of ``search.keyword_search`` that have a key, by way of the index.

    A query with a word under three characters scans the texts.
    """
    words = _words(query)
    if not words or top_k < 1 or any(len(w) < GRAM for w in words):
        return search.keyword_search(rows.filter(F.col(key).isNotNull()), key, body, query, top_k)
    _, keys = _to_verify(rows, index, key, body, query, top_k)
    return search.best(_verified(rows, key, body, query, keys), top_k)


def search_cost(rows: DataFrame, index: DataFrame, key: str, body: str, query: str, top_k: int = search.TOP_K) -> DataFrame:
    """``(measure, n)`` of an indexed search: all ``texts``, ``postings`` read, ``candidates``, texts ``verified``.

    Only for queries whose words all have three characters or more.
    """
    asked = sorted({g for w in _words(query) for g in word_grams(w)})
    found, keys = _to_verify(rows, index, key, body, query, top_k)
    read = {"texts": rows, "postings": index.filter(F.col("gram").isin(asked)), "candidates": found, "verified": keys}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n") for name, df in read.items()]
    return reduce(DataFrame.unionByName, counts)


def table_postings(index: DataFrame) -> DataFrame:
    """Postings of a search index of tables (``source_id, table_name, searchable_text``)."""
    return postings(search.named(index), "key", "searchable_text")


def search_tables(index: DataFrame, held: DataFrame, definitions: DataFrame, query: str, top_k: int = search.TOP_K) -> DataFrame:
    """The rows of ``search.search_tables`` without vectors, by way of the postings ``held``."""
    return search.described(keyword_search(search.named(index), held, "key", "searchable_text", query, top_k), definitions)
