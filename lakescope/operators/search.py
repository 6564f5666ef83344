"""Keyword, vector and fused ranking of rows.

A result list is ordered by score, ties by key. Top-k results come from one
scan; fused results need exact ranks of a bounded set of candidates only, which
a second scan counts without sorting the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.functions import text, vectors
from lakescope.session import cut_lineage

RRF_K = 60  # fixed value: the rank constant of reciprocal rank fusion
TOP_K = 5


def keyword_score(query: str, body: Column) -> Column:
    """Number of query words contained in the text; repeated words count again."""
    low = F.lower(body)
    score = F.lit(0)
    for word in text.query_tokens(query):
        score = score + low.contains(word).cast("int")
    return score


def vector_score(query: Sequence[float], vector: Column) -> Column:
    return vectors.cosine(vector, vectors.literal(query))


def _scored_keywords(df: DataFrame, key: str, body: str, query: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), keyword_score(query, F.col(body)).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("key")).limit(k)


def keyword_search(df: DataFrame, key: str, body: str, query: str, top_k: int = TOP_K) -> DataFrame:
    """Rows matching at least one query word, best first."""
    if not text.query_tokens(query):
        return df.select(F.col(key).alias("key"), F.lit(0).alias("score")).limit(0)
    # filtering the k winners leaves each text scored once; rows without a match come last anyway
    return best(_scored_keywords(df, key, body, query), top_k).filter("score > 0")


def vector_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], top_k: int = TOP_K) -> DataFrame:
    """Rows by cosine with the query vector, no threshold."""
    scored = df.select(F.col(key).alias("key"), F.round(vector_score(query, F.col(vector)), 12).alias("score"))
    return best(scored, top_k)


def _entries_before(entries: list, key_type: str) -> Column:
    """How many of the entries, best first, rank before a row ``(key, score)``: a binary search as nested conditions."""

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        held, at = f"CAST('{entries[mid][0]!r}' AS DOUBLE)", f"CAST(CAST(X'{str(entries[mid][1]).encode().hex()}' AS STRING) AS {key_type})"
        return f"CASE WHEN score < {held} OR (score = {held} AND key > {at}) THEN {search(mid + 1, high)} ELSE {search(low, mid)} END"

    return F.expr(search(0, len(entries)))


def _exact_ranks(lists: dict[str, DataFrame], keys: list) -> DataFrame:
    """``(key, list, rank)`` of the listed keys within each scored list, by counting better rows.

    Only the listed keys travel; every task counts its rows per gap between two
    listed entries, so the shuffle moves a few hundred counters. All lists are read
    together, once for the entries and once for the counts.
    """
    tagged = {name: df.select(F.lit(name).alias("list"), "key", F.col("score").cast("double").alias("score")) for name, df in lists.items()}
    listed = reduce(DataFrame.unionByName, [df.filter(F.col("key").isin(keys)) for df in tagged.values()]).collect()
    entries = {name: sorted(((r["score"], r["key"]) for r in listed if r["list"] == name), key=lambda e: (-e[0], e[1])) for name in lists}
    first = next(iter(lists.values()))
    key_type = first.schema["key"].dataType.simpleString()
    gaps = [df.select("list", _entries_before(entries[name], key_type).alias("g")) for name, df in tagged.items()]
    counts = {(r["list"], r["g"]): r["n"] for r in reduce(DataFrame.unionByName, gaps).groupBy("list", "g").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for name, found in entries.items():
        seen = 0
        for i, (_, key) in enumerate(found):
            seen += counts.get((name, i), 0)
            rows.append((key, name, seen))
    return first.sparkSession.createDataFrame(rows, f"key {key_type}, list string, rank bigint")


def hybrid_rrf(
    docs: DataFrame,
    key: str,
    body: str,
    query: str,
    vecs: DataFrame,
    vec_key: str,
    vector: str,
    query_vector: Sequence[float],
    top_k: int = TOP_K,
) -> DataFrame:
    """Fuse the keyword and the vector list by sum of 1 / (60 + rank).

    Whoever ranks beyond ``60 + 2 k`` in both lists scores less than
    ``2 / (2 * (60 + k))``, which k rows of either list reach on one rank alone.
    So the first ``60 + 2 k`` of both lists are all the candidates there are.
    Lists shorter than that are complete anyway.
    """
    depth = RRF_K + 2 * top_k
    # scoring reads the texts and vectors once; ranks then come from the narrow (key, score) rows
    words = cut_lineage(_scored_keywords(docs, key, body, query)).filter("score > 0")
    cosines = cut_lineage(
        vecs.select(F.col(vec_key).alias("key"), F.round(vector_score(query_vector, F.col(vector)), 12).alias("score"))
    )
    firsts = best(words, depth).select("key").unionByName(best(cosines, depth).select("key")).distinct()
    keys = [r["key"] for r in firsts.collect()]  # at most 2 * depth keys
    ranks = _exact_ranks({"words": words, "cosines": cosines}, keys)
    part = F.sum(F.lit(1.0) / (RRF_K + F.col("rank")))
    return best(ranks.groupBy("key").agg(F.round(part, 12).alias("score")), top_k)


def named(index: DataFrame) -> DataFrame:
    """Rows of tables with ``key``: the shown name, and behind it what tells apart names that look the same."""
    name = F.concat(F.concat_ws("::", "source_id", "table_name"), F.lit("\0"), F.to_json(F.struct("source_id", "table_name")))
    return index.withColumn("key", name)


def described(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """Hits by such a key with the definition of their table; lower ``relevance_rank`` is better."""
    at = F.from_json(F.regexp_extract("key", "\\x00(.*)$", 1), "source_id string, table_name string")
    ranked = hits.select(at.alias("at"), (-F.col("score")).alias("relevance_rank"))
    ranked = ranked.select("at.source_id", "at.table_name", "relevance_rank")
    held = definitions.withColumnsRenamed({"source_id": "_source", "table_name": "_table"})
    same = F.col("source_id").eqNullSafe(F.col("_source")) & (F.col("table_name") == F.col("_table"))
    return ranked.join(held, same, "left").drop("_source", "_table")


def search_tables(
    index: DataFrame, definitions: DataFrame, query: str, top_k: int = TOP_K,
    vecs: DataFrame | None = None, query_vector: Sequence[float] | None = None,
) -> DataFrame:
    """Ranked tables with their definition; lower ``relevance_rank`` is better.

    ``index`` rows: ``source_id, table_name, searchable_text``. With vectors
    (``source_id, table_name, vector``) the ranking is fused.
    """
    keyed = named(index)
    if vecs is not None and query_vector is not None:
        hits = hybrid_rrf(keyed, "key", "searchable_text", query, named(vecs), "key", "vector", query_vector, top_k)
    else:
        hits = keyword_search(keyed, "key", "searchable_text", query, top_k)
    return described(hits, definitions)
