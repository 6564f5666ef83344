"""Importance resampling of documents towards a target collection, over hashed n-grams.

Words come from a byte table and ``bytes.split``. The CRC-32 of a run of words is the seed
that extends it by a space and the next word, so all runs of up to ``n`` words are hashed
without building their text; the hash modulo ``buckets`` is the feature. Counters add up
the buckets of all texts of the source and of the target; the gain of a bucket is the
logarithm of the ratio of its smoothed frequencies, and a document's weight the sum of
gains over its features. A Gumbel value drawn from the id is added, and the documents of
highest score are taken: a draw without replacement in proportion to the weights.

The only table held whole is that of the ``buckets`` gains. Scores are numbered by ranges
of the order, so no task sorts all documents.

Defined cases: a null text has no words, so weight 0; a null id is drawn by the hash of
the prefix alone and comes before all ids among equal scores; rows that repeat are drawn each; an
empty source or target counts nothing and is smoothed like any other; an empty table gives
no rows. Other columns than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescope.llm.byte_words import ALNUM_TABLE, raw, word_lists
from lakescope.llm.words import pieces
from lakescope.operators.segments import with_segment
from lakescope.session import cut_lineage


class Plan(NamedTuple):
    """Longest run of words, buckets, least words of a document to be drawn, per cent drawn, seed of the draw."""

    n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024:"


PLAN = Plan()


def features(text: bytes, plan: Plan = PLAN) -> tuple[int, Counter]:
    """Number of words, and how often each bucket occurs among the runs of 1 to n words."""
    n_words, found = 0, Counter()
    tails: list[int] = []  # CRCs of the runs of 1 to n - 1 words that end before the next list, longest last
    for words in word_lists(text, ALNUM_TABLE):
        n_words += len(words)
        if plan.n == 1:
            found.update([zlib.crc32(w) % plan.buckets for w in words])
            continue
        for word in words:
            tails = [zlib.crc32(word), *[zlib.crc32(word, zlib.crc32(b" ", t)) for t in tails[: plan.n - 1]]]
            found.update([t % plan.buckets for t in tails])
    return n_words, found


def bucket_counts(docs: DataFrame, text: str = "text", plan: Plan = PLAN) -> np.ndarray:
    """Occurrences of each bucket in all texts: a table of ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for value in raw(batch.column("text")):
                total.update(features(value, plan)[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (total.keys(), total.values())], names=["bucket", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(plan.buckets, dtype=np.int64)
    for r in counted.collect():
        table[r["bucket"]] = r["n"]
    return table


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(doc_id: int | None, seed: str = PLAN.seed) -> int:
    """A Gumbel value in thousandths, drawn from the id."""
    h = int(hashlib.sha256((seed + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", plan: Plan = PLAN) -> DataFrame:
    """One row per row: doc_id, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.tolist()
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for i, value in zip(piece.column("doc_id").to_pylist(), raw(piece.column("text")), strict=True):
                    n_words, found = features(value, plan)
                    weight = sum(gain[b] * n for b, n in found.items())
                    rows.append((i, n_words, found.total(), weight, weight + gumbel(i, plan.seed)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def drawn(weighted: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The rows of ``weights`` with ``rank``: 1, 2, 3 ... of those drawn, null of the others."""
    able = F.col("n_words") >= plan.least_words
    keyed = weighted.withColumn("_below", F.when(able, -F.col("score")))
    ranged = with_segment(keyed.filter(able), "_below", ["doc_id"])
    per_range = ranged.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = cut_lineage(per_range.select("_seg", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all")))
    inside = F.row_number().over(Window.partitionBy("_seg").orderBy("_below", F.col("doc_id").asc_nulls_first()))
    place = F.col("_before") + F.col("_inside")
    numbered = ranged.withColumn("_inside", inside).join(before, "_seg").withColumn("rank", F.when(place <= F.expr(f"({plan.percent} * _all) div 100"), place).cast("bigint"))
    columns = [*weighted.columns, "rank"]
    others = weighted.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return numbered.select(*columns).unionByName(others.select(*columns))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = PLAN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text, plan), bucket_counts(target, text, plan))
    return drawn(cut_lineage(weights(docs, gain, doc_id, text, plan)), plan)
