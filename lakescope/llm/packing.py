"""Best-fit packing of documents into sequences of ``capacity`` words, with conflicts.

A text is cut into parts of at most ``capacity`` words, so nothing is dropped. Parts are
dealt to shards by a hash and placed in order of falling length: the open bins of a shard
are ordered by residual space, and from the smallest residual that fits the successor
search goes on until a bin is found whose source and duplicate-cluster bitmaps are
disjoint from the part's. ``near_clusters`` gives the components of near copies as
clusters; ``measure`` alone knows word-identical copies only (``same``), which is enough
where one document of each component is left. Otherwise a bin is opened. So no bin holds two documents of one
source or of one cluster. A shard holds about ``SHARD_PARTS`` parts, whatever the size of
the corpus, and each source and cluster is spread over all shards.

Defined cases: a null or empty text is one part of no words and is placed like any other;
a null source or cluster conflicts with nothing; rows that repeat are placed each (they
share a cluster, so never in one bin); ties in length go by id, then part. Rows are told
apart by id and ``tie``, a hash of the text, so ids that repeat or are null do no harm; rows
that agree in both are parts of the same text as often as there are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm import jaccard_join
from lakescope.llm.words import NONSPACE, Words, pieces
from lakescope.session import cut_lineage

CAPACITY = 2048
SHARD_PARTS = 8_000
PLACED = "doc_id bigint, tie bigint, part int, first bigint, n_words int, bin_id bigint, offset int"


class Bins:
    """Open bins by residual; those of one residual by their source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.residuals = 0  # bit r: some bin has residual r
        self.used: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a part; ``source`` and ``cluster`` are one-bit maps or 0."""
        left = self.residuals >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            for held, bins in self.open[r].items():
                if held & source:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not self.clusters[bins[i]] & cluster:
                        return self._fill(bins.pop(i), r, held, bins, size, source, cluster)
            left &= left - 1
        self.used.append(0)
        self.clusters.append(0)
        return self._fill(len(self.used) - 1, None, 0, None, size, source, cluster)

    def _fill(self, b: int, r, held: int, bins, size: int, source: int, cluster: int) -> tuple[int, int]:
        if bins is not None and not bins:
            del self.open[r][held]
            if not self.open[r]:
                self.residuals &= ~(1 << r)
        offset = self.used[b]
        self.used[b] += size
        self.clusters[b] |= cluster
        r = self.capacity - self.used[b]
        self.open[r].setdefault(held | source, []).append(b)
        self.residuals |= 1 << r
        return b, offset


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "part", "tie"], ascending=[False, True, True, True], na_position="last")
        sources = {s: 1 << i for i, s in enumerate(sorted(rows["source"].dropna().unique()))}
        counts = rows["cluster"].value_counts()
        shared = {c: 1 << i for i, c in enumerate(sorted(counts.index[counts > 1]))}  # a cluster with one part here conflicts with nothing
        bins, placed = Bins(capacity), []
        for size, source, cluster in zip(rows["n_words"].tolist(), rows["source"], rows["cluster"], strict=True):
            placed.append(bins.place(int(size), sources.get(source, 0), shared.get(cluster, 0)))
        out = rows[["doc_id", "tie", "part", "first", "n_words"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        out["offset"] = [o for _, o in placed]
        return out

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            words = Words(piece.column("text"), NONSPACE)
            digests = [hashlib.blake2b(words.hashes[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
            columns = [*(piece.column(c) for c in ("doc_id", "tie", "source")), pa.array(words.counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "source", "n_words", "same"])


def _rows(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("tie"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, tie, source, number of words, and ``same``: a key of the sequence of words."""
    return _rows(docs, doc_id, text, source).mapInArrow(_measure, "doc_id bigint, tie bigint, source string, n_words bigint, same string")


def near_clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rule: jaccard_join.Rule = jaccard_join.NEAR) -> DataFrame:
    """doc_id, tie, source, n_words and ``cluster``: the component of near copies, null for texts without words."""
    found = jaccard_join.similar_documents(_rows(docs, doc_id, text, source), rule=rule, keep=("tie", "source"))
    return found.select("doc_id", "tie", "source", "n_words", F.when(F.col("n_shingles") > 0, F.col("first").cast("string")).alias("cluster"))


def pack(measured: DataFrame, cluster: str = "same", capacity: int = CAPACITY) -> DataFrame:
    """One row per part: doc_id, tie, part, first word, words, bin and place in it."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n_words") / capacity).cast("int") - 1)
    parts = measured.select("doc_id", "tie", "source", F.col(cluster).alias("cluster"), "n_words", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    first = F.col("part").cast("bigint") * capacity
    parts = cut_lineage(parts.select("doc_id", "tie", "source", "cluster", "part", first.alias("first"), F.least(F.lit(capacity), F.col("n_words") - first).cast("int").alias("n_words")))
    shards = max(1, -(-parts.count() // SHARD_PARTS))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "part"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), PLACED)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The placed parts with their texts; a document's parts joined in order are its text."""
    where = placed.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list(F.struct("part", "first", "n_words", "bin_id", "offset"))).alias("parts"))
    where = where.withColumnRenamed("tie", "at")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    if docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(doc_id).alias("ids")).filter("rows <> ids").count():
        rows = rows.dropDuplicates(["id", "tie"])  # rows that repeat have their parts as often
    rows = rows.join(where, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tie") == F.col("at"))).select("doc_id", "tie", "text", "parts")
    return rows.mapInArrow(_cut(capacity), f"{PLACED}, text string")


def _cut(capacity: int):
    """Each text cut before every ``capacity``-th word, with the places of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "first", "n_words", "bin_id", "offset"]
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, at, places, texts = Words(piece.column("text"), NONSPACE), [], [], []
                for i, parts in enumerate(piece.column("parts").to_pylist()):
                    a, b = words.offsets[i], words.offsets[i + 1]
                    cuts = [a, *words.starts[words.bounds[i] : words.bounds[i + 1]][capacity::capacity].tolist(), b]
                    for p in parts:
                        at.append(i)
                        places.append(tuple(p[n] for n in names))
                        texts.append(words.raw[cuts[p["part"]] : cuts[p["part"] + 1]].tobytes().decode("utf-8", "replace"))
                columns = list(zip(*places, strict=True)) if places else [[]] * 5
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "tie")], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(texts, pa.string())],
                    names=["doc_id", "tie", *names, "text"],
                )

    return run
