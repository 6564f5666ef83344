"""Exact duplicates over a sharded cuckoo-filter index of live text digests.

A text's digest is SHA-256 over its UTF-8 bytes with A-Z lower-cased; a null text counts
as empty. Digests are spread over shards by their leading bytes. A shard holds a cuckoo
filter of 16-bit fingerprints beside the stored digests with their row count and largest
``doc_id``. Arriving digests ask the filter first: a miss is new and inserted without
looking at the content; a hit is verified against the stored digests. Deletion lowers the
count and, with the last row, takes the fingerprint out. When an insertion runs out of
kicks, the filter doubles and is refilled from the stored digests.

Defined cases: null ids lose against any id and stay only among themselves; of rows that
repeat both id and text exactly one stays; an empty table gives no rows; columns other
than id and text are never looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.session import cut_lineage

SHARD_KEYS = 50_000  # stored digests a shard is laid out for
SALTS = 8  # a digest arrives as this many pre-aggregated rows at most
KICKS = 200
SLOTS = 4
INDEX = "shard int, digest binary, keep_id bigint, n bigint, slots binary"


class CuckooFilter:
    """Approximate set with deletion: 16-bit fingerprints in buckets of four."""

    def __init__(self, capacity: int = 64):
        self.n_buckets = 1 << max(4, int(capacity / (SLOTS * 0.9)).bit_length())
        self.slots = [0] * (self.n_buckets * SLOTS)
        self.turn = 0

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.slots = np.frombuffer(data, dtype="<u2").tolist()
        out.n_buckets, out.turn = len(out.slots) // SLOTS, 0
        return out

    def dump(self) -> bytes:
        return np.array(self.slots, dtype="<u2").tobytes()

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & (self.n_buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.n_buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._place(digest)
        s = self.slots
        return mark in s[one * SLOTS : one * SLOTS + SLOTS] or mark in s[two * SLOTS : two * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when no place was found; the filter must then be rebuilt from the stored keys."""
        mark, one, two = self._place(digest)
        if self._put(one, mark) or self._put(two, mark):
            return True
        bucket = two
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            i = bucket * SLOTS + self.turn
            mark, self.slots[i] = self.slots[i], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Only for digests that are known to be in the set."""
        mark, one, two = self._place(digest)
        for bucket in (one, two):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return


class Shard:
    """One shard: the filter and the stored digests with [largest id, rows]."""

    def __init__(self, content: dict[bytes, list], slots: bytes | None):
        self.content = content
        self.filter = CuckooFilter.load(slots) if slots else CuckooFilter(max(64, len(content)))
        if not slots and content:
            self._refill()

    def _refill(self) -> None:
        while not all(self.filter.insert(d) for d in self.content):
            self.filter = CuckooFilter(2 * SLOTS * self.filter.n_buckets)

    def add(self, digest: bytes, keep, n: int) -> None:
        held = self.content.get(digest) if digest in self.filter else None
        if held is not None:
            held[0] = keep if held[0] is None else held[0] if keep is None else max(held[0], keep)
            held[1] += n
            return
        self.content[digest] = [keep, n]
        if not self.filter.insert(digest):
            self.filter = CuckooFilter(2 * SLOTS * self.filter.n_buckets)
            self._refill()

    def remove(self, digest: bytes, keep, n: int) -> None:
        """Take n rows out; ``keep`` is the largest id among those left."""
        held = self.content.get(digest) if digest in self.filter else None
        if held is None:
            return
        if held[1] <= n:
            self.filter.delete(digest)
            del self.content[digest]
        else:
            self.content[digest] = [keep, held[1] - n]


@F.arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer().to_pybytes().lower() if t.is_valid else b"").digest() for t in text], pa.binary())


def _id(value):
    return None if pd.isna(value) else int(value)


def _rows(shard: int, state: Shard) -> pd.DataFrame:
    digests = list(state.content)
    return pd.DataFrame(
        {
            "shard": [shard] * (len(digests) + 1),
            "digest": [*digests, None],
            "keep_id": pd.array([*(v[0] for v in state.content.values()), None], dtype="Int64"),
            "n": [*(v[1] for v in state.content.values()), len(digests)],
            "slots": [*[None] * len(digests), state.filter.dump()],
        }
    )


def _apply(key: tuple, held: pd.DataFrame, arriving: pd.DataFrame) -> pd.DataFrame:
    stored = held[held["digest"].notna()]
    slots = next(iter(held.loc[held["digest"].isna(), "slots"]), None)
    state = Shard({d: [_id(k), int(n)] for d, k, n in zip(stored["digest"], stored["keep_id"], stored["n"], strict=True)}, slots)
    for digest, keep, n in zip(arriving["digest"], arriving["keep_id"], arriving["n"], strict=True):
        if n > 0:
            state.add(digest, _id(keep), int(n))
        else:
            state.remove(digest, _id(keep), int(-n))
    return _rows(int(key[0]), state)


@dataclass(frozen=True)
class DigestIndex:
    """Live rows (``doc_id, digest``) and the shards' filters and stored digests."""

    members: DataFrame
    shards: DataFrame
    n_shards: int

    @property
    def content(self) -> DataFrame:
        return self.shards.filter(F.col("digest").isNotNull()).select("digest", "keep_id", "n")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(F.col(text)).alias("digest"))


def _shard(n: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def _arriving(members: DataFrame, n_shards: int) -> DataFrame:
    """Pre-aggregated rows of a batch; the salt spreads a digest that very many rows share."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    return members.groupBy(_shard(n_shards).alias("shard"), "digest", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("salt")


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int | None = None) -> DigestIndex:
    """Index all rows of ``docs``; the number of shards follows the number of rows."""
    members = cut_lineage(digests(docs, doc_id, text))
    n_shards = n_shards or max(1, -(-members.count() // SHARD_KEYS))
    empty = pd.DataFrame({"digest": [], "keep_id": [], "n": [], "slots": []})

    def start(key: tuple, arriving: pd.DataFrame) -> pd.DataFrame:
        return _apply(key, empty, arriving)

    shards = _arriving(members, n_shards).groupBy("shard").applyInPandas(start, INDEX)
    return DigestIndex(members, cut_lineage(shards), n_shards)


def _update(index: DigestIndex, arriving: DataFrame) -> DataFrame:
    return cut_lineage(index.shards.groupBy("shard").cogroup(arriving.groupBy("shard")).applyInPandas(_apply, INDEX))


def insert(index: DigestIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DigestIndex:
    """The index with the rows of a further batch."""
    new = cut_lineage(digests(docs, doc_id, text))
    return DigestIndex(index.members.unionByName(new), _update(index, _arriving(new, index.n_shards)), index.n_shards)


def delete(index: DigestIndex, gone: DataFrame, doc_id: str = "doc_id") -> DigestIndex:
    """The index without the rows whose id is in ``gone``."""
    ids = gone.select(F.col(doc_id).cast("bigint").alias("doc_id")).distinct()
    left = cut_lineage(index.members.join(ids, "doc_id", "left_anti"))
    taken = index.members.join(ids, "doc_id", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    keep = left.join(taken.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    arriving = taken.join(keep, "digest", "left").select(_shard(index.n_shards).alias("shard"), "digest", "keep_id", (-F.col("n")).alias("n"))
    return DigestIndex(left, _update(index, arriving), index.n_shards)


def lookup(index: DigestIndex) -> DataFrame:
    """One row per live row: doc_id, digest, keep_id, group_size, kept."""
    rows = index.members.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    found = rows.join(index.content, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows with equal texts, the one with the largest id; all columns stay."""
    keep = lookup(build(docs, doc_id, text)).filter("kept").select(F.col("doc_id").alias("keep"), "digest")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("id"), text_digest(F.col(text)).alias("found"))
    one = F.row_number().over(Window.partitionBy("keep", "digest").orderBy(F.lit(1)))
    same = rows["id"].eqNullSafe(keep["keep"]) & (rows["found"] == keep["digest"])
    return rows.join(keep, same).withColumn("copy", one).filter("copy = 1").select("row.*")
