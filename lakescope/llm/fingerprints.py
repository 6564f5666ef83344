"""Document fingerprints: the hashes of a text's shingles below a fixed fraction of all hashes.

A shingle is a run of five words (white space apart, A-Z lower-cased), or all words of a
shorter text. A word's hash is the first 32 bits of its MD5; a shingle's hash joins two
polynomials over them modulo 2**31 - 1, so it has 62 bits and needs no text built. The
fingerprint keeps **every** hash below ``1 / FRACTION`` of the range, so its size follows
the text and the share of a fingerprint found in another estimates containment however
unequal the two are. If no hash is that small the smallest one is kept.

Fingerprints merge: of the union of two, the hashes below the fraction, or else the
smallest, are the fingerprint of the two sets together (``merge``, in rows of one hash, as
the fingerprint of a large group does not fit into one row).

``with_neighbours`` hands each document the next one in descending order of id: ids alone
are cut into ranges, whole texts are dealt by range and streamed in order, and the first
document of each range is lent to the range before. No task holds more than two documents.

Defined cases: a null text is empty; texts without words have the empty fingerprint, which
is like another empty one (1) and unlike all else (0); null ids come last; rows that repeat
an id follow each other by a hash of their text; the only document follows itself; an
empty table gives no rows. Other columns than id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.byte_words import NONSPACE_TABLE, raw, word_lists
from lakescope.operators.segments import with_segment

K = 5
FRACTION = 8
# The modulus, and the bases of the two polynomials.
MODULUS = (1 << 31) - 1
BASES = (1_000_003, 1_566_083_941)
LIMIT = (1 << 62) // FRACTION
CACHE = 1 << 20  # words whose hash a task remembers
DIGITS = 16
SKETCH = "doc_id bigint, n_chars bigint, hashes array<bigint>"
NEIGHBOURS = "doc_id bigint, n_chars bigint, edited_sha256 string, hashes array<bigint>, edited_hashes array<bigint>, next_hashes array<bigint>"
U = np.uint64


class WordHashes(dict):
    """32-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return value


def sketch(text: bytes, hashes: WordHashes, k: int = K, limit: int = LIMIT) -> np.ndarray:
    """The fingerprint of a text: sorted, distinct 62-bit values."""
    w = [np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)) for words in word_lists(text, NONSPACE_TABLE)]
    if not w:
        return np.zeros(0, dtype=np.int64)
    w = w[0] if len(w) == 1 else np.concatenate(w)
    run = min(k, len(w))
    n, halves = len(w) - run + 1, []
    for base in BASES:
        v = np.zeros(n, dtype=np.uint64)
        for i in range(run):
            v = (v * U(base) + w[i : n + i]) % U(MODULUS)
        halves.append(v)
    value = ((halves[0] << U(31)) | halves[1]).view(np.int64)
    small = value[value < limit]
    return np.unique(small) if len(small) else value.min(keepdims=True)


def fingerprint(hashes: Column) -> Column:
    """The hashes as text: ``DIGITS`` hex digits each, ascending."""
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) > 0, both / F.size(a)).otherwise(F.when(F.size(b) > 0, 0.0).otherwise(1.0))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 if both are empty. The larger of the smallest hashes does not bias it much."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(1.0)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, limit: int = LIMIT) -> DataFrame:
    """One row per row: doc_id, n_chars, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            hashes = [sketch(t, known, k, limit) for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "n_chars", "hashes"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_chars"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SKETCH)


def merge(sketched: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame:
    """Fingerprints of groups as rows (*by, hash): groups of any size, combined before the shuffle."""
    rows = sketched.select(*by, F.explode("hashes").alias("hash")).distinct()
    least = rows.groupBy(*by).agg(F.min("hash").alias("hash"))
    return rows.filter(F.col("hash") < limit).unionByName(least.filter(F.col("hash") >= limit))


def group_containment(merged: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """For asked pairs of groups (``a_*``, ``b_*`` of ``by``): share of the hashes of a that b has."""
    left = merged.select(*[F.col(c).alias(f"a_{c}") for c in by], "hash")
    right = merged.select(*[F.col(c).alias(f"b_{c}") for c in by], "hash", F.lit(1).alias("hit"))
    asked = pairs.select(*[f"{s}_{c}" for s in "ab" for c in by]).distinct()
    found = asked.join(left, [f"a_{c}" for c in by]).join(right, [*[f"b_{c}" for c in by], "hash"], "left")
    return found.groupBy(*asked.columns).agg((F.count("hit") / F.count(F.lit(1))).alias("containment"))


def edit(own: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, and those of its edited text and of the next document by descending id."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = with_segment(rows.select("doc_id", "tie"), "doc_id", ["tie"])
    ends = ranged.groupBy("_seg").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")).alias("low"), F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")).alias("high"))
    found = sorted(ends.collect(), key=lambda r: r["_seg"])  # one row per range
    if not found:
        return docs.sparkSession.createDataFrame([], NEIGHBOURS)
    key = [[(r["has"], r["doc_id"] or 0, r["tie"]) for r in (e["low"], e["high"])] for e in found]
    lows, highs = [k[0] for k in key], [k[1] for k in key]
    n = len(found)

    @F.pandas_udf("struct<range: int, first: boolean>")
    def place(ids: pd.Series, has: pd.Series, ties: pd.Series) -> pd.DataFrame:
        keys = list(zip(has.tolist(), ids.tolist(), ties.tolist(), strict=True))
        at = [bisect_right(lows, k) - 1 for k in keys]
        return pd.DataFrame({"range": at, "first": [highs[a] == k for a, k in zip(at, keys, strict=True)]})

    known = F.col("doc_id").isNotNull()
    placed = rows.withColumn("at", place(F.coalesce("doc_id", F.lit(0)), known, "tie"))
    own = F.struct(F.col("at.range").alias("range"), F.lit(False).alias("lent"))
    lent = F.struct(F.pmod(F.col("at.range") + 1, F.lit(n)).cast("int").alias("range"), F.lit(True).alias("lent"))
    copies = placed.select("doc_id", "text", "tie", F.inline(F.when(F.col("at.first"), F.array(own, lent)).otherwise(F.array(own))))
    dealt = copies.repartitionById(n, "range").sortWithinPartitions("range", "lent", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("doc_id", "text", "lent").mapInArrow(_stream, NEIGHBOURS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range in order: a row is complete when its successor has come; what is lent comes last and only ends the range."""
    known, before, done = WordHashes(), None, False
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
    names = [f.split()[0] for f in NEIGHBOURS.split(", ")]
    for batch in batches:
        out, held = [], 0
        for i, text, lent in zip(*(batch.column(c) for c in ("doc_id", "text", "lent")), strict=True):
            if done:
                break
            text = text.as_py()
            own = sketch(text.encode(), known)
            if before is not None:
                edited = edit(before[1], text).encode()
                out.append((before[0], len(before[1]), hashlib.sha256(edited).hexdigest(), before[2], sketch(edited, known), own))
                held += len(edited)
            before, done = (i.as_py(), text, own), lent.as_py()
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
