"""Benchmark passages in documents: winnowed fingerprints find them, windows confirm them.

Words are runs of ASCII letters and digits and all characters beyond ASCII, with A-Z
lower-cased. An item's windows are its runs of ``WINDOW`` words; a shorter item is one
window. Documents and items keep the smallest hash of every ``WINDOW - K + 1`` consecutive
k-grams (winnowing), so any shared run of ``WINDOW`` words shares a kept fingerprint.
Document fingerprints that are in no item are discarded before anything is shuffled: the
items' fingerprints are folded into a bit table of fixed size. Around each remaining hit
the windows that contain it are joined with the items' windows by their words, so the
result is exact. Items shorter than a window are looked up at every position, for the
lengths that occur.

Defined cases: a null or empty text has no words; every row of ``docs`` gets a row, also
when rows repeat; items without words are ignored; an item without id marks words, but is
neither counted nor listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm import bitset
from lakescope.llm.words import ALNUM, Words, grams, pieces

WINDOW = 10
K = 5


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the first of equals) of every ``width`` in a row."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    at = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1) + np.arange(len(hashes) - width + 1)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for piece_at, piece in _located(batch, "text"):
            words, at, size, key, marks = Words(piece.column("text"), ALNUM), [], [], [], []
            for i in range(piece.num_rows):
                a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                n = min(WINDOW, b - a)
                for j in range(a, b - n + 1) if n else ():
                    at.append(piece_at + i)
                    size.append(n)
                    key.append(words.text(j, j + n))
                    g = grams(words.hashes[j : j + n], K if n == WINDOW else n)
                    marks.append(int(np.int64(g.min().view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(key, pa.string()), pa.array(marks, pa.int64())],
                names=["item_id", "size", "key", "mark"],
            )


def _located(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    at = 0
    for piece in pieces(batch, column):
        yield at, piece
        at += piece.num_rows


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per window of each item: its words, their number and its winnowed fingerprint."""
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_item_windows, "item_id string, size int, key string, mark bigint")


def _candidates(table: np.ndarray, short: list[int]):
    inner = WINDOW - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("key", pa.string())]))
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, found = Words(piece.column("text"), ALNUM), []
                for i in range(piece.num_rows):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    h, spans = words.hashes[a:b], set()
                    if b - a >= WINDOW:
                        g = grams(h, K)
                        at = winnow(g, inner + 1)
                        for p in at[bitset.holds(table, g[at])].tolist():
                            spans.update((s, WINDOW) for s in range(max(0, p - inner), min(p, b - a - WINDOW) + 1))
                    for n in short:
                        spans.update((s, n) for s in np.flatnonzero(bitset.holds(table, grams(h, n))).tolist())
                    found.append([{"start": s, "size": n, "key": words.text(a + s, a + s + n)} for s, n in sorted(spans)] or None)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("uid"), piece.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(found, kind)],
                    names=["uid", "doc_id", "n_words", "found"],
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, ``spans`` of matched windows (word start and size) and ``items`` found."""
    windows = item_windows(items, item_id, item_text)
    table = bitset.collect(windows, "mark")
    short = sorted(r["size"] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # nine values at most
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "uid bigint, doc_id bigint, n_words bigint, found array<struct<start: int, size: int, key: string>>"
    asked = rows.mapInArrow(_candidates(table, short), schema).select("uid", "doc_id", "n_words", F.explode_outer("found").alias("w"))
    nothing = F.concat(F.lit("\0"), F.col("uid").cast("string"))  # no word holds it, and it spreads the rows
    asked = asked.select("uid", "doc_id", "n_words", F.struct("w.start", "w.size").alias("span"), F.coalesce("w.key", nothing).alias("key"))
    held = windows.select("key", F.col("item_id").alias("item"), F.lit(True).alias("hit")).distinct()
    return (
        asked.join(held, "key", "left")
        .groupBy("uid", "doc_id", "n_words")
        .agg(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("span")))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        .drop("uid")
    )


def covered(spans: str) -> str:
    """SQL for the number of words under sorted spans."""
    return (
        f"aggregate({spans}, named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct("
        "'upto', greatest(a.upto, s.start + s.size), "
        "'n', a.n + greatest(0, s.start + s.size - greatest(a.upto, s.start))), a -> a.n)"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window; rows that share an id share their fate."""
    bad = contamination(docs, items, doc_id, text).filter(F.size("spans") > 0).select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("id"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
