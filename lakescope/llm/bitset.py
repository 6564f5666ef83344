"""A set of 64-bit hashes folded into a bit table of fixed size.

The size does not depend on the data, so the table may be collected and broadcast; a
set that outgrows it only lets more candidates through to the exact join behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2**24 bits: 2 MB


def _words(hashes: DataFrame, column: str | Column, bits: int) -> DataFrame:
    """The words of the table that are not 0: word, bit."""
    h = F.col(column) if isinstance(column, str) else column
    place = F.shiftrightunsigned(h, 64 - bits)
    return (
        hashes.select(place.alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
    )


def collect(hashes: DataFrame, column: str | Column, bits: int = BITS) -> np.ndarray:
    """The table of all values of a bigint column, as 64-bit words."""
    rows = _words(hashes, column, bits).collect()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if rows:
        table[[r["word"] for r in rows]] = np.array([r["bit"] for r in rows], dtype=np.int64).view(np.uint64)
    return table


def marked(rows: DataFrame, key: str, among: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``rows`` with ``marked``: false only if no row of ``among`` has its key. No row is moved."""
    words = _words(among, F.xxhash64(column), bits).select(F.col("word").alias("_word"), F.col("bit").alias("_bit"))
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    at = rows.withColumns({"_word": F.shiftright(place, 6), "_place": place})
    hit = F.coalesce(F.expr("_bit & shiftleft(1L, cast(_place % 64 as int))"), F.lit(0)) != 0
    return at.join(F.broadcast(words), "_word", "left").withColumn("marked", hit).drop("_word", "_place", "_bit")


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    place = hashes >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
