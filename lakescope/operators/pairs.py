"""Joins of rows that share a key, safe when one key holds a large share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2_000


def with_blocks(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Cut the rows of each key into ``_nblk`` hash blocks of about ``block`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    hot = sizes.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_n") / block).cast("int").alias("_hot"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_h_{k}"))
    blocks = F.coalesce("_hot", F.lit(1))
    return (
        df.join(hot, cond, "left")
        .withColumn("_nblk", blocks)
        .withColumn("_blk", F.pmod(F.xxhash64(*row_id), blocks).cast("int"))
        .drop("_hot", *[f"_h_{k}" for k in keys])
    )


def self_pairs(
    df: DataFrame, keys: Sequence[str], row_id: Sequence[str], where: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """Every unordered pair of different rows with equal keys, as structs ``l``, ``r``.

    The pairs of one key are spread over (block, block) units, so a hot key is
    worked on by many tasks and no unit joins more than ``block`` by ``block``
    rows. ``where`` may restrict the pairs in terms of ``l`` and ``r``.
    """
    rows = with_blocks(df, keys, row_id, block)
    body = F.struct(*[F.col(c) for c in df.columns])
    left = rows.select(
        *[F.col(k).alias(f"_l_{k}") for k in keys],
        F.col("_blk").alias("_lu"),
        F.explode(F.sequence("_blk", F.col("_nblk") - 1)).alias("_lv"),
        body.alias("l"),
    )
    right = rows.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.explode(F.sequence(F.lit(0), "_blk")).alias("_ru"),
        F.col("_blk").alias("_rv"),
        body.alias("r"),
    )
    cond = (F.col("_lu") == F.col("_ru")) & (F.col("_lv") == F.col("_rv"))
    for k in keys:
        cond = cond & (F.col(f"_l_{k}") == F.col(f"_r_{k}"))
    once = (F.col("_lu") < F.col("_lv")) | (
        F.struct(*[F.col(f"l.{c}") for c in row_id]) < F.struct(*[F.col(f"r.{c}") for c in row_id])
    )
    out = left.join(right, cond & once)
    if where is not None:
        out = out.filter(where)
    return out.select("l", "r")
