"""Ordered operators that stay parallel inside one hot key.

A plain window sends every row of a key to one task. Here the table is cut by ranges of
order column and tiebreak into as many segments as the session has shuffle partitions, the
window runs per (key, segment), and a small per-segment aggregate carries the missing
prefix across segments. With S segments no task sorts more than about 1/S of the table even
if one key holds all of it and many rows share one order value, and results equal the plain
window. The cut table is written once to the shared folder and read by all steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.session import cut_lineage


def with_segment(df: DataFrame, order: str, tiebreak: Sequence[str] = (), segments: int | None = None) -> DataFrame:
    """The rows with ``_seg``: their range of (order, tiebreak) over the whole table.

    Any orderable type will do; nulls come first. The number of segments follows
    ``spark.sql.shuffle.partitions``, the setting by which a session is fitted to its data.
    """
    segments = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(segments, F.col(order).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in tiebreak])
    return cut_lineage(ranged.withColumn("_seg", F.spark_partition_id()))


def _carry(seg: DataFrame, by: Sequence[str], aggs: Sequence[Column], before: dict[str, Column]) -> DataFrame:
    """Per (key, segment) aggregates, then ``before`` over a key's earlier segments."""
    per_seg = seg.groupBy(*by, "_seg").agg(*aggs)
    w = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return per_seg.select(*by, "_seg", *[expr.over(w).alias(name) for name, expr in before.items()])


def _attach(rows: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality of the keys."""
    renamed = extra.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return rows.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in keys])


def ranks(df: DataFrame, by: Sequence[str], order: str, tiebreak: Sequence[str], segments: int | None = None) -> DataFrame:
    """Add ``row_number``, ``rank``, ``dense_rank`` and ``group_rows`` per key."""
    seg = with_segment(df, order, tiebreak, segments)
    local = seg.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_seg").orderBy(order, *tiebreak)))
    rows_before = _carry(seg, by, [F.count(F.lit(1)).alias("_rows")], {"_rows_before": F.sum("_rows")})
    # ranks belong to order values: one row per key and value, whatever number of rows shares it
    values = seg.groupBy(*by, order).agg(F.count(F.lit(1)).alias("_n"), F.min("_seg").alias("_seg"))
    in_order = Window.partitionBy(*by, "_seg").orderBy(order)
    placed = values.select(
        *by,
        order,
        "_seg",
        F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_less"),
        F.row_number().over(in_order).alias("_dr"),
    )
    earlier = _carry(
        values,
        by,
        [F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_vals")],
        {"_less_before": F.sum("_rows"), "_vals_before": F.sum("_vals")},
    )
    zero = F.lit(0)
    ranked = _attach(placed, earlier, [*by, "_seg"]).select(
        *by,
        order,
        (F.coalesce("_less", zero) + F.coalesce("_less_before", zero) + 1).alias("_rank"),
        (F.col("_dr") + F.coalesce("_vals_before", zero)).alias("_dense"),
    )
    totals = values.groupBy(*by).agg(F.sum("_n").alias("group_rows"))
    out = _attach(_attach(_attach(local, rows_before, [*by, "_seg"]), ranked, [*by, order]), totals, by)
    return out.select(
        *df.columns,
        (F.col("_rn") + F.coalesce("_rows_before", zero)).alias("row_number"),
        F.col("_rank").alias("rank"),
        F.col("_dense").alias("dense_rank"),
        "group_rows",
    )


def ntile(n: int) -> Column:
    """The n-tile of a row from ``row_number`` and ``group_rows``."""
    rn, total = F.col("row_number"), F.col("group_rows")
    size, extra = F.expr(f"group_rows div {n}"), total % n
    big = extra * (size + 1)
    return (
        F.when(rn <= big, F.ceil(rn / (size + 1)))
        .otherwise(extra + F.ceil((rn - big) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    tiebreak: Sequence[str],
    value: str,
    alias: str,
    segments: int | None = None,
) -> DataFrame:
    """Sum of ``value`` from the start of the key up to and including the row."""
    seg = with_segment(df, order, tiebreak, segments)
    w = Window.partitionBy(*by, "_seg").orderBy(order, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.withColumn("_run", F.sum(value).over(w))
    carry = _carry(seg, by, [F.sum(value).alias("_s")], {"_before": F.sum("_s")})
    total = F.when(F.col("_run").isNull(), F.col("_before")).otherwise(
        F.col("_run") + F.coalesce(F.col("_before"), F.lit(0))
    )
    return _attach(local, carry, [*by, "_seg"]).select(*df.columns, total.alias(alias))


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    tiebreak: Sequence[str],
    value: str,
    segments: int | None = None,
) -> DataFrame:
    """Add ``lag``, ``lead``, ``first``, ``last`` and ``last_known`` of ``value``.

    ``last_known`` is the latest non-null value up to the row.
    """
    seg = with_segment(df, order, tiebreak, segments)
    ordered = Window.partitionBy(*by, "_seg").orderBy(order, *tiebreak)
    boxed = F.struct(F.col(value).alias("v"))
    key = F.struct(F.col(order), *[F.col(t) for t in tiebreak])
    local = seg.select(
        "*",
        F.lag(boxed).over(ordered).alias("_lag"),
        F.lead(boxed).over(ordered).alias("_lead"),
        F.last(value, ignorenulls=True)
        .over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        .alias("_known"),
    )
    ends = seg.groupBy(*by, "_seg").agg(
        F.min_by(boxed, key).alias("_first"),
        F.max_by(boxed, key).alias("_last"),
        F.max_by(value, F.when(F.col(value).isNotNull(), key)).alias("_last_known"),
    )
    order_seg = Window.partitionBy(*by).orderBy("_seg")
    whole = Window.partitionBy(*by)
    before = order_seg.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *by,
        "_seg",
        F.lag("_last").over(order_seg).alias("_prev"),
        F.lead("_first").over(order_seg).alias("_next"),
        F.last("_last_known", ignorenulls=True).over(before).alias("_known_before"),
        F.min_by("_first", "_seg").over(whole).alias("_first_all"),
        F.max_by("_last", "_seg").over(whole).alias("_last_all"),
    )
    return _attach(local, carry, [*by, "_seg"]).select(
        *df.columns,
        F.coalesce("_lag", "_prev")["v"].alias("lag"),
        F.coalesce("_lead", "_next")["v"].alias("lead"),
        F.col("_first_all")["v"].alias("first"),
        F.col("_last_all")["v"].alias("last"),
        F.coalesce("_known", "_known_before").alias("last_known"),
    )


def trailing_sum(df: DataFrame, by: Sequence[str], ts: str, value: str, days: int, alias: str) -> DataFrame:
    """Sum over the trailing RANGE of ``days`` days (all rows of the current time included).

    Rows are added up per (key, time) first. A frame is then the prefix of its last segment,
    the totals of the segments between, and what its first segment holds behind the last time
    before the frame, which an as-of join finds; only prefixes of one segment are subtracted,
    so doubles are rounded as in the running sum of one segment, not of the whole key. Rows
    without a time form one frame per key; a frame without values sums to null.
    """
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(*[F.col(c) for c in by])
    per = cut_lineage(df.groupBy(key.alias("_k"), moment.alias("_t")).agg(F.sum(value).alias("_v"), F.count(value).alias("_n")))
    seg = with_segment(per.filter("_t IS NOT NULL"), "_t", ["_k"])
    so_far = Window.partitionBy("_k", "_seg").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut_lineage(seg.select("_k", "_t", F.col("_seg").alias("_own"), F.coalesce(F.sum("_v").over(so_far), F.lit(0)).alias("_upto"), F.sum("_n").over(so_far).alias("_count")))
    totals = seg.groupBy("_k", "_seg").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("v"), F.sum("_n").alias("n"))
    totals = totals.groupBy("_k").agg(F.collect_list(F.struct("_seg", "v", "n")).alias("_totals"))  # one entry per segment
    left = local.withColumn("_from", F.col("_t") - F.lit(days * 86_400_000_000) - 1)
    right = local.select("_k", F.col("_t").alias("_at"), F.col("_own").alias("_aseg"), F.col("_upto").alias("_aupto"), F.col("_count").alias("_acount"))
    found = asof_join(left, right, ["_k"], "_from", "_at", ["_aseg", "_aupto", "_acount"], how="left")
    placed = _attach(found, totals, ["_k"])

    def frame(upto: str, total: str) -> Column:
        before = F.col(f"_a{upto[1:]}")
        between = F.filter("_totals", lambda x: (x["_seg"] < F.col("_own")) & (x["_seg"] > F.coalesce(F.col("_aseg"), F.lit(-1))))
        first = F.filter("_totals", lambda x: x["_seg"] == F.col("_aseg"))[0][total]
        whole = F.aggregate(F.transform(between, lambda x: x[total]), F.lit(0).cast(seg_types[total]), lambda acc, x: acc + x)
        apart = F.col(upto) + whole
        return F.when(F.col("_aseg").isNull(), apart).when(F.col("_aseg") == F.col("_own"), F.col(upto) - before).otherwise(apart + first - before)

    entry = totals.schema["_totals"].dataType.elementType
    seg_types = {c: entry[c].dataType for c in ("v", "n")}
    sums = placed.select("_k", "_t", F.when(frame("_count", "n") > 0, frame("_upto", "v")).alias(alias))
    sums = sums.unionByName(per.filter("_t IS NULL").select("_k", "_t", F.col("_v").alias(alias)))
    return _attach(df.withColumns({"_k": key, "_t": moment}), sums, ["_k", "_t"]).drop("_k", "_t")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str,
    right_ts: str,
    payload: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join each left row with the latest right row of its key at or before ``ts``.

    Of right rows with equal keys and times one with the greatest payload wins. Nulls match
    nothing: right rows with a null key or time are no match for any row, and left rows with
    one have none.
    """
    box = F.struct(F.col(right_ts).alias("t"), *[F.col(c) for c in payload])
    rows_r = right.dropna(subset=[*by, right_ts]).select(*by, F.col(right_ts).alias(ts), F.lit(0).alias("_side"), box.alias("_hit"))
    both = left.select("*", F.lit(1).alias("_side")).unionByName(rows_r, allowMissingColumns=True)
    both = with_segment(both, ts, ["_side"])
    w = (
        Window.partitionBy(*by, "_seg")
        .orderBy(F.col(ts), F.col("_side"), F.col("_hit"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = both.withColumn("_in", F.last("_hit", ignorenulls=True).over(w)).filter("_side = 1")
    per_seg = both.groupBy(*by, "_seg").agg(F.max("_hit").alias("_max"))
    before = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_seg.select(*by, "_seg", F.last("_max", ignorenulls=True).over(before).alias("_before"))
    out = _attach(local, carry, [*by, "_seg"]).withColumn("_match", F.coalesce("_in", "_before"))
    if how == "inner":
        out = out.filter("_match is not null")
    return out.select(
        *left.columns, F.col("_match")["t"].alias(right_ts), *[F.col("_match")[c].alias(c) for c in payload]
    )
