"""Column profiles of a table.

``profile_table`` reads the table once and computes every statistic of every
column in a single aggregation of mergeable sketches. The exact mode counts the
distinct values of each column with a map-side combine and takes quantiles from
segmented running counts, so that no task holds one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.operators import segments

QUARTILES = [0.25, 0.5, 0.75]
SKETCH_SIZE = 1_000
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_temporal(field: T.StructField) -> bool:
    return isinstance(field.dataType, TEMPORAL)


def _ref(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`")


def _measure(field: T.StructField) -> Column:
    """A column as double: numbers as they are, times as microseconds."""
    if is_numeric(field):
        return _ref(field).cast("double")
    return F.unix_micros(_ref(field).cast("timestamp")).cast("double")


def _text(field: T.StructField) -> Column:
    return F.to_json(_ref(field)) if isinstance(field.dataType, NESTED) else _ref(field).cast("string")


def _orderable(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.MapType, T.VariantType))


def _select(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*[f"`{c}`" for c in columns])


def _sketched_quartiles(measure: Column) -> Column:
    """Quartiles from a mergeable KLL sketch (rank error well below 1 %)."""
    sketch = F.kll_sketch_agg_double(measure, SKETCH_SIZE)
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(q) for q in QUARTILES]))


def _column_stats(field: T.StructField, quartiles: bool) -> list[Column]:
    """One struct of mergeable aggregates per column."""
    ref = _ref(field)
    double, string = F.lit(None).cast("double"), F.lit(None).cast("string")
    nested = isinstance(field.dataType, NESTED)
    low, high = (F.min(ref), F.max(ref)) if _orderable(field) else (string, string)
    if nested and _orderable(field):
        low, high = F.to_json(low), F.to_json(high)
    measured = is_numeric(field) or is_temporal(field)
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("column_type"),
        low.cast("string").alias("min_value"),
        high.cast("string").alias("max_value"),
        (F.avg(_measure(field)) if measured else double).alias("avg"),
        (F.stddev_samp(_measure(field)) if is_numeric(field) else double).alias("std"),
        (
            F.when(F.count(ref) > 0, _sketched_quartiles(_measure(field)))
            if measured and quartiles
            else F.lit(None).cast("array<double>")
        ).alias("quartiles"),
        (F.approx_count_distinct(_text(field) if nested else ref) if quartiles else F.lit(None).cast("bigint")).alias(
            "distinct_count"
        ),
        F.count(ref).alias("non_null"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(is_temporal(field)).alias("temporal"),
    )


def _one_pass(df: DataFrame, quartiles: bool) -> DataFrame:
    stats = F.array(*[_column_stats(f, quartiles) for f in df.schema.fields])
    return df.agg(stats.alias("stats")).select(F.posexplode("stats").alias("ordinal", "s")).select("ordinal", "s.*")


def values_long(df: DataFrame) -> DataFrame:
    """Distinct values of every column: ``(ordinal, value, measure, n)``.

    Long values are replaced by their SHA-256 so that the shuffle moves keys,
    not texts. Equal values are combined before the shuffle.
    """
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            _text(f).alias("value"),
            (_measure(f) if is_numeric(f) or is_temporal(f) else F.lit(None).cast("double")).alias("measure"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("value is not null")
    key = F.when(F.length("value") > 64, F.sha2("value", 256)).otherwise(F.col("value"))
    return long.groupBy("ordinal", key.alias("value")).agg(
        F.first("measure").alias("measure"), F.count(F.lit(1)).alias("n")
    )


def exact_quantiles(values: DataFrame, by: str, probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles from ``(by, measure, n)`` value counts."""
    known = values.filter("measure is not null").groupBy(by, "measure").agg(F.sum("n").alias("n"))
    run = segments.running_sum(known, [by], "measure", [], "n", "upto")
    totals = known.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.lit(p) for p in probs]))
    targets = totals.select("_by", wanted.alias("prob"), "total").withColumn("pos", F.col("prob") * (F.col("total") - 1))
    hits = run.join(
        targets,
        (F.col(by) == F.col("_by"))
        & (F.col("upto") > F.floor("pos"))
        & (F.col("upto") - F.col("n") <= F.ceil("pos")),
    )
    # at most two values per target survive: those at floor(pos) and ceil(pos)
    low = F.min(F.when(F.col("upto") > F.floor("pos"), F.col("measure")))
    high = F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("measure")))
    frac = F.first("pos") - F.floor(F.first("pos"))
    found = hits.groupBy(by, "prob").agg((low + (F.coalesce(high, low) - low) * frac).alias("q"))
    return found.groupBy(by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(f"q{round(p * 100)}") for p in probs]
    )


def _finish(stats: DataFrame) -> DataFrame:
    temporal = F.col("temporal")

    def number(name: str) -> Column:
        return F.when(~temporal, F.col(name)).alias(name)

    def moment(name: str) -> Column:
        return F.when(temporal, F.timestamp_micros(F.round(name).cast("bigint"))).alias(f"{name}_ts")

    percent = F.when(F.col("row_count") > 0, (F.col("row_count") - F.col("non_null")) * 100.0 / F.col("row_count"))
    return stats.select(
        "ordinal",
        "column_name",
        "column_type",
        "min_value",
        "max_value",
        "distinct_count",
        number("avg"),
        "std",
        *[number(f"q{q}") for q in (25, 50, 75)],
        *[moment(c) for c in ("avg", "q25", "q50", "q75")],
        "row_count",
        percent.alias("null_percentage"),
        (percent / 100).alias("null_rate"),
    )


def profile_table(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row of statistics per column.

    The default uses sketches (distinct count, quartiles) in one pass over the
    table. ``exact=True`` replaces both by exact values at the price of a
    shuffle of the distinct values.
    """
    df = _select(df, columns)
    stats = _one_pass(df, quartiles=not exact)
    if not exact:
        quarts = [F.col("quartiles")[i].alias(f"q{q}") for i, q in enumerate((25, 50, 75))]
        return _finish(stats.select("*", *quarts))
    values = values_long(df)
    distinct = values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    quarts = exact_quantiles(values, "ordinal", QUARTILES)
    joined = stats.drop("distinct_count").join(distinct, "ordinal", "left").join(quarts, "ordinal", "left")
    return _finish(joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))))


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, in percent and as a rate; one pass."""
    df = _select(df, columns)
    pairs = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.avg(_ref(f).isNull().cast("double")).alias("null_rate"))
            for f in df.schema.fields
        ]
    )
    rows = df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return rows.select("column_name", (F.col("null_rate") * 100).alias("null_percentage"), "null_rate")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    df = _select(df, columns)
    if exact:
        named = F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column_name")) for i, c in enumerate(df.columns)]))
        counts = values_long(df).groupBy("ordinal").agg(F.count(F.lit(1)).alias("found"))
        every = df.sparkSession.range(1).select(named)  # a column without any value counts 0
        return every.join(counts, F.col("at") == F.col("ordinal"), "left").select("column_name", F.coalesce("found", F.lit(0)).alias("distinct_count"))
    pairs = [
        F.struct(F.lit(f.name).alias("column_name"), F.approx_count_distinct(_ref(f)).alias("distinct_count"))
        for f in df.schema.fields
    ]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def quartiles(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Quartiles of the numeric columns as numbers, of the temporal ones as times; nulls for a column without values."""
    stats = profile_table(df, columns, exact=exact)
    measured = [f.name for f in df.schema.fields if is_numeric(f) or is_temporal(f)]
    return stats.filter(F.col("column_name").isin(measured)).select(
        "column_name", "q25", "q50", "q75", "q25_ts", "q50_ts", "q75_ts"
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    df = _select(df, columns)
    entries = F.array(
        *[F.struct(F.lit(f.name).alias("column_name"), _text(f).alias("value")) for f in df.schema.fields]
    )
    counts = (
        df.select(F.inline(entries))
        .filter("value is not null")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    # the filter on the rank becomes a per-task top-k before the shuffle
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_profiles(base: DataFrame, fresh: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Overlay new statistics on stored ones; a null keeps the stored value."""
    a, b = base.alias("a"), fresh.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    cols += [F.coalesce(f"b.{s}", f"a.{s}").alias(s) for s in stats]
    return a.join(b, cond, "full").select(*cols)
