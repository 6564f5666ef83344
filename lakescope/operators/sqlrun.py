"""Read-only SQL over registered tables, and operators Spark SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescope.operators import sqllog
from lakescope.operators.segments import with_segment
from lakescope.session import conf_set, cut_lineage

DEFAULT_ROWS = 1000


# Functions that call into the JVM, and formats that open files by path.
CALLS = ("reflect", "java_method", "try_reflect")
FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "jdbc", "xml", "delta", "hive")


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(spark: SparkSession, plan):
    """All nodes of a parsed plan: children, named subqueries, and plans inside expressions."""
    gateway, catalyst = spark.sparkContext._gateway, "org.apache.spark.sql.catalyst"
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _scala(node.children())
        if is_instance_of(gateway, node, f"{catalyst}.plans.QueryPlan"):
            todo += _scala(node.expressions())
            if node.getClass().getSimpleName() == "UnresolvedWith":
                todo += [pair._2() for pair in _scala(node.cteRelations())]
        elif is_instance_of(gateway, node, f"{catalyst}.expressions.PlanExpression"):
            todo.append(node.plan())


def _refusal(spark: SparkSession, plan) -> str | None:
    """Why a parsed statement is refused, or None."""
    for node in _nodes(spark, plan):
        kind = node.getClass().getSimpleName()
        if "Command" in kind or kind.startswith("InsertInto"):
            return "not a query"
        if "ScriptTransformation" in kind:
            return "script transformation"
        if kind == "UnresolvedFunction" and _scala(node.nameParts())[-1].lower() in CALLS:
            return "call of Java code"
        if kind == "UnresolvedRelation":
            parts = _scala(node.multipartIdentifier())
            if len(parts) > 1 and (parts[0].lower() in FORMATS or "/" in parts[-1]):
                return "direct file relation"
    return None


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """One read-only statement; double quotes delimit identifiers.

    The text rules refuse anything but a single SELECT or WITH, string literals left aside.
    The parsed plan must hold no command, no script transformation, no call of Java code and
    no file named by its path.
    """
    verdict = sqllog.check(spark, sql, literals_first=True)
    if not verdict["safe"]:
        raise ValueError(f"SQL safety check failed: {verdict['reason']}")
    text = sql.strip().rstrip(";")
    with conf_set(spark, **{"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}):
        refusal = _refusal(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
        if refusal:
            raise ValueError(f"SQL safety check failed: {refusal}")
        return spark.sql(text)


@dataclass(frozen=True)
class Bounded:
    """A capped result: ``rows`` holds at most the cap, ``total`` counts all."""

    rows: DataFrame
    total: int
    truncated: bool


def bounded(df: DataFrame, max_rows: int = DEFAULT_ROWS) -> Bounded:
    """Cap a result. The capped rows are computed once and kept; a full count runs only if the cap was exceeded."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    kept = cut_lineage(df.limit(max_rows + 1))
    seen = kept.count()
    return Bounded(kept.limit(max_rows), seen if seen <= max_rows else df.count(), seen > max_rows)


def sample_rows(df: DataFrame, order: Sequence[Column | str] = (), k: int = 5) -> DataFrame:
    """The first k rows of a table by ``order`` (any k rows without)."""
    return (df.orderBy(*order) if order else df).limit(k)


GROUP_LIMIT = 1_000  # Spark cuts ranks in each task up to here
SALTS = 32


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows per key (QUALIFY row_number() <= k, DISTINCT ON for k = 1).

    A hot key is cut before its rows meet: in each task for small k, else in salted parts,
    of which each keeps its first k.
    """
    def first(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")

    if k > GROUP_LIMIT:
        df = first(df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))), *by, "_salt").drop("_salt")
    return first(df, *by)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union of frames by column name; missing columns become null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows with ``low <= value <= high``, by an equi-join on ranges of the points.

    The points are cut into ranges of about equal numbers; neighbouring ranges pair up to the
    next level, up to one range of all. An interval goes to the lowest level at which it touches
    two ranges at most, so it makes two rows however long it is; a point goes to the levels
    that some interval uses. Points with one value are spread over several ranges if there are
    very many, and the join may split a range that holds most of the points.
    """
    known = points.filter(F.col(value).isNotNull()).withColumn("_tie", F.xxhash64(*points.columns))
    seg = with_segment(known, value, ["_tie"]).drop("_tie")
    ends = sorted((r["_seg"], r["lo"], r["hi"]) for r in seg.groupBy("_seg").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect())  # one row per range
    kind = seg.schema[value].dataType
    if not ends:
        return points.join(intervals, F.lit(False))
    top = max(1, (ends[-1][0]).bit_length())
    lows, highs = (F.array(*[F.struct(F.lit(e[0]).alias("s"), F.lit(e[i]).cast(kind).alias("v")) for e in ends]) for i in (1, 2))
    first = F.array_min(F.transform(F.filter(highs, lambda e: e["v"] >= F.col(low)), lambda e: e["s"]))
    last = F.array_max(F.transform(F.filter(lows, lambda e: e["v"] <= F.col(high)), lambda e: e["s"]))
    touched = intervals.filter(F.col(low) <= F.col(high)).withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    level = F.expr(f"array_min(filter(sequence(0, {top}), n -> shiftright(_last, n) - shiftright(_first, n) <= 1))")
    nodes = F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))")
    placed = touched.withColumn("_level", level).withColumn("_node", F.explode(nodes))
    placed = cut_lineage(placed.drop("_first", "_last"))
    used = sorted(r[0] for r in placed.select("_level").distinct().collect())  # at most one per level
    dealt = seg.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>"))).withColumn("_node", F.expr("shiftright(_seg, _level)")).drop("_seg")
    joined = dealt.join(placed, ["_level", "_node"]).filter((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)))
    return joined.drop("_level", "_node")
