"""Join-path discovery over a frame of columns.

Input rows: ``source_id, table_name, table_pos, ordinal, column_name, dtype,
comment``. Name rules are equi-joins on derived keys instead of comparisons of
all column pairs. ``cross=False`` keeps every step inside one source;
``cross=True`` works over all sources and reports the source ``__cross__``.

Passing ``anchors`` (the tables a user asks about) computes only the paths that
touch those tables, which is linear in the catalog; without it the full set of
paths is found per class of alike tables (``pathclasses``) and expanded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.functions import text
from lakescope.operators import pairs
from lakescope.operators.similarity import similar_pairs
from lakescope.session import cut_lineage

CROSS = "__cross__"

# Confidences and thresholds of the signals.
FK_CONFIDENCE = 1.0
FK_ID_CONFIDENCE = 0.85
EXACT_CONFIDENCE = 0.65
SUFFIX_CONFIDENCE = 0.5
MIN_CONFIDENCE = 0.4
PATHS_PER_PAIR = 3
INDIRECT_FACTOR = 0.8
COSINE_THRESHOLD = 0.7
VECTOR_WEIGHT = 0.6
BLEND_NAME, BLEND_VECTOR = 0.6, 0.4
LOW_CONFIDENCE = 0.6

SIDE = ["source_id", "table_name", "table_pos"]
PLAIN_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"  # needs no quotes in SQL
FK_NOTE = r"(?iU)FK\s*->\s*(\w+)\.(\w+)"


def table_key(source: Column, table: Column) -> Column:
    return F.concat_ws("|", source, table)


def keyed_columns(columns: DataFrame, normalise: str | None = None, *more: str) -> DataFrame:
    """Add the match keys of every column; ``more`` names columns to keep.

    ``normalise`` is an optional pattern removed from the names before the rules
    apply (``^[a-z]{1,2}_`` strips star-schema prefixes).
    """
    name = F.regexp_replace("column_name", normalise, "") if normalise else F.col("column_name")
    low, stripped, single = F.lower(name), text.strip_id_suffix(name), text.singular(F.col("table_name"))
    return columns.select(
        *SIDE,
        "ordinal",
        "column_name",
        *more,
        table_key(F.col("source_id"), F.col("table_name")).alias("tkey"),
        text.type_class(F.col("dtype")).alias("cls"),
        low.alias("low"),
        F.concat(single, F.lit("_id")).alias("own_id"),
        stripped.alias("stripped"),
        # names with an empty stem can only match exactly
        F.when(stripped == "", F.concat(F.lit("="), low)).otherwise(stripped).alias("mkey"),
    )


def _field(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def _is_fk_id(child: str, parent: str) -> Column:
    own = _field(parent, "own_id")
    return (_field(child, "low") == own) & ((_field(parent, "low") == "id") | (_field(parent, "low") == own))


def _rule() -> tuple[Column, Column]:
    """Confidence and signal of a column pair; the first rule that holds wins."""
    fk_id = _is_fk_id("a", "b") | _is_fk_id("b", "a")
    exact = (_field("a", "low") == _field("b", "low")) & (_field("a", "low") != "id")
    ends = F.lit(False)
    for side in ("a", "b"):
        ends = ends | _field(side, "low").endswith("_id") | _field(side, "low").endswith("_key")
    suffix = (_field("a", "stripped") != "") & (_field("a", "stripped") == _field("b", "stripped")) & ends
    confidence = (
        F.when(fk_id, FK_ID_CONFIDENCE).when(exact, EXACT_CONFIDENCE).when(suffix, SUFFIX_CONFIDENCE)
    )
    signal = (
        F.when(fk_id, "name_pattern:fk_id")
        .when(exact, "name_pattern:exact_match")
        .when(suffix, "name_pattern:stripped_suffix")
    )
    return confidence, signal


def _oriented(joined: DataFrame) -> DataFrame:
    """Name the earlier table ``a``."""
    first = F.struct(_field("l", "table_pos"), _field("l", "tkey")) < F.struct(
        _field("r", "table_pos"), _field("r", "tkey")
    )
    return joined.select(
        F.when(first, F.col("l")).otherwise(F.col("r")).alias("a"),
        F.when(first, F.col("r")).otherwise(F.col("l")).alias("b"),
    )


def _quote(name: Column) -> Column:
    return F.when(name.rlike(PLAIN_NAME), name).otherwise(F.concat(F.lit("`"), name, F.lit("`")))


def _path_columns(source: Column, confidence: Column, signal: Column) -> list[Column]:
    """A candidate without its texts, which are long and written only for what fusion keeps."""
    return [
        source.alias("source_id"),
        *[_field(s, c).alias(f"{s}_{c}") for s in ("a", "b") for c in ("tkey", "table_name", "table_pos", "ordinal", "column_name")],
        F.lit(None).cast("string").alias("join_condition"),
        F.lit(None).cast("string").alias("on_sql"),
        confidence.alias("confidence"),
        signal.alias("signal_source"),
    ]


def with_texts(paths: DataFrame) -> DataFrame:
    """Fill in the shown condition and the one to run."""
    a, b, left, right = F.col("a_table_name"), F.col("b_table_name"), F.col("a_column_name"), F.col("b_column_name")
    condition = F.concat(a, F.lit("."), left, F.lit(" = "), b, F.lit("."), right)
    runnable = F.concat(_quote(a), F.lit("."), _quote(left), F.lit(" = "), _quote(b), F.lit("."), _quote(right))
    return paths.withColumns({"join_condition": F.coalesce("join_condition", condition), "on_sql": F.coalesce("on_sql", runnable)})


def name_candidates(
    columns: DataFrame, cross: bool = False, anchors: DataFrame | None = None, normalise: str | None = None
) -> DataFrame:
    """Column pairs of two tables that match by name (rules fk_id, exact, suffix)."""
    return with_texts(_by_name(columns, cross, anchors, normalise))


def _by_name(columns: DataFrame, cross: bool, anchors: DataFrame | None, normalise: str | None) -> DataFrame:
    if anchors is None:
        from lakescope.operators import pathclasses  # it builds on the rules of this module

        return pathclasses.by_name(columns, cross, normalise)
    keyed = cut_lineage(keyed_columns(columns, normalise))  # keys are computed once, then read per join side
    scope = [] if cross else ["source_id"]
    apart = _field("l", "tkey") != _field("r", "tkey")
    if cross:
        apart = apart & (_field("l", "table_name") != _field("r", "table_name"))
    row_id = ["table_pos", "tkey", "ordinal"]
    asked = anchors.select(table_key(F.col("source_id"), F.col("table_name")).alias("_asked")).distinct()
    marked = keyed.join(asked, F.col("tkey") == F.col("_asked"), "left").withColumn("asked", F.col("_asked").isNotNull())
    body = F.struct(*keyed.columns, "asked")
    # "id" never equals another table's column by these rules, only a parent's own key
    left = marked.filter("asked").select(body.alias("l"))
    right = marked.select(body.alias("r"))
    equal = (_field("l", "cls") == _field("r", "cls")) & (_field("l", "mkey") == _field("r", "mkey"))
    on = (_field("l", "cls") == _field("r", "cls")) & (_field("l", "low") == _field("r", "own_id"))
    for s in scope:
        equal, on = equal & (_field("l", s) == _field("r", s)), on & (_field("l", s) == _field("r", s))
    once = ~_field("r", "asked") | (
        F.struct(*[_field("l", c) for c in row_id]) < F.struct(*[_field("r", c) for c in row_id])
    )
    same = left.join(right, equal & apart & once).select("l", "r")
    # a child column "<parent>_id" against a parent's "id" column
    kids = marked.filter("low like '%\\\\_id'").select(body.alias("l"))
    ids = marked.filter("low = 'id'").select(body.alias("r"))
    touch = _field("l", "asked") | _field("r", "asked")
    to_id = kids.join(ids, on & apart & touch).select("l", "r")
    confidence, signal = _rule()
    source = F.lit(CROSS) if cross else _field("a", "source_id")
    found = _oriented(same).unionByName(_oriented(to_id))
    return found.select(*_path_columns(source, confidence, signal)).filter("confidence is not null")


def fk_candidates(
    columns: DataFrame,
    cross: bool = False,
    foreign_keys: DataFrame | None = None,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Paths from ``FK -> table.column`` comments and from declared keys.

    ``foreign_keys`` rows: ``source_id, table_name, column_name, references``.
    """
    return with_texts(_by_key(columns, cross, foreign_keys, anchors))


def _by_key(columns: DataFrame, cross: bool, foreign_keys: DataFrame | None, anchors: DataFrame | None) -> DataFrame:
    noted = columns.filter(F.col("comment").rlike(FK_NOTE)).select(
        *SIDE,
        "ordinal",
        "column_name",
        F.regexp_extract("comment", FK_NOTE, 1).alias("ref_table"),
        F.regexp_extract("comment", FK_NOTE, 2).alias("ref_column"),
    )
    if foreign_keys is not None:
        declared = foreign_keys.withColumn("_at", F.split("references", r"\."))
        declared = columns.select(*SIDE, "ordinal", "column_name").join(
            declared.select(
                "source_id", "table_name", "column_name",
                F.col("_at")[0].alias("ref_table"), F.col("_at")[1].alias("ref_column"),
            ),
            ["source_id", "table_name", "column_name"],
        )
        noted = noted.unionByName(declared).dropDuplicates(
            ["source_id", "table_name", "column_name", "ref_table", "ref_column"]
        )
    known = columns.groupBy("source_id", "table_name").agg(F.min("table_pos").alias("ref_pos"))
    known = known.select(F.col("source_id").alias("_s"), F.col("table_name").alias("_t"), "ref_pos")
    on = (F.col("source_id") == F.col("_s")) & (F.col("ref_table") == F.col("_t"))
    linked = noted.join(known, on, "inner" if cross else "left")
    a = F.struct(*SIDE, "ordinal", "column_name", table_key(F.col("source_id"), F.col("table_name")).alias("tkey"))
    b = F.struct(
        F.col("source_id"),
        F.col("ref_table").alias("table_name"),
        F.col("ref_pos").alias("table_pos"),
        F.lit(None).cast("bigint").alias("ordinal"),
        F.col("ref_column").alias("column_name"),
        table_key(F.col("source_id"), F.col("ref_table")).alias("tkey"),
    )
    source = F.lit(CROSS) if cross else _field("a", "source_id")
    out = linked.select(a.alias("a"), b.alias("b")).select(
        *_path_columns(source, F.lit(FK_CONFIDENCE), F.lit("fk_constraint"))
    )
    if anchors is not None:
        asked = anchors.select(table_key(F.col("source_id"), F.col("table_name")).alias("_asked")).distinct()
        a_hit = out.join(asked, F.col("a_tkey") == F.col("_asked"), "left_semi")
        b_hit = out.join(asked, F.col("b_tkey") == F.col("_asked"), "left_semi")
        out = a_hit.unionByName(b_hit.join(asked, F.col("a_tkey") == F.col("_asked"), "left_anti"))
    return out


def _pair_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"pa": F.least("a_tkey", "b_tkey"), "pb": F.greatest("a_tkey", "b_tkey")})


def vector_scores(vectors: DataFrame, cross: bool = False, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """Table pairs whose vectors have a cosine above the threshold.

    ``vectors`` rows: ``source_id, table_name, table_pos, vector``.
    """
    rows = vectors.select(
        F.struct(*SIDE).alias("side"),
        F.lit(CROSS).alias("scope") if cross else F.col("source_id").alias("scope"),
        F.col("vector"),
    )
    found = similar_pairs(rows, "side", "vector", threshold, by="scope")
    first = F.struct("l.table_pos", "l.source_id", "l.table_name") < F.struct("r.table_pos", "r.source_id", "r.table_name")
    out = found.select(
        F.col("scope").alias("source_id"),
        F.when(first, F.col("l")).otherwise(F.col("r")).alias("a"),
        F.when(first, F.col("r")).otherwise(F.col("l")).alias("b"),
        "cosine",
    )
    if cross:
        out = out.filter("a.table_name <> b.table_name")
    return out.select(
        "source_id",
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("table_name", "table_pos")],
        *[table_key(F.col(f"{s}.source_id"), F.col(f"{s}.table_name")).alias(f"{s}_tkey") for s in ("a", "b")],
        "cosine",
    )


def blend_vectors(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Mix the vector score of a table pair into its name-pattern candidates."""
    pair = _pair_key(scores).select(
        F.col("source_id").alias("_s"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"), F.col("cosine").alias("_cos")
    )
    on = (F.col("source_id") == F.col("_s")) & (F.col("pa") == F.col("_pa")) & (F.col("pb") == F.col("_pb"))
    mix = F.col("_cos").isNotNull() & F.col("signal_source").startswith("name_pattern")
    mixed = F.lit(BLEND_NAME) * F.col("confidence") + F.lit(BLEND_VECTOR) * (F.col("_cos") * VECTOR_WEIGHT)
    return (
        _pair_key(candidates)
        .join(pair, on, "left")
        .withColumn("confidence", F.when(mix, mixed).otherwise(F.col("confidence")))
        .withColumn(
            "signal_source",
            F.when(mix, F.concat("signal_source", F.lit("+embedding"))).otherwise(F.col("signal_source")),
        )
        .select(*candidates.columns)
    )


def vector_candidates(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pseudo-paths for similar table pairs that have no other candidate."""
    seen = _pair_key(candidates).select("source_id", "pa", "pb").distinct()
    lone = _pair_key(scores).join(seen, ["source_id", "pa", "pb"], "left_anti")
    shown = F.format_string("%.3f", "cosine")
    return lone.select(
        "source_id",
        *[
            (F.col(f"{s}_{c}") if c in ("tkey", "table_name", "table_pos") else F.lit(None).cast(t)).alias(f"{s}_{c}")
            for s in ("a", "b")
            for c, t in (("tkey", ""), ("table_name", ""), ("table_pos", ""), ("ordinal", "bigint"), ("column_name", "string"))
        ],
        F.concat(F.lit("-- embedding similarity "), shown, F.lit(", manual verification needed")).alias("join_condition"),
        F.concat(F.lit("embedding:"), shown).alias("on_sql"),
        (F.col("cosine") * VECTOR_WEIGHT).alias("confidence"),
        F.lit("embedding").alias("signal_source"),
    )


def fuse(candidates: DataFrame) -> DataFrame:
    """Per table pair: all FK paths if there are any, else the three best.

    Ties keep discovery order (column order of ``a``, then of ``b``).
    """
    pair = Window.partitionBy("source_id", "pa", "pb")
    best = pair.orderBy(F.desc("confidence"), "a_table_pos", "b_table_pos", "a_ordinal", "b_ordinal")
    is_fk = F.col("signal_source") == "fk_constraint"
    kept = (
        _pair_key(candidates)
        .filter(F.col("confidence") >= MIN_CONFIDENCE)
        .withColumn("has_fk", F.max(is_fk).over(pair))
        .filter(is_fk | ~F.col("has_fk"))
        .withColumn("pair_rank", F.row_number().over(best))
        .filter(F.col("has_fk") | (F.col("pair_rank") <= PATHS_PER_PAIR))
        .drop("has_fk")
    )
    return with_texts(kept)


def indirect(direct: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One-hop paths A - M - B between tables without a direct path."""
    strong = direct.filter((F.col("pair_rank") == 1) & (F.col("confidence") * INDIRECT_FACTOR >= MIN_CONFIDENCE))

    def half(x: str, m: str) -> DataFrame:
        return strong.select(
            "source_id",
            *[F.col(f"{x}_{c}").alias(f"end_{c}") for c in ("tkey", "table_name", "table_pos")],
            F.col(f"{m}_tkey").alias("mid_tkey"),
            F.col(f"{m}_table_name").alias("mid_table_name"),
            "join_condition",
            "on_sql",
            "confidence",
        )

    edges = half("a", "b").unionByName(half("b", "a")).filter("end_table_pos is not null")
    if anchors is not None:
        asked = anchors.select(table_key(F.col("source_id"), F.col("table_name")).alias("_asked")).distinct()
        edges = edges.join(asked, F.col("end_tkey") == F.col("_asked"), "left_semi")
    # hops are found and thinned out by keys alone; texts are joined to the survivors
    slim = edges.select("source_id", "mid_tkey", "end_tkey", "end_table_pos")
    hops = pairs.self_pairs(
        slim,
        ["source_id", "mid_tkey"],
        ["end_table_pos", "end_tkey"],
        _field("l", "end_tkey") != _field("r", "end_tkey"),
    )
    first = F.struct(_field("l", "end_table_pos"), _field("l", "end_tkey")) < F.struct(
        _field("r", "end_table_pos"), _field("r", "end_tkey")
    )
    ends = hops.select(
        F.col("l.source_id").alias("source_id"),
        F.col("l.mid_tkey").alias("mid_tkey"),
        F.when(first, F.col("l.end_tkey")).otherwise(F.col("r.end_tkey")).alias("key_a"),
        F.when(first, F.col("r.end_tkey")).otherwise(F.col("l.end_tkey")).alias("key_b"),
    ).withColumns({"pa": F.least("key_a", "key_b"), "pb": F.greatest("key_a", "key_b")})
    # the direct pairs are distinct per rank 1, so this anti join needs no distinct
    survivors = ends.join(
        direct.filter("pair_rank = 1").select("source_id", "pa", "pb"), ["source_id", "pa", "pb"], "left_anti"
    ).drop("pa", "pb")
    return hop_rows(survivors, edges)


def hop_rows(survivors: DataFrame, edges: DataFrame) -> DataFrame:
    """Path rows of (source_id, mid_tkey, key_a, key_b) from the edges of both ends."""
    edge = F.struct(*[c for c in edges.columns if c not in ("source_id", "mid_tkey")])
    side_a = edges.select("source_id", "mid_tkey", F.col("end_tkey").alias("key_a"), edge.alias("a"))
    side_b = edges.select("source_id", "mid_tkey", F.col("end_tkey").alias("key_b"), edge.alias("b"))
    open_pairs = survivors.join(side_a, ["source_id", "mid_tkey", "key_a"]).join(
        side_b, ["source_id", "mid_tkey", "key_b"]
    )
    mid = F.col("a.mid_table_name")
    return open_pairs.select(
        "source_id",
        *[F.col(f"{s}.end_{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("tkey", "table_name", "table_pos")],
        mid.alias("via"),
        F.concat("a.join_condition", F.lit(" AND "), "b.join_condition").alias("join_condition"),
        F.concat(
            F.lit("SELECT * FROM "), _quote(F.col("a.end_table_name")),
            F.lit(" JOIN "), _quote(mid), F.lit(" ON "), F.col("a.on_sql"),
            F.lit(" JOIN "), _quote(F.col("b.end_table_name")), F.lit(" ON "), F.col("b.on_sql"),
        ).alias("sql_template"),
        (F.least("a.confidence", "b.confidence") * INDIRECT_FACTOR).alias("confidence"),
        F.concat(F.lit("indirect:via_"), mid).alias("signal_source"),
        F.concat(F.lit("via:"), mid).alias("id_text"),
    )


PATH_COLUMNS = [
    "path_id", "source_id", "table_a", "table_b", "join_type", "join_condition",
    "confidence", "signal_source", "sql_template", "version",
]


def render(paths: DataFrame) -> DataFrame:
    """Final path rows with a stable id."""
    raw = F.concat_ws("|", "source_id", "a_table_name", "b_table_name", "id_text")
    return paths.select(
        text.sha16(raw).alias("path_id"),
        "source_id",
        F.col("a_table_name").alias("table_a"),
        F.col("b_table_name").alias("table_b"),
        F.lit("INNER").alias("join_type"),
        "join_condition",
        "confidence",
        "signal_source",
        "sql_template",
        F.lit(1).alias("version"),
    )


def render_direct(direct: DataFrame) -> DataFrame:
    is_vector = F.col("signal_source") == "embedding"
    a, b = _quote(F.col("a_table_name")), _quote(F.col("b_table_name"))
    cos = F.regexp_extract("on_sql", "embedding:(.*)", 1)
    template = F.when(
        is_vector,
        F.concat(
            F.lit("-- No auto-generated JOIN: tables are semantically related (cosine="),
            cos,
            F.lit(") but no matching columns found"),
        ),
    ).otherwise(F.concat(F.lit("SELECT * FROM "), a, F.lit(" JOIN "), b, F.lit(" ON "), F.col("on_sql")))
    id_text = F.when(is_vector, F.col("on_sql")).otherwise(F.col("join_condition"))
    return render(direct.withColumns({"sql_template": template, "id_text": id_text}))


def candidates(
    columns: DataFrame,
    cross: bool = False,
    vectors: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    anchors: DataFrame | None = None,
    normalise: str | None = None,
    threshold: float = COSINE_THRESHOLD,
) -> DataFrame:
    """All signals before fusion; ``with_texts`` adds their conditions."""
    found = _by_key(columns, cross, foreign_keys, anchors).unionByName(_by_name(columns, cross, anchors, normalise))
    if vectors is None:
        return found
    scores = vector_scores(vectors, cross, threshold)
    return blend_vectors(found, scores).unionByName(vector_candidates(scores, found))


def discover(
    columns: DataFrame,
    cross: bool = False,
    vectors: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    anchors: DataFrame | None = None,
    normalise: str | None = None,
    threshold: float = COSINE_THRESHOLD,
) -> DataFrame:
    """Direct and indirect join paths, one row per path.

    Without anchors they are found per class of tables and expanded (``pathclasses``).
    """
    if anchors is None:
        from lakescope.operators import pathclasses, pathscopes

        paths = pathclasses.factored(columns, cross, vectors, foreign_keys, normalise, threshold)
        found = []
        if paths.small is not None:
            found.append(pathscopes.rendered(pathscopes.paths(paths.small, cross, normalise)))
        if paths.large is not None:
            direct = cut_lineage(pathclasses.direct_rows(paths.large))  # read several times below
            found.append(render_direct(direct).unionByName(render(pathclasses.indirect_rows(paths.large, direct))))
        return reduce(DataFrame.unionByName, found)
    fused = fuse(candidates(columns, cross, vectors, foreign_keys, anchors, normalise, threshold))
    direct = cut_lineage(fused)  # read several times below
    return render_direct(direct).unionByName(render(indirect(direct, anchors)))


def lookup(paths: DataFrame, wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """Paths of requested table pairs, in either direction, per source.

    ``wanted`` rows: ``table_a, table_b`` and optionally ``source_id``, the source meant (null:
    any). Tables of one name in several sources keep apart: each source's paths come with
    its ``source_id`` and its own ``warning``, which marks pairs with a path of low confidence. A
    path of the run over all sources is left out where the run of a source found the same one.
    A pair that names a table missing from ``tables`` (of that source) yields one row with ``error`` set.
    """
    source = F.col("source_id") if "source_id" in wanted.columns else F.lit(None).cast("string")
    asked = wanted.select(source.alias("asked_in"), F.col("table_a").alias("asked_a"), F.col("table_b").alias("asked_b")).withColumn("_row", F.monotonically_increasing_id())
    asked = cut_lineage(asked)
    names = tables.select("source_id", "table_name").distinct()
    at = [(F.col(f"asked_{s}") == F.col("table_name")) & (F.col("asked_in").isNull() | (F.col("asked_in") == F.col("source_id"))) for s in "ab"]
    seen = [asked.join(names, on, "left_semi").select("_row", F.lit(True).alias(f"_k{s}")) for s, on in zip("ab", at, strict=True)]
    known = asked.join(seen[0], "_row", "left").join(seen[1], "_row", "left").withColumns(
        {
            "_bad": F.when(F.col("_ka").isNull(), F.col("asked_a")).when(F.col("_kb").isNull(), F.col("asked_b")),
            "pa": F.least("asked_a", "asked_b"),
            "pb": F.greatest("asked_a", "asked_b"),
        }
    )
    keyed = (
        paths.withColumns({"pa": F.least("table_a", "table_b"), "pb": F.greatest("table_a", "table_b")})
        .groupBy("source_id", "pa", "pb", "join_condition", "signal_source", "sql_template")
        .agg(F.max("confidence").alias("confidence"))
    )
    same = ["pa", "pb", "join_condition", "signal_source", "sql_template"]
    own = keyed.filter(F.col("source_id") != CROSS)
    keyed = cut_lineage(own.unionByName(keyed.filter(F.col("source_id") == CROSS).join(own.select(*same).distinct(), same, "left_anti")))
    lowest = keyed.groupBy("source_id", "pa", "pb").agg((F.min("confidence") < LOW_CONFIDENCE).alias("_low"))
    listed = keyed.join(lowest, ["source_id", "pa", "pb"])
    here = F.col("asked_in").isNull() | F.col("source_id").isin(CROSS) | (F.col("source_id") == F.col("asked_in"))
    hits = known.join(listed, ["pa", "pb"]).filter(here)
    found = hits.unionByName(known.join(hits.select("_row").distinct(), "_row", "left_anti"), allowMissingColumns=True)
    is_indirect = F.col("signal_source").startswith("indirect:")
    return found.select(
        F.coalesce("source_id", "asked_in").alias("source_id"),
        F.col("asked_a").alias("table_a"),
        F.col("asked_b").alias("table_b"),
        F.when(is_indirect, "indirect").when(~is_indirect, "direct").alias("kind"),
        F.when(is_indirect, F.regexp_replace("signal_source", "indirect:via_", "")).alias("via"),
        F.round("confidence", 2).alias("confidence"),
        F.col("signal_source").alias("signal"),
        "join_condition",
        F.col("sql_template").alias("join_sql"),
        F.when(F.col("_low"), "low confidence, manual verification recommended").alias("warning"),
        F.when(
            F.col("_bad").isNotNull(),
            F.concat(F.lit('Table "'), F.col("_bad"), F.lit('" not found in any connected source')),
        ).alias("error"),
    )


def apply_path(a: DataFrame, b: DataFrame, a_column: str, b_column: str) -> DataFrame:
    """Run a discovered path: inner join on its condition."""
    return a.join(b, a[a_column] == b[b_column])
