"""Join paths of a whole catalog in factored form: classes of tables instead of pairs of tables.

Two tables are of one class if nothing the rules look at tells them apart: the same shared
columns in the same order, the same explicit links (foreign keys, vectors), and the same
own key or table name where another table refers to it or repeats it. Then every pair of
tables of two classes has the same direct paths, and the same tables in between, so all
results are rows per pair of classes:

* ``groups``: per match key and rule, how many column pairs match, counted without pairs;
* ``Factored``: classes with their members, direct links of class pairs and explicit links of
  table pairs; ``hops``: (class, class between, class) with the number of paths they stand for.

A name that 50,000 alike tables hold is one class and one link; ``direct_rows`` and
``indirect_rows`` expand links and hops to the rows of tables, for all tables or for those asked
for. Where all tables differ in what they share, there are as many classes as tables and the
class pairs are the table pairs.

Scopes of few columns need no classes: ``pathscopes`` works out each by one task, and ``factored``
hands them on as they are.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.operators import joinpaths as jp
from lakescope.operators import pairs, pathscopes
from lakescope.session import cut_lineage

BLOCK = 2_000  # members of a class that one task pairs with as many of another


class Factored(NamedTuple):
    """``members``: scope, class, tkey, source_id, table_name, table_pos (null: named by a key but not in the catalog).
    ``classes``: scope, class, n. ``links``: scope, a_class, b_class, a_column_name, b_column_name, a_at, b_at,
    confidence, signal_source, pair_rank for pairs with the table of a_class first. ``explicit``: rows as ``joinpaths.fuse`` gives them.
    ``direct``: scope, one, two, confidence: linked classes (one <= two) and their best confidence.
    All five are None if no scope is large. ``small``: the columns of the other scopes, None if there are none."""

    members: DataFrame | None
    classes: DataFrame | None
    links: DataFrame | None
    explicit: DataFrame | None
    direct: DataFrame | None
    small: DataFrame | None = None
    cross: bool = False
    normalise: str | None = None

    @property
    def large(self) -> Factored | None:
        return None if self.members is None else self._replace(small=None)


def _both(*found: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [f for f in found if f is not None])


def _split(columns: DataFrame, cross: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """The columns of small scopes, with their ``scope``, and those of large ones."""
    if cross:
        return None, columns
    sizes = columns.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.filter(F.col("n") > pathscopes.SCOPE_COLUMNS).select("source_id"))
    scoped = columns.withColumn("scope", F.col("source_id"))
    if large.isEmpty():
        return scoped, None
    return scoped.join(large, "source_id", "left_anti"), columns.join(large, "source_id", "left_semi")


def _scope(cross: bool) -> Column:
    return F.lit(jp.CROSS) if cross else F.col("source_id")


def _elsewhere(side: str) -> Column:
    """Whether a table other than the row's own has the key; false where nobody has it."""
    return F.coalesce((F.col(f"{side}_low") != F.col("th")) | (F.col(f"{side}_high") != F.col("th")), F.lit(False))


def _holders(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Least and greatest hash of the tables that have the keys, combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("th").alias(f"{side}_low"), F.max("th").alias(f"{side}_high"))


def _shapes(columns: DataFrame, explicit: DataFrame, cross: bool, normalise: str | None) -> DataFrame:
    """One row per table that may be linked: scope, tkey, source, name, position, class and its ``shape``."""
    column = ["scope", "tkey", "th", "ordinal", "column_name", "cls", "low", "mkey", "stripped", "own_id"]
    keyed = cut_lineage(jp.keyed_columns(columns, normalise).withColumns({"scope": _scope(cross), "th": F.xxhash64("tkey")}).select(*column))
    owners = keyed.select("scope", "tkey", "th", "own_id").distinct()
    own = _holders(owners, ["scope", "own_id"], "o").withColumnRenamed("own_id", "low")
    shared = _holders(keyed.filter("low <> 'id'"), ["scope", "cls", "mkey"], "k").filter("k_low <> k_high")
    # parents: tables whose own key is a column of another table; children: those columns
    named = _holders(keyed, ["scope", "low"], "l").withColumnRenamed("low", "own_id")
    parents = owners.join(named, ["scope", "own_id"]).filter(_elsewhere("l")).select("scope", "tkey", F.col("own_id").alias("own"))
    marked = keyed.drop("own_id").join(shared, ["scope", "cls", "mkey"], "left").join(own, ["scope", "low"], "left").join(parents, ["scope", "tkey"], "left")
    is_id = F.col("low") == "id"
    kept = marked.filter((~is_id & (F.col("k_low").isNotNull() | (F.col("low").endswith("_id") & _elsewhere("o")))) | (is_id & F.col("own").isNotNull()))
    body = F.struct("ordinal", "column_name", "cls", "low", "mkey", "stripped")
    widths = kept.groupBy("scope", "tkey").agg(F.transform(F.array_sort(F.collect_list(body)), lambda c: c.dropFields("ordinal")).alias("cols"))
    # explicit links count by who and how; which columns they use does not matter here
    ends = [explicit.select(F.col("source_id").alias("scope"), *[F.col(f"{x}_{c}").alias(c) for c in ("tkey", "table_name")], F.col(f"{y}_tkey").alias("partner"), "signal_source", "confidence") for x, y in ("ab", "ba")]
    ends = ends[0].unionByName(ends[1]).distinct()
    partner = [F.bit_xor(F.xxhash64(F.lit(seed), "partner", "signal_source", "confidence")).alias(f"p{seed}") for seed in (1, 2)]
    tied = ends.groupBy("scope", "tkey").agg(*partner, F.count(F.lit(1)).alias("p0"), F.max("table_name").alias("seen_name"))
    tables = columns.groupBy(_scope(cross).alias("scope"), "source_id", "table_name").agg(F.min("table_pos").alias("table_pos")).withColumn("tkey", jp.table_key(F.col("source_id"), F.col("table_name")))
    out = widths.join(tied, ["scope", "tkey"], "full").join(parents, ["scope", "tkey"], "left").join(tables, ["scope", "tkey"], "left")
    out = out.withColumn("table_name", F.coalesce("table_name", "seen_name"))
    if cross:  # tables of one name are never paired by name
        again = tables.groupBy("table_name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("table_name", F.col("table_name").alias("again"))
        out = out.join(again, "table_name", "left")
    else:
        out = out.withColumn("again", F.lit(None).cast("string"))
    none = F.expr("array()").cast("array<struct<column_name: string, cls: string, low: string, mkey: string, stripped: string>>")
    shape = [F.coalesce("cols", none), *[F.struct(c) for c in ("own", "again")], F.col("table_pos").isNull(), "p0", "p1", "p2"]
    digest = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *shape)), 16, "0") for seed in (1, 2)])
    return out.select("scope", "tkey", "source_id", "table_name", "table_pos", digest.alias("class"), F.struct(F.coalesce("cols", none).alias("cols"), "own", "again").alias("shape"))


def _class_columns(shapes: DataFrame) -> DataFrame:
    classes = shapes.groupBy("scope", "class").agg(F.count(F.lit(1)).alias("n"), F.first("shape").alias("shape"))
    return classes.select("scope", "class", "n", "shape.own", "shape.again", F.posexplode("shape.cols").alias("at", "col")).select("scope", "class", "n", F.col("own").alias("own_id"), "again", "at", "col.*")


def _class_candidates(shapes: DataFrame) -> DataFrame:
    """Every column pair of two classes that a name rule joins, once per order of the tables."""
    cols = cut_lineage(_class_columns(shapes))
    two = (jp._field("l", "class") != jp._field("r", "class")) | (jp._field("l", "n") > 1)
    apart = two & ~F.coalesce(jp._field("l", "again") == jp._field("r", "again"), F.lit(False))
    named = cols.filter("low <> 'id'")
    same = pairs.self_pairs(named, ["scope", "cls", "mkey"], ["class", "at"], apart)
    itself = named.filter("n > 1 AND again IS NULL").select(F.struct("*").alias("l"), F.struct("*").alias("r"))
    kids = named.filter("low like '%\\\\_id'").select(F.struct("*").alias("l"))
    ids = cols.filter("low = 'id' AND own_id IS NOT NULL").select(F.struct("*").alias("r"))
    on = [jp._field("l", c) == jp._field("r", d) for c, d in (("scope", "scope"), ("cls", "cls"), ("low", "own_id"))]
    to_id = kids.join(ids, on[0] & on[1] & on[2] & apart).select("l", "r")
    once = same.unionByName(to_id)
    both = once.select(F.col("l").alias("a"), F.col("r").alias("b")).unionByName(once.select(F.col("r").alias("a"), F.col("l").alias("b"))).unionByName(itself.select(F.col("l").alias("a"), F.col("r").alias("b")))
    confidence, signal = jp._rule()
    return both.select(
        F.col("a.scope").alias("scope"), F.col("a.class").alias("a_class"), F.col("b.class").alias("b_class"),
        F.col("a.column_name").alias("a_column_name"), F.col("b.column_name").alias("b_column_name"),
        F.col("a.at").alias("a_at"), F.col("b.at").alias("b_at"), confidence.alias("confidence"), signal.alias("signal_source"),
    ).filter("confidence is not null")


def _expand(links: DataFrame, members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Rows of table pairs, the earlier table first; only those that touch ``asked`` (a ``tkey``) if given."""
    known = members.filter("table_pos is not null").select("scope", "class", F.struct("source_id", "table_name", "table_pos", "tkey").alias("t"), "tkey")
    if asked is None:
        return _expand_pairs(links, known, known)
    chosen = known.join(asked, "tkey", "left_semi")
    rest = known.join(asked, "tkey", "left_anti")
    return _expand_pairs(links, chosen, known).unionByName(_expand_pairs(links, rest, chosen))


def _expand_pairs(links: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    units, sides = links, []
    for s, rows in (("a", first), ("b", second)):
        dealt = pairs.with_blocks(rows, ["scope", "class"], ["tkey"], BLOCK)
        hot = dealt.filter("_nblk > 1").groupBy("scope", F.col("class").alias(f"{s}_class")).agg(F.max("_nblk").alias("_n"))
        units = units.join(hot, ["scope", f"{s}_class"], "left").withColumn(f"{s}_blk", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        sides.append(dealt.select("scope", F.col("class").alias(f"{s}_class"), F.col("_blk").alias(f"{s}_blk"), F.col("t").alias(s)))
    before = F.struct(jp._field("a", "table_pos"), jp._field("a", "tkey")) < F.struct(jp._field("b", "table_pos"), jp._field("b", "tkey"))
    return units.join(sides[0], ["scope", "a_class", "a_blk"]).join(sides[1], ["scope", "b_class", "b_blk"]).filter(before)


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("tkey", "table_name", "table_pos")]
    none = F.lit(None).cast("string")
    return rows.select(F.col("scope").alias("source_id"), *sides, F.col("a_at").cast("bigint").alias("a_ordinal"), F.col("b_at").cast("bigint").alias("b_ordinal"), "a_column_name", "b_column_name", none.alias("join_condition"), none.alias("on_sql"), "confidence", "signal_source", *more)


def by_name(columns: DataFrame, cross: bool = False, normalise: str | None = None) -> DataFrame:
    """The column pairs of all tables that match by name, in the layout of ``joinpaths.candidates``.

    ``a_ordinal`` and ``b_ordinal`` are the places among a table's shared columns.
    """
    small, large = _split(columns, cross)
    found = pathscopes.flat(pathscopes.names(small, cross, normalise)) if small is not None else None
    if large is None:
        return found
    nothing = jp._by_key(large.limit(0), cross, None, None)
    shapes = cut_lineage(_shapes(large, nothing, cross, normalise))
    return _both(found, _flat(_expand(_class_candidates(shapes), shapes)))


def _explicit(columns: DataFrame, cross: bool, vectors: DataFrame | None, foreign_keys: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Paths by key, scored pairs, and both as links that tell tables apart."""
    keys = cut_lineage(jp._by_key(columns, cross, foreign_keys, None))
    marks = ["source_id", *[f"{s}_{c}" for s in "ab" for c in ("tkey", "table_name", "table_pos")], "signal_source", "confidence"]
    if vectors is None:
        return keys, None, keys.select(*marks)
    scores = cut_lineage(jp.vector_scores(vectors, cross, threshold))
    scored = scores.withColumns({"signal_source": F.lit("embedding"), "confidence": F.col("cosine").cast("double")})
    return keys, scores, keys.select(*marks).unionByName(scored.select(*marks))


def _class_pairs(rows: DataFrame, shapes: DataFrame, *more: str) -> DataFrame:
    """(scope, one, two, ...) classes of table pairs, the smaller name first, for rows with source_id, a_tkey, b_tkey."""
    of = [shapes.select(F.col("scope").alias("source_id"), F.col("tkey").alias(f"{s}_tkey"), F.col("class").alias(f"{s}_class")) for s in "ab"]
    found = rows.join(of[0], ["source_id", "a_tkey"]).join(of[1], ["source_id", "b_tkey"])
    return found.select(F.col("source_id").alias("scope"), F.least("a_class", "b_class").alias("one"), F.greatest("a_class", "b_class").alias("two"), *more)


def factored(
    columns: DataFrame,
    cross: bool = False,
    vectors: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    normalise: str | None = None,
    threshold: float = jp.COSINE_THRESHOLD,
) -> Factored:
    """All direct and indirect paths of a catalog per class of tables."""
    small = None
    if vectors is None and foreign_keys is None:
        small, columns = _split(columns, cross)
        if columns is None:
            return Factored(None, None, None, None, None, small, cross, normalise)
    keys, scores, marks = _explicit(columns, cross, vectors, foreign_keys, threshold)
    shapes = cut_lineage(_shapes(columns, marks, cross, normalise))
    classes = cut_lineage(shapes.groupBy("scope", "class").agg(F.count(F.lit(1)).alias("n")))
    found = cut_lineage(_class_candidates(shapes))
    # pairs with a key or a score are worked out one by one, all others per class
    apart = _class_pairs(marks.filter("a_tkey <> b_tkey"), shapes).distinct()
    ordered = apart.select("scope", F.col("one").alias("a_class"), F.col("two").alias("b_class"))
    ordered = ordered.unionByName(apart.select("scope", F.col("two").alias("a_class"), F.col("one").alias("b_class"))).distinct()
    best = Window.partitionBy("scope", "a_class", "b_class").orderBy(F.desc("confidence"), "a_at", "b_at")
    links = found.join(ordered, ["scope", "a_class", "b_class"], "left_anti").filter(F.col("confidence") >= jp.MIN_CONFIDENCE)
    links = cut_lineage(links.withColumn("pair_rank", F.row_number().over(best)).filter(F.col("pair_rank") <= jp.PATHS_PER_PAIR))
    everything = keys
    if scores is not None:
        of = [shapes.select(F.col("scope").alias("source_id"), F.col("tkey").alias(f"{s}_tkey"), F.col("class").alias(f"{s}_class"), F.col("source_id").alias(f"{s}_source"), F.col("table_name").alias(f"{s}_name"), F.col("table_pos").alias(f"{s}_pos")) for s in "ab"]
        pair = scores.select("source_id", "a_tkey", "b_tkey").distinct().join(of[0], ["source_id", "a_tkey"]).join(of[1], ["source_id", "b_tkey"])
        sides = [F.struct(F.col(f"{s}_source").alias("source_id"), F.col(f"{s}_name").alias("table_name"), F.col(f"{s}_pos").alias("table_pos"), F.col(f"{s}_tkey").alias("tkey")).alias(s) for s in "ab"]
        named = _flat(pair.select(F.col("source_id").alias("scope"), "a_class", "b_class", *sides).join(found, ["scope", "a_class", "b_class"]))
        seen = keys.unionByName(named)
        everything = jp.blend_vectors(seen, scores).unionByName(jp.vector_candidates(scores, seen))
    explicit = cut_lineage(jp.fuse(everything))
    best_of = _class_pairs(explicit.filter("pair_rank = 1 AND a_tkey <> b_tkey"), shapes, "confidence").distinct()
    named_best = links.filter("pair_rank = 1").select("scope", F.least("a_class", "b_class").alias("one"), F.greatest("a_class", "b_class").alias("two"), "confidence").distinct()
    direct = cut_lineage(best_of.unionByName(named_best).groupBy("scope", "one", "two").agg(F.max("confidence").alias("confidence")))
    return Factored(shapes.select("scope", "class", "tkey", "source_id", "table_name", "table_pos"), classes, links, explicit, direct, small, cross, normalise)


def hops(paths: Factored) -> DataFrame:
    """scope, one, mid, two, confidence, n_paths: classes without a direct path that have strong ones to the class between."""
    direct, classes = paths.direct, paths.classes
    known = paths.members.filter("table_pos is not null").select("scope", F.col("class").alias("end")).distinct()
    strong = direct.filter((F.col("confidence") * jp.INDIRECT_FACTOR >= jp.MIN_CONFIDENCE) & (F.col("one") != F.col("two")))
    ends = strong.select("scope", F.col("one").alias("end"), F.col("two").alias("mid"), "confidence").unionByName(strong.select("scope", F.col("two").alias("end"), F.col("one").alias("mid"), "confidence"))
    ends = cut_lineage(ends.join(known, ["scope", "end"]).join(classes.select("scope", F.col("class").alias("end"), "n"), ["scope", "end"]))
    met = pairs.self_pairs(ends, ["scope", "mid"], ["end"]).select(
        "l.scope", F.least("l.end", "r.end").alias("one"), "l.mid", F.greatest("l.end", "r.end").alias("two"), F.least("l.confidence", "r.confidence").alias("least"), (F.col("l.n") * F.col("r.n")).alias("pairs")
    )
    inside = ends.filter("n > 1").select("scope", F.col("end").alias("one"), "mid", F.col("end").alias("two"), F.col("confidence").alias("least"), F.expr("n * (n - 1) div 2").alias("pairs"))
    open_ = met.unionByName(inside).join(direct.select("scope", "one", "two"), ["scope", "one", "two"], "left_anti")
    mids = classes.select("scope", F.col("class").alias("mid"), F.col("n").alias("mids"))
    return open_.join(mids, ["scope", "mid"]).select("scope", "one", "mid", "two", (F.col("least") * jp.INDIRECT_FACTOR).alias("confidence"), (F.col("pairs") * F.col("mids")).alias("n_paths"))


def direct_rows(paths: Factored, asked: DataFrame | None = None) -> DataFrame:
    """The direct paths of all tables, or of the asked ones (``tkey``), as ``joinpaths.fuse`` gives them."""
    small = None
    if paths.small is not None:
        small = pathscopes.flat(pathscopes.paths(paths.small, paths.cross, paths.normalise, hops=False), "pair_rank")
        if asked is not None:
            hit = [small.join(asked.select(F.col("tkey").alias(f"{s}_tkey")), f"{s}_tkey", k).select(small.columns) for s, k in (("a", "left_semi"), ("a", "left_anti"))]
            small = hit[0].unionByName(hit[1].join(asked.select(F.col("tkey").alias("b_tkey")), "b_tkey", "left_semi"))
        small = jp.with_texts(small)
    if paths.large is None:
        return small
    named = _flat(_expand(paths.links, paths.members, asked), "pair_rank")
    explicit = paths.explicit
    if asked is not None:
        touched = [explicit.join(asked.select(F.col("tkey").alias(f"{s}_tkey")), f"{s}_tkey", "left_semi") for s in "ab"]
        explicit = touched[0].unionByName(touched[1]).distinct()
    columns = named.columns
    return _both(small, jp.with_texts(named.unionByName(explicit.select(*columns))))


def indirect_rows(paths: Factored, direct: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The one-hop paths between all tables, or between asked ones; ``direct`` holds the direct paths of their ends."""
    small = None
    if paths.small is not None:
        small = pathscopes.hops(paths.small, paths.cross, paths.normalise)
        for s in "ab" if asked is not None else "":
            small = small.join(asked.select(F.col("tkey").alias(f"{s}_tkey")), f"{s}_tkey", "left_semi").select(small.columns)
    if paths.large is None:
        return small
    strong = direct.filter((F.col("pair_rank") == 1) & (F.col("a_tkey") != F.col("b_tkey")))
    halves = [
        strong.select("source_id", *[F.col(f"{x}_{c}").alias(f"end_{c}") for c in ("tkey", "table_name", "table_pos")], F.col(f"{y}_tkey").alias("mid_tkey"), F.col(f"{y}_table_name").alias("mid_table_name"), "join_condition", "on_sql", "confidence")
        for x, y in ("ab", "ba")
    ]
    edges = halves[0].unionByName(halves[1])
    # a hop is expanded like a direct link of its two ends, in both orders, then once per table between
    found = cut_lineage(hops(paths).select("scope", "one", "mid", "two"))
    both = [found.select("scope", F.col(x).alias("a_class"), F.col(y).alias("b_class"), "mid") for x, y in (("one", "two"), ("two", "one"))]
    both = both[0].unionByName(both[1].filter("a_class <> b_class"))
    members = paths.members
    if asked is not None:
        members = members.join(asked, "tkey", "left_semi")
    ends = _expand(both, members).select(F.col("scope").alias("source_id"), F.col("a.tkey").alias("key_a"), F.col("b.tkey").alias("key_b"), "mid")
    mids = paths.members.select(F.col("scope").alias("source_id"), F.col("class").alias("mid"), F.col("tkey").alias("mid_tkey"))
    survivors = ends.join(mids, ["source_id", "mid"]).drop("mid")
    return _both(small, jp.hop_rows(survivors, edges))


def path_counts(paths: Factored) -> DataFrame:
    """Number of paths by source, signal and confidence, without a row per path."""
    small = pathscopes.counts(paths.small, paths.cross, paths.normalise) if paths.small is not None else None
    if paths.large is None:
        return small
    sizes = [paths.classes.select("scope", F.col("class").alias(f"{s}_class"), F.col("n").alias(f"{s}_n")) for s in "ab"]
    # a pair of classes is linked in both orders with equal confidences; each pair of tables has one of them
    named = paths.links.filter("a_class <= b_class").join(sizes[0], ["scope", "a_class"]).join(sizes[1], ["scope", "b_class"])
    n_pairs = F.when(F.col("a_class") == F.col("b_class"), F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
    direct = named.select("scope", "signal_source", "confidence", n_pairs.alias("n_paths"))
    keyed = paths.explicit.select(F.col("source_id").alias("scope"), "signal_source", "confidence", F.lit(1).cast("bigint").alias("n_paths"))
    between = hops(paths).select("scope", F.lit("indirect").alias("signal_source"), "confidence", "n_paths")
    every = _both(direct.unionByName(keyed).unionByName(between).withColumnRenamed("scope", "source_id"), small)
    return every.groupBy("source_id", "signal_source", "confidence").agg(F.sum("n_paths").cast("bigint").alias("n_paths"))


def name_groups(columns: DataFrame, cross: bool = False, normalise: str | None = None) -> DataFrame:
    """Per match key and rule, how many column pairs of different tables match: source_id, cls, match_key, signal_source, n_pairs.

    Counted from how often each table holds each name, so a name that very many tables hold
    costs no more than its columns.
    """
    small, columns = _split(columns, cross)
    small = pathscopes.groups(small, cross, normalise) if small is not None else None
    if columns is None:
        return small
    keyed = cut_lineage(jp.keyed_columns(columns, normalise).withColumn("scope", _scope(cross)))
    table = "table_name" if cross else "tkey"  # tables of one name are not paired across sources
    ends = F.col("low").endswith("_id") | F.col("low").endswith("_key")
    named = keyed.filter("low <> 'id'")
    held = named.groupBy("scope", "cls", "mkey", "low", F.col(table).alias("t"), (F.col("low") == F.col("own_id")).alias("own"), (F.col("stripped") != "").alias("stem"), ends.alias("ends")).agg(F.count(F.lit(1)).alias("n"))
    held = cut_lineage(held)

    def across(rows: DataFrame, keys: list[str], alias: str) -> DataFrame:
        """Pairs of columns in different tables among rows of equal keys."""
        per = rows.groupBy(*keys, "t").agg(F.sum("n").alias("n"))
        return per.groupBy(*keys).agg((F.expr("(sum(n) * sum(n) - sum(n * n)) div 2")).cast("bigint").alias(alias))

    group, name = ["scope", "cls", "mkey"], ["scope", "cls", "mkey", "low"]
    equal = across(held, name, "all").join(across(held.filter("NOT own"), name, "plain"), name, "left")
    equal = equal.groupBy(*group).agg(F.sum("all").alias("all"), F.sum(F.coalesce("plain", F.lit(0))).alias("exact"))
    stems = held.filter("stem")
    # different names of one stem, at least one of which ends like a key
    quiet = stems.filter("NOT ends")
    suffix = across(stems, group, "every").join(across(stems, name, "x").groupBy(*group).agg(F.sum("x").alias("alike")), group, "left")
    silent = across(quiet, group, "q").join(across(quiet, name, "x").groupBy(*group).agg(F.sum("x").alias("q_alike")), group, "left")
    suffix = suffix.join(silent, group, "left").select(*group, (F.col("every") - F.coalesce("alike", F.lit(0)) - F.coalesce(F.col("q") - F.coalesce("q_alike", F.lit(0)), F.lit(0))).alias("suffix"))
    # a child's "<parent>_id" against the parent's "id"
    kids = keyed.filter("low like '%\\\\_id'").groupBy("scope", "cls", "mkey", F.col("low").alias("own_id"), F.col(table).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ids = keyed.filter("low = 'id'").groupBy("scope", "cls", "own_id", F.col(table).alias("t")).agg(F.count(F.lit(1)).alias("m"))
    of = ["scope", "cls", "own_id"]
    total = kids.groupBy(*of, "mkey").agg(F.sum("n").alias("n")).join(ids.groupBy(*of).agg(F.sum("m").alias("m")), of)
    same = kids.join(ids, [*of, "t"]).groupBy(*of, "mkey").agg(F.sum(F.col("n") * F.col("m")).alias("same"))
    to_id = total.join(same, [*of, "mkey"], "left").select(*group, (F.col("n") * F.col("m") - F.coalesce("same", F.lit(0))).alias("n_pairs"), F.lit("name_pattern:fk_id").alias("signal_source"))
    rows = (
        equal.select(*group, F.col("exact").alias("n_pairs"), F.lit("name_pattern:exact_match").alias("signal_source"))
        .unionByName(equal.select(*group, (F.col("all") - F.col("exact")).alias("n_pairs"), F.lit("name_pattern:fk_id").alias("signal_source")))
        .unionByName(suffix.select(*group, F.col("suffix").alias("n_pairs"), F.lit("name_pattern:stripped_suffix").alias("signal_source")))
        .unionByName(to_id)
    )
    rows = _both(rows.select(F.col("scope").alias("source_id"), "cls", F.col("mkey").alias("match_key"), "signal_source", "n_pairs"), small)
    counted = rows.groupBy("source_id", "cls", "match_key", "signal_source").agg(F.sum("n_pairs").cast("bigint").alias("n_pairs"))
    return counted.filter("n_pairs > 0")
