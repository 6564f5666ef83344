"""Business domains: tables clustered by the words in their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescope.functions import text
from lakescope.operators import clustering
from lakescope.operators.catalog import joined_sha16
from lakescope.session import cut_lineage

TABLE = ["source_id", "table_name", "table_pos"]
NAME_TERMS = 3
KEYWORDS = 5
SEPARATOR = "_"


def tokens(columns: DataFrame) -> DataFrame:
    """Words of the table name, then of the column names, repeats kept.

    ``(ordinal, idx)`` is the position of a word inside its table.
    """
    heads = columns.select(*TABLE).distinct().select(*TABLE, F.lit(-1).cast("bigint").alias("ordinal"), F.col("table_name").alias("n"))
    names = heads.unionByName(columns.select(*TABLE, "ordinal", F.col("column_name").alias("n")))
    return names.select(*TABLE, "ordinal", F.posexplode(text.name_tokens(F.col("n"))).alias("idx", "term"))


def term_counts(words: DataFrame, by: Sequence[str] = ("table_pos",)) -> DataFrame:
    return words.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(counts: DataFrame, n: int) -> DataFrame:
    """ln((n + 1) / (df + 1)) per term from per-table counts; 0 for a term of every table."""
    freq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return freq.select("term", "df", F.log(F.lit(n + 1) / (F.col("df") + 1)).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Unit features ``(id, term, w)`` from counts ``(table_pos, term, tf)``."""
    raw = counts.join(weights, "term").select(
        F.col("table_pos").alias("id"), "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    return clustering.unit_features(raw)


def features(columns: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and items: table vectors if every table has one, else TF-IDF.

    ``vectors`` rows: ``source_id, table_name, vector``.
    """
    tables = columns.select(*TABLE).distinct()
    items = tables.select(F.col("table_pos").alias("id"))
    if vectors is not None:
        held = tables.join(vectors.select("source_id", "table_name", "vector"), ["source_id", "table_name"], "left")
        if held.filter("vector is null").limit(1).count() == 0:
            return clustering.vector_features(held, "table_pos", "vector"), items
    counts = cut_lineage(term_counts(tokens(columns)))
    return tfidf(counts, idf(counts, items.count())), items


def domain_terms(words: DataFrame, members: DataFrame) -> DataFrame:
    """Word counts per domain with the place of the first appearance."""
    return (
        words.join(members.select("table_pos", "label"), "table_pos")
        .groupBy("label", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.min(F.struct("table_pos", "ordinal", "idx")).alias("seen"))
    )


def _ordered(ranked: DataFrame, limit: int, alias: str) -> DataFrame:
    """The first ``limit`` terms per label, in rank order."""
    top = ranked.filter(F.col("rank") <= limit).groupBy("label")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.agg(F.transform(pairs, lambda p: p["term"]).alias(alias))


def domain_names(terms: DataFrame, domains: int) -> DataFrame:
    """Top 3 terms by tf * ln((D + 1) / (d + 1)); ties by first appearance."""
    spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    score = F.round(F.col("tf") * F.log(F.lit(domains + 1) / (F.col("d") + 1)), 12)
    w = Window.partitionBy("label").orderBy(F.desc("score"), "seen")
    ranked = terms.join(spread, "term").withColumn("score", score).withColumn("rank", F.row_number().over(w))
    return _ordered(ranked, NAME_TERMS, "name_terms").select(
        "label", F.concat_ws(SEPARATOR, "name_terms").alias("domain_name")
    )


def domain_keywords(terms: DataFrame) -> DataFrame:
    """The 5 most frequent terms; ties by first appearance."""
    w = Window.partitionBy("label").orderBy(F.desc("tf"), "seen")
    return _ordered(terms.withColumn("rank", F.row_number().over(w)), KEYWORDS, "keywords")


def domain_ids(members: DataFrame) -> DataFrame:
    """16 hex digits over the sorted table names of each domain."""
    return joined_sha16(members.select("label", "table_name"), ["label"], "table_name", "domain_id")


def assemble(words: DataFrame, members: DataFrame, domains: int, single: bool = False) -> DataFrame:
    """Domain rows ``(domain_id, domain_name, keywords, table_count)`` per label."""
    terms = domain_terms(words, members)
    keys = domain_keywords(terms)
    if single:
        names = keys.select("label", F.concat_ws(SEPARATOR, F.slice("keywords", 1, NAME_TERMS)).alias("domain_name"))
    else:
        names = domain_names(terms, domains)
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("table_count"))
    named = F.when(F.coalesce("domain_name", F.lit("")) == "", "default").otherwise(F.col("domain_name"))
    return (
        sizes.join(domain_ids(members), "label")
        .join(names, "label", "left")
        .join(keys, "label", "left")
        .select(
            "label",
            "domain_id",
            named.alias("domain_name"),
            F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
            "table_count",
        )
    )


def single_domain(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fallback: one domain of all tables, named by its first keywords."""
    members = columns.select(*TABLE).distinct().withColumn("label", F.lit(0))
    return assemble(tokens(columns), members, 1, single=True), members


def discover(columns: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Domains and their members ``(source_id, table_name, table_pos, label)``.

    Membership stays in rows, so a domain may hold any number of tables.
    """
    feats, items = features(columns, vectors)
    feats, items = cut_lineage(feats), cut_lineage(items)
    n = items.count()
    if n < clustering.MIN_ITEMS:
        return single_domain(columns)
    history = clustering.average_linkage(feats, items)
    labels = cut_lineage(clustering.cut(history, items, clustering.cluster_counts(n)))
    best = clustering.choose_k(clustering.silhouettes(feats, labels))
    if best is None:
        return single_domain(columns)
    chosen = labels.filter(F.col("k") == best[0]).select(F.col("id").alias("table_pos"), "label")
    members = cut_lineage(columns.select(*TABLE).distinct().join(chosen, "table_pos").select(*TABLE, "label"))
    return assemble(tokens(columns), members, best[0]), members


def report(domains: DataFrame, members: DataFrame, source_id: str | None = None) -> DataFrame:
    """Member rows with their domain, for one source or all.

    ``table_count`` counts the members shown; domains without any drop out.
    """
    shown = members if source_id is None else members.filter(F.col("source_id") == source_id)
    counts = shown.groupBy("label").agg(F.count(F.lit(1)).alias("table_count"))
    return (
        shown.join(counts, "label")
        .join(domains.drop("table_count"), "label")
        .select("domain_name", "source_id", "table_name", "keywords", "table_count")
    )


def unclustered(tables: DataFrame, members: DataFrame, source_id: str | None = None) -> DataFrame:
    rows = tables if source_id is None else tables.filter(F.col("source_id") == source_id)
    return rows.join(members.select("source_id", "table_name"), ["source_id", "table_name"], "left_anti")
