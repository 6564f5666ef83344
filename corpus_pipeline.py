"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakescope.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from lakescope.llm.queries import table
from lakescope.session import bound_batches, cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is scored as an empty one; rows that repeat are judged alike, and a score of
    exactly one half is kept. Labels are matched by id, so rows that share an id share a label.
    """
    bound_batches(spark)
    labelled = quality.training(table(spark, sf_dir, "labels"))
    model = quality.fit(quality.features(docs), labelled)
    return quality.keep_good(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, which a null id loses against.

    Null and empty texts are equal; of rows that repeat both id and text one stays.
    """
    bound_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the smallest id.

    Texts without words are like nothing and stay; where ids repeat or are null, rows are
    told apart by id and text.
    """
    bound_batches(spark)
    return jaccard_join.one_of_each_group(docs, rule=jaccard_join.NEAR)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows; null and empty texts have none, nor has an empty item.

    Rows that share an id share their fate.
    """
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' parts with their texts, bins and places.

    A null or empty text is one part without words; equal lengths go by id, part and a hash of
    the text, by which rows that share an id are told apart; rows that repeat are packed each.
    """
    bound_batches(spark)
    return packing.sequences(docs, packing.pack(packing.measure(docs)))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # a trained classifier and a packing are beyond SQL; tests/llm checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Stages but the last keep all columns, whatever their names; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
