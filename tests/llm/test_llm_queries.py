"""Registered queries of the subpackage against DuckDB, and the cases every operator must define."""

import compare
import pytest
from pyspark.sql import functions as F

from lakescope.llm import decontamination, exact_dedup, fingerprints, html_text, infill, jaccard_join, licenses, packing, quality, resampling, secrets, token_counts, urls
from lakescope.llm.queries import ORACLES, PATTERN, QUERIES, TOKENIZER

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, row int, text_ string"


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert compare.mismatch(QUERIES[name](spark, sf), compare.connect(sf), ORACLES[name]) is None


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None), (None, ""), (1, ""), (2, None), (3, "Same Text, twice over"), (3, "Same Text, twice over"), (4, "same text, twice over"), (5, long), (6, "x" * 300_000)]
    return frame(spark, [(*r, "en", "s", 1, "i", "d", 7, "t") for r in rows])


OPERATORS = {
    "decontamination": lambda d: decontamination.contamination(d, d.sparkSession.createDataFrame([(1, "same text twice over"), (2, None), (None, "")], "item_id bigint, text string")),
    "licenses": licenses.license_spans,
    "jaccard": jaccard_join.similar_documents,
    "tokens": lambda d: token_counts.token_counts(d, TOKENIZER, PATTERN),
    "packing": lambda d: packing.pack(packing.measure(d)),
    "near packing": lambda d: packing.pack(packing.near_clusters(d), "cluster"),
    "sequences": lambda d: packing.sequences(d, packing.pack(packing.measure(d))),
    "quality": quality.features,
    "urls": lambda d: urls.judge(d, url="text"),
    "secrets": lambda d: secrets.findings(d, path="doc_id"),
    "exact": lambda d: exact_dedup.lookup(exact_dedup.build(d)),
    "html": lambda d: html_text.main_texts(d, "text"),
    "sketches": fingerprints.sketches,
    "neighbours": fingerprints.with_neighbours,
    "infill": lambda d: infill.restore(infill.infill(d)),
    "resampling": lambda d: resampling.resample(d, d),
    "resampling towards nothing": lambda d: resampling.resample(d, d.limit(0)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    one_each = {"decontamination", "jaccard", "quality", "urls", "secrets", "exact", "html", "sketches", "neighbours", "infill", "resampling", "resampling towards nothing"}
    assert not (name in one_each) or len(rows) == 9
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [exact_dedup.drop_duplicates, jaccard_join.one_of_each_group, lambda d: decontamination.drop_contaminated(d, d.limit(0).select(F.lit(1).alias("item_id"), "text"))])
def test_stages_keep_the_columns(odd, stage):
    out = stage(odd)
    assert out.columns == odd.columns
    assert stage(odd.limit(0)).count() == 0
    assert out.filter("row <> 7 OR digest <> 'd'").count() == 0
