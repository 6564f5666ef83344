"""The stages one after the other, each held against its own definition."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_decontamination import brute as brute_leaks
from test_jaccard_join import brute as brute_groups
from test_jaccard_join import brute_by

from lakescope.session import BATCH_BYTES, cut_lineage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = cut_lineage(stages["quality classifier"](spark, docs, sf))
    assert good.columns == columns
    wrong = labels.join(docs.join(good, "doc_id", "left_anti"), "doc_id").filter("quality = 1")
    assert wrong.count() <= 0.02 * labels.count()
    assert labels.join(good, "doc_id").filter("quality = 0").count() <= 0.2 * labels.filter("quality = 0").count()

    single = cut_lineage(stages["exact dedup"](spark, good, sf))
    fold = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = good.groupBy(fold.alias("t")).agg(F.max("doc_id").alias("i")).select("i").collect()
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in want)

    apart = cut_lineage(stages["n-gram Jaccard join"](spark, single, sf))
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, _, first in brute_groups(rows) if i == first)

    clean = cut_lineage(stages["benchmark decontamination"](spark, apart, sf))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _, hit, _ in brute_leaks([(r["doc_id"], r["text"]) for r in apart.collect()], items) if hit}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in apart.collect() if r["doc_id"] not in leaks)

    out = stages["best-fit packing"](spark, clean, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, text in texts.items():
        assert "".join(r["text"] for r in sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["part"])) == text
    assert corpus_pipeline.run(spark, sf).count() == len(out)


ODD = [(None, None), (None, ""), (7, "row one of an id that repeats"), (7, "another row of an id that repeats"), (None, "no id but a text of its own"), (900_003, "x" * 300_000), (900_004, "twice the same row"), (900_004, "twice the same row")]


def test_odd_rows_and_clashing_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = {"row": F.lit(7), "id": F.lit("i"), "digest": F.lit("d"), "tie": F.lit(1.5), "part": F.lit("p"), "component": F.lit(0), "n_words": F.lit("n")}
    odd = spark.createDataFrame([(i, t, "en", "s", None) for i, t in ODD], docs.schema)
    docs.unionByName(odd).withColumns(names).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = kept.columns
        kept = cut_lineage(stage(spark, kept, str(tmp_path)))
        assert kept.columns == columns, name
    assert kept.filter("row <> 7 OR id <> 'i' OR part <> 'p'").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {}
    for r in sorted(out, key=lambda r: r["part"]):
        whole.setdefault((r["doc_id"], r["tie"]), []).append(r["text"])
    assert sorted(str((i, "".join(ts))) for (i, _), ts in whole.items()) == sorted(str((r["doc_id"], r["text"] or "")) for r in kept.collect())


def test_no_documents(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        (rows.limit(0) if t == "documents" else rows).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark, sf):
    base = [f"w{i}" for i in range(100)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900_001, " ".join(base)), (900_002, " ".join(base + [f"x{i}" for i in range(20)]))]  # 96 of 116 shingles of five words
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 900_001 in ids and 900_002 not in ids
    groups = dict(brute_by(rows, 5, 80, 100))
    assert ids == sorted(i for i, t in rows if groups[i] == i or not t)


def test_texts_reach_python_in_small_batches(spark, sf):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 400).alias("text"), F.lit("s").alias("source"))
    few, most = docs.filter("doc_id < 9"), 5 << 20
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_BYTES)
        stage(spark, few, sf)
        got = docs.mapInArrow(sizes, "n bigint, bytes bigint").collect()  # computed after the stage, as its result is
        assert sum(r["n"] for r in got) == 2000 and max(r["bytes"] for r in got) < most, name
    spark.conf.set(BATCH_BYTES, "12m")
    stage(spark, few, sf)
    assert spark.conf.get(BATCH_BYTES) == "12m"  # a session's own bound stays
    spark.conf.unset(BATCH_BYTES)
