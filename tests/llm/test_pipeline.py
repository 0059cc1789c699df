"""The pipeline on a small table: what each stage keeps, and its columns."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        sizes.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "quality classifier":
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
        if name == "near copies":
            assert docs.select(F.countDistinct(F.md5("text"))).first()[0] == sizes[-1]
        if name == "secret scan":
            assert docs.where("text rlike '(?i)token *= *\"[0-9a-f]{20,}'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] <= sizes[5]
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_repeated_ids_and_no_rows(spark, tmp_path):
    """Texts of one doc_id are documents of their own, exact repetitions are one, and an empty table goes through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = dict(corpus_pipeline.STAGES)["near copies"]
    one, two = "the first text of this id has its own words and no more", "another text that shares nothing with what stands above"
    rows = docs.limit(0).unionByName(
        spark.createDataFrame([(1, one, 11), (1, two, 12), (1, two, 12), (2, one, 13), (3, None, 14), (None, one, 15)], "doc_id long, text string, t1 int"), allowMissingColumns=True
    )
    out = near(spark, rows, SF)
    assert out.columns == rows.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["t1"]) for r in out.collect())
    assert got == sorted([(1, one, 11), (1, two, 12), (3, "", 14), (0, one, 15)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
