"""Stages keep columns of documents that are named like their own."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in ("quality_score", "lang_pred", "secret_spans", "_base")})
    for name, stage in corpus_pipeline.STAGES:
        if name == "best-fit packing":
            continue
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where("quality_score <> concat('quality_score of ', doc_id) or secret_spans <> concat('secret_spans of ', doc_id) or _base <> concat('_base of ', doc_id)").count() == 0
