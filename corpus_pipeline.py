"""A corpus pipeline over `documents`: quality, language, near copies, secrets, packing.

Each stage is (spark, documents, sf_dir) -> DataFrame over all that its predecessor kept; run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, language, near_copies, packing, quality, secrets
from tidemark.llm.common import stored

#: Documents below these scores go.
LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.5


def _keeping(*names: str):
    """Lets a stage use columns of these names although documents may have such columns of their own, which stay."""

    def around(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
            own = {c: f"own__{c}" for c in documents.columns if c in names}
            out = stage(spark, documents.withColumnsRenamed(own), sf_dir)
            return out.withColumnsRenamed({v: k for k, v in own.items()})

        return run

    return around


@_keeping("quality_score")
def quality_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, trained on `labels`, doesn't reject."""
    weights = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(documents, weights)
    return scored.where(F.col("quality_score") >= LEAST_QUALITY).select(*documents.columns)


@_keeping("lang_pred", "lang_score")
def language_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: not `und`, and with a posterior of LEAST_LANGUAGE or more."""
    found = language.identify(documents, *language.train(documents))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE)).select(*documents.columns)


@_keeping("t1", "t2")
def near_copies_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (the first by doc_id and a hash of the text), and those without doc_id.

    Rows of one doc_id with other texts are documents of their own; rows that repeat doc_id and text are one.
    """
    key = ["doc_id", "t1", "t2"]
    first = near_copies.classes(documents.select("doc_id", "text")).where("kept and doc_id is not null").select(key).distinct()
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    named = near_copies.keyed(documents.where("doc_id is not null"), *others).join(stored(first, "first"), key, "left_semi").dropDuplicates(key)
    kind = documents.schema["doc_id"].dataType
    return named.withColumn("doc_id", F.col("doc_id").cast(kind)).select(*documents.columns).unionByName(documents.where("doc_id is null"))


@_keeping("secret_spans", "_base", "_more")
def secrets_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; n_chars follows the text."""
    clean = secrets.redact(secrets.find(documents, secrets.train(documents)))
    changed = clean.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else clean
    return changed.select(*documents.columns)


def packing_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of packing.CAPACITY tokens."""
    return packing.pack(stored(packing.pieces(documents, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near copies", near_copies_stage),
    ("secret scan", secrets_stage),
    ("best-fit packing", packing_stage),
]
#: SQL can't express the models, the sampled join and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`. What a stage needed besides its result is deleted after it."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = common.made()
    for name, stage in STAGES:
        documents = stored(stage(spark, documents, sf_dir), name.replace(" ", "-"))
        common.release(spark, began, keep_last=True)
    return documents
