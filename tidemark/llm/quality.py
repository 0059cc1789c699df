"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import added, part, text_slices, texts_of

#: Weights of the model.
BUCKETS = 1 << 18
#: Labelled rows that training takes at most (about); they are chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Parts of the training rows; each trains alone and the weights are averaged.
SHARDS = 8

_AGAIN = np.uint64(0x5851F42D4C957F2D)  # stands for a word that repeats the one before


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' word 1-grams and 2-grams, and where each text's begin.

    Words are runs of letters and digits or of marks, as written; a word equal to the one before it is one fixed symbol.
    """
    h, at = chars.token_hashes(texts, chars.words_and_marks())
    if not len(h):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(len(h), bool)
    first[at[:-1][at[:-1] < len(h)]] = True
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    word = np.where(same, _AGAIN, h)
    before = np.empty_like(word)
    before[0], before[1:] = 0, word[:-1]
    before[first] = np.uint64(1)
    pair = chars.mix(before * np.uint64(3) + word)
    out = np.empty(2 * len(h), np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out[0::2] = chars.mix(word) >> shift
    out[1::2] = pair >> shift
    return out, 2 * at


class Ftrl:
    """Per-coordinate follow-the-regularised-leader logistic regression; the last weight is the bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, buckets: np.ndarray, y: float) -> None:
        i, counts = np.unique(buckets, return_counts=True)
        x = np.append(counts / np.sqrt(max(1, len(buckets))), 1.0)
        i = np.append(i, BUCKETS)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1: a sparse dot product for each text. A text without words gets the bias alone."""
    out = np.empty(len(texts))
    for a, b in text_slices(texts):
        i, at = features(texts[a:b])
        dot = chars.segment_sums(weights[i].astype(np.float64), at) / np.sqrt(np.maximum(1, np.diff(at)))
        out[a:b] = 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))
    return out


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> np.ndarray:
    """The weights. Labelled rows whose crc32(doc_id) mod 4 is 2 are held out; null labels and texts are left out.

    At most about `rows` labels are used: so few are broadcast, and only their documents' texts are shuffled.
    A document labelled more than once takes its largest label. Without any label every weight is 0 (score 0.5).
    """
    known = labels.where(F.col(label).isNotNull() & (part("doc_id", 4) != 2)).select("doc_id", F.col(label).alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = F.pmod(F.xxhash64(F.lit(4711), F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * share)
    docs = documents.where(F.col("text").isNotNull() & chosen).select("doc_id", "text")
    both = docs.join(F.broadcast(known.where(chosen)), "doc_id").select(
        "y", "text", F.xxhash64(F.lit(7), "doc_id").alias("at"), F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(SHARDS)).alias("shard")
    )

    def fit(pdf):
        import pandas as pd

        model = Ftrl()
        pdf = pdf.sort_values(["at", "text"])
        for a, b in text_slices(texts := pdf["text"].tolist()):
            i, at = features(texts[a:b])
            for k, y in enumerate(pdf["y"].iloc[a:b]):
                model.learn(i[at[k] : at[k + 1]], float(y))
        return pd.DataFrame({"n": [len(pdf)], "weights": [model.weights().astype("<f4").tobytes()]})

    found = both.groupBy("shard").applyInPandas(fit, "n long, weights binary").collect()  # SHARDS rows
    if not found:
        return np.zeros(BUCKETS + 1, np.float32)
    share = np.array([r["n"] for r in found], float)
    return np.average([np.frombuffer(r["weights"], "<f4") for r in found], axis=0, weights=share).astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents with `quality_score` (0 to 1) added; a column of that name in documents is replaced."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(weights)
    documents = documents.drop("quality_score")
    schema = added(documents, quality_score="double")
    target = schema.fieldNames()

    def run(batches):
        for batch in batches:
            out = scores(texts_of(batch), model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=target)

    return documents.mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a model learnt from the rows of `labels` that aren't held out.

    Null and empty texts are scored by the bias; a null doc_id isn't held out; repeated rows each get their row.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(documents, labels)
    out = score(documents.select("doc_id", "text"), weights)
    return out.select(
        "doc_id",
        F.coalesce(part("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )
