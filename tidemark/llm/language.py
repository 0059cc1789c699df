"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix grows with the number of languages, not with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import added, part, sampled, slices_of, text_slices, texts_of, tree_sum, unpack

#: Columns of the log-probability matrix.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that training takes at most (about).
TRAIN_ROWS = 40_000
#: Languages in one slice of the matrix: a slice (64 MB with BUCKETS) is broadcast, and documents meet one slice after another.
SLICE_LANGUAGES = 256
SMOOTHING = 0.5


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at each character (BUCKETS where it would leave its text), and text bounds."""
    c, at = chars.code_points([t.lower() for t in texts])
    c = c.astype(np.uint64) + np.uint64(1)
    ends, lengths = at[1:], np.diff(at)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h[: len(c) - n + 1] = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in ORDERS:
            i = (chars.mix(h + np.uint64(n)) >> np.uint64(48)).astype(np.int32)
            for k in range(1, n):
                i[ends[lengths >= k] - k] = BUCKETS
            out.append(i)
    return out, at


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket).

    Learns from documents with text and lang whose crc32(doc_id) mod 3 isn't 1, about `rows` of them at most.
    """
    known = sampled(documents.where((part("doc_id", 3) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), "doc_id", rows)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        task = TaskContext.get().partitionId()

        def packed():
            for lang, total in sums.items():
                total[BUCKETS] = number[lang]
                yield pa.RecordBatch.from_pylist(slices_of(total, lang=lang, task=task), schema=_COUNTS)
            sums.clear()
            number.clear()

        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1))
                number[lang] = number.get(lang, 0) + len(own)
                for a, b in text_slices(own):
                    for i in grams(own[a:b])[0]:
                        total += np.bincount(i, minlength=BUCKETS + 1)
                if len(sums) >= 64:  # so many arrays at once at most
                    yield from packed()
        yield from packed()

    counts = known.select("lang", "text").mapInArrow(count, "lang string, task int, slice int, counts binary")
    total = tree_sum(counts, ["lang", "slice"], known.rdd.getNumPartitions()).collect()  # languages x BUCKETS numbers
    langs = sorted({r["lang"] for r in total})
    table = np.array([unpack([r for r in total if r["lang"] == x], BUCKETS + 1) for x in langs]).reshape(len(langs), BUCKETS + 1)
    docs, table = table[:, BUCKETS].copy(), table[:, :BUCKETS] + SMOOTHING
    logs = np.zeros((len(langs), BUCKETS + 2), np.float32)
    logs[:, :BUCKETS] = np.log(table / table.sum(1, keepdims=True)) if langs else 0
    logs[:, BUCKETS + 1] = np.log(docs / docs.sum()) if langs else 0
    return langs, logs


_COUNTS = pa.schema([("lang", pa.string()), ("task", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary())])


def _has_letter(texts: list[str]) -> np.ndarray:
    """Which texts have a letter (a character of Unicode's category L)."""
    c, at = chars.code_points(texts)
    return chars.segment_sums(chars.classes()[c] == 1, at) > 0


def predict(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the most probable language of the matrix, its log score, and log of the sum of all languages' scores
    over it. The first of equals counts. Very long texts have very low scores; these are relative to the best."""
    best, top, rest = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for a, b in text_slices(texts):
        found, at = grams(texts[a:b])
        points = np.empty((len(logs), b - a))
        for k in range(len(logs)):
            points[k] = sum(chars.segment_sums(logs[k][i], at) for i in found) / len(ORDERS) + logs[k][BUCKETS + 1]
        best[a:b], top[a:b] = points.argmax(0), points.max(0)
        rest[a:b] = np.log(np.exp(points - points.max(0)).sum(0))
    return best, top, rest


def identify(documents: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """documents with `lang_pred` and `lang_score` (its posterior) added; columns of those names in documents are replaced.

    A text without a letter is `und` with score 0, and so is every text if no language was learnt.
    """
    context = documents.sparkSession.sparkContext
    slices = [context.broadcast((k, logs[k : k + SLICE_LANGUAGES])) for k in range(0, len(langs), SLICE_LANGUAGES)]
    names = context.broadcast(langs)
    documents = documents.drop("lang_pred", "lang_score")
    schema = added(documents, lang_pred="string", lang_score="double")
    columns = schema.fieldNames()

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            best, top, rest = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
            for s in slices:
                first, table = s.value
                k, score, more = predict(texts, table)
                higher = score > top
                # log of the sum over all languages so far, relative to the best so far
                rest = np.where(higher, np.logaddexp(more, np.where(np.isinf(top), -np.inf, top + rest) - score), np.logaddexp(rest, more + score - np.where(higher, score, top)))
                best, top = np.where(higher, first + k, best), np.maximum(top, score)
            known = _has_letter(texts) & bool(names.value)
            pred = [names.value[i] if x else "und" for i, x in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(known, np.exp(-rest), 0.0))], names=columns)

    return documents.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model learnt from the documents that aren't held out.

    Null texts and texts without a letter are `und` with score 0; a null doc_id isn't held out (nor learnt from).
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, logs = train(documents)
    out = identify(documents.select("doc_id", "text"), langs, logs)
    return out.select(
        "doc_id", F.coalesce(part("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
