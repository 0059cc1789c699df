"""Cross-entropy difference: target and background word bigram models of one vocabulary, counted exactly.

Counts are looked up without a row for each pair: documents are put together in chunks, each chunk sends its distinct keys
(words and pairs) with their counts to shards by a range of hashes, a shard adds up what it gets and answers each chunk
with totals in the order of its keys, and the chunk's texts meet their answers. So keys are moved once and totals once.

A key is its shard and 40 more bits of a hash; shards grow with the texts, so one key in about a million shares its counts
with another, at any size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import added, stored, texts_of

#: Characters of texts in one chunk, and in all texts for each shard of the counts (about); both bound what a task holds.
CHUNK, SHARD = 1 << 21, 1 << 22
#: What every word counts more than seen, and the weight of the single-word estimate in counts of a context.
SMOOTHING, PRIOR = 0.1, 4.0

#: Bytes of a key besides its shard.
KEY_BYTES = 5
_START = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Events:
    """The words of some texts in order, by number: of the text, the word, the word before and the pair. Word 0 stands before
    a text's first word. A word's count as one before another takes in that the text ends there."""

    text: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    keys: np.ndarray
    words: int
    begun: np.ndarray

    def split(self, of_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each event the value of its word's, the word before's and the pair's key."""
        w = of_keys[: self.words]
        return w[self.word], w[self.before], of_keys[self.words :][self.pair]

    def counts(self, of_texts: np.ndarray) -> np.ndarray:
        """How often each key is there; a text's count as often as of_texts says."""
        weights = of_texts[self.text]
        out = np.concatenate([np.bincount(self.word, weights, self.words), np.bincount(self.pair, weights, len(self.keys) - self.words)])
        out[0] = of_texts[self.begun].sum()
        return out.astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each event how often its word, the word before and the pair are in its text."""
        _, at, n = np.unique(self.text * self.words + self.word, return_inverse=True, return_counts=True)
        word = n[at]
        _, at, n = np.unique(self.text * (int(self.pair.max(initial=0)) + 1) + self.pair, return_inverse=True, return_counts=True)
        before = np.ones_like(word)
        later = self.before > 0
        before[later] = word[np.flatnonzero(later) - 1]
        return word, before, n[at]


def events(texts: list[str]) -> Events:
    """Words are runs of letters and digits or of marks, in lower case."""
    h, at = chars.token_hashes([t.lower() for t in texts], chars.words_and_marks())
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    words, word = np.unique(h, return_inverse=True)
    word = word + 1
    before = np.zeros_like(word)
    begun = np.flatnonzero(np.diff(at))
    if len(h):
        before[1:] = word[:-1]
        before[at[:-1][begun]] = 0
    hashes = np.append(_START, chars.mix(words))
    pairs, pair = np.unique(before * len(hashes) + word, return_inverse=True)
    one, two = np.divmod(pairs, len(hashes))
    keys = np.concatenate([hashes & ~np.uint64(1), chars.mix(chars.mix(hashes[one]) + hashes[two]) | np.uint64(1)])
    return Events(text, word, before, pair, keys, len(hashes), begun)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cut(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _uncut(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8")[:, 0]


def _packed(a: np.ndarray) -> bytes:
    """Counts, most of which are small: a byte each, and those from 255 on once more."""
    return zlib.compress(np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i8").tobytes(), 1)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _chunks(documents: DataFrame) -> DataFrame:
    """(chunk, characters, ids, docs): documents of about CHUNK characters as one Arrow message, and their ids."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def packed():
            docs = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(docs)
            ids = docs.column("doc_id").combine_chunks()
            columns = [pa.array([task << 32 | number]), pa.array([size], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([sink.getvalue().to_pybytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "characters", "ids", "docs"])

        for batch in batches:
            start = 0
            for i, n in enumerate(map(len, texts_of(batch))):
                if size and size + n > CHUNK:
                    held.append(batch.slice(start, i - start))
                    yield packed()
                    held, start, size, number = [], i, 0, number + 1
                size += n
            held.append(batch.slice(start))
        if sum(b.num_rows for b in held):
            yield packed()

    return documents.mapInArrow(run, f"chunk long, characters long, ids array<{documents.schema['doc_id'].dataType.simpleString()}>, docs binary")


def _target(rows: int, places: list[int] | None) -> np.ndarray:
    out = np.zeros(rows)
    out[places or []] = 1
    return out


_ASKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
_TOTALS = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.binary()), ("t", pa.binary()), ("words", pa.int64()), ("total", pa.int64()), ("target_total", pa.int64())])


def _docs(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def score(documents: DataFrame, good: DataFrame) -> DataFrame:
    """documents with n_words, background_bits, target_bits (bits a word) and lm_score = target_bits - background_bits.

    The background has counted all documents, the target those whose doc_id is in good; a document's own words are left out of
    both while it is scored. The background's counts are scaled to the target's number of words, so that both are smoothed
    alike. Lower is nearer to the target. A text without words has n_words 0 and 0.0 in the others. Columns of those names are
    replaced. Whole texts count; repeated rows count as often as they are there.
    """
    documents = documents.drop("n_words", "background_bits", "target_bits", "lm_score")
    chunks = stored(_chunks(documents), "chunks")
    # ids alone are joined; of each chunk's documents the places of the target's, so that Spark knows how little that is
    ids = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).where("doc_id is not null")
    wanted = good.select("doc_id").where("doc_id is not null").distinct()
    places = stored(ids.join(wanted, "doc_id", "left_semi").groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias("target")), "target")
    marked = chunks.drop("ids").join(places, "chunk", "left")
    shards = max(1, -(-(chunks.agg(F.sum("characters")).first()[0] or 0) // SHARD))

    def ask(batches):
        for batch in batches:
            for chunk, docs, target in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "target")), strict=True):
                table = _docs(docs)
                e = events(texts_of(table))
                order = np.argsort(e.keys)
                keys = e.keys[order]
                n, t = e.counts(np.ones(table.num_rows))[order], e.counts(_target(table.num_rows, target))[order]
                bounds = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
                full = np.flatnonzero(np.diff(bounds)).tolist()
                parts = [slice(bounds[s], bounds[s + 1]) for s in full]
                columns = [full, [chunk] * len(full), [_cut(keys[p]) for p in parts], [_packed(n[p]) for p in parts], [_packed(t[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)

    def add(table: pa.Table) -> pa.Table:
        lists = [_uncut(x) for x in table.column("keys").to_pylist()]
        size = [len(x) for x in lists]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([_unpacked(x, k) for x, k in zip(table.column(c).to_pylist(), size, strict=True)]), len(keys)).astype(np.int64) for c in ("n", "t")]
        word = (keys & np.uint64(1) == 0) & (keys != _uncut(_cut(np.array([_START & ~np.uint64(1)])))[0])
        cuts = np.cumsum(size)[:-1]
        once = [[int(x)] + [0] * (len(size) - 1) for x in (word.sum(), sums[0][word].sum(), sums[1][word].sum())]
        answers = [[_packed(x) for x in np.split(s[at], cuts)] for s in sums]
        return pa.table([table.column("chunk"), table.column("shard"), *answers, *once], schema=_TOTALS)

    asked = marked.mapInArrow(ask, "shard int, chunk long, keys binary, n binary, t binary")
    totals = stored(asked.groupBy("shard").applyInArrow(add, "chunk long, shard int, n binary, t binary, words long, total long, target_total long"), "totals")
    vocabulary, total, target_total = (x or 0 for x in totals.agg(F.sum("words"), F.sum("total"), F.sum("target_total")).first())
    scale = target_total / total if target_total else 1.0
    schema = added(documents, n_words="long", background_bits="double", target_bits="double", lm_score="double")
    names = schema.fieldNames()

    def bits(counts, own, own_words, total: float, share: float) -> np.ndarray:
        word, before, pair = ((c - o) * share for c, o in zip(counts, own, strict=True))
        single = (word + SMOOTHING) / ((total - own_words) * share + SMOOTHING * max(1, vocabulary))
        return -np.log2((pair + PRIOR * single) / (before + PRIOR))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for docs, target in zip(left.column("docs").to_pylist(), left.column("target").to_pylist(), strict=True):
            table = _docs(docs)
            e = events(texts_of(table))
            order = np.argsort(e.keys)
            size = np.bincount(_shard(e.keys, shards), minlength=shards)
            answers = right.sort_by("shard")
            n = np.bincount(e.text, minlength=table.num_rows)
            own, own_n, is_target = e.own(), n[e.text], _target(table.num_rows, target)[e.text]
            means = []
            for column, words, share, mine in (("n", total, scale, 1), ("t", target_total, 1.0, is_target)):
                counts = np.empty(len(order), np.int64)
                counts[order] = np.concatenate([_unpacked(x, size[s]) for x, s in zip(answers.column(column).to_pylist(), answers.column("shard").to_pylist(), strict=True)])
                each = bits(e.split(counts), [o * mine for o in own], own_n * mine, words, share)
                means.append(np.bincount(e.text, each, table.num_rows) / np.maximum(n, 1))
            columns = [*table.columns, pa.array(n, pa.int64()), *map(pa.array, means), pa.array(means[1] - means[0])]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out)

    return marked.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(compare, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's cross-entropy under the model of well-labelled documents less that under the model of all documents.

    Target: documents labelled quality 1 and not toxic. Null texts count as empty.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(documents, labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")).drop("text")
