"""Best-fit packing: tokenised pieces into sequences, exact complements first.

The plan is made from the counts of lengths alone (one number for each length up to the capacity), so it has the same size
for any input; pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import stored

CAPACITY = 4096
END = 1
#: Pieces of one length that are ranked in one group (about).
RANKED = 200_000


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).model


def _encoder(path: str) -> bpe.Encoder:
    m, library, letters = bpe.model(path), _tokenizer(path), bpe.byte_letters()

    def word(w: str) -> list[int]:
        return [t.id for t in library.tokenize("".join(map(letters.__getitem__, w.encode("utf-8", "replace"))))]

    return bpe.Encoder(word, m.split, m.special, lambda: bpe.Transducer(m))


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and END, cut every `capacity` ids."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            rows: list[list] = [[], [], [], [], []]
            held: list[np.ndarray] = []
            state = {"i": 0, "n": 0, "start": 0}

            def put(ids: np.ndarray) -> None:
                k = state["start"] // capacity
                for column, x in zip(rows, (doc_ids[state["i"]], k, state["start"], len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    column.append(x)
                state["start"] += len(ids)

            def take(ids: np.ndarray, last: bool) -> None:
                held.append(ids)
                state["n"] += len(ids)
                if state["n"] >= capacity or last:
                    a = np.concatenate(held)
                    full = len(a) if last else len(a) // capacity * capacity
                    for k in range(0, full, capacity):
                        put(a[k : min(k + capacity, full)])
                    held[:], state["n"] = [a[full:]], len(a) - full
                if last:
                    held.clear()
                    state.update(i=state["i"] + 1, n=0, start=0)

            end = np.array([END], np.uint32)
            for i, ids in encoder.stream(texts):
                while state["i"] < i:
                    take(end, True)
                take(ids, False)
            while state["i"] < len(texts):
                take(end, True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Patterns of lengths that fill sequences, each with the number of sequences that have it."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.patterns: list[tuple[list[int], int]] = []
        for length in range(capacity, 0, -1):
            while self.left[length] > 0:
                self._fill(length)

    def _fits(self, need: Counter, more: tuple[int, ...]) -> bool:
        total = need + Counter(more)
        return all(self.left[x] >= total[x] for x in more)

    def _exact(self, gap: int, need: Counter) -> tuple[int, ...] | None:
        """A length, or a pair or triple of available lengths, that adds up to the gap."""
        if self._fits(need, (gap,)):
            return (gap,)
        there = self.left[: gap + 1] > 0
        there[0] = False
        if (two := self._pair(gap, there, need, ())) is not None:
            return two
        for a in np.flatnonzero(there[:gap])[::-1].tolist():
            if 3 * a < gap:
                break
            if self._fits(need, (a,)) and (two := self._pair(gap - a, there, need, (a,))) is not None:
                return (a, *two)
        return None

    def _pair(self, gap: int, there: np.ndarray, need: Counter, more: tuple[int, ...]) -> tuple[int, int] | None:
        half = gap // 2
        for b in (np.flatnonzero(there[1 : half + 1] & there[gap - 1 : gap - half - 1 : -1]) + 1).tolist():
            if self._fits(need, (*more, gap - b, b)):
                return gap - b, b
        return None

    def _fill(self, length: int) -> None:
        need, gap = Counter([length]), self.capacity - length
        while gap:
            if (found := self._exact(gap, need)) is None:
                free = np.flatnonzero(self.left[1 : gap + 1])[::-1] + 1  # best fit: the longest that goes in
                found = next(((int(x),) for x in free if self.left[x] > need[int(x)]), None)
            if found is None:
                break
            need.update(found)
            gap -= sum(found)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= times * n
        self.patterns.append((sorted(need.elements(), reverse=True), times))

    def ranges(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), by length and rank: a length's ranks from the first rank on
        go to consecutive sequences, at that offset."""
        used, sequence, out = Counter(), 0, []
        for lengths, times in self.patterns:
            offset = 0
            for x in lengths:
                out.append((x, used[x], sequence, offset))
                used[x] += times
                offset += x
            sequence += times
        return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with doc_id, piece, start, length from 1 to capacity) and their sequence_id and offset.

    rows are read three times: hand over a stored table. Equal rows are told apart by rank alone, so either may take a place.
    """
    spark = rows.sparkSession
    found = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in found.items():
        counts[x] = n
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).ranges())
    salts = max(8, -(-int(counts.sum()) // RANKED))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select(*rows.columns, (F.col("rank") + F.col("base")).alias("rank"))

    names = [*rows.columns, "sequence_id", "offset"]

    def place(batches):
        length, rank, sequence, offset = plan.value.T
        key = (length << 40) + rank
        for batch in batches:
            own = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 40) + own, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])], names=names)

    return ranked.mapInArrow(place, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most CAPACITY tokens. Null and empty texts are one END token."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(stored(pieces(documents, public_tokenizers.path("word_bpe_49k.json")), "pieces"))
