"""What the corpus operators share: a scratch place all executors see, bounded samples and tree sums."""

from __future__ import annotations

import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays that one group of a tree sum adds up at most.
FAN_IN = 32
#: Buckets in one row of a table of counts.
SLICE = 1 << 14


class _Made(threading.local):
    """Paths by thread: two pipelines at once in one process don't delete each other's tables."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below the warehouse, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    return path


def made() -> int:
    """How many paths shared_dir() has named so far."""
    return len(_made.paths)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what shared_dir() has named since then (all but the last, if so). Nothing may read those any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _made.paths[since : -1 if keep_last else None]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _made.paths.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a stored table; whatever else it stored in the shared folder is deleted."""
    began = made()
    out = stored(make(), name)
    release(spark, began, keep_last=True)
    return out


def added(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema and the given columns (name and type) after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items())).fields])


def part(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows of df at most, chosen by a hash of the key (all rows when there are fewer)."""
    rows = df.count()
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(20240229), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * bound / rows))


def text_slices(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `limit` characters; a longer text is alone in its range."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices_of(counts: np.ndarray, **keys) -> list[dict]:
    """Rows of a table of counts: nonzero slices as compressed float64."""
    out = []
    for k in range(0, len(counts), SLICE):
        piece = counts[k : k + SLICE]
        if piece.any():
            out.append(keys | {"slice": k // SLICE, "counts": zlib.compress(piece.astype("<f8").tobytes(), 1)})
    return out


def _array(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<f8")


def tree_sum(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Sums packed arrays (`counts`) by keys, at most FAN_IN arrays a group and round, so no group grows with the input.

    df has `task`, the number of the task that made a row: one row for each task and key. `partitions`: how many tasks there
    are, about. Where they are more, several rows are left for a key, and unpack() adds those.
    """
    schema = df.schema

    def add(pdf):
        import pandas as pd

        row = pdf.iloc[:1].copy()
        row["counts"] = [zlib.compress(sum(_array(x) for x in pdf["counts"]).astype("<f8").tobytes(), 1)]
        return pd.DataFrame(row)

    while True:
        df = df.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        df = df.groupBy(*keys, "task").applyInPandas(add, schema)
        partitions = -(-partitions // FAN_IN)
        if partitions <= 1:
            return df


def by_blocks(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(table) -> table for the rows of each combination of integer keys: one shuffle and one sort, and no call into Python
    for each of many small blocks. A block's rows are held together, so blocks must be of bounded size."""

    def blocks(batches):
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, bool)
            new[0] = last is not None and tuple(int(c[0]) for c in columns) != last
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            last = tuple(int(c[-1]) for c in columns)
            table = pa.Table.from_batches([batch])
            start = 0
            for cut in np.flatnonzero(new).tolist():
                held.append(table.slice(start, cut - start))
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held, start = [], cut
            held.append(table.slice(start))
        if held:
            yield pa.concat_tables(held) if len(held) > 1 else held[0]

    def map_blocks(batches):
        out: list[pa.Table] = []
        rows = 0
        for block in blocks(batches):
            if not block.num_rows:
                continue
            made = run(block)
            if made.num_rows:
                out.append(made)
                rows += made.num_rows
            if rows >= 10_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(map_blocks, schema)


def unpack(rows, size: int) -> np.ndarray:
    """The dense array of rows (slice, counts)."""
    out = np.zeros(size)
    for r in rows:
        a = _array(r["counts"])
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(a)] += a
    return out
