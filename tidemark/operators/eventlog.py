"""Audits of an event log: gaps, digests, manifests, causes, cursors, retention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import settled


def gaps(log: DataFrame, by: Iterable[str] = ("run_id",), seq: str = "seq") -> DataFrame:
    """Ranges of missing sequence numbers within each run."""
    nxt = F.lead(seq).over(Window.partitionBy(*by).orderBy(seq))
    out = log.select(*by, seq).distinct().withColumn("_next", nxt).where(F.col("_next") - F.col(seq) > 1)
    return out.select(*by, (F.col(seq) + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def digest(fields: Iterable[str]):
    """SHA-256 of the fields as text, each led by its length."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    return F.sha2(F.concat(*[x for t in text for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]), 256)


def hash_mismatches(log: DataFrame, fields: Iterable[str], stored: str = "entry_hash") -> DataFrame:
    return log.where(~digest(fields).eqNullSafe(F.col(stored)))


def manifest_mismatches(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs whose count or highest sequence number differ from the manifest's."""
    found = log.groupBy("run_id").agg(F.count("*").alias("entries"), F.max("seq").alias("high"))
    both = manifest.join(found, "run_id", "full_outer")
    return both.where(~F.col("entries").eqNullSafe(F.col("stated_entries")) | ~F.col("high").eqNullSafe(F.col("stated_high")))


def causes(log: DataFrame, key: str = "entry_id", parent: str = "causation_id") -> DataFrame:
    """Each entry with its whole chain of causes, nearest first; the chain ends where a cause isn't in the log.

    Each round puts an entry's chain and that of its last cause together, so that chains double: a chain of n causes takes
    log2(n) joins. Causes that lead back to themselves are an error.
    """
    up = log.select(F.col(key).alias("_k"))
    at = log.select(key, F.col(parent).alias("_at")).join(up, F.col("_at") == F.col("_k"), "left")
    now = settled(at.select(key, F.when(F.col("_k").isNotNull(), F.array("_k")).otherwise(F.array().cast(f"array<{dict(log.dtypes)[key]}>")).alias("chain"), F.col("_k").alias("_at")))
    most = now.count()
    for _ in range(most.bit_length() + 1):
        if now.where("_at is not null").isEmpty():
            return now.select(key, "chain")
        then = now.select(F.col(key).alias("_k"), F.col("chain").alias("_more"), F.col("_at").alias("_next"))
        joined = now.join(then, F.col("_at") == F.col("_k"), "left")
        now = settled(joined.select(key, F.when(F.col("_k").isNotNull(), F.concat("chain", "_more")).otherwise(F.col("chain")).alias("chain"), F.col("_next").alias("_at")))
    raise ValueError("an entry is among its own causes")


def cursors(log: DataFrame, upto: int, by: Iterable[str], seq: str = "seq") -> DataFrame:
    """The last position of each stream at or before a sequence number."""
    return log.where(F.col(seq) <= upto).groupBy(*by).agg(F.max(seq).alias("seq"), F.max_by("ts_init", seq).alias("ts_init"))


def replay(log: DataFrame, start: DataFrame, end: DataFrame, by: Iterable[str], seq: str = "seq") -> DataFrame:
    """Rows of each stream after one cursor and up to another; streams without a first cursor begin at their beginning."""
    by = list(by)
    bounds = end.select(*by, F.col("seq").alias("_to")).join(start.select(*by, F.col("seq").alias("_from")), by, "left")
    return log.join(bounds, by).where((F.col(seq) > F.coalesce("_from", F.lit(-1))) & (F.col(seq) <= F.col("_to"))).drop("_from", "_to")


def retention(runs: DataFrame, keep: int, by: Iterable[str] = ()) -> DataFrame:
    """Sealed runs older than the latest good one that may go; the newest `keep` stay in any case."""
    w = Window.partitionBy(*by).orderBy(F.desc("run_id"))
    good = F.max(F.when(F.col("good"), F.col("run_id"))).over(Window.partitionBy(*by))
    rows = runs.withColumns({"_n": F.row_number().over(w), "_good": good})
    return rows.where(F.col("sealed") & (F.col("_n") > keep) & (F.col("run_id") < F.col("_good"))).drop("_n", "_good")
