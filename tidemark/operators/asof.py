"""Joins in time: as-of, latest-value alignment, interval, audit and cross-rate joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import BY, running, settled


def asof_join(
    left: DataFrame, right: DataFrame, by: Iterable[str] = BY, time: str = "ts_event", seq: str | None = "seq",
    forward: bool = False, tolerance: int | None = None, prefix: str = "r_", keep_unmatched: bool = True, bucket: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (forward: the first at or after), columns prefixed.

    Both sides go through one shuffle and one sort: they are put together, and each left row takes the last right row that
    stands before it. Right rows of equal time count as known. Tolerance is in units of `time`.

    With a bucket (a span of `time`, which must then be a whole number) a key of many rows spreads over many tasks: only rows
    of one key and bucket are sorted together, and what earlier buckets know goes in front of them as a row more.
    """
    by = list(by)
    row = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in by])
    tie = [seq] if seq else []
    sides = right.select(*by, F.col(time).alias("_t"), *[F.col(c).alias("_s") for c in tie], F.lit(0).alias("_side"), row.alias("_right"))
    own = left.select(*by, F.col(time).alias("_t"), *[F.col(c).alias("_s") for c in tie], F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = own.unionByName(sides, allowMissingColumns=True)
    turn = F.desc if forward else F.asc
    keys = by
    if bucket is not None:
        keys = [*by, "_bucket"]
        both = both.withColumn("_bucket", _bucket("_t", bucket))
        known = _known_before(both, by, {"_right": F.col("_right")}, ["_t", *["_s" for _ in tie]], forward)
        edge = F.col("_bucket") + bucket if forward else F.col("_bucket")
        both = both.unionByName(known.withColumns({"_t": edge, "_side": F.lit(-1)}), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(turn("_t"), F.asc("_side"), *[turn("_s") for _ in tie]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance is not None:
        gap = F.abs(F.col("_t") - F.col(f"_right.{prefix}{time}"))
        out = out.withColumn("_right", F.when(gap <= tolerance, F.col("_right")))
    if not keep_unmatched:
        out = out.where("_right is not null")
    return out.select("_left.*", "_right.*")


def _bucket(time: str, span: int) -> Column:
    """Where the bucket of a time starts, in whole numbers."""
    return F.col(time) - F.pmod(F.col(time), F.lit(span))


def _known_before(rows: DataFrame, by: list[str], values: dict[str, Column], order: list[str], forward: bool = False) -> DataFrame:
    """For each key and `_bucket` of rows, the last non-null of each value in earlier buckets (forward: the first in later ones).

    A row for each key and bucket, out of an aggregate that is partial before its shuffle.
    """
    pick, turn = (F.min_by, F.desc) if forward else (F.max_by, F.asc)
    ends = rows.groupBy(*by, "_bucket").agg(*[pick(v, F.when(v.isNotNull(), F.struct(*order))).alias(n) for n, v in values.items()])
    w = Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*by, "_bucket", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in values])


def align_latest(legs: dict[str, DataFrame], value: str, by: Iterable[str] = (), order: Iterable[str] = ("ts_event", "seq"), bucket: int | None = None) -> DataFrame:
    """Every update of any leg with the latest value of all legs in a column each; rows before all legs are known go.

    With a bucket (a span of the first order column) the rows of a key, or all rows where `by` is empty, spread over many
    tasks, as in asof_join.
    """
    by, order = list(by), list(order)
    frames = [df.select(*by, *order, F.lit(name).alias("leg"), F.col(value).alias("_v")) for name, df in legs.items()]
    own = {n: F.when(F.col("leg") == n, F.col("_v")) for n in legs}
    out = reduce(DataFrame.unionByName, frames)
    w = running(by, [*order, "leg"])
    if bucket is not None:
        out = out.withColumn("_bucket", _bucket(order[0], bucket))
        known = _known_before(out, by, own, order)
        rows = out.select(*by, "_bucket", *order, "leg", *[v.alias(n) for n, v in own.items()], F.lit(1).alias("_own"))
        out = rows.unionByName(known.withColumn("_own", F.lit(0)), allowMissingColumns=True)
        own = {n: F.col(n) for n in legs}
        w = running([*by, "_bucket"], ["_own", *order, "leg"])
    latest = [F.last(v, ignorenulls=True).over(w).alias(n) for n, v in own.items()]
    out = out.select(*by, *order, "leg", *latest)
    return out.where(reduce(lambda a, b: a & b, [F.col("leg").isNotNull(), *[F.col(n).isNotNull() for n in legs]]))


def interval_join(df: DataFrame, intervals: DataFrame, key: str, lo: str, hi: str, time: str = "ts_event") -> DataFrame:
    """Rows with the interval of their key that holds their time, lo <= time < hi; Spark broadcasts the intervals when small."""
    r = intervals.withColumnRenamed(key, "_key")
    return df.join(r, (F.col(key) == F.col("_key")) & (F.col(time) >= F.col(lo)) & (F.col(time) < F.col(hi))).drop("_key")


def differences(a: DataFrame, b: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys on one side alone or with a differing field, and which fields differ."""
    keys = list(keys)
    fields = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*fields).alias("_a"))
    y = b.select(*keys, F.struct(*fields).alias("_b"))
    both = x.join(y, keys, "full_outer")
    differ: list[Column] = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in fields]
    out = both.withColumn("fields", F.array_join(F.array_compact(F.array(*differ)), ","))
    side = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").otherwise("both")
    return out.withColumn("side", side).where("side <> 'both' or fields <> ''").select(*keys, "side", "fields")


def cross_rates(pairs: DataFrame, price_types: Iterable[str] = ("BID", "ASK", "MID")) -> DataFrame:
    """(price_type, base, quote, rate, path) between all currencies that quoted pairs (base, quote, bid, ask) lead to.

    A pair counts both ways, the other way as 1 / rate; prices that aren't positive count for nothing. Where one pair is quoted
    more than once (or from either side), the larger rate counts. Of several paths the shortest, then the first by name, stays.
    Each round puts two paths together, so paths double; the table never has more than a row for two currencies.
    """
    rate = {"BID": F.col("bid"), "ASK": F.col("ask"), "MID": (F.col("bid") + F.col("ask")) / 2}
    kinds = F.array(*[F.struct(F.lit(t).alias("price_type"), rate[t].cast("double").alias("rate")) for t in price_types])
    good = pairs.select("base", "quote", F.explode(kinds).alias("x")).select("x.price_type", "base", "quote", "x.rate").where("rate > 0 and base <> quote")
    edges = good.unionByName(good.select("price_type", F.col("quote").alias("base"), F.col("base").alias("quote"), (1 / F.col("rate")).alias("rate")))
    best = F.min_by(F.struct("rate", "path", "hops"), F.struct("hops", "path")).alias("x")
    key, size = ["price_type", "base", "quote"], None
    now = edges.groupBy(key).agg(F.max("rate").alias("rate")).select(*key, "rate", F.concat_ws(">", "base", "quote").alias("path"), F.lit(1).alias("hops"))
    while True:
        now = settled(now)
        if size == (size := now.count()):
            return now.drop("hops")
        on = now.select("price_type", F.col("base").alias("quote"), F.col("quote").alias("_to"), F.col("rate").alias("_r"), F.expr("substr(path, length(base) + 1)").alias("_path"), F.col("hops").alias("_n"))
        more = now.join(on, ["price_type", "quote"]).where(F.col("_to") != F.col("base"))
        more = more.select("price_type", "base", F.col("_to").alias("quote"), (F.col("rate") * F.col("_r")).alias("rate"), F.concat("path", "_path").alias("path"), (F.col("hops") + F.col("_n")).alias("hops"))
        now = now.unionByName(more).groupBy(key).agg(best).select(*key, "x.rate", "x.path", "x.hops")
