"""Projections, filters, top-k and latest-row operators over tick tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import BY, ORDER, ordered, running, running_sum

F_LAST = 128


def extract_price(kind: str) -> Column:
    """BID, ASK or MID of a quote."""
    sides = {"BID": F.col("bid_price"), "ASK": F.col("ask_price"), "MID": (F.col("bid_price") + F.col("ask_price")) / 2}
    return sides[kind]


def extract_size(kind: str) -> Column:
    sides = {"BID": F.col("bid_size"), "ASK": F.col("ask_size"), "MID": (F.col("bid_size") + F.col("ask_size")) / 2}
    return sides[kind]


def last_n(df: DataFrame, n: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """The n newest rows of each key with `nth` (0 the newest)."""
    w = ordered(by, [F.desc(c) for c in order])
    return df.withColumn("nth", F.row_number().over(w) - 1).where(F.col("nth") < n)


def latest(df: DataFrame, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """The newest row of each key: one aggregate, with partial results before the shuffle."""
    by, order = list(by), list(order)
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*by).agg(best).select(*by, "row.*")


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every given value (None: no condition); lists mean any of them."""
    tests = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in values.items() if v is not None]
    return df.where(all_of(tests)) if tests else df


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def topic_matches(topic: Column, pattern: str) -> Column:
    """Wildcards: * any characters, ? one."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return topic.like(like)


def between(df: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None, time: str = "ts_event", order: Iterable[str] = ORDER) -> DataFrame:
    """Rows of [start, end]; with a limit the first ones in order."""
    tests = [F.col(time) >= start] if start is not None else []
    tests += [F.col(time) <= end] if end is not None else []
    out = df.where(all_of(tests)) if tests else df
    return out.orderBy(*order).limit(limit) if limit is not None else out


def merged(streams: dict[str, DataFrame], order: Iterable[str] | None = ORDER, places: int | None = None) -> DataFrame:
    """Rows of all streams with their name in `stream`, by time, then name, then sequence. order=None leaves them unsorted.

    places: instead of a sort, each row's place (from 1) in that order, counted by spans of so many units of time: rows of a span
    are sorted by themselves, and a count for each span brings what came before.
    """
    frames = [df.withColumn("stream", F.lit(name)) for name, df in streams.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if order is None:
        return out
    first, *rest = order
    if places is not None:
        return running_sum(out, "place", F.lit(1).cast("long"), [], [first, "stream", *rest], places)
    return out.orderBy(first, "stream", *rest)


def chunks(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """Consecutive ranges (chunk, lo, hi) of `step` that cover [start, end), made on the executors."""
    n = max(0, -(-(end - start) // step))
    lo = F.lit(start) + F.col("id") * step
    return spark.range(n).select(F.col("id").alias("chunk"), lo.alias("lo"), F.least(lo + step, F.lit(end)).alias("hi"))


def changed_quotes(df: DataFrame, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """Quotes that differ from the one before in a price or size."""
    w = ordered(by, order)
    same = all_of(F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("bid_price", "ask_price", "bid_size", "ask_size"))
    return df.withColumn("_same", same & F.lag(F.lit(1)).over(w).isNotNull()).where(~F.col("_same")).drop("_same")


def completed_quotes(df: DataFrame, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """Missing sides filled from the last known ones; rows before both sides are known go."""
    w = running(by, order)
    fields = ("bid_price", "ask_price", "bid_size", "ask_size")
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields}).where(all_of(F.col(c).isNotNull() for c in fields))


def bar_type_parts(c: Column) -> dict[str, Column]:
    """instrument, step, aggregation, price type, source of `INSTRUMENT-STEP-AGG-PRICE-SOURCE[@composite]`."""
    p = r"^(.+)-(\d+)-([A-Z_]+)-([A-Z]+)-([A-Z]+)(?:@(.*))?$"
    names = ("instrument_id", "step", "aggregation", "price_type", "source", "composite")
    return {n: F.regexp_extract(c, p, i + 1) for i, n in enumerate(names)}


def delta_batches(df: DataFrame, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """`batch`: rows up to and with one that carries F_LAST."""
    w = ordered(by, order)
    done = F.coalesce(F.lag((F.col("flags").bitwiseAND(F_LAST) != 0).cast("int")).over(w), F.lit(0))
    return df.withColumn("_done", done).withColumn("batch", F.sum("_done").over(running(by, order))).drop("_done")


def out_of_order(df: DataFrame, arrival: str = "seq", time: str = "ts_event", by: Iterable[str] = BY) -> DataFrame:
    """`late`: the row's time lies before one that arrived earlier."""
    w = ordered(by, [arrival]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.col(time) < F.max(time).over(w), F.lit(False)))
