"""Bars from ticks: by time, calendar, count, volume, value, imbalance, runs and bricks; continuous contracts; spreads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernels
from tidemark.operators.kernels import folded
from tidemark.operators.windows import BY, ORDER, ordered, running, running_sum

DAY = 86_400_000_000_000


def _ohlcv(order: Iterable[str], price: str, size: str) -> list[Column]:
    at = F.struct(*order)
    return [
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(size).alias("volume"), F.count("*").alias("count"),
    ]


def time_bars(
    df: DataFrame, interval: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER, price: str = "price", size: str = "size",
    left_open: bool = True, stamp_on_close: bool = True, origin: int = 0, skip_first: bool = False, fill_empty: bool = False,
) -> DataFrame:
    """Bars of a fixed interval in nanoseconds.

    left_open: an interval is (start, end], else [start, end). `ts_event` is its end or start. skip_first drops a key's first
    interval if its first tick comes after the start. fill_empty puts bars of the last close and no volume into empty intervals
    between the first and the last.
    """
    by, order = list(by), list(order)
    t = F.col(order[0]) - origin
    exact = F.expr(f"({order[0]} - {origin}) div {interval}")
    rest = F.pmod(t, F.lit(interval))
    floor = exact - F.when((t < 0) & (rest != 0), 1).otherwise(0)
    end = (floor + F.when(rest != 0, 1).otherwise(0)) * interval if left_open else (floor + 1) * interval
    bars = df.withColumn("_end", end + origin).groupBy(*by, "_end").agg(*_ohlcv(order, price, size), F.min(order[0]).alias("_first"))
    if skip_first:
        w = ordered(by, ["_end"])
        inside = F.col("_first") > F.col("_end") - interval + (0 if not left_open else 1)
        bars = bars.withColumn("_n", F.row_number().over(w)).where(~((F.col("_n") == 1) & inside)).drop("_n")
    bars = bars.drop("_first")
    if fill_empty:
        grid = bars.groupBy(*by).agg(F.min("_end").alias("a"), F.max("_end").alias("b"))
        grid = grid.select(*by, F.explode(F.sequence("a", "b", F.lit(interval))).alias("_end"))
        bars = grid.join(bars, [*by, "_end"], "left")
        close = F.last("close", ignorenulls=True).over(running(by, ["_end"]))
        bars = bars.withColumn("_close", close).withColumns({c: F.coalesce(c, "_close") for c in ("open", "high", "low", "close")})
        bars = bars.withColumns({"volume": F.coalesce("volume", F.lit(0.0)), "count": F.coalesce("count", F.lit(0))}).drop("_close")
    stamp = F.col("_end") - (0 if stamp_on_close else interval)
    return bars.select(*by, stamp.alias("ts_event"), "open", "high", "low", "close", "volume", "count")


def calendar_bars(df: DataFrame, unit: str, step: int = 1, by: Iterable[str] = BY, order: Iterable[str] = ORDER, price: str = "price", size: str = "size") -> DataFrame:
    """Bars of months or years (and steps of them, counted from year 0), with their first day in `start`."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast({order[0]} div {DAY} as int)"))
    months = F.year(day) * 12 + F.month(day) - 1
    size_ = step * (12 if unit == "year" else 1)
    first = F.floor(months / size_) * size_
    start = F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1))
    return df.withColumn("start", start).groupBy(*by, "start").agg(*_ohlcv(order, price, size))


def composite_bars(bars: DataFrame, interval: int, by: Iterable[str] = BY) -> DataFrame:
    """Longer bars from shorter ones that are stamped on their close."""
    by = list(by)
    end = F.expr(f"((ts_event - 1) div {interval} + 1) * {interval}")
    at = F.col("ts_event")
    return bars.groupBy(*by, end.alias("end")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum("count").alias("count"),
    ).withColumnRenamed("end", "ts_event")


def tick_bars(df: DataFrame, step: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER, price: str = "price", size: str = "size", bucket: int | None = None) -> DataFrame:
    """Bars of `step` ticks; what is left at the end isn't a bar. bucket: see windows.running_sum."""
    by, order = list(by), list(order)
    bar = F.expr(f"(_n - 1) div {step}")
    rows = running_sum(df, "_n", F.lit(1).cast("long"), by, order, bucket).withColumn("bar", bar)
    return rows.groupBy(*by, "bar").agg(*_ohlcv(order, price, size), F.max(order[0]).alias("ts_event")).where(F.col("count") == step)


def threshold_bars(df: DataFrame, amount: Column, step, by: Iterable[str] = BY, order: Iterable[str] = ORDER, price: str = "price", sums: dict[str, Column] | None = None, bucket: int | None = None) -> DataFrame:
    """Bars that close whenever the running amount passes a multiple of step; a tick that crosses is split.

    Amounts are decimals, so bars hold exactly `step`; what is left at the end isn't a bar. `sums` adds up further shares of
    the split amount (for example of one side). bucket: see windows.running_sum.
    """
    by, order = list(by), list(order)
    exact = "decimal(28,6)"
    rows = running_sum(df.withColumn("_amount", amount.cast(exact)).where("_amount > 0"), "_hi", F.col("_amount"), by, order, bucket)
    rows = rows.withColumn("_hi", F.col("_hi").cast(exact))
    unit = F.lit(step).cast(exact)
    lo = (F.col("_hi") - F.col("_amount")).cast(exact)
    first = F.floor(lo / unit).cast("long")
    last_ = F.ceil(F.col("_hi") / unit).cast("long") - 1
    rows = rows.withColumn("_lo", lo).withColumn("bar", F.explode(F.sequence(first, last_)))
    part = F.least(F.col("_hi"), ((F.col("bar") + 1) * unit).cast(exact)) - F.greatest(F.col("_lo"), (F.col("bar") * unit).cast(exact))
    rows = rows.withColumn("_part", part.cast(exact))
    at = F.struct(*order)
    more = [F.sum(F.when(c, F.col("_part")).otherwise(F.lit(0).cast(exact))).cast("double").alias(n) for n, c in (sums or {}).items()]
    bars = rows.groupBy(*by, "bar").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum("_part").alias("_total"), F.count("*").alias("count"), F.max(order[0]).alias("ts_event"), *more,
    )
    return bars.where(F.col("_total") == unit).withColumn("amount", F.col("_total").cast("double")).drop("_total")


def volume_bars(df: DataFrame, step, **more) -> DataFrame:
    return threshold_bars(df, F.col("size"), step, **more)


def value_bars(df: DataFrame, step, **more) -> DataFrame:
    return threshold_bars(df, F.col("price") * F.col("size"), step, **more)


def _folded(df, kernel, by, order, bucket):
    return folded(df, kernel, by, order) if bucket is None else kernels.folded_in_spans(df, kernel, bucket, by, order)


def imbalance_bars(df: DataFrame, step: float, kind: str = "tick", by: Iterable[str] = BY, order: Iterable[str] = ORDER, bucket: int | None = None) -> DataFrame:
    """Bars that close when buys less sells reach `step` either way, in ticks, volume or value. bucket: see
    kernels.folded_in_spans."""
    return _folded(df, kernels.ImbalanceBars(step, kind), by, order, bucket)


def runs_bars(df: DataFrame, step: float, kind: str = "tick", by: Iterable[str] = BY, order: Iterable[str] = ORDER, bucket: int | None = None) -> DataFrame:
    """Bars that close when a run of one side reaches `step`; a change of side or a close begins a new run.
    bucket: see kernels.folded_in_spans."""
    return _folded(df, kernels.RunsBars(step, kind), by, order, bucket)


def tick_runs_bars(df: DataFrame, step: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """runs_bars of ticks in closed form: every step-th tick of a run closes."""
    by, order = list(by), list(order)
    w = ordered(by, order)
    rows = df.withColumn("_new", F.coalesce((F.col("aggressor_side") != F.lag("aggressor_side").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(running(by, order)))
    rows = rows.withColumn("_k", F.row_number().over(ordered([*by, "_run"], order))).withColumn("_close", (F.col("_k") % step == 0).cast("int"))
    rows = rows.withColumn("bar", F.sum("_close").over(running(by, order)) - F.col("_close"))
    bars = rows.groupBy(*by, "bar").agg(*_ohlcv(order, "price", "size"), F.max(order[0]).alias("ts_event"), F.max("_close").alias("_done"))
    return bars.where("_done = 1").drop("_done")


def renko_bars(df: DataFrame, brick: float, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """A bar for each brick that the price moves from the last brick's close; one tick may give several."""
    return folded(df, kernels.RenkoBars(brick), by, order)


def roll_offsets(rolls: DataFrame, backward: bool = True, ratio: bool = False) -> DataFrame:
    """For each segment of a roll table (transition, pre_id, post_id, pre_price, post_price): contract, [lo, hi) and its adjustment.

    The table is small: one row for each roll of one chain.
    """
    w = Window.orderBy("transition")
    change = F.log(F.col("post_price") / F.col("pre_price")) if ratio else F.col("post_price") - F.col("pre_price")
    rows = rolls.withColumns({"_c": change, "lo": F.lag("transition").over(w)})
    if backward:
        total = F.sum("_c").over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        total = -F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = rows.select(F.col("pre_id").alias("contract"), F.coalesce("lo", F.lit(-(1 << 62))).alias("lo"), F.col("transition").alias("hi"), total.alias("adjust"))
    end = F.max(F.lit(0.0)) if backward else -F.sum("_c")
    final = rows.agg(F.max_by("post_id", "transition").alias("contract"), F.max("transition").alias("lo"), end.alias("adjust"))
    out = first.unionByName(final.withColumn("hi", F.lit(1 << 62)))
    return out.withColumn("adjust", F.exp("adjust")) if ratio else out


def roll_violations(rolls: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rolls that don't rise in time, don't chain, or have a price that isn't positive; by: the columns that name a chain."""
    w = Window.partitionBy(*by).orderBy("seq")
    reason = F.when(F.col("transition") <= F.lag("transition").over(w), "time").when(F.col("pre_id") != F.lag("post_id").over(w), "chain")
    reason = reason.when((F.col("pre_price") <= 0) | (F.col("post_price") <= 0), "price")
    return rolls.withColumn("reason", reason).where("reason is not null")


def spread_quotes(aligned: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Bid and ask of a spread: each leg at the side that its ratio's sign trades on. aligned has structs (bid, ask) by leg."""
    bid = sum(F.lit(float(r)) * F.col(f"{leg}.{'bid' if r > 0 else 'ask'}") for leg, r in ratios.items())
    ask = sum(F.lit(float(r)) * F.col(f"{leg}.{'ask' if r > 0 else 'bid'}") for leg, r in ratios.items())
    return aligned.withColumns({"bid_price": bid, "ask_price": ask})


def option_spread_quotes(aligned: DataFrame, ratios: dict[str, float], tick: float) -> DataFrame:
    """Bid and ask of a spread of options around the spread of mids, vega weighted and rounded out to ticks.

    aligned has structs (bid, ask, vega) by leg. Half-width: mean of (ask - bid) / vega over the legs, times half the absolute
    sum of ratio times vega.
    """
    mid = sum(F.lit(float(r)) * (F.col(f"{leg}.bid") + F.col(f"{leg}.ask")) / 2 for leg, r in ratios.items())
    per_vega = sum((F.col(f"{leg}.ask") - F.col(f"{leg}.bid")) / F.col(f"{leg}.vega") for leg in ratios) / len(ratios)
    half = per_vega * F.abs(sum(F.lit(float(r)) * F.col(f"{leg}.vega") for leg, r in ratios.items())) / 2
    return aligned.withColumns({"bid_price": F.floor(F.round((mid - half) / tick, 9)) * tick, "ask_price": F.ceil(F.round((mid + half) / tick, 9)) * tick})


def bounded_rolls(rolls: DataFrame, last_post: str | None = None, first_pre: str | None = None) -> DataFrame:
    """The rolls from the one that leaves first_pre to the one that enters last_post. One chain's table is small."""
    w = Window.orderBy("transition")
    rows = rolls.withColumn("_n", F.row_number().over(w))
    every = Window.partitionBy()
    if first_pre is not None:
        rows = rows.withColumn("_a", F.min(F.when(F.col("pre_id") == first_pre, F.col("_n"))).over(every)).where("_n >= _a").drop("_a")
    if last_post is not None:
        rows = rows.withColumn("_b", F.max(F.when(F.col("post_id") == last_post, F.col("_n"))).over(every)).where("_n <= _b").drop("_b")
    return rows.drop("_n")


def single_price() -> Column:
    """Whether a bar's prices are all one."""
    return (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
