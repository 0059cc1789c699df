"""On-chain pools: swaps as trades, price impact, activity, liquidity by position and tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = ("block", "transaction_index", "log_index")


def spot_price(sqrt_price: Column, decimals0: Column, decimals1: Column) -> Column:
    """Price of token 0 in token 1 from its square root (as a double, already without the 2**96 scale)."""
    return F.pow(sqrt_price, F.lit(2.0)) * F.pow(F.lit(10.0), (decimals0 - decimals1).cast("double"))


def as_trades(swaps: DataFrame, priority: list[str]) -> DataFrame:
    """Base and quote by token priority (the token named first is the quote), side, quantities and execution price."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(c)), F.lit(0))
    order = lambda c: F.when(rank(c) == 0, len(priority) + 1).otherwise(rank(c))
    swap = order("token0") < order("token1")
    base = F.when(swap, F.col("amount1")).otherwise(F.col("amount0"))
    quote = F.when(swap, F.col("amount0")).otherwise(F.col("amount1"))
    return swaps.select(
        "*", F.when(swap, F.col("token1")).otherwise(F.col("token0")).alias("base_token"), F.when(swap, F.col("token0")).otherwise(F.col("token1")).alias("quote_token"),
        F.when(base > 0, "SELL").otherwise("BUY").alias("trade_side"), F.abs(base).alias("base_qty"), F.abs(quote).alias("quote_qty"), F.when(base != 0, F.abs(quote / base)).alias("execution_price"),
    )


def impacts(swaps: DataFrame, order: tuple[str, ...] = POSITION) -> DataFrame:
    """Move of the spot price and distance of the execution price from the spot before, in basis points."""
    before = F.lag("spot").over(Window.partitionBy("pool").orderBy(*order))
    rows = swaps.withColumn("_b", before)
    bps = lambda x: F.when(F.col("_b") > 0, F.abs(x - F.col("_b")) / F.col("_b") * 10_000)
    return rows.withColumns({"impact_bps": bps(F.col("spot")), "slippage_bps": bps(F.col("execution"))}).drop("_b")


def activity(events: DataFrame) -> DataFrame:
    """Counts by kind and totals of each pool."""
    return events.groupBy("pool").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"{k}s") for k in ("swap", "mint", "burn", "collect", "flash")],
        F.sum(F.when(F.col("kind") == "mint", F.col("amount")).otherwise(0.0)).alias("deposited"), F.sum(F.when(F.col("kind") == "collect", F.col("amount")).otherwise(0.0)).alias("collected"),
    )


def liquidity_positions(events: DataFrame) -> DataFrame:
    """Net liquidity of each owner and range."""
    signed = F.when(F.col("kind") == "mint", F.col("liquidity")).when(F.col("kind") == "burn", -F.col("liquidity")).otherwise(0.0)
    return events.groupBy("pool", "owner", "lower", "upper").agg(F.sum(signed).alias("liquidity"), F.count("*").alias("events"))


def tick_map(positions: DataFrame) -> DataFrame:
    """Gross and net liquidity at each tick, and what is active from it on."""
    ends = F.array(F.struct(F.col("lower").alias("tick"), F.col("liquidity").alias("net")), F.struct(F.col("upper").alias("tick"), (-F.col("liquidity")).alias("net")))
    ticks = positions.select("pool", F.explode(ends).alias("x")).select("pool", "x.*")
    ticks = ticks.groupBy("pool", "tick").agg(F.sum(F.abs("net")).alias("gross"), F.sum("net").alias("net"))
    return ticks.withColumn("active", F.sum("net").over(Window.partitionBy("pool").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))


def utilisation(positions: DataFrame, tick: Column) -> DataFrame:
    """Share of each pool's liquidity whose range holds the tick."""
    live = F.sum(F.when((F.col("lower") <= tick) & (tick < F.col("upper")), F.col("liquidity")).otherwise(0.0))
    total = F.sum("liquidity")
    return positions.groupBy("pool").agg(F.when(total != 0, live / total).alias("utilisation"))


def last_continuous_block(blocks: DataFrame, by: str = "pool") -> DataFrame:
    """The block before the first gap, and the last block of all."""
    nxt = F.lead("block").over(Window.partitionBy(by).orderBy("block"))
    rows = blocks.select(by, "block").distinct().withColumn("_n", nxt)
    gap = F.min(F.when(F.col("_n") > F.col("block") + 1, F.col("block")))
    return rows.groupBy(by).agg(F.coalesce(gap, F.max("block")).alias("continuous"), F.max("block").alias("latest"))
