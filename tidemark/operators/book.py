"""Order-book operators: level history, snapshots, depth queries, grouping, own orders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.kernels import BookQuotes, folded
from tidemark.operators.windows import running

FOREVER = 1 << 62


def level_history(deltas: DataFrame, key: str = "price") -> DataFrame:
    """How long each level stood: (instrument, side, key, size, valid_from, valid_to, seq).

    The last action of a key and time wins; DELETE and size 0 end a level; a CLEAR ends all levels of its instrument.
    """
    epoch = F.count(F.when(F.col("action") == "CLEAR", 1)).over(running(["instrument_id"]))
    rows = deltas.withColumn("epoch", epoch)
    cleared = rows.where("action = 'CLEAR'").groupBy("instrument_id", (F.col("epoch") - 1).alias("epoch")).agg(F.min("ts_event").alias("cleared"))
    acts = rows.where("action <> 'CLEAR'")
    at = Window.partitionBy("instrument_id", "epoch", "side", key)
    acts = acts.withColumn("_last", F.max("seq").over(at.partitionBy("instrument_id", "epoch", "side", key, "ts_event"))).where("seq = _last").drop("_last")
    acts = acts.withColumn("_next", F.lead("ts_event").over(at.orderBy("ts_event", "seq")))
    acts = acts.where("action <> 'DELETE' and size > 0").join(cleared, ["instrument_id", "epoch"], "left")
    return acts.select("instrument_id", "side", key, "size", F.col("ts_event").alias("valid_from"), F.coalesce("_next", "cleared", F.lit(FOREVER)).alias("valid_to"), "seq")


def book_at(history: DataFrame, grid: DataFrame, step: int, time: str = "ts") -> DataFrame:
    """Levels that stand at each time of an even grid (its first and last time suffice), with their rank from the best price of
    their side. A level is put out to the times that it covers, so nothing is compared with a whole grid."""
    ends = grid.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    first = F.greatest(F.expr(f"((valid_from - 1) div {step} + 1) * {step}"), F.col("_a"))
    final = F.least(F.expr(f"((valid_to - 1) div {step}) * {step}"), F.col("_b"))
    live = history.join(F.broadcast(ends)).where(first <= final).withColumn(time, F.explode(F.sequence(first, final, F.lit(step)))).drop("_a", "_b")
    better = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    return live.withColumn("level", F.row_number().over(Window.partitionBy("instrument_id", time, "side").orderBy(better, "seq")))


def to_l2(levels: DataFrame, by: Iterable[str]) -> DataFrame:
    """Size and number of orders at each price."""
    return levels.groupBy(*by, "side", "price").agg(F.sum("size").alias("size"), F.count("*").alias("count"))


def top_of_book(levels: DataFrame, by: Iterable[str]) -> DataFrame:
    bid, ask = F.col("side") == "BUY", F.col("side") == "SELL"
    price = F.col("price")
    out = levels.groupBy(*by).agg(
        F.max(F.when(bid, price)).alias("bid_price"), F.max_by("size", F.when(bid, price)).alias("bid_size"),
        F.min(F.when(ask, price)).alias("ask_price"), F.min_by("size", F.when(ask, price)).alias("ask_size"),
    )
    return out.withColumns({"spread": F.col("ask_price") - F.col("bid_price"), "mid": (F.col("ask_price") + F.col("bid_price")) / 2})


def sides(levels: DataFrame, by: Iterable[str], depth: int = 10) -> DataFrame:
    """Books as rows: arrays of (price, size) from the best price on, `depth` levels of each side."""
    ranked = levels.where(F.col("level") <= depth)

    def side(name: str, sign: int) -> Column:
        rows = F.collect_list(F.when(F.col("side") == name, F.struct((sign * F.col("price")).alias("k"), "price", "size")))
        return F.transform(F.sort_array(rows), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))

    return ranked.groupBy(*by).agg(side("BUY", -1).alias("bids"), side("SELL", 1).alias("asks"))


def quantity_for_price(levels: Column, price: Column, buy: bool) -> Column:
    """Size that an order at the price could take from the other side's levels."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + F.when((x["price"] <= price) if buy else (x["price"] >= price), x["size"]).otherwise(0.0))


def crossed_levels(levels: Column, price: Column, buy: bool) -> Column:
    return F.filter(levels, lambda x: (x["price"] <= price) if buy else (x["price"] >= price))


def quantity_at_level(levels: Column, price: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + F.when(x["price"] == price, x["size"]).otherwise(0.0))


def sweep(levels: Column, quantity: Column) -> Column:
    """(price, size) fills of an order that walks the levels."""
    zero = F.struct(quantity.cast("double").alias("left"), F.array().cast("array<struct<price:double,size:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["size"])
        more = F.concat(acc["out"], F.array(F.struct(x["price"].alias("price"), take.alias("size"))))
        return F.struct((acc["left"] - take).alias("left"), F.when(take > 0, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(levels, zero, step, lambda acc: acc["out"])


def avg_price(fills: Column) -> Column:
    """Average of (price, size); 0 without any."""
    size = F.aggregate(fills, F.lit(0.0), lambda acc, x: acc + x["size"])
    value = F.aggregate(fills, F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"])
    return F.when(size > 0, value / size).otherwise(0.0)


def worst_price(fills: Column) -> Column:
    return F.element_at(fills, -1)["price"]


def exposure_walk(levels: Column, target: Column, unit: float = 1.0) -> Column:
    """(average price, quantity) that takes up to a notional, whole units of each level; prices of 0 are passed over."""
    zero = F.struct(target.cast("double").alias("left"), F.lit(0.0).alias("q"), F.lit(0.0).alias("v"))

    def step(acc: Column, x: Column) -> Column:
        room = F.floor(acc["left"] / x["price"] / unit) * unit
        take = F.when(x["price"] > 0, F.least(room.cast("double"), x["size"])).otherwise(0.0)
        return F.struct((acc["left"] - take * x["price"]).alias("left"), (acc["q"] + take).alias("q"), (acc["v"] + take * x["price"]).alias("v"))

    return F.aggregate(levels, zero, step, lambda a: F.struct(F.when(a["q"] > 0, a["v"] / a["q"]).otherwise(0.0).alias("price"), a["q"].alias("quantity")))


def violations(levels: DataFrame, by: Iterable[str], kind: str = "L2") -> DataFrame:
    """Books whose best bid reaches the best ask, or with more levels or orders than their kind may have."""
    top = top_of_book(levels, by).where("bid_price >= ask_price").select(*by, F.lit("crossed").alias("reason"))
    if kind == "L3":
        return top
    key = ["side"] if kind == "L1" else ["side", "price"]
    many = levels.groupBy(*by, *key).count().where("count > 1").select(*by, F.lit("levels" if kind == "L1" else "orders").alias("reason")).distinct()
    return top.unionByName(many)


def grouped(levels: DataFrame, by: Iterable[str], group: float) -> DataFrame:
    """Sizes by price bucket: bids rounded down, asks up."""
    bucket = F.when(F.col("side") == "BUY", F.floor(F.col("price") / group)).otherwise(F.ceil(F.col("price") / group)) * group
    return levels.groupBy(*by, "side", bucket.cast("double").alias("price")).agg(F.sum("size").alias("size"))


def net_of_own(levels: DataFrame, own: DataFrame, by: Iterable[str]) -> DataFrame:
    """Levels less own size at their price; nothing left, nothing shown."""
    mine = own.groupBy(*by, "side", "price").agg(F.sum("size").alias("own"))
    out = levels.join(mine, [*by, "side", "price"], "left").withColumn("size", F.col("size") - F.coalesce("own", F.lit(0.0)))
    return out.where("size > 0").drop("own")


def own_book(orders: DataFrame) -> DataFrame:
    """Leaves quantity by price of open, priced orders that are not immediate."""
    live = orders.where("price is not null and status in ('ACCEPTED', 'PARTIALLY_FILLED') and time_in_force not in ('IOC', 'FOK')")
    left = F.col("quantity") - F.coalesce("filled_qty", F.lit(0.0))
    return live.groupBy("instrument_id", "side", "price").agg(F.sum(left).alias("size"), F.count("*").alias("count")).where("size > 0")


def binary_combined(yes: DataFrame, no: DataFrame) -> DataFrame:
    """A binary market as one book: a NO order at p is a YES order of the other side at 1 - p."""
    flipped = no.withColumns({"price": 1 - F.col("price"), "side": F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")})
    return yes.unionByName(flipped)


def snapshot_deltas(levels: DataFrame, by: Iterable[str], time: str) -> DataFrame:
    """A book state as a CLEAR and an ADD for each level, in `n`'s order."""
    by = list(by)
    clear = levels.groupBy(*by, time).agg(F.lit("CLEAR").alias("action")).select(*by, time, "action", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("size"))
    adds = levels.select(*by, time, F.lit("ADD").alias("action"), "side", "price", "size")
    w = Window.partitionBy(*by, time).orderBy((F.col("action") == "ADD").cast("int"), "side", "price")
    return clear.unionByName(adds).withColumn("n", F.row_number().over(w))


def mbp_key(flags: Column, side: Column, price: Column, tob: int = 64, mbp: int = 16) -> Column:
    """What identifies a level: the side for top-of-book updates, the price for aggregated ones."""
    return F.when(flags.bitwiseAND(tob) != 0, side).when(flags.bitwiseAND(mbp) != 0, price.cast("string"))


def derived_quotes(deltas: DataFrame) -> DataFrame:
    """Quotes after each F_LAST delta, when both sides stand and the best prices or sizes have changed.

    Memory is one instrument's live levels; a delta costs the logarithm of their number.
    """
    return folded(deltas, BookQuotes())


def top_from_ticks(kind: str) -> dict[str, Column]:
    """The top of a book that only ticks are known of: a quote's sides, a trade's or a bar's price on both."""
    if kind == "quotes":
        return {c: F.col(c) for c in ("bid_price", "ask_price", "bid_size", "ask_size")}
    price, size = (F.col("price"), F.col("size")) if kind == "trades" else (F.col("close"), F.col("volume"))
    return {"bid_price": price, "ask_price": price, "bid_size": size, "ask_size": size}
