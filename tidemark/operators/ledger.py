"""Orders, positions, accounts and risk as aggregates and windows over event tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import affine, ordered, running_sum

#: Which status may follow which.
TRANSITIONS = [
    ("INITIALIZED", "SUBMITTED"), ("INITIALIZED", "DENIED"), ("SUBMITTED", "ACCEPTED"), ("SUBMITTED", "REJECTED"), ("SUBMITTED", "CANCELED"),
    ("ACCEPTED", "PARTIALLY_FILLED"), ("ACCEPTED", "FILLED"), ("ACCEPTED", "CANCELED"), ("ACCEPTED", "EXPIRED"), ("ACCEPTED", "PENDING_UPDATE"),
    ("ACCEPTED", "PENDING_CANCEL"), ("ACCEPTED", "TRIGGERED"), ("PARTIALLY_FILLED", "PARTIALLY_FILLED"), ("PARTIALLY_FILLED", "FILLED"),
    ("PARTIALLY_FILLED", "CANCELED"), ("PARTIALLY_FILLED", "EXPIRED"), ("PENDING_UPDATE", "ACCEPTED"), ("PENDING_CANCEL", "CANCELED"), ("TRIGGERED", "FILLED"),
]


def order_state(events: DataFrame, at: int | None = None, by: str = "order_id") -> DataFrame:
    """Each order's status, filled quantity, average price and times, as of a time if one is given."""
    events = events if at is None else events.where(F.col("ts_event") <= at)
    last = F.struct("ts_event", "seq")
    qty = F.sum("last_qty")
    return events.groupBy(by).agg(
        F.max_by("event", last).alias("status"), F.coalesce(qty, F.lit(0.0)).alias("filled_qty"), (F.sum(F.col("last_qty") * F.col("last_px")) / qty).alias("avg_px"),
        F.min("ts_event").alias("ts_init"), F.max("ts_event").alias("ts_last"), F.count("*").alias("events"),
    )


def illegal_transitions(events: DataFrame, by: str = "order_id") -> DataFrame:
    """Events whose status may not follow the one before."""
    spark = events.sparkSession
    allowed = spark.createDataFrame(TRANSITIONS, "before string, event string")  # a constant
    steps = events.withColumn("before", F.lag("event").over(ordered([by], ["ts_event", "seq"]))).where("before is not null")
    return steps.join(F.broadcast(allowed), ["before", "event"], "left_anti").select(by, "ts_event", "before", "event")


def execution_quality(events: DataFrame, reference: Column, by: str = "order_id") -> DataFrame:
    """Slippage of the average price against a reference (against the order's side) and time from submission to the last fill."""
    qty = F.sum("last_qty")
    avg = F.sum(F.col("last_qty") * F.col("last_px")) / qty
    first = lambda e: F.min(F.when(F.col("event") == e, F.col("ts_event")))
    out = events.withColumn("_ref", reference).groupBy(by, "order_side").agg(avg.alias("avg_px"), F.max("_ref").alias("ref"), first("SUBMITTED").alias("_s"), F.max(F.when(F.col("event") == "FILLED", F.col("ts_event"))).alias("_f"))
    sign = F.when(F.col("order_side") == "BUY", 1).otherwise(-1)
    return out.where("avg_px is not null").select(by, (sign * (F.col("avg_px") - F.col("ref"))).alias("slippage"), (F.col("_f") - F.col("_s")).alias("latency"))


def cycles(fills: DataFrame, by: Iterable[str], order: Iterable[str] = ("ts_event", "seq"), bucket: int | None = None) -> DataFrame:
    """Fills cut where the net position crosses zero, with their position cycle: signed quantity, net before and after.

    A fill that crosses is two rows, one that closes and one that opens. All in closed form: running sums and their signs.
    bucket: see windows.running_sum.
    """
    by, order = list(by), list(order)
    q = F.when(F.col("order_side") == "BUY", F.col("last_qty")).otherwise(-F.col("last_qty"))
    rows = running_sum(fills.withColumn("_q", q.cast("decimal(28,9)")), "_after", F.col("_q"), by, order, bucket)
    rows = rows.withColumn("_after", F.col("_after").cast("decimal(28,9)"))
    before = (F.col("_after") - F.col("_q")).cast("decimal(28,9)")
    rows = rows.withColumn("_before", before)
    crosses = F.col("_before") * F.col("_after") < 0
    part = lambda a, b, k: F.struct(F.lit(k).alias("part"), (b - a).cast("decimal(28,9)").alias("qty"), a.cast("decimal(28,9)").alias("before"), b.cast("decimal(28,9)").alias("after"))
    zero = F.lit(0).cast("decimal(28,9)")
    whole = F.array(part(F.col("_before"), F.col("_after"), 0))
    two = F.array(part(F.col("_before"), zero, 0), part(zero, F.col("_after"), 1))
    rows = rows.withColumn("_p", F.explode(F.when(crosses, two).otherwise(whole))).select(*fills.columns, "_p.*")
    opens = F.col("before") == 0
    rows = running_sum(rows, "cycle", opens.cast("int"), by, [*order, "part"], bucket)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("qty", "before", "after")})


def cost_basis(fills: DataFrame, by: Iterable[str], order: Iterable[str] = ("ts_event", "seq")) -> DataFrame:
    """cycles() with the cost of the open quantity, its average price and each row's realised result.

    Cost is an affine recurrence: adding adds quantity times price, reducing scales it down.
    """
    by, order = list(by), list(order)
    rows = cycles(fills, by, order)
    adds = F.col("before") * F.col("qty") >= 0
    value = F.col("qty") * F.col("last_px")
    rows = rows.withColumns({"a": F.when(adds, 1.0).otherwise(F.col("after") / F.col("before")), "b": F.when(adds, value).otherwise(0.0), "seed": value})
    rows = affine(rows, "cost", [*by, "cycle"], [*order, "part"])
    before = F.lag("cost").over(ordered([*by, "cycle"], [*order, "part"])) / F.col("before")
    closing = F.col("before") * F.col("qty") < 0
    rows = rows.withColumns({"avg_px_open": F.when(F.col("after") != 0, F.col("cost") / F.col("after")), "realized_pnl": F.when(closing, -F.col("qty") * (F.col("last_px") - before)).otherwise(0.0)})
    return rows.withColumn("event", F.when(F.col("before") == 0, "OPENED").when(F.col("after") == 0, "CLOSED").otherwise("CHANGED"))


def positions(fills: DataFrame, by: Iterable[str], order: Iterable[str] = ("ts_event", "seq"), bucket: int | None = None) -> DataFrame:
    """One row for each position cycle: side, peak, prices, realised result, return, times. Closed cycles have quantity 0.

    With a position_id in `by` this is hedging, without it netting. The result of a closed cycle is what was received less
    what was paid, so no recurrence is needed. bucket: see windows.running_sum.
    """
    by, order = list(by), list(order)
    rows = cycles(fills, by, order, bucket)
    at = F.struct(*order, "part")
    opens = F.col("before") * F.col("qty") >= 0
    entry_qty, exit_qty = F.sum(F.when(opens, F.abs("qty"))), F.sum(F.when(~opens, F.abs("qty")))
    value = (F.abs("qty") * F.col("last_px")).cast("decimal(28,9)")  # sums of decimals don't depend on their order
    out = rows.groupBy(*by, "cycle").agg(
        F.when(F.min_by("qty", at) > 0, "LONG").otherwise("SHORT").alias("entry"), F.max_by("after", at).alias("signed_qty"), F.max(F.abs("after")).alias("peak_qty"),
        (F.sum(F.when(opens, value)).cast("double") / entry_qty).alias("avg_px_open"), (F.sum(F.when(~opens, value)).cast("double") / exit_qty).alias("avg_px_close"),
        (-F.sum((F.col("qty") * F.col("last_px")).cast("decimal(28,9)"))).cast("double").alias("_cash"), F.min(order[0]).alias("ts_opened"), F.max(order[0]).alias("_last"), F.min_by("seq", at).alias("opening_order"), F.max_by("seq", at).alias("closing_order"), F.count("*").alias("fills"),
    )
    closed = F.col("signed_qty") == 0
    sign = F.when(F.col("entry") == "LONG", 1.0).otherwise(-1.0)
    out = out.withColumns({
        "realized_pnl": F.when(closed, F.col("_cash")), "realized_return": F.when(closed, sign * (F.col("avg_px_close") - F.col("avg_px_open")) / F.col("avg_px_open")),
        "ts_closed": F.when(closed, F.col("_last")), "duration_ns": F.when(closed, F.col("_last") - F.col("ts_opened")),
    })
    return out.withColumn("closing_order", F.when(closed, F.col("closing_order"))).drop("_cash", "_last")


def pnl(entry: Column, exit_: Column, signed_qty: Column, multiplier: Column, inverse: Column) -> Column:
    """Result of a signed quantity; of an inverse contract in base currency."""
    return F.when(inverse, signed_qty * multiplier * (1 / entry - 1 / exit_)).otherwise((exit_ - entry) * signed_qty * multiplier)


def notional(qty: Column, price: Column, multiplier: Column, inverse: Column) -> Column:
    return F.when(inverse, qty * multiplier / price).otherwise(qty * multiplier * price)


def fee(maker_rate: float, taker_rate: float) -> Column:
    """Maker or taker rate of a fill's value."""
    return F.col("last_qty") * F.col("last_px") * F.when(F.col("liquidity_side") == "MAKER", maker_rate).otherwise(taker_rate)


def commissions(fills: DataFrame, amount: Column, by: Iterable[str], currency: str = "currency") -> DataFrame:
    """What each position has paid in each currency: amounts of different currencies are never added up."""
    return fills.withColumn("_c", amount).groupBy(*by, currency).agg(F.sum("_c").alias("commission"), F.count("*").alias("fills"))


def fixed_fee(amount: float, order_key: str, once: bool = True) -> Column:
    """A fixed amount for each order (its first fill) or each fill."""
    first = F.row_number().over(Window.partitionBy(order_key).orderBy("ts_event", "seq")) == 1
    return F.when(first, amount).otherwise(0.0) if once else F.lit(amount)


def option_fee(rate: float, premium_cap: float = 0.125) -> Column:
    """Rate of the underlying's value, at most a share of the premium."""
    return F.least(F.col("quantity") * F.col("underlying") * rate, F.col("quantity") * F.col("premium") * premium_cap)


def balance_changes(fills: DataFrame, base: Column, quote: Column) -> DataFrame:
    """What a fill does to each currency: base and quote move against each other."""
    sign = F.when(F.col("order_side") == "BUY", 1.0).otherwise(-1.0)
    moves = F.array(F.struct(base.alias("currency"), (sign * F.col("last_qty")).alias("change")), F.struct(quote.alias("currency"), (-sign * F.col("last_qty") * F.col("last_px")).alias("change")))
    return fills.withColumn("_m", F.explode(moves)).select(*fills.columns, "_m.*")


def running_balances(changes: DataFrame, by: Iterable[str] = ("account_id", "currency"), start: float = 0.0, bucket: int | None = None, digits: int | None = None) -> DataFrame:
    """The balance after each change. bucket: see windows.running_sum.

    digits: changes have so many decimal places at most, and are summed as decimals, so the balance is exact (a decimal) whatever
    the order and the spans; sums of doubles are off in their last bits, which decides at a half that is to be rounded.
    """
    kind = None if digits is None else f"decimal(38,{digits})"
    change, first = (F.col("change"), F.lit(start)) if kind is None else (F.round("change", digits).cast(kind), F.lit(start).cast(kind))
    rows = running_sum(changes, "balance", change, by, ["ts_event", "seq"], bucket)
    balance = first + F.col("balance")
    return rows.withColumn("balance", balance if kind is None else balance.cast(kind))


def locked(orders: DataFrame) -> DataFrame:
    """What open orders lock: notional in quote currency for buys, quantity in base for sells."""
    amount = F.when(F.col("order_side") == "BUY", F.col("quantity") * F.col("price")).otherwise(F.col("quantity"))
    currency = F.when(F.col("order_side") == "BUY", F.lit("QUOTE")).otherwise(F.lit("BASE"))
    return orders.groupBy("account_id", currency.alias("currency")).agg(F.sum(amount).alias("locked"))


def margins(positions_: DataFrame, init_rate: float, maint_rate: float, leverage: Column | float = 1.0) -> DataFrame:
    """Initial and maintenance margin by instrument, by account and in all; leverage divides the notional."""
    base = F.col("notional") / leverage
    rows = positions_.withColumns({"_i": base * init_rate, "_m": base * maint_rate})
    out = rows.rollup("account_id", "instrument_id").agg(F.sum("_i").alias("initial"), F.sum("_m").alias("maintenance"), F.grouping_id().alias("scope"))
    return out


def exposures(fills: DataFrame, by: Iterable[str], price: DataFrame) -> DataFrame:
    """Net quantity, side and exposure at a price of each instrument."""
    q = F.when(F.col("order_side") == "BUY", F.col("last_qty")).otherwise(-F.col("last_qty"))
    net = fills.groupBy(*by).agg(F.sum(q).alias("net_qty"))
    side = F.when(F.col("net_qty") > 0, "LONG").when(F.col("net_qty") < 0, "SHORT").otherwise("FLAT")
    return net.join(price, "instrument_id", "left").withColumns({"side": side, "exposure": F.col("net_qty") * F.col("mark")})


def conversion_side() -> Column:
    """The quote side that an account's exposures convert at: all long BID, all short ASK, else MID."""
    return F.when(F.min("side") == F.max("side"), F.when(F.min("side") == "LONG", "BID").otherwise("ASK")).otherwise("MID")


def risk_size(equity: Column, risk: float, entry: Column, stop: Column, tick: float, commission: float = 0.0, fx: Column | float = 1.0, units: int = 1, batch: float = 1.0, hard_limit: float | None = None, maximum: float | None = None) -> Column:
    """Quantity that risks a share of equity between entry and stop; 0 without risk, a rate or a distance."""
    ticks = F.round(F.abs(entry - stop) / tick)
    money = equity * risk * (1 - 2 * commission)
    fx_ = fx if isinstance(fx, Column) else F.lit(float(fx))
    size = money / fx_ / ticks / tick
    size = F.least(size, F.lit(hard_limit)) if hard_limit is not None else size
    size = F.floor(size / units / batch) * batch
    size = F.least(size, F.lit(maximum)) if maximum is not None else size
    return F.when((ticks > 0) & (fx_ > 0) & (money > 0), size).otherwise(0.0)


def order_faults(price: str, qty: str, tick: float, lot: float, least: float, most: float, max_notional: float) -> Column:
    """Why an order would be refused; null if it wouldn't."""
    p, q = F.col(price), F.col(qty)
    off = lambda x, step: F.abs(x / step - F.round(x / step)) > 1e-6
    reason = F.when(p <= 0, "price not positive").when(off(p, tick), "price precision").when(off(q, lot), "quantity precision")
    return reason.when(q < least, "quantity below minimum").when(q > most, "quantity above maximum").when(p * q > max_notional, "notional above maximum")


def rate_breaches(commands: DataFrame, limit: int, interval: int, by: Iterable[str]) -> DataFrame:
    """Commands that came with more than `limit` within the interval up to them."""
    w = Window.partitionBy(*by).orderBy("ts_event").rangeBetween(-interval, 0)
    return commands.withColumn("n", F.count("*").over(w)).where(F.col("n") > limit)


def tick_round(price: Column, tick: Column | float, up: bool, n: int = 0) -> Column:
    """The tick at or beyond a price, and n ticks on."""
    t = tick if isinstance(tick, Column) else F.lit(float(tick))
    steps = F.ceil(F.round(price / t, 9)) + n if up else F.floor(F.round(price / t, 9)) - n
    return steps * t


def tier_tick(price: Column, tiers: list[tuple[float, float]]) -> Column:
    """The tick size of the tier that a price lies in; tiers are (from, tick) in rising order."""
    out = F.lit(float(tiers[0][1]))
    for start, tick in tiers[1:]:
        out = F.when(price >= start, float(tick)).otherwise(out)
    return out


def reconcile(computed: DataFrame, reported: DataFrame, by: Iterable[str]) -> DataFrame:
    """Positions that differ between our fold and a venue's report."""
    both = computed.select(*by, F.col("net_qty").alias("ours")).join(reported.select(*by, F.col("net_qty").alias("theirs")), list(by), "full_outer")
    diff = F.coalesce("ours", F.lit(0.0)) - F.coalesce("theirs", F.lit(0.0))
    return both.withColumn("difference", diff).where(F.abs("difference") > 1e-9)


def netted(sub_positions: DataFrame, by: Iterable[str]) -> DataFrame:
    """Hedged sub-positions (signed_qty, avg_px_open, ts_opened, position_id) as one net position with its open price, for margin.

    They are folded in order of opening as if each were a fill.
    """
    q = F.col("signed_qty")
    fills = sub_positions.where(q != 0).select(*by, F.when(q > 0, "BUY").otherwise("SELL").alias("order_side"), F.abs(q).alias("last_qty"), F.col("avg_px_open").alias("last_px"), F.col("ts_opened").alias("ts_event"), F.col("position_id").alias("seq"))
    rows = cost_basis(fills, by)
    at = F.struct("ts_event", "seq", "part")
    return rows.groupBy(*by).agg(F.max_by("after", at).alias("net_qty"), F.max_by("avg_px_open", at).alias("avg_px_open"))
