"""Streaming queries: each runs a stream over the trades to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import frames, kernels
from tidemark.operators.windows import rounded
from tidemark.plans import market
from tidemark.plans.catalogue import scratch
from tidemark.plans.depth import DERIVED, LEVELS
from tidemark.plans.market import _TICKS, HOUR, folded
from tidemark.sources import views
from tidemark.sources.catalog import Catalog
from tidemark.sources.views import recursive, sql
from tidemark.streaming import streams
from tidemark.streaming.keyed import keyed

Q: dict = {}
S: dict = {}


#: Parts that the input is cut into by time; keyed queries are started anew between fewer of them.
PARTS, FEWER = 3, 2
#: Rows of a trigger of keyed queries, about.
ROWS = 1 << 20
#: How long after the last row the end comes: longer than any window and delay.
END = "365 days"


def run(spark, d, make, mode: str = "append", held=None, parts=PARTS, end=True, rows=None):
    """The trades as a stream, as replay() gives them."""
    t = views.trades(spark, d).withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_event"), F.lit(1000)))).drop("ts_event")
    return replay(spark, t.select("instrument_id", "price", "size", "aggressor_side", "ts", "seq"), make, mode, held, parts, end, rows)


def replay(spark, t, make, mode: str = "append", held=None, parts=PARTS, end=True, rows=None, **last):
    """t, cut by time and read as a stream, a part a trigger; a last row (if end) only moves the watermark past all others. Of
    `held` rows one comes a part later than its time says. last: values of the last row's columns where it isn't to be
    empty or 0.

    The cuts divide the span of ts evenly, and the first and the last part are open, so every row is in one part; rows without
    ts come with the first. Each part is several files by ranges of ts; the stream reads them all before the next is written.
    rows: a part of more rows than that is cut into triggers of about so many (see _pieces), since the Python side of a keyed
    query holds a key's rows of one trigger together.
    """
    folder = scratch(spark)
    us = F.unix_micros("ts")
    lo, hi = t.agg(F.min(us), F.max(us)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    number = F.lit(0)
    for k in range(1, parts):
        number = F.when(us >= lo + (hi - lo) * k // parts, k).otherwise(number)
    if held is not None:
        number = F.least(number + (F.col("seq") % held == 2).cast("int"), F.lit(parts - 1))
    cut = [t.where(number == k) for k in range(parts)]
    ts = F.timestamp_micros(F.lit(hi).cast("long")) + F.expr(f"interval {END}")
    values = {"instrument_id": "~end", "seq": -1, **last}
    close = spark.range(1).coalesce(1).select(*[(ts if f.name == "ts" else F.lit(values.get(f.name, "" if f.dataType.simpleString() == "string" else 0)).cast(f.dataType)).alias(f.name) for f in t.schema])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
    for part in [*cut, close] if end else cut:
        files = _pieces(part, f"{folder}/in", rows, schema) if rows and part is not close else 0
        if not files:
            (part if part is close else part.repartitionByRange("ts").sortWithinPartitions("ts", "seq")).write.mode("append").parquet(f"{folder}/in")
        out = make(streams.read_files(spark, f"{folder}/in", schema, files or (1 << 31) - 1))
        q = out.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where("instrument_id <> '~end'")


def _pieces(part, folder: str, rows: int, schema: str) -> int:
    """Writes a part of more than so many rows as files of about so many each, in order of time, to be read one a trigger.

    A stream takes files by the time they were written. So the part is first put aside, by pieces between quantiles of ts, and
    then the pieces are written one after the other: every row is moved twice, however many pieces there are. Rows of one time
    stay together, those without any come first. Returns how many files belong to a trigger; 0 if nothing was written.
    """
    n = part.count()
    if n <= rows:
        return 0
    spark, us, m = part.sparkSession, F.unix_micros("ts"), -(-n // rows)
    least, found = part.agg(F.min(us), F.percentile_approx(us, [k / m for k in range(1, m)], max(10_000, 100 * m))).first()
    bounds = [b for b in sorted(set(found or [])) if b > least]
    piece = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: us >= b)) if bounds else F.lit(0)
    aside = scratch(spark)
    part.withColumn("piece", piece).repartition("piece").sortWithinPartitions("piece", "ts", "seq").write.partitionBy("piece").parquet(aside)
    for k in range(len(bounds) + 1):
        spark.read.schema(schema).parquet(f"{aside}/piece={k}").coalesce(1).write.mode("append").parquet(folder)
    return 1


def once(spark, d, make):
    """run() for operators that give out rows as they come."""
    return run(spark, d, make, parts=FEWER, end=False, rows=ROWS)


_NS = "epoch_us(date_trunc('hour', make_timestamp(ts_event // 1000)))"
_BAR = "arg_min(price, (ts_event, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts_event, seq)) as close, sum(size) as volume"
Q["stream_time_bars"] = lambda spark, d: run(spark, d, lambda s: streams.time_bars(s, "1 hour", "10 minutes")).select("instrument_id", F.unix_micros("start").alias("start"), "open", "high", "low", "close", "volume", "count")
S["stream_time_bars"] = sql(f"select instrument_id, {_NS} as start, {_BAR}, count(*) as count from trades group by 1, 2", "trades")
Q["stream_chained_bars"] = lambda spark, d: run(spark, d, lambda s: streams.chained_bars(s, "1 hour", "6 hours", "10 minutes")).select("instrument_id", F.unix_micros("end").alias("end"), "open", "high", "low", "close", "volume")
S["stream_chained_bars"] = sql(f"select instrument_id, (ts_event // 21600000000000 + 1) * 21600000000 as end, {_BAR} from trades group by 1, 2", "trades")
Q["stream_deduplicated"] = lambda spark, d: run(spark, d, lambda s: streams.deduplicated(s.unionByName(s), ["instrument_id", "seq"], "1 hour")).groupBy("instrument_id").agg(F.count("*").alias("n"))
S["stream_deduplicated"] = sql("select instrument_id, count(*) as n from trades group by 1", "trades")
Q["stream_sessions"] = lambda spark, d: run(spark, d, lambda s: streams.sessions(s, "40 minutes", "10 minutes")).select("instrument_id", F.unix_micros("start").alias("start"), "n", "volume")
S["stream_sessions"] = sql("select instrument_id, min(ts_event) // 1000 as start, count(*) as n, sum(size) as volume from (select *, sum(new) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as g from (select *, case when ts_event - lag(ts_event) over (partition by instrument_id order by ts_event, seq) < 2400000000000 then 0 else 1 end as new from trades)) group by instrument_id, g", "trades")
Q["stream_rate_monitor"] = lambda spark, d: run(spark, d, lambda s: streams.rate_monitor(s, "30 minutes", "10 minutes", 4, "10 minutes")).select("instrument_id", F.unix_micros("end").alias("end"), "n")
S["stream_rate_monitor"] = sql("select instrument_id, (ts_event // 600000000000 + k) * 600000000 as end, count(*) as n from trades, (values (1), (2), (3)) as r(k) group by 1, 2 having count(*) > 4", "trades")
Q["stream_imbalance_bars"] = lambda spark, d: once(spark, d, lambda s: streams.imbalance_bars(s, 6))
S["stream_imbalance_bars"] = f"select * exclude (ts_event) from ({folded('tick', 6, False)})"
Q["stream_ema"] = lambda spark, d: rounded(once(spark, d, lambda s: streams.ema(s, 10)))
S["stream_ema"] = recursive("select instrument_id, seq, round(y, 6) as ema from f", "trades", t=_TICKS,
    f="select instrument_id, seq, n, price as y from t where n = 1 union all select t.instrument_id, t.seq, t.n, (1 - 2 / 11::double) * f.y + 2 / 11::double * t.price from f join t on t.instrument_id = f.instrument_id and t.n = f.n + 1")
Q["stream_positions"] = lambda spark, d: rounded(once(spark, d, lambda s: streams.position_fold(s)))
S["stream_positions"] = recursive("select instrument_id, seq, net, round(a, 6) as avg_px, round(pnl, 6) as realized from f where n > 0", "trades", t=_TICKS,
    k="select instrument_id, seq, n, price, case when sign = 1 then size else -size end as x from t",
    f="""select instrument_id, -1::bigint as seq, 0::bigint as n, 0::double as net, 0::double as a, 0::double as pnl from k group by 1 union all
        select k.instrument_id, k.seq, k.n, f.net + k.x, case when f.net * k.x < 0 then (case when abs(k.x) > abs(f.net) then k.price else f.a end) when f.net + k.x <> 0 then (f.a * abs(f.net) + k.price * abs(k.x)) / (abs(f.net) + abs(k.x)) else 0 end,
        f.pnl + case when f.net * k.x < 0 then least(abs(f.net), abs(k.x)) * (k.price - f.a) * sign(f.net) else 0 end from f join k on k.instrument_id = f.instrument_id and k.n = f.n + 1""")  # fmt: skip
Q["stream_latest_legs"] = lambda spark, d: once(spark, d, lambda s: streams.latest_legs(s, ("view", "click"))).select("seq", "first", "second")
S["stream_latest_legs"] = sql("""select seq, a as first, b as second from (select seq, last_value(case when instrument_id = 'view' then price end ignore nulls) over w as a, last_value(case when instrument_id = 'click' then price end ignore nulls) over w as b
    from trades where instrument_id in ('view', 'click') window w as (order by ts_event, seq rows between unbounded preceding and current row)) where a is not null and b is not null""", "trades")  # fmt: skip
Q["stream_changed_prices"] = lambda spark, d: once(spark, d, lambda s: streams.changed_prices(s)).select("instrument_id", "seq")
S["stream_changed_prices"] = sql("select instrument_id, seq from (select *, lag(price) over (partition by instrument_id order by ts_event, seq) as b from trades) where b is null or b <> price", "trades")
Q["stream_subscription"] = lambda spark, d: run(spark, d, lambda s: streams.subscribed(s, "?i*")).groupBy("instrument_id").agg(F.count("*").alias("n"))
S["stream_subscription"] = sql("select instrument_id, count(*) as n from trades where instrument_id like '_i%' group by 1", "trades")
Q["stream_snapshots"] = lambda spark, d: run(spark, d, lambda s: streams.snapshots(s, "6 hours", "10 minutes")).select("instrument_id", F.unix_micros("end").alias("end"), "price", "size", "seq")
S["stream_snapshots"] = sql("select instrument_id, (ts_event // 21600000000000 + 1) * 21600000000 as end, arg_max(price, (ts_event, seq)) as price, arg_max(size, (ts_event, seq)) as size, arg_max(seq, (ts_event, seq)) as seq from trades group by 1, 2", "trades")


def _book(spark, d):
    """Book updates as a stream; the quotes that they lead to."""
    t = views.deltas(spark, d).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).drop("ts_event")
    return replay(spark, t, streams.book_quotes, parts=FEWER, end=False, rows=ROWS)


Q["stream_book_quotes"] = _book
S["stream_book_quotes"] = f"select * exclude (ts_event) from ({DERIVED})"


# kernels: what batch folds and streams share

#: Bars of all kinds, and the units of the exact amounts.
UNIT = 1_000_000
ONLINE = {
    "tick": kernels.TickBars(20), "volume": kernels.ThresholdBars(200 * UNIT, "size_units"), "value": kernels.ThresholdBars(5000 * UNIT, "value_units"), "renko": kernels.RenkoBars(10.0),
    "tick_imbalance": kernels.ImbalanceBars(6), "volume_imbalance": kernels.ImbalanceBars(60.0, "volume"), "value_imbalance": kernels.ImbalanceBars(900.0, "value"),
    "tick_runs": kernels.RunsBars(3), "volume_runs": kernels.RunsBars(20.0, "volume"), "value_runs": kernels.RunsBars(300.0, "value"),
}


def in_units(t):
    units = lambda c: (c.cast("decimal(28,6)") * UNIT).cast("long")
    return t.withColumns({"size_units": units(F.col("size")), "value_units": units(F.round(F.col("price") * F.col("size"), 6))})


_BARS = ["instrument_id", "kind", "bar", "open", "high", "low", "close", "count", "ts_event"]
Q["stream_bars_of_all_kinds"] = lambda spark, d: rounded(once(spark, d, lambda s: keyed(in_units(s), kernels.Together(ONLINE))).select(_BARS))
S["stream_bars_of_all_kinds"] = " union all ".join(
    f"select instrument_id, '{kind}' as kind, bar, round(open, 6) as open, {'null' if kind == 'renko' else 'round(high, 6)'} as high, {'null' if kind == 'renko' else 'round(low, 6)'} as low, round(close, 6) as close, {'null' if kind == 'renko' else 'count'} as count, ts_event from ({market.S[f'{kind}_bars']})"
    for kind in ONLINE
)


class Streaks(kernels.Kernel):
    """An indicator of a user's own: by how much and how many times running the price has risen, or fallen (below 0)."""

    reads = ("price", "seq")
    output = "seq long, streak long, moved double"
    state = "before double, streak long, moved double"

    def start(self):
        return [None, 0, 0.0]

    def update(self, state, rows):
        before, streak, moved = state
        out = []
        for price, seq in rows:
            way = 0 if before is None else (price > before) - (price < before)
            streak, moved = (streak + way, moved + price - before) if way and way * streak > 0 else (way, price - before if way else 0.0)
            before = price
            out.append((seq, streak, moved))
        state[:] = [before, streak, moved]
        return out


_STREAKS = recursive("select instrument_id, seq, streak, round(moved, 6) as moved from f", "trades", t=_TICKS,
    f="""select instrument_id, seq, n, price, 0::bigint as streak, 0::double as moved from t where n = 1 union all
        select t.instrument_id, t.seq, t.n, t.price, case when sign(t.price - f.price) * f.streak > 0 then f.streak else 0 end + sign(t.price - f.price)::bigint,
        case when t.price = f.price then 0 when sign(t.price - f.price) * f.streak > 0 then f.moved + t.price - f.price else t.price - f.price end from f join t on t.instrument_id = f.instrument_id and t.n = f.n + 1""")  # fmt: skip
Q["custom_indicator"] = lambda spark, d: rounded(kernels.folded(views.trades(spark, d), Streaks()))
S["custom_indicator"] = _STREAKS
Q["stream_custom_indicator"] = lambda spark, d: rounded(once(spark, d, lambda s: keyed(s, Streaks())))
S["stream_custom_indicator"] = _STREAKS

ONLINE_INDICATORS = {
    "sma": kernels.Recent(10, lambda x: (float(x.mean()),), partial=True), "deviation": kernels.Recent(20, lambda x: (float(x.std()),)), "highest": kernels.Recent(20, lambda x: (float(x.max()),)),
    "change": kernels.Recent(6, lambda x: (float(x[-1] - x[0]),)), "ema": kernels.Average(2 / 11), "wilder": kernels.Average(1 / 14), "volume": kernels.Recent(5, lambda x: (float(x.sum()),), "size"),
}
Q["stream_indicators"] = lambda spark, d: rounded(once(spark, d, lambda s: keyed(s, kernels.Together(ONLINE_INDICATORS))))
_OVER = "over (partition by instrument_id order by ts_event, seq rows between {} preceding and current row)"
_AVERAGED = "select instrument_id, seq, n, price as y from t where n = 1 union all select t.instrument_id, t.seq, t.n, {} from {} as e join t on t.instrument_id = e.instrument_id and t.n = e.n + 1"
S["stream_indicators"] = recursive(f"""select instrument_id, kind, seq, round(value, 6) as value from (
    select instrument_id, 'sma' as kind, seq, n, 0 as k, avg(price) {_OVER.format(9)} as value from t union all select instrument_id, 'deviation', seq, n, 20, stddev_pop(price) {_OVER.format(19)} from t
    union all select instrument_id, 'highest', seq, n, 20, max(price) {_OVER.format(19)} from t union all select instrument_id, 'change', seq, n, 6, price - first_value(price) {_OVER.format(5)} from t
    union all select instrument_id, 'volume', seq, n, 5, sum(size) {_OVER.format(4)} from t union all select instrument_id, 'ema', seq, n, 0, y from e union all select instrument_id, 'wilder', seq, n, 0, y from w) where n >= k""", "trades", t=_TICKS,
    e=_AVERAGED.format("(1 - 2 / 11::double) * e.y + 2 / 11::double * t.price", "e"), w=_AVERAGED.format("(1 - 1 / 14::double) * e.y + 1 / 14::double * t.price", "w"))

#: Every so many rows one comes a part late; by how much at most.
LATE, DELAY = 5, "25 days"
Q["stream_positions_in_order"] = lambda spark, d: rounded(run(spark, d, lambda s: keyed(s, kernels.Positions(), delay=DELAY), held=LATE, parts=FEWER, rows=ROWS))
S["stream_positions_in_order"] = S["stream_positions"]


def _resumed(spark, d):
    """Imbalance bars of the later half of the trades by a stream that goes on from the state after the earlier half."""
    t = views.trades(spark, d)
    middle = F.lit(t.agg(F.expr("(min(ts_event) + max(ts_event)) div 2")).first()[0])
    kernel = kernels.ImbalanceBars(6)
    begun = kernels.states(t.where(F.col("ts_event") < middle), kernel)
    later = t.where(F.col("ts_event") >= middle).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).drop("ts_event")
    return replay(spark, later, lambda s: keyed(s, kernel, initial=begun), parts=FEWER, end=False, rows=ROWS)


Q["stream_resumed_bars"] = _resumed
S["stream_resumed_bars"] = f"select * from ({folded('tick', 6, False)}) where ts_event >= (select (min(epoch_us(ts)) * 1000 + max(epoch_us(ts)) * 1000) // 2 from events)"

# clocks: rows that come without any input

#: Six hours; how many times a clock strikes without rows before it waits for the next.
EVERY, IDLE = 6 * HOUR, 2
_STRIKES = f"select distinct instrument_id, (ts_event // {EVERY} + 1 + k) * {EVERY} as b from {{}}, range({IDLE + 1}) as r(k)"
Q["stream_clock_latest"] = lambda spark, d: run(spark, d, lambda s: keyed(s, kernels.Latest("price double, size double, seq long"), delay=DELAY, every=EVERY, idle=IDLE), held=LATE, parts=FEWER, rows=ROWS)
S["stream_clock_latest"] = sql("select s.instrument_id, b as ts_event, arg_max(price, (t.ts_event, t.seq)) as price, arg_max(size, (t.ts_event, t.seq)) as size, arg_max(seq, (t.ts_event, t.seq)) as seq from s join trades t on t.instrument_id = s.instrument_id and t.ts_event < b group by 1, 2", "trades", s=_STRIKES.format("trades"))
Q["stream_clock_positions"] = lambda spark, d: rounded(run(spark, d, lambda s: keyed(s, kernels.Valued(), delay=DELAY, every=EVERY, idle=IDLE), held=LATE, parts=FEWER, rows=ROWS))
S["stream_clock_positions"] = f"""with p as ({S['stream_positions'].replace('round(a, 6)', 'a').replace('round(pnl, 6)', 'pnl')}), q as (select p.*, e.value as price, epoch_us(e.ts) * 1000 as done from p join events e on e.event_id = p.seq), s as ({_STRIKES.format('(select instrument_id, done as ts_event from q)')})
    select s.instrument_id, b as ts_event, arg_max(net, (done, seq)) as net, round(arg_max(realized, (done, seq)), 6) as realized, round(arg_max(net * (price - avg_px), (done, seq)), 6) as unrealized from s join q on q.instrument_id = s.instrument_id and q.done < b group by 1, 2"""


def _tops(spark, d):
    """The best levels of each book at the times of a clock."""
    t = views.deltas(spark, d).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).drop("ts_event")
    return replay(spark, t, lambda s: keyed(s, kernels.BookTops(), delay=DELAY, every=EVERY, idle=IDLE), held=LATE, parts=FEWER, rows=ROWS, action="CLEAR")


Q["stream_clock_books"] = _tops
S["stream_clock_books"] = sql("""select s.instrument_id, b as ts_event, max(l.price) filter (l.side = 'BUY') as bid_price, min(l.price) filter (l.side = 'SELL') as ask_price, arg_max(l.size, l.price) filter (l.side = 'BUY') as bid_size, arg_min(l.size, l.price) filter (l.side = 'SELL') as ask_size
    from (select s.instrument_id, b, max(n) as n from s join r on r.instrument_id = s.instrument_id and r.ts_event < b group by 1, 2) s left join l on l.instrument_id = s.instrument_id and l.n <= s.n and l.gone > s.n group by 1, 2""", "deltas", s=_STRIKES.format("deltas"), **LEVELS)  # fmt: skip


def _converted(spark, d):
    """What a stream wrote, taken into a catalog and read back by it."""
    c = Catalog(spark, scratch(spark))
    folder = scratch(spark)
    run(spark, d, lambda s: s).withColumn("ts_event", F.unix_micros("ts") * 1000).withColumn("ts_init", F.col("ts_event")).write.parquet(folder)
    c.convert_stream(folder, "trades")
    return c.trades(ordered=False).groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("ts_init").alias("first"), F.sum("size").alias("size"))


Q["stream_to_catalog"] = _converted
S["stream_to_catalog"] = sql("select instrument_id, count(*) as n, min(ts_event) as first, sum(size) as size from trades group by 1", "trades")


def _late(spark, d):
    """Trades of which every seventh comes with the last part, whatever its time; late ones go to a table of their own."""
    folder = scratch(spark)
    t = views.trades(spark, d).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).drop("ts_event").select("instrument_id", "price", "size", "aggressor_side", "ts", "seq")
    held = F.col("seq") % 7 == 0
    for part in (t.where(~held), t.where(held)):
        part.write.mode("append").parquet(f"{folder}/in")
        source = streams.read_files(spark, f"{folder}/in", files_per_trigger=(1 << 31) - 1)
        q = streams.with_late_rows(source, f"{folder}/state", f"{folder}/rows", f"{folder}/late", 86_400).trigger(availableNow=True).start()
        q.awaitTermination()
    read = lambda name: spark.read.parquet(f"{folder}/{name}").select("instrument_id", F.lit(name).alias("went_to"))
    return read("rows").unionByName(read("late")).groupBy("instrument_id", "went_to").agg(F.count("*").alias("n"))


Q["stream_late_rows"] = _late
S["stream_late_rows"] = sql("""select instrument_id, case when seq % 7 = 0 and make_timestamp(ts_event // 1000) < (select max(make_timestamp(ts_event // 1000)) from trades where seq % 7 <> 0) - interval 1 day then 'late' else 'rows' end as went_to, count(*) as n
    from trades group by 1, 2""", "trades")  # fmt: skip


def _replayed(spark, d):
    """Trades and quotes of a catalog in their common order, slice by slice, by a replay that is stopped once and then goes on;
    a row's place is counted on from slice to slice."""
    c = Catalog(spark, scratch(spark))
    for kind in ("trades", "quotes"):
        c.write(getattr(views, kind)(spark, d).withColumn("ts_init", F.col("ts_event")), kind)
    first, last_ = c.bounds("trades").agg(F.min("first"), F.max("last")).first()
    folder = scratch(spark)

    def handle(rows, n):
        placed = frames.merged({"": rows.withColumnRenamed("stream", "kind")}, order=("ts_event", "kind", "seq"), places=24 * HOUR).drop("stream")
        placed.write.mode("overwrite").parquet(f"{folder}/slice={n}")

    step = -(-(last_ - first + 1) // 4)
    for slices in (2, None):
        streams.replayed(c, ["trades", "quotes"], first, last_, step, handle, f"{folder}-state", slices)
    out = spark.read.parquet(folder)
    counts = out.groupBy("slice").agg(F.count("*").alias("n"))
    before = counts.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each slice
    return out.join(F.broadcast(before), "slice").select(F.col("kind").alias("stream"), "seq", "ts_event", (F.col("place") + F.col("before")).alias("place"))


Q["stream_replay"] = _replayed
S["stream_replay"] = market.S["merged_streams"]


def _rotated(spark, d):
    """Trades in files of 40 rows at most and of one day, the day beginning at 17:00, of three instruments; the last trigger is
    run again before the files are read."""
    folder = scratch(spark)
    t = views.trades(spark, d).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).select("instrument_id", "price", "size", "aggressor_side", "ts", "seq")
    conf = spark._jsc.hadoopConfiguration()
    for part in (0, 1, None):
        if part is None:  # as after a failure before the trigger was committed
            commit = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/commits/1")
            commit.getFileSystem(conf).delete(commit, False)
        else:
            t.where(F.col("seq") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        source = streams.read_files(spark, f"{folder}/in", files_per_trigger=(1 << 31) - 1)
        streams.rotating_sink(source, f"{folder}/out", f"{folder}/state", 40, 24 * HOUR, 17 * HOUR, ["v*", "?lick", "signup"]).trigger(availableNow=True).start().awaitTermination()
    files = streams.read_sink(spark, f"{folder}/out").groupBy("period", "file").agg(F.count("*").alias("n"))
    return files.groupBy("period").agg(F.sum("n").alias("n"), (F.max("n") <= 40).alias("bounded"))


Q["stream_rotated_files"] = _rotated
S["stream_rotated_files"] = sql(f"select (ts_event - {17 * HOUR}) // {24 * HOUR} as period, count(*) as n, true as bounded from trades where instrument_id in ('view', 'click', 'signup') group by 1", "trades")
