"""Queries over ticks: filters, joins in time, bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, bars, frames
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import recursive, sql

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
W = "(partition by instrument_id order by ts_event, seq)"
OHLCV = """arg_min(price, (ts_event, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts_event, seq)) as close, sum(size) as volume, count(*) as count"""


def _bars(end: str, extra: str = "") -> str:
    return f"select instrument_id, {end} as ts_event, {OHLCV} from trades {extra} group by 1, 2"


LEFT = f"((ts_event - 1) // {HOUR} + 1) * {HOUR}"
RIGHT = f"(ts_event // {HOUR} + 1) * {HOUR}"

Q: dict = {}
S: dict = {}


def query(name: str, text: str | None = None):
    def keep(f):
        Q[name] = f
        if text is not None:
            S[name] = text
        return f

    return keep


@query("time_bars", sql(f"""select instrument_id, ts_event, open, high, low, close, volume, count, round(avg(close) over (partition by instrument_id order by ts_event rows 4 preceding), 6) as sma
    from ({_bars(LEFT)})""", "trades"))  # fmt: skip
def _(spark, d):
    from tidemark.operators.indicators import Indicators

    b = bars.time_bars(views.trades(spark, d), HOUR)
    return rounded(Indicators(b).sma("close", 5).df.drop("sma_initialized"))


@query("extract_price", sql("select instrument_id, seq, round((bid_price + ask_price) / 2, 6) as mid, bid_price as bid, round(ask_price, 6) as ask, (bid_size + ask_size) / 2 as size from quotes", "quotes"))
def _(spark, d):
    p, z = frames.extract_price, frames.extract_size
    return rounded(views.quotes(spark, d).select("instrument_id", "seq", p("MID").alias("mid"), p("BID").alias("bid"), p("ASK").alias("ask"), z("MID").alias("size")))


@query("last_n", sql("select * from (select *, row_number() over (partition by instrument_id order by ts_event desc, seq desc) - 1 as nth from trades) where nth < 5", "trades"))
def _(spark, d):
    return frames.last_n(views.trades(spark, d), 5).withColumn("nth", F.col("nth").cast("long"))


@query("latest_quote", sql("select instrument_id, bid_price, round(ask_price, 6) as ask_price, bid_size, ask_size, ts_event, seq from (select *, row_number() over (partition by instrument_id order by ts_event desc, seq desc) as n from quotes) where n = 1", "quotes"))
def _(spark, d):
    return rounded(frames.latest(views.quotes(spark, d)))


@query("entity_filter", sql("select instrument_id, order_side, count(*) as n from fills where account_id in (1, 2, 3) and order_side = 'BUY' group by 1, 2", "fills"))
def _(spark, d):
    return frames.matching(views.fills(spark, d), account_id=[1, 2, 3], order_side="BUY").groupBy("instrument_id", "order_side").agg(F.count("*").alias("n"))


@query("id_set_operations", sql("select seq from fills where order_side = 'BUY' intersect select seq from fills where account_id < 5 except select seq from fills where liquidity_side = 'MAKER'", "fills"))
def _(spark, d):
    f = views.fills(spark, d)
    return f.where("order_side = 'BUY'").select("seq").intersect(f.where("account_id < 5").select("seq")).exceptAll(f.where("liquidity_side = 'MAKER'").select("seq").distinct())


@query("topic_wildcard", sql("select topic, count(*) as n from event_log where regexp_matches(topic, '^data\\.c.*\\..$') group by 1", "event_log"))
def _(spark, d):
    return views.event_log(spark, d).where(frames.topic_matches(F.col("topic"), "data.c*.?")).groupBy("topic").agg(F.count("*").alias("n"))


@query("request_range", sql("select * from trades where ts_event between 1704412800000000000 and 1704844800000000000 order by ts_event, seq limit 500", "trades"))
def _(spark, d):
    return frames.between(views.trades(spark, d), 1704412800000000000, 1704844800000000000, 500)


@query("merged_streams", sql("""select stream, seq, ts_event, row_number() over (order by ts_event, stream, seq) as place from (
    select 'quotes' as stream, ts_event, seq from quotes union all select 'trades', ts_event, seq from trades)""", "quotes", "trades"))  # fmt: skip
def _(spark, d):
    return frames.merged({"quotes": views.quotes(spark, d), "trades": views.trades(spark, d)}, places=DAY).select("stream", "seq", "ts_event", "place")


@query("range_chunks", sql("""select c.chunk, c.lo, c.hi, count(t.seq) as n from (select i as chunk, 1704067200000000000 + i * 259200000000000 as lo,
    least(1704067200000000000 + (i + 1) * 259200000000000, 1704067200000000000 + 10 * 86400000000000) as hi from range(4) r(i)) c
    left join trades t on t.ts_event >= c.lo and t.ts_event < c.hi group by 1, 2, 3""", "trades"))  # fmt: skip
def _(spark, d):
    start = 1704067200000000000
    c = frames.chunks(spark, start, start + 10 * DAY, 3 * DAY)
    t = views.trades(spark, d).where((F.col("ts_event") >= start) & (F.col("ts_event") < start + 10 * DAY)).select(F.expr(f"(ts_event - {start}) div {3 * DAY}").alias("chunk"), "seq")
    return c.join(t, "chunk", "left").groupBy("chunk", "lo", "hi").agg(F.count("seq").alias("n"))


@query("changed_quotes", sql(f"""select instrument_id, seq, bid_price from (select *, lag(bid_price) over w as b, lag(bid_size) over w as s, lag(seq) over w as l from (select instrument_id, round(bid_price / 10) as bid_price,
    bid_size, ts_event, seq from (select *, ts_event as t from quotes)) window w as {W}) where l is null or b <> bid_price or s <> bid_size""".replace("(select *, ts_event as t from quotes)", "quotes"), "quotes"))  # fmt: skip
def _(spark, d):
    q = views.quotes(spark, d).withColumns({"bid_price": F.round(F.col("bid_price") / 10), "ask_price": F.lit(1.0), "ask_size": F.lit(1.0)})
    return frames.changed_quotes(q).select("instrument_id", "seq", "bid_price")


@query("completed_quotes", sql(f"""select * from (select instrument_id, ts_event, seq, last_value(bid_price ignore nulls) over w as bid_price, round(last_value(ask_price ignore nulls) over w, 6) as ask_price,
    last_value(bid_size ignore nulls) over w as bid_size, last_value(ask_size ignore nulls) over w as ask_size from partial_quotes
    window w as (partition by instrument_id order by ts_event, seq rows between unbounded preceding and current row)) where bid_price is not null and ask_price is not null""", "partial_quotes"))  # fmt: skip
def _(spark, d):
    return rounded(frames.completed_quotes(views.partial_quotes(spark, d)))


@query("bar_type_parts", """select distinct event_type || '.X' as instrument_id, '5' as step, 'MINUTE' as aggregation, 'LAST' as price_type, 'INTERNAL' as source, '1-MINUTE-EXTERNAL' as composite from events""")
def _(spark, d):
    name = F.concat("event_type", F.lit(".X-5-MINUTE-LAST-INTERNAL@1-MINUTE-EXTERNAL"))
    return views.table(spark, d, "events").select(*[c.alias(n) for n, c in frames.bar_type_parts(name).items()]).distinct()


_SIGNAL = "(select event_type as instrument_id, epoch_us(ts) * 1000 as ts_event, event_id as seq, value as impact from events where value > 40 and user_id % 3 = 0)"


@query("next_event", sql(f"""select t.seq, n.seq as r_seq, n.impact as r_impact from trades t asof left join {_SIGNAL} n on t.instrument_id = n.instrument_id and t.ts_event <= n.ts_event""", "trades"))
def _(spark, d):
    t = views.trades(spark, d)
    n = views.table(spark, d, "events").where("value > 40 and user_id % 3 = 0").select(F.col("event_type").alias("instrument_id"), views.nanos("ts").alias("ts_event"), F.col("event_id").alias("seq"), F.col("value").alias("impact"))
    return asof.asof_join(t, n, forward=True, bucket=DAY).select("seq", "r_seq", "r_impact")


@query("delta_batches", sql(f"""select instrument_id, batch, count(*) as n, max(seq) as last_seq from (select *, coalesce(sum(done) over (partition by instrument_id order by ts_event, seq rows unbounded preceding), 0)::bigint as batch
    from (select *, coalesce(lag(case when flags & 128 <> 0 then 1 else 0 end) over {W}, 0) as done from deltas)) group by 1, 2""", "deltas"))  # fmt: skip
def _(spark, d):
    return frames.delta_batches(views.deltas(spark, d)).groupBy("instrument_id", "batch").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("out_of_order", sql("""select account_id, seq from (select *, max(ts_event) over (partition by account_id order by seq rows between unbounded preceding and 1 preceding) as m from fills) where ts_event < m""", "fills"))
def _(spark, d):
    return frames.out_of_order(views.fills(spark, d), by=["account_id"]).where("late").select("account_id", "seq")


# joins


@query("asof_join", sql("""select t.instrument_id, t.seq, q.seq as r_seq, q.bid_price as r_bid_price from trades t asof left join (select * from quotes where seq % 3 = 0) q
    on t.instrument_id = q.instrument_id and t.ts_event >= q.ts_event""", "trades", "quotes"))  # fmt: skip
def _(spark, d):
    q = views.quotes(spark, d).where("seq % 3 = 0")
    return asof.asof_join(views.trades(spark, d), q, bucket=DAY).select("instrument_id", "seq", "r_seq", "r_bid_price")


@query("asof_join_tolerance", sql("""select t.instrument_id, t.seq, case when t.ts_event - q.ts_event <= 600000000000 then q.seq end as r_seq from trades t asof left join (select * from quotes where seq % 3 = 0) q
    on t.instrument_id = q.instrument_id and t.ts_event >= q.ts_event""", "trades", "quotes"))  # fmt: skip
def _(spark, d):
    q = views.quotes(spark, d).where("seq % 3 = 0")
    return asof.asof_join(views.trades(spark, d), q, tolerance=600_000_000_000, bucket=DAY).select("instrument_id", "seq", "r_seq")


_LEGS = """(select ts_event, seq, instrument_id as leg, last_value(case when instrument_id = 'view' then price end ignore nulls) over w as view, last_value(case when instrument_id = 'click' then price end ignore nulls) over w as click
    from trades where instrument_id in ('view', 'click') window w as (order by ts_event, seq, instrument_id rows between unbounded preceding and current row))"""


@query("aligned_latest", sql(f"select * from {_LEGS} where view is not null and click is not null", "trades"))
def _(spark, d):
    t = views.trades(spark, d)
    return asof.align_latest({n: t.where(F.col("instrument_id") == n) for n in ("view", "click")}, "price", bucket=DAY)


@query("quote_greeks_join", sql("""select g.instrument_id, g.seq, q.bid_price as r_bid_price, round(g.price / 100, 6) as delta from trades g asof join (select * from quotes where seq % 2 = 0) q
    on g.instrument_id = q.instrument_id and g.ts_event >= q.ts_event where g.seq % 2 = 1""", "trades", "quotes"))  # fmt: skip
def _(spark, d):
    greeks = views.trades(spark, d).where("seq % 2 = 1").withColumn("delta", F.col("price") / 100)
    out = asof.asof_join(greeks, views.quotes(spark, d).where("seq % 2 = 0"), keep_unmatched=False, bucket=DAY)
    return rounded(out.select("instrument_id", "seq", "r_bid_price", "delta"))


@query("instrument_dimension", """select l_returnflag, round(sum(l_quantity * (1 + p_size % 3)), 6) as quantity from lineitem join part on p_partkey = l_partkey group by 1""")
def _(spark, d):
    line, part = views.table(spark, d, "lineitem"), views.table(spark, d, "part").select("p_partkey", (1 + F.col("p_size") % 3).alias("multiplier"))
    out = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(out.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") * F.col("multiplier")).alias("quantity")))


@query("order_fill_trace", sql("""select e.account_id, count(*) as orders, count(f.seq) as fills from (select distinct order_id, account_id from order_events) e
    left join (select order_id as seq from order_events where event = 'FILLED') f on f.seq = e.order_id group by 1""", "order_events"))  # fmt: skip
def _(spark, d):
    e = views.order_events(spark, d)
    orders = e.select("order_id", "account_id").distinct()
    filled = e.where("event = 'FILLED'").select("order_id", F.lit(1).alias("f"))
    return orders.join(filled, "order_id", "left").groupBy("account_id").agg(F.count("*").alias("orders"), F.count("f").alias("fills"))


_ROLLS = "(values (0, 1704499200000000000, 'click', 'view', 10.0, 11.0), (1, 1704931200000000000, 'view', 'purchase', 12.0, 11.5), (2, 1705363200000000000, 'purchase', 'signup', 20.0, 22.0), (3, 1705795200000000000, 'signup', 'error', 21.0, 20.0)) as r(seq, transition, pre_id, post_id, pre_price, post_price)"


def rolls(spark):
    rows = [(0, 1704499200000000000, "click", "view", 10.0, 11.0), (1, 1704931200000000000, "view", "purchase", 12.0, 11.5), (2, 1705363200000000000, "purchase", "signup", 20.0, 22.0), (3, 1705795200000000000, "signup", "error", 21.0, 20.0)]
    return spark.createDataFrame(rows, "seq int, transition long, pre_id string, post_id string, pre_price double, post_price double")


_SEGMENTS = f"""(select pre_id as contract, coalesce(lag(transition) over (order by transition), -4611686018427387904) as lo, transition as hi,
    sum(post_price - pre_price) over (order by transition rows between current row and unbounded following)::double as back, -coalesce(sum(post_price - pre_price) over (order by transition rows between unbounded preceding and 1 preceding), 0)::double as forth
    from {_ROLLS} union all select arg_max(post_id, transition), max(transition), 4611686018427387904, 0, -sum(post_price - pre_price)::double from {_ROLLS})"""


def _segment_join(column: str) -> str:
    return sql(f"select t.instrument_id, t.seq, round(t.price + s.{column}, 6) as price from trades t join {_SEGMENTS} s on t.instrument_id = s.contract and t.ts_event >= s.lo and t.ts_event < s.hi", "trades")


@query("roll_backward", _segment_join("back"))
def _(spark, d):
    t = asof.interval_join(views.trades(spark, d), bars.roll_offsets(rolls(spark)).withColumnRenamed("contract", "instrument_id"), "instrument_id", "lo", "hi")
    return rounded(t.select("instrument_id", "seq", (F.col("price") + F.col("adjust")).alias("price")))


@query("roll_forward", _segment_join("forth"))
def _(spark, d):
    t = asof.interval_join(views.trades(spark, d), bars.roll_offsets(rolls(spark), backward=False).withColumnRenamed("contract", "instrument_id"), "instrument_id", "lo", "hi")
    return rounded(t.select("instrument_id", "seq", (F.col("price") + F.col("adjust")).alias("price")))


@query("roll_ratio_backward", sql(f"""select t.instrument_id, t.seq, round(t.price * s.f, 6) as price from trades t join (select pre_id as contract, coalesce(lag(transition) over (order by transition), -4611686018427387904) as lo, transition as hi,
    exp(sum(ln(post_price::double / pre_price::double)) over (order by transition rows between current row and unbounded following)) as f from {_ROLLS} union all select 'error', 1705795200000000000, 4611686018427387904, 1) s
    on t.instrument_id = s.contract and t.ts_event >= s.lo and t.ts_event < s.hi""", "trades"))  # fmt: skip
def _(spark, d):
    t = asof.interval_join(views.trades(spark, d), bars.roll_offsets(rolls(spark), ratio=True).withColumnRenamed("contract", "instrument_id"), "instrument_id", "lo", "hi")
    return rounded(t.select("instrument_id", "seq", (F.col("price") * F.col("adjust")).alias("price")))


@query("continuous_bars", sql(f"""select ts_event, arg_min(price, (t, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (t, seq)) as close, sum(size) as volume, count(*) as count from (
    select 'chain' as i, ((t.ts_event - 1) // {DAY} + 1) * {DAY} as ts_event, t.ts_event as t, t.seq, t.size, round(t.price + s.back, 6) as price from trades t join {_SEGMENTS} s on t.instrument_id = s.contract and t.ts_event >= s.lo and t.ts_event < s.hi) group by 1""", "trades"))  # fmt: skip
def _(spark, d):
    t = asof.interval_join(views.trades(spark, d), bars.roll_offsets(rolls(spark)).withColumnRenamed("contract", "instrument_id"), "instrument_id", "lo", "hi")
    t = t.withColumns({"instrument_id": F.lit("chain"), "price": F.round(F.col("price") + F.col("adjust"), 6)})
    return rounded(bars.time_bars(t, DAY).drop("instrument_id"))


@query("roll_violations", sql("""select seq, reason from (select seq, case when ts_event <= lag(ts_event) over w then 'time' when order_side <> lag(case when order_side = 'BUY' then 'SELL' else 'BUY' end) over w then 'chain'
    when last_px <= 0 then 'price' end as reason from fills window w as (partition by account_id, instrument_id order by seq)) where reason is not null""", "fills"))  # fmt: skip
def _(spark, d):
    f = views.fills(spark, d)
    r = f.select("account_id", "instrument_id", "seq", F.col("ts_event").alias("transition"), F.col("order_side").alias("pre_id"), F.when(F.col("order_side") == "BUY", "SELL").otherwise("BUY").alias("post_id"), F.col("last_px").alias("pre_price"), F.col("last_px").alias("post_price"))
    return bars.roll_violations(r, ["account_id", "instrument_id"]).select("seq", "reason")


@query("day_grid_join", sql("select r.series, r.day, round(r.ret - b.ret, 6) as active from returns r join benchmark_returns b using (day)", "returns", "benchmark_returns"))
def _(spark, d):
    r, b = views.returns(spark, d), views.returns(spark, d, grouped=False)
    return rounded(r.join(b.withColumnRenamed("ret", "b"), "day").select("series", "day", (F.col("ret") - F.col("b")).alias("active")))


@query("own_order_audit", sql("select distinct order_id from order_events where order_id not in (select order_id from order_events where event = 'FILLED')", "order_events"))
def _(spark, d):
    e = views.order_events(spark, d)
    return e.select("order_id").distinct().join(e.where("event = 'FILLED'").select("order_id"), "order_id", "left_anti")


@query("snapshot_differences", sql("""select coalesce(a.seq, b.seq) as seq, case when a.seq is null then 'right only' when b.seq is null then 'left only' else 'both' end as side,
    concat_ws(',', case when a.price is distinct from b.price then 'price' end, case when a.size is distinct from b.size then 'size' end) as fields from (select seq, price, size from trades where seq % 5 <> 0) a
    full join (select seq, case when seq % 4 = 0 then price + 1 else price end as price, case when seq % 6 = 0 then 0 else size end as size from trades where seq % 7 <> 0) b on a.seq = b.seq
    where a.seq is null or b.seq is null or a.price is distinct from b.price or a.size is distinct from b.size""", "trades"))  # fmt: skip
def _(spark, d):
    t = views.trades(spark, d).select("seq", "price", "size")
    other = t.where("seq % 7 <> 0").select("seq", F.when(F.col("seq") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(F.col("seq") % 6 == 0, 0.0).otherwise(F.col("size")).alias("size"))
    return asof.differences(t.where("seq % 5 <> 0"), other, ["seq"])


@query("cross_rates", """with recursive q as (select 'C' || n_nationkey as base, 'C' || (n_nationkey + 1) as quote, 1 + n_nationkey / 10::double as bid, 1.01::double + n_nationkey / 10::double as ask from nation where n_nationkey < 24),
    pairs as (select 'BID' as price_type, base, quote, bid as rate from q union all select 'ASK', base, quote, ask from q union all select 'MID', base, quote, (bid + ask) / 2 from q),
    edges as (select * from pairs union all select price_type, quote, base, 1 / rate from pairs),
    p as (select price_type, base, quote, rate, base || '>' || quote as path, 1 as hops from edges
      union all select p.price_type, p.base, e.quote, p.rate * e.rate, p.path || '>' || e.quote, hops + 1 from p join edges e on e.price_type = p.price_type and e.base = p.quote where e.quote <> p.base and not list_contains(string_split(p.path, '>'), e.quote))
    select price_type, base, quote, round(arg_min(rate, (hops, path)), 6) as rate, arg_min(path, (hops, path)) as path from p group by 1, 2, 3""")  # fmt: skip
def _(spark, d):
    n = views.table(spark, d, "nation").where("n_nationkey < 24")
    k = F.col("n_nationkey")
    pairs = n.select(F.concat(F.lit("C"), k.cast("string")).alias("base"), F.concat(F.lit("C"), (k + 1).cast("string")).alias("quote"), (1 + k / 10).alias("bid"), (1.01 + k / 10).alias("ask"))
    return rounded(asof.cross_rates(pairs))


# bars


@query("time_bars_right_open", sql(_bars(RIGHT), "trades"))
def _(spark, d):
    return rounded(bars.time_bars(views.trades(spark, d), HOUR, left_open=False))


@query("time_bars_open_stamp_origin", sql(_bars(f"((ts_event - 900000000000 - 1) // {HOUR}) * {HOUR} + 900000000000"), "trades"))
def _(spark, d):
    return rounded(bars.time_bars(views.trades(spark, d), HOUR, stamp_on_close=False, origin=900_000_000_000))


@query("time_bars_skip_first", sql(f"""select * exclude (n, f) from (select *, row_number() over (partition by instrument_id order by ts_event) as n from (select instrument_id, {LEFT} as ts_event, {OHLCV}, min(ts_event) as f from trades group by 1, 2))
    where not (n = 1 and f > ts_event - {HOUR} + 1)""", "trades"))  # fmt: skip
def _(spark, d):
    return rounded(bars.time_bars(views.trades(spark, d), HOUR, skip_first=True))


@query("time_bars_filled", sql(f"""select g.instrument_id, g.ts_event, coalesce(b.open, c) as open, coalesce(b.high, c) as high, coalesce(b.low, c) as low, coalesce(b.close, c) as close, coalesce(b.volume, 0) as volume, coalesce(b.count, 0) as count
    from (select g.instrument_id, g.ts_event, last_value(b.close ignore nulls) over (partition by g.instrument_id order by g.ts_event rows between unbounded preceding and current row) as c
      from (select instrument_id, unnest(range(min(ts_event), max(ts_event) + 1, {HOUR})) as ts_event from b group by 1) g left join b using (instrument_id, ts_event)) g left join b using (instrument_id, ts_event)""", "trades", b=_bars(LEFT)))  # fmt: skip
def _(spark, d):
    return rounded(bars.time_bars(views.trades(spark, d), HOUR, fill_empty=True))


@query("month_bars", sql(f"select instrument_id, date_trunc('month', make_timestamp(ts_event // 1000))::date as start, {OHLCV} from (select account_id::varchar as instrument_id, last_px as price, last_qty as size, ts_event, seq from fills) group by 1, 2", "fills"))
def _(spark, d):
    f = views.fills(spark, d).select(F.col("account_id").cast("string").alias("instrument_id"), F.col("last_px").alias("price"), F.col("last_qty").alias("size"), "ts_event", "seq")
    return bars.calendar_bars(f, "month")


@query("year_bars", sql(f"select instrument_id, make_date(year(make_timestamp(ts_event // 1000)) // 2 * 2, 1, 1) as start, {OHLCV} from (select instrument_id, last_px as price, last_qty as size, ts_event, seq from fills) group by 1, 2", "fills"))
def _(spark, d):
    f = views.fills(spark, d).select("instrument_id", F.col("last_px").alias("price"), F.col("last_qty").alias("size"), "ts_event", "seq")
    return bars.calendar_bars(f, "year", 2)


@query("composite_bars", sql(f"""select instrument_id, ((ts_event - 1) // {4 * HOUR} + 1) * {4 * HOUR} as ts_event, arg_min(open, ts_event) as open, max(high) as high, min(low) as low, arg_max(close, ts_event) as close, sum(volume) as volume, sum(count)::bigint as count from b group by 1, 2""", "trades", b=_bars(LEFT)))
def _(spark, d):
    return rounded(bars.composite_bars(bars.time_bars(views.trades(spark, d), HOUR), 4 * HOUR))


@query("tick_bars", sql(f"""select instrument_id, bar, {OHLCV}, max(ts_event) as ts_event from (select *, (row_number() over {W} - 1) // 20 as bar from trades) group by 1, 2 having count(*) = 20""", "trades"))
def _(spark, d):
    return rounded(bars.tick_bars(views.trades(spark, d), 20, bucket=DAY))


def _threshold(amount: str, step: int) -> str:
    return sql(f"""select instrument_id, bar, arg_min(price, (ts_event, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts_event, seq)) as close, count(*) as count, max(ts_event) as ts_event,
        sum(part)::double as amount from (select *, least(hi, (bar + 1) * {step}) - greatest(hi - x, bar * {step}) as part from (select *, unnest(range(floor((hi - x) / {step})::bigint, ceil(hi / {step})::bigint)) as bar
        from (select *, sum(x) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as hi from (select *, ({amount})::decimal(18,6) as x from trades) where x > 0)))
        group by 1, 2 having sum(part) = {step}""", "trades")  # fmt: skip


@query("volume_bars", _threshold("size", 200))
def _(spark, d):
    return rounded(bars.volume_bars(views.trades(spark, d), 200, bucket=DAY))


@query("value_bars", _threshold("round(price * size, 6)", 5000))
def _(spark, d):
    return rounded(bars.threshold_bars(views.trades(spark, d), F.round(F.col("price") * F.col("size"), 6), 5000, bucket=DAY))


@query("tick_runs_bars", sql(f"""select instrument_id, bar::bigint as bar, {OHLCV}, max(ts_event) as ts_event from (select *, sum(c) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) - c as bar from
    (select *, case when row_number() over (partition by instrument_id, run order by ts_event, seq) % 3 = 0 then 1 else 0 end as c from (select *, sum(new) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as run from
    (select *, case when aggressor_side = lag(aggressor_side) over {W} then 0 else 1 end as new from trades)))) group by 1, 2 having max(c) = 1""", "trades"))  # fmt: skip
def _(spark, d):
    return rounded(bars.tick_runs_bars(views.trades(spark, d), 3))


_AMOUNT = {"tick": "1", "volume": "size", "value": "size * price"}
_TICKS = f"select *, row_number() over {W} as n, case aggressor_side when 'BUYER' then 1 when 'SELLER' then -1 else 0 end as sign from trades"


def folded(kind: str, step: float, runs: bool) -> str:
    """Bars of imbalances or runs, walked tick by tick: the state is the sum, its side and whether the last tick closed a bar."""
    if runs:
        side = "case when k.sign = 0 then (case when f.done then 0 else f.side end) else k.sign end"
        total = "case when k.sign = 0 then (case when f.done then 0 else f.s end) else k.x + case when not f.done and f.side = k.sign then f.s else 0 end end"
    else:
        side, total = "0", "case when f.done then 0 else f.s end + k.sign * k.x"
    walk = f"""select instrument_id, 0::bigint as n, 0::bigint as bar, 0::double as s, 0 as side, false as done from k group by 1 union all
        select instrument_id, n, bar, s, side, sign <> 0 and abs(s) >= {step} from (select k.instrument_id, k.n, f.bar + f.done::int as bar, {total} as s, {side} as side, k.sign from f join k on k.instrument_id = f.instrument_id and k.n = f.n + 1)"""
    return recursive(f"select instrument_id, bar, {OHLCV}, max(ts_event) as ts_event from t join f using (instrument_id, n) group by 1, 2 having bool_or(done)", "trades", t=_TICKS, k=f"select instrument_id, n, sign, ({_AMOUNT[kind]})::double as x from t", f=walk)


for _kind, _step in (("tick", 6), ("volume", 60.0), ("value", 900.0)):
    Q[f"{_kind}_imbalance_bars"] = lambda spark, d, k=_kind, s=_step: rounded(bars.imbalance_bars(views.trades(spark, d), s, k))
    S[f"{_kind}_imbalance_bars"] = folded(_kind, _step, False)
for _kind, _step in (("volume", 20.0), ("value", 300.0)):
    Q[f"{_kind}_runs_bars"] = lambda spark, d, k=_kind, s=_step: rounded(bars.runs_bars(views.trades(spark, d), s, k))
    S[f"{_kind}_runs_bars"] = folded(_kind, _step, True)
# the same with a key's days shared by many tasks
for _kind, _step in (("tick", 6), ("volume", 60.0), ("value", 900.0)):
    Q[f"{_kind}_imbalance_bars_in_spans"] = lambda spark, d, k=_kind, s=_step: rounded(bars.imbalance_bars(views.trades(spark, d), s, k, bucket=DAY))
    S[f"{_kind}_imbalance_bars_in_spans"] = S[f"{_kind}_imbalance_bars"]
Q["value_runs_bars_in_spans"] = lambda spark, d: rounded(bars.runs_bars(views.trades(spark, d), 300.0, "value", bucket=DAY))
S["value_runs_bars_in_spans"] = S["value_runs_bars"]
Q["renko_bars"] = lambda spark, d: rounded(bars.renko_bars(views.trades(spark, d), 10.0))
S["renko_bars"] = recursive("select instrument_id, bar - 1 as bar, round(open, 6) as open, round(brick_close, 6) as close, ts_event from f where brick", "trades", t=_TICKS,
    f="""select instrument_id, n, price, ts_event, price as brick_close, price as open, 0::bigint as bar, false as brick from t where n = 1 union all
        select t.instrument_id, t.n, t.price, t.ts_event, case when abs(f.price - f.brick_close) >= 10 then f.brick_close + sign(f.price - f.brick_close) * 10.0::double else f.brick_close end, f.brick_close, f.bar + (abs(f.price - f.brick_close) >= 10)::int, abs(f.price - f.brick_close) >= 10
        from f join t on t.instrument_id = f.instrument_id and t.n = f.n + case when abs(f.price - f.brick_close) >= 10 then 0 else 1 end""")  # fmt: skip


_PAIR = """(select ts_event, seq, last_value(case when instrument_id = 'view' then {'bid': bid_price, 'ask': ask_price} end ignore nulls) over w as v, last_value(case when instrument_id = 'click' then {'bid': bid_price, 'ask': ask_price} end ignore nulls) over w as c
    from quotes where instrument_id in ('view', 'click') window w as (order by ts_event, seq rows between unbounded preceding and current row))"""


@query("spread_quotes", sql(f"select ts_event, seq, round(v.bid - 2 * c.ask, 6) as bid_price, round(v.ask - 2 * c.bid, 6) as ask_price from {_PAIR} where v is not null and c is not null", "quotes"))
def _(spark, d):
    return rounded(_spread(spark, d).select("ts_event", "seq", "bid_price", "ask_price"))


def _spread(spark, d):
    q = views.quotes(spark, d).withColumn("both", F.struct(F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask")))
    legs = asof.align_latest({n: q.where(F.col("instrument_id") == n) for n in ("view", "click")}, "both", bucket=DAY)
    return bars.spread_quotes(legs, {"view": 1.0, "click": -2.0})


@query("spread_quotes_at_interval", sql(f"""select g.ts_event, round(arg_max(s.bid_price, s.seq), 6) as bid_price from (select distinct ((ts_event - 1) // {DAY} + 1) * {DAY} as ts_event from s) g join s on s.ts_event <= g.ts_event and s.ts_event > g.ts_event - {DAY} group by 1""",
    "quotes", s=f"select ts_event, seq, v.bid - 2 * c.ask as bid_price from {_PAIR} where v is not null and c is not null"))
def _(spark, d):
    s = _spread(spark, d).withColumn("t", F.expr(f"((ts_event - 1) div {DAY} + 1) * {DAY}"))
    return rounded(s.groupBy("t").agg(F.max_by("bid_price", F.struct("ts_event", "seq")).alias("bid_price")).withColumnRenamed("t", "ts_event"))




_OPTS = """(select ts_event, seq, last_value(case when instrument_id = 'view' then {'bid': bid_price, 'ask': ask_price, 'vega': bid_size} end ignore nulls) over w as v, last_value(case when instrument_id = 'click' then {'bid': bid_price, 'ask': ask_price, 'vega': bid_size} end ignore nulls) over w as c
    from quotes where instrument_id in ('view', 'click') window w as (order by ts_event, seq rows between unbounded preceding and current row))"""


@query("option_spread_quotes", sql(f"""select ts_event, seq, round(floor(round((mid - half) / 0.05::double, 9)) * 0.05::double, 6) as bid_price, round(ceil(round((mid + half) / 0.05::double, 9)) * 0.05::double, 6) as ask_price from (select ts_event, seq, (v.bid + v.ask) / 2 - 2 * (c.bid + c.ask) / 2 as mid,
    ((v.ask - v.bid) / v.vega + (c.ask - c.bid) / c.vega) / 2 * abs(v.vega - 2 * c.vega) / 2 as half from {_OPTS} where v is not null and c is not null)""", "quotes"))  # fmt: skip
def _(spark, d):
    q = views.quotes(spark, d).withColumn("all", F.struct(F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), F.col("bid_size").alias("vega")))
    legs = asof.align_latest({n: q.where(F.col("instrument_id") == n) for n in ("view", "click")}, "all", bucket=DAY)
    return rounded(bars.option_spread_quotes(legs, {"view": 1.0, "click": -2.0}, 0.05).select("ts_event", "seq", "bid_price", "ask_price"))


@query("single_price_bars", sql(f"select instrument_id, count(*) as n from ({_bars(LEFT)}) where open = high and high = low and low = close group by 1", "trades"))
def _(spark, d):
    return bars.time_bars(views.trades(spark, d), HOUR).where(bars.single_price()).groupBy("instrument_id").agg(F.count("*").alias("n"))


@query("bounded_roll_chain", sql(f"select t.instrument_id, count(*) as n from trades t join (select * from {_ROLLS} where transition between 1704931200000000000 and 1705363200000000000) r on t.instrument_id = r.pre_id and t.ts_event < r.transition group by 1", "trades"))
def _(spark, d):
    r = bars.bounded_rolls(rolls(spark), last_post="signup", first_pre="view").select(F.col("pre_id").alias("instrument_id"), "transition")
    return views.trades(spark, d).join(r, "instrument_id").where("ts_event < transition").groupBy("instrument_id").agg(F.count("*").alias("n"))


@query("bars_with_fills", sql(f"""select b.instrument_id, b.ts_event, b.close, coalesce(f.n, 0) as fills, coalesce(f.bought, 0) as bought, coalesce(f.sold, 0) as sold from ({_bars(LEFT)}) b left join (select instrument_id, {LEFT} as ts_event, count(*) as n,
    sum(case when aggressor_side = 'BUYER' then size else 0 end) as bought, sum(case when aggressor_side <> 'BUYER' then size else 0 end) as sold from trades where seq % 4 = 0 group by 1, 2) f using (instrument_id, ts_event)""", "trades"))  # fmt: skip
def _(spark, d):
    from tidemark.operators import stats

    t = views.trades(spark, d)
    f = t.where("seq % 4 = 0").select("instrument_id", "ts_event", F.when(F.col("aggressor_side") == "BUYER", "BUY").otherwise("SELL").alias("order_side"), F.col("size").alias("last_qty"))
    return stats.bars_with_fills(bars.time_bars(t, HOUR), f).select("instrument_id", "ts_event", "close", "fills", "bought", "sold")


@query("top_from_trades", sql("select instrument_id, seq, price as bid_price, price as ask_price, size as bid_size, size as ask_size from trades", "trades"))
def _(spark, d):
    from tidemark.operators import book

    return views.trades(spark, d).select("instrument_id", "seq", *[c.alias(n) for n, c in book.top_from_ticks("trades").items()])
