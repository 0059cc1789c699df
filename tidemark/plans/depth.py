"""Queries over order books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import book
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import sql

Q: dict = {}
S: dict = {}
STEP = 6 * 3_600_000_000_000
GRID = ["instrument_id", "ts"]

_HISTORY = """select a.instrument_id, side, price, size, ts_event as valid_from, coalesce(nxt, cleared, 4611686018427387904) as valid_to, seq from (
    select *, lead(ts_event) over (partition by instrument_id, epoch, side, price order by ts_event, seq) as nxt from (
      select *, max(seq) over (partition by instrument_id, epoch, side, price, ts_event) as l from e where action <> 'CLEAR') where seq = l) a
    left join (select instrument_id, epoch - 1 as epoch, min(ts_event) as cleared from e where action = 'CLEAR' group by 1, 2) c on c.instrument_id = a.instrument_id and c.epoch = a.epoch
    where action <> 'DELETE' and size > 0"""
_EPOCH = "select *, count(case when action = 'CLEAR' then 1 end) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as epoch from deltas"
_LIVE = f"select h.*, g.ts from history h join (select i * {STEP} as ts from range((select min(ts_event) // {STEP} + 1 from deltas), (select max(ts_event) // {STEP} + 1 from deltas)) r(i)) g on h.valid_from <= g.ts and h.valid_to > g.ts"
_RANKED = "select *, row_number() over (partition by instrument_id, ts, side order by case when side = 'BUY' then -price else price end, seq) as level from live"


def _sql(body: str) -> str:
    return sql(body, "deltas", e=_EPOCH, history=_HISTORY, live=_LIVE, ranked=_RANKED)


def history(spark, d):
    return book.level_history(views.deltas(spark, d))


def live(spark, d):
    """Every STEP from the first update to the last."""
    ends = views.deltas(spark, d).agg(F.expr(f"(min(ts_event) div {STEP} + 1) * {STEP}").alias("a"), F.expr(f"max(ts_event) div {STEP} * {STEP}").alias("b"))
    return book.book_at(history(spark, d), ends.select(F.explode(F.array("a", "b")).alias("ts")), STEP)


def books(spark, d):
    return book.sides(live(spark, d), GRID, 20)


Q["book_level_history"] = history
S["book_level_history"] = _sql("select * from history")
Q["book_snapshots"] = lambda spark, d: live(spark, d).where("level <= 5").select(*GRID, "side", "price", "size", F.col("level").cast("long").alias("level"))
S["book_snapshots"] = _sql("select instrument_id, ts, side, price, size, level from ranked where level <= 5")
Q["book_l3_to_l2"] = lambda spark, d: book.to_l2(live(spark, d).withColumn("price", F.round("price", -1)), GRID)
S["book_l3_to_l2"] = _sql("select instrument_id, ts, side, round(price, -1) as price, sum(size) as size, count(*) as count from live group by 1, 2, 3, 4")
Q["top_of_book"] = lambda spark, d: rounded(book.top_of_book(live(spark, d), GRID))
S["top_of_book"] = _sql("""select instrument_id, ts, max(price) filter (side = 'BUY') as bid_price, arg_max(size, price) filter (side = 'BUY') as bid_size, min(price) filter (side = 'SELL') as ask_price, arg_min(size, price) filter (side = 'SELL') as ask_size,
    min(price) filter (side = 'SELL') - max(price) filter (side = 'BUY') as spread, (min(price) filter (side = 'SELL') + max(price) filter (side = 'BUY')) / 2 as mid from live group by 1, 2""")  # fmt: skip
Q["book_quantity_for_price"] = lambda spark, d: books(spark, d).select(*GRID, book.quantity_for_price(F.col("asks"), F.lit(8.0), True).alias("quantity"), F.size(book.crossed_levels(F.col("asks"), F.lit(8.0), True)).cast("long").alias("levels"), book.quantity_at_level(F.col("asks"), F.lit(5.0)).alias("at_five"))
S["book_quantity_for_price"] = _sql("select instrument_id, ts, coalesce(sum(size) filter (side = 'SELL' and price <= 8 and level <= 20), 0) as quantity, count(*) filter (side = 'SELL' and price <= 8 and level <= 20) as levels, coalesce(sum(size) filter (side = 'SELL' and price = 5 and level <= 20), 0) as at_five from ranked where level <= 20 group by 1, 2")
_WALK = "select *, greatest(0, least(size, 25 - coalesce(sum(size) over (partition by instrument_id, ts order by level rows between unbounded preceding and 1 preceding), 0))) as take from ranked where side = 'SELL' and level <= 20"


def _sweep(spark, d):
    fills = book.sweep(F.col("asks"), F.lit(25.0))
    b = books(spark, d).withColumn("fills", fills)
    return rounded(b.where(F.size("fills") > 0).select(*GRID, book.avg_price(F.col("fills")).alias("avg_px"), book.worst_price(F.col("fills")).alias("worst_px"), F.size("fills").cast("long").alias("n")))


Q["book_sweep"] = _sweep
S["book_sweep"] = _sql(f"select instrument_id, ts, round(sum(price * take) / sum(take), 6) as avg_px, arg_max(price, level) as worst_px, count(*) as n from ({_WALK}) where take > 0 group by 1, 2")
Q["book_exposure_walk"] = lambda spark, d: rounded(books(spark, d).select(*GRID, book.exposure_walk(F.col("asks"), F.lit(200.0)).alias("x")).select(*GRID, "x.price", "x.quantity"))
_UNITS = "case when k.price > 0 then least(floor(f.money / k.price), k.size) else 0 end"
S["book_exposure_walk"] = views.recursive("select instrument_id, ts, round(case when q > 0 then v / q else 0 end, 6) as price, q as quantity from (select instrument_id, ts, arg_max(q, level) as q, arg_max(v, level) as v from f group by 1, 2)", "deltas",
    e=_EPOCH, history=_HISTORY, live=_LIVE, ranked=_RANKED, k="select instrument_id, ts, level, price, size from ranked where side = 'SELL' and level <= 20",
    f=f"""select instrument_id, ts, 0::bigint as level, 200::double as money, 0::double as q, 0::double as v from ranked where level <= 20 group by 1, 2 union all
        select k.instrument_id, k.ts, k.level, f.money - {_UNITS} * k.price, f.q + {_UNITS}, f.v + {_UNITS} * k.price from f join k on k.instrument_id = f.instrument_id and k.ts = f.ts and k.level = f.level + 1""")  # fmt: skip
Q["book_violations"] = lambda spark, d: book.violations(live(spark, d), GRID)
S["book_violations"] = _sql("select instrument_id, ts, 'crossed' as reason from live group by 1, 2 having max(price) filter (side = 'BUY') >= min(price) filter (side = 'SELL') union all select distinct instrument_id, ts, 'orders' from (select instrument_id, ts, side, price from live group by all having count(*) > 1)")
Q["book_grouped"] = lambda spark, d: book.grouped(live(spark, d), GRID, 5.0)
S["book_grouped"] = _sql("select instrument_id, ts, side, case when side = 'BUY' then floor(price / 5) else ceil(price / 5) end * 5 as price, sum(size) as size from live group by 1, 2, 3, 4")
Q["book_net_of_own"] = lambda spark, d: book.net_of_own(live(spark, d).select(*GRID, "side", "price", "size"), live(spark, d).where("seq % 3 = 0").select(*GRID, "side", "price", (F.col("size") - F.col("seq") % 2).alias("size")), GRID)
S["book_net_of_own"] = _sql("select * from (select l.instrument_id, l.ts, l.side, l.price, l.size - coalesce(o.size, 0) as size from live l left join (select instrument_id, ts, side, price, sum(size - seq % 2) as size from live where seq % 3 = 0 group by 1, 2, 3, 4) o using (instrument_id, ts, side, price)) where size > 0")


def _own(spark, d):
    o = views.table(spark, d, "orders")
    k = F.col("o_orderkey")
    orders = o.select(
        F.col("o_orderpriority").alias("instrument_id"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.round(F.col("o_totalprice") / 10000).alias("price"),
        (1 + k % 50).cast("double").alias("quantity"), (k % 30).cast("double").alias("filled_qty"), F.when(F.col("o_orderstatus") == "O", "ACCEPTED").otherwise("FILLED").alias("status"), F.when(k % 5 == 0, "IOC").otherwise("GTC").alias("time_in_force"),
    )
    return book.own_book(orders)


Q["own_book"] = _own
S["own_book"] = """select * from (select o_orderpriority as instrument_id, case when o_orderkey % 2 = 0 then 'BUY' else 'SELL' end as side, round(o_totalprice / 10000) as price, sum(1 + o_orderkey % 50 - o_orderkey % 30)::double as size, count(*) as count
    from orders where o_orderstatus = 'O' and o_orderkey % 5 <> 0 group by 1, 2, 3) where size > 0"""
Q["book_binary_combined"] = lambda spark, d: rounded(book.binary_combined(*[live(spark, d).where(f"seq % 2 = {k}").select(*GRID, "side", (F.col("price") / 1000).alias("price"), "size") for k in (0, 1)]).groupBy("instrument_id", "side").agg(F.sum("size").alias("size"), F.max("price").alias("price")))
S["book_binary_combined"] = _sql("select instrument_id, s as side, sum(size) as size, round(max(p), 6) as price from (select instrument_id, size, case when seq % 2 = 0 then side when side = 'BUY' then 'SELL' else 'BUY' end as s, case when seq % 2 = 0 then price / 1000 else 1 - price / 1000 end as p from live) group by 1, 2")
Q["book_snapshot_deltas"] = lambda spark, d: book.snapshot_deltas(live(spark, d).where("level <= 3").select(*GRID, "side", "price", "size"), ["instrument_id"], "ts").withColumn("n", F.col("n").cast("long"))
S["book_snapshot_deltas"] = _sql("select instrument_id, ts, action, side, price, size, row_number() over (partition by instrument_id, ts order by (action = 'ADD')::int, side, price) as n from (select distinct instrument_id, ts, 'CLEAR' as action, null::varchar as side, null::double as price, null::double as size from ranked where level <= 3 union all select instrument_id, ts, 'ADD', side, price, size from ranked where level <= 3)")
Q["book_level_exposure"] = lambda spark, d: rounded(live(spark, d).groupBy(*GRID).agg(F.sum(F.col("price") * F.col("size")).alias("exposure"), F.sum(F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))).alias("signed_size")))
S["book_level_exposure"] = _sql("select instrument_id, ts, round(sum(price * size), 6) as exposure, sum(case when side = 'BUY' then size else -size end) as signed_size from live group by 1, 2")
Q["mbp_keys"] = lambda spark, d: views.deltas(spark, d).select("seq", book.mbp_key(F.when(F.col("seq") % 3 == 0, 64).otherwise(16), F.col("side"), F.col("price").cast("long")).alias("key"))
S["mbp_keys"] = sql("select seq, case when seq % 3 = 0 then side else price::bigint::varchar end as key from deltas", "deltas")
#: Each update's level stands until the next one of its side and price or the next CLEAR.
LEVELS = dict(
    r="select *, row_number() over (partition by instrument_id order by ts_event, seq) as n from deltas",
    c="select *, coalesce(min(case when action = 'CLEAR' then n end) over (partition by instrument_id order by n rows between current row and unbounded following), 1::bigint << 60) as cleared from r",
    l="select * from (select *, least(cleared, coalesce(lead(n) over (partition by instrument_id, side, price order by n), 1::bigint << 60)) as gone from c where action <> 'CLEAR') where action <> 'DELETE' and size > 0",
)
DERIVED = sql("""select instrument_id, seq, ts_event, bid_price, ask_price, bid_size, ask_size from (select *, lag((bid_price, ask_price, bid_size, ask_size)) over (partition by instrument_id order by n) as before from (
    select f.instrument_id, f.seq, f.ts_event, f.n, max(l.price) filter (l.side = 'BUY') as bid_price, min(l.price) filter (l.side = 'SELL') as ask_price, arg_max(l.size, l.price) filter (l.side = 'BUY') as bid_size, arg_min(l.size, l.price) filter (l.side = 'SELL') as ask_size
    from r f join l on l.instrument_id = f.instrument_id and l.n <= f.n and l.gone > f.n where f.flags >= 128 group by 1, 2, 3, 4) where bid_price is not null and ask_price is not null)
    where before is null or before <> (bid_price, ask_price, bid_size, ask_size)""", "deltas", **LEVELS)  # fmt: skip
Q["derived_quotes"] = lambda spark, d: book.derived_quotes(views.deltas(spark, d))
S["derived_quotes"] = DERIVED
Q["quotes_from_depth"] = lambda spark, d: books(spark, d).where("size(bids) > 0 and size(asks) > 0").select(*GRID, F.col("bids")[0]["price"].alias("bid_price"), F.col("asks")[0]["price"].alias("ask_price"), F.col("bids")[0]["size"].alias("bid_size"), F.col("asks")[0]["size"].alias("ask_size"))
S["quotes_from_depth"] = _sql("select * from (select instrument_id, ts, max(price) filter (side = 'BUY') as bid_price, min(price) filter (side = 'SELL') as ask_price, arg_max(size, price) filter (side = 'BUY') as bid_size, arg_min(size, price) filter (side = 'SELL') as ask_size from live group by 1, 2) where bid_price is not null and ask_price is not null")
