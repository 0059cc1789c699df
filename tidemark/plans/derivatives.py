"""Queries over synthetic prices, option chains, greeks, rates and funding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, derived
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import sql

Q: dict = {}
S: dict = {}
DAY = 86_400_000_000_000
_LEGS = """(select ts_event, seq, last_value(case when instrument_id = 'view' then price end ignore nulls) over w as view, last_value(case when instrument_id = 'click' then price end ignore nulls) over w as click
    from trades where instrument_id in ('view', 'click') window w as (order by ts_event, seq, instrument_id rows between unbounded preceding and current row))"""


def legs(spark, d):
    t = views.trades(spark, d)
    return {n: t.where(F.col("instrument_id") == n) for n in ("view", "click")}


Q["synthetic_price"] = lambda spark, d: derived.synthetic(legs(spark, d), "price", (F.col("view") + F.col("click")) / 2.0, 4, bucket=DAY).select("ts_event", "seq", "price")
S["synthetic_price"] = sql(f"select ts_event, seq, round((view + click) / 2, 4) as price from {_LEGS} where view is not null and click is not null", "trades")
Q["synthetic_functions"] = lambda spark, d: derived.synthetic(legs(spark, d), "price", F.when(F.col("view") > F.col("click"), F.greatest(F.ceil("view"), F.floor(F.col("click") * 2))).otherwise(F.least(F.abs(F.col("view") - F.col("click")), F.pow(F.col("view"), F.lit(2.0)) % 7)), 4, bucket=DAY).select("ts_event", "seq", "price")
S["synthetic_functions"] = sql(f"select ts_event, seq, round(case when view > click then greatest(ceil(view), floor(click * 2)) else least(abs(view - click), pow(view, 2) % 7) end, 4)::double as price from {_LEGS} where view is not null and click is not null", "trades")
Q["synthetic_guard"] = lambda spark, d: derived.synthetic({n: x.withColumn("price", F.when(F.col("seq") % 10 != 0, F.col("price")).otherwise(F.lit(0.0))) for n, x in legs(spark, d).items()}, "price", F.try_divide(F.col("view"), F.col("click")), 4, bucket=DAY).select("ts_event", "seq", "price")
S["synthetic_guard"] = sql(f"select ts_event, seq, round(view / nullif(click, 0), 4) as price from {_LEGS.replace('from trades', 'from (select * replace (case when seq % 10 <> 0 then price else 0 end as price) from trades)')} where view is not null and click is not null and click <> 0", "trades")

_CHAIN = "select p_brand as series, p_size::double as strike, case when p_partkey % 2 = 0 then 'CALL' else 'PUT' end as kind, p_partkey, p_retailprice / 100 as bid, p_retailprice / 100 + 0.5::double as ask, (p_partkey % 100) / 100.0::double as delta, 20 + (p_partkey % 13)::double as underlying_price from part"


def chain(spark, d):
    p = views.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("series"), F.col("p_size").cast("double").alias("strike"), F.when(k % 2 == 0, "CALL").otherwise("PUT").alias("kind"), k, (F.col("p_retailprice") / 100).alias("bid"),
        (F.col("p_retailprice") / 100 + 0.5).alias("ask"), ((k % 100) / 100).alias("delta"), (20 + k % 13).cast("double").alias("underlying_price"),
    )


def with_atm(spark, d):
    c = chain(spark, d)
    atm = c.groupBy("series").agg(F.max_by("underlying_price", "p_partkey").alias("atm"))
    return c.join(atm, "series")


_ATM = "select c.*, a.atm from c join (select series, arg_max(underlying_price, p_partkey) as atm from c group by 1) a using (series)"
Q["option_chain_slice"] = lambda spark, d: rounded(chain(spark, d).groupBy("series", "strike").pivot("kind", ["CALL", "PUT"]).agg(F.max_by("bid", "p_partkey").alias("bid"), F.max_by("ask", "p_partkey").alias("ask")).withColumnsRenamed({"CALL_bid": "call_bid", "CALL_ask": "call_ask", "PUT_bid": "put_bid", "PUT_ask": "put_ask"}))
S["option_chain_slice"] = sql("select series, strike, " + ", ".join(f"round(arg_max({x}, p_partkey) filter (kind = '{k}'), 6) as {k.lower()}_{x}" for k in ("CALL", "PUT") for x in ("bid", "ask")) + " from c group by 1, 2", c=_CHAIN)
Q["atm_price"] = lambda spark, d: derived.atm_price(chain(spark, d).withColumn("underlying_price", F.when(F.col("p_partkey") % 5 == 0, F.col("underlying_price"))), ["series"], ["p_partkey"], F.lit(25.0)).select("series", "p_partkey", "atm")
S["atm_price"] = sql("select series, p_partkey, coalesce(last_value(case when p_partkey % 5 = 0 then underlying_price end ignore nulls) over (partition by series order by p_partkey rows between unbounded preceding and current row), 25) as atm from c", c=_CHAIN)
Q["strikes_fixed"] = lambda spark, d: chain(spark, d).where(F.col("strike").isin(10.0, 20.0, 30.0)).groupBy("series").agg(F.count("*").alias("n"))
S["strikes_fixed"] = sql("select series, count(*) as n from c where strike in (10, 20, 30) group by 1", c=_CHAIN)
Q["strikes_around_atm"] = lambda spark, d: derived.strikes_around(with_atm(spark, d), ["series"], 3, 2)
S["strikes_around_atm"] = sql("""select series, strike, atm from (select *, max(case when near = 1 then n end) over (partition by series) as c from (select *, row_number() over (partition by series order by strike) as n, row_number() over (partition by series order by abs(strike - atm), strike) as near
    from (select distinct series, strike, atm from a))) where n between c - 2 and c + 3""", c=_CHAIN, a=_ATM)  # fmt: skip
Q["strikes_percent"] = lambda spark, d: derived.strikes_within(with_atm(spark, d), 0.2).groupBy("series").agg(F.countDistinct("strike").alias("strikes"))
S["strikes_percent"] = sql("select series, count(distinct strike) as strikes from a where abs(strike - atm) <= 0.2::double * atm group by 1", c=_CHAIN, a=_ATM)
Q["strikes_by_delta"] = lambda spark, d: derived.strikes_by_delta(with_atm(spark, d), ["series"], 0.25, 0.02)
S["strikes_by_delta"] = sql("""select distinct series, strike, atm from a where abs(abs(delta) - 0.25::double) <= 0.02::double union all
    select series, strike, atm from (select *, max(case when near = 1 then n end) over (partition by series) as c from (select *, row_number() over (partition by series order by strike) as n, row_number() over (partition by series order by abs(strike - atm), strike) as near
    from (select distinct series, strike, atm from a where series not in (select series from a where abs(abs(delta) - 0.25::double) <= 0.02::double)))) where n between c - 5 and c + 5""", c=_CHAIN, a=_ATM)  # fmt: skip
Q["chain_accessors"] = lambda spark, d: chain(spark, d).groupBy("series").agg(F.countDistinct("strike").alias("strikes"), F.sum((F.col("kind") == "CALL").cast("long")).alias("calls"), F.sum((F.col("kind") == "PUT").cast("long")).alias("puts"))
S["chain_accessors"] = sql("select series, count(distinct strike) as strikes, count(*) filter (kind = 'CALL') as calls, count(*) filter (kind = 'PUT') as puts from c group by 1", c=_CHAIN)
Q["chain_rebalance"] = lambda spark, d: derived.active_strikes(views.trades(spark, d).select("instrument_id", "ts_event", "seq", F.col("price").alias("atm")), ["instrument_id"], ["ts_event", "seq"], 5.0, 3, 0.1, 3_600_000_000_000)
_TURNS = "abs(t.price - f.centre) > 3 and t.ts_event - f.since >= 3600000000000"
S["chain_rebalance"] = views.recursive("select instrument_id, since as ts_event, centre, centre - 15 as lowest, centre + 15 as highest from f where hit", "trades",
    t="select *, row_number() over (partition by instrument_id order by ts_event, seq) as n, round_even(price / 5, 0) * 5 as near from trades",
    f=f"""select instrument_id, n, ts_event as since, near as centre, true as hit from t where n = 1 union all
        select t.instrument_id, t.n, case when {_TURNS} then t.ts_event else f.since end, case when {_TURNS} then t.near else f.centre end, {_TURNS} from f join t on t.instrument_id = f.instrument_id and t.n = f.n + 1""")  # fmt: skip


def positions(spark, d):
    k = F.col("p_partkey")
    return with_atm(spark, d).withColumns({"quantity": (k % 7 - 3).cast("double"), "multiplier": F.lit(10.0), "gamma": F.col("delta") / 10, "vega": F.col("delta") * 2, "theta": -F.col("delta")})


_PG = "select *, (p_partkey % 7 - 3)::double as quantity, delta / 10 as gamma, delta * 2 as vega, -delta as theta from a"
Q["portfolio_greeks"] = lambda spark, d: rounded(positions(spark, d).select("series", *derived.scaled_greeks()).groupBy("series").agg(*[F.sum(g).alias(g) for g in ("delta", "gamma", "vega", "theta")]))
S["portfolio_greeks"] = sql("select series, " + ", ".join(f"round(sum(quantity * 10 * {g}), 6) as {g}" for g in ("delta", "gamma", "vega", "theta")) + " from p group by 1", c=_CHAIN, a=_ATM, p=_PG)
Q["portfolio_greeks_filtered"] = lambda spark, d: rounded(positions(spark, d).where("series like 'Brand#1%' and quantity > 0").select("kind", *derived.scaled_greeks()).groupBy("kind").agg(F.sum("delta").alias("delta")))
S["portfolio_greeks_filtered"] = sql("select kind, round(sum(quantity * 10 * delta), 6) as delta from p where series like 'Brand#1%' and quantity > 0 group by 1", c=_CHAIN, a=_ATM, p=_PG)
Q["weighted_greeks"] = lambda spark, d: rounded(positions(spark, d).withColumns({"beta": F.lit(1.2), "spot": F.col("atm"), "index": F.lit(100.0), "days": 1 + F.col("p_partkey") % 60}).select("p_partkey", derived.weighted_delta().alias("delta"), derived.weighted_vega(30.0).alias("vega")))
S["weighted_greeks"] = sql("select p_partkey, round(delta * 1.2::double * atm / 100, 6) as delta, round(vega * sqrt(30.0::double / (1 + p_partkey % 60)), 6) as vega from p", c=_CHAIN, a=_ATM, p=_PG)


def options(spark, d):
    return with_atm(spark, d).select("p_partkey", F.col("atm").alias("spot"), "strike", ((1 + F.col("p_partkey") % 300) / 365.25).alias("years"), (0.15 + F.col("delta") / 2).alias("vol"), F.lit(0.02).alias("rate"), F.lit(0.02).alias("carry"), (F.col("kind") == "CALL").alias("is_call"))


Q["greeks"] = lambda spark, d: rounded(derived.greeks(options(spark, d)))
Q["implied_vols"] = lambda spark, d: rounded(derived.implied_vols(derived.greeks(options(spark, d))).select("p_partkey", "vol", "implied_vol"))
Q["greeks_shocked"] = lambda spark, d: rounded(derived.shocked(options(spark, d), [-0.1, 0.0, 0.1], [0.0, 0.05], [0.0, 5.0]).groupBy("spot_shock", "vol_shock", "day_shock").agg(F.count("*").alias("n"), F.sum("delta").alias("delta")))
_CURVE = [(0.25, 1.0), (1.0, 1.5), (5.0, 2.5), (10.0, 3.0)]


def _fit(i: int) -> str:
    (a, ya), (b, yb), (c, yc) = _CURVE[i - 1], _CURVE[i], _CURVE[i + 1]
    x = "x"
    n = lambda v: f"({v}::double)"
    return f"{n(ya)} * (({x} - {n(b)}) * ({x} - {n(c)}) / {n((a - b) * (a - c))}) + {n(yb)} * (({x} - {n(a)}) * ({x} - {n(c)}) / {n((b - a) * (b - c))}) + {n(yc)} * (({x} - {n(a)}) * ({x} - {n(b)}) / {n((c - a) * (c - b))})"


Q["yield_curve"] = lambda spark, d: rounded(chain(spark, d).select("p_partkey", derived.curve_rate(F.col("p_partkey") % 130 / 10, _CURVE).alias("rate")))
S["yield_curve"] = sql(f"select p_partkey, round(case when x <= 0.25 then 1 when x >= 10 then 3 when x <= 3 then {_fit(1)} else {_fit(2)} end, 6) as rate from (select p_partkey, (p_partkey % 130) / 10::double as x from c)", c=_CHAIN)
Q["linear_interpolation"] = lambda spark, d: rounded(chain(spark, d).select("p_partkey", derived.interpolated(F.col("strike"), F.lit(0.0), F.col("bid"), F.lit(50.0), F.col("ask")).alias("y")))
S["linear_interpolation"] = sql("select p_partkey, round(bid + strike / 50 * (ask - bid), 6) as y from c", c=_CHAIN)
Q["parity_forward"] = lambda spark, d: rounded(Q["option_chain_slice"](spark, d).where("call_bid is not null and put_bid is not null").select("series", "strike", derived.parity_forward(F.col("strike"), F.col("call_bid"), F.col("put_bid")).alias("forward")))
S["parity_forward"] = sql("select series, strike, round(strike + k - p, 6) as forward from (select series, strike, arg_max(bid, p_partkey) filter (kind = 'CALL') as k, arg_max(bid, p_partkey) filter (kind = 'PUT') as p from c group by 1, 2) where k is not null and p is not null", c=_CHAIN)
_DAY = "cast(cast(o_orderdate as timestamp_ntz) as date)"
Q["fx_rollover"] = lambda spark, d: rounded(views.table(spark, d, "orders").select("o_orderkey", derived.rollover(F.expr(_DAY), 1 + F.col("o_orderkey") % 5, F.lit(2.0)).alias("rate")).withColumn("rate", F.col("rate") * 1000))
S["fx_rollover"] = "select o_orderkey, round((1 + o_orderkey % 5 - 2) / 365::double / 100 * case when dayofweek(o_orderdate) in (3, 5) then 3 else 1 end * 1000, 6) as rate from orders"


def _funding(spark, d):
    f = views.fills(spark, d)
    from tidemark.operators.windows import running

    q = F.when(F.col("order_side") == "BUY", F.col("last_qty")).otherwise(-F.col("last_qty"))
    held = f.withColumn("net", F.sum(q).over(running(["instrument_id"]))).select("instrument_id", "ts_event", "seq", "net", "last_px")
    times = f.select("instrument_id").distinct().select("instrument_id", F.explode(F.sequence(F.lit(757382400000000000), F.lit(757382400000000000 + 60 * 2592000000000000), F.lit(2592000000000000))).alias("ts_event")).withColumn("seq", F.lit(1 << 60))
    at = asof.asof_join(times, held, keep_unmatched=False)
    return at.select("instrument_id", "ts_event", (F.col("r_net") * F.col("r_last_px") * 0.0001).alias("payment"))


Q["funding_payments"] = lambda spark, d: rounded(_funding(spark, d))
S["funding_payments"] = sql("""select g.instrument_id, g.ts_event, round(net * last_px * 0.0001::double, 6) as payment from (select instrument_id, 757382400000000000 + i * 2592000000000000 as ts_event from (select distinct instrument_id from fills), range(61) r(i)) g asof join
    (select instrument_id, ts_event, max_by(net, seq) as net, max_by(last_px, seq) as last_px from (select *, sum(case when order_side = 'BUY' then last_qty else -last_qty end) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as net from fills) group by 1, 2) h
    on g.instrument_id = h.instrument_id and g.ts_event >= h.ts_event""", "fills")  # fmt: skip
Q["moneyness"] = lambda spark, d: rounded(with_atm(spark, d).select("p_partkey", *[c.alias(n) for n, c in derived.moneyness(F.col("atm"), F.col("strike"), F.col("kind") == "CALL", F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 90).cast("int"))).items()]))
S["moneyness"] = sql("select p_partkey, (p_partkey % 90)::int as days, round((p_partkey % 90) / 365.25::double, 6) as years, greatest(case when kind = 'CALL' then atm - strike else strike - atm end, 0) as intrinsic from a", c=_CHAIN, a=_ATM)
