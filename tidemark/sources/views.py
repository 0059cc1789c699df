"""Market-data views of the driver tables: trades, quotes, book deltas, fills, returns and the rest, as DataFrames.

Times are nanoseconds since the epoch (`ts_event`), `seq` orders rows of one time. SQL has the same views as common table
expressions, so that both sides of a comparison start from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(c: str) -> Column:
    """Nanoseconds since the epoch of a timestamp without time zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz)) * 1000")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument_id"),
        F.col("value").alias("price"),
        (1 + F.col("event_id") % 10).cast("double").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "BUYER").otherwise("SELLER").alias("aggressor_side"),
        nanos("ts").alias("ts_event"),
        F.col("event_id").alias("seq"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument_id"),
        F.col("value").alias("bid_price"),
        (F.col("value") + 0.01 * (1 + e % 5)).alias("ask_price"),
        (1 + e % 10).cast("double").alias("bid_size"),
        (1 + F.floor(e / 10) % 10).cast("double").alias("ask_size"),
        nanos("ts").alias("ts_event"),
        e.alias("seq"),
    )


def partial_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir)
    for side, m in (("bid", 7), ("ask", 11)):
        gone = F.col("seq") % m == 0
        q = q.withColumns({f"{side}_{c}": F.when(~gone, F.col(f"{side}_{c}")) for c in ("price", "size")})
    return q


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    size = (e % 7).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument_id"),
        F.when(e % 499 == 0, "CLEAR").when(size == 0, "DELETE").otherwise("UPDATE").alias("action"),
        F.when(e % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.round("value").alias("price"),
        size.alias("size"),
        F.when(e % 5 == 4, 128).otherwise(0).alias("flags"),
        nanos("ts").alias("ts_event"),
        e.alias("seq"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("account_id"),
        F.col("o_orderpriority").alias("instrument_id"),
        F.when(o % 2 == 0, "BUY").otherwise("SELL").alias("order_side"),
        (1 + o % 50).cast("double").alias("last_qty"),
        (F.col("o_totalprice") / 1000).alias("last_px"),
        F.when(o % 3 == 0, "MAKER").otherwise("TAKER").alias("liquidity_side"),
        nanos("o_orderdate").alias("ts_event"),
        o.alias("seq"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INITIALIZED, SUBMITTED, ACCEPTED and a last event of each order, a second apart."""
    o = F.col("o_orderkey")
    last = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "CANCELED").otherwise("EXPIRED")
    kinds = F.array(F.lit("INITIALIZED"), F.lit("SUBMITTED"), F.lit("ACCEPTED"), last)
    t = table(spark, sf_dir, "orders").select(
        o.alias("order_id"),
        F.col("o_orderpriority").alias("instrument_id"),
        (F.col("o_custkey") % 20).alias("account_id"),
        F.when(o % 2 == 0, "BUY").otherwise("SELL").alias("order_side"),
        (1 + o % 50).cast("double").alias("quantity"),
        (F.col("o_totalprice") / 1000).alias("price"),
        nanos("o_orderdate").alias("ts"),
        F.posexplode(kinds).alias("k", "event"),
    )
    return t.select(
        "order_id", "instrument_id", "account_id", "order_side", "quantity", "price", "event",
        F.when(F.col("event") == "FILLED", F.col("quantity")).alias("last_qty"),
        F.when(F.col("event") == "FILLED", F.col("price")).alias("last_px"),
        (F.col("ts") + F.col("k").cast("long") * 1_000_000_000).alias("ts_event"), F.col("k").cast("long").alias("seq"),
    )


def returns(spark: SparkSession, sf_dir: str, grouped: bool = True) -> DataFrame:
    """Daily returns: a hundredth of the log change of the day's order value."""
    from pyspark.sql import Window

    by = ["series"] if grouped else []
    day = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.expr("cast(cast(o_orderdate as timestamp_ntz) as date)").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("x")
    )
    day = day.groupBy(*by, "day").agg(F.sum("x").cast("double").alias("x"))
    w = Window.partitionBy(*by).orderBy("day")
    return day.withColumn("ret", 0.01 * F.log(F.col("x") / F.lag("x").over(w))).where("ret is not null").select(*by, "day", "ret")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(e % 37 != 0).select(
        (e % 4).alias("run_id"), F.floor(e / 4).alias("seq"), F.concat(F.lit("data."), "event_type", F.lit("."), F.col("user_id").cast("string")).alias("topic"),
        F.col("props").alias("payload"), nanos("ts").alias("ts_init"), F.when(e >= 10, e - 10).alias("causation_id"), e.alias("entry_id"),
    )


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool swaps from order lines."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pool")), "l_partkey").select(
        "pool", F.floor(nanos("l_shipdate") / 86_400_000_000_000).cast("long").alias("block"), F.col("l_orderkey").alias("transaction_index"),
        F.col("l_linenumber").cast("long").alias("log_index"), F.col("l_quantity").cast("double").alias("base"), F.col("l_extendedprice").cast("double").alias("quote"),
        F.when(F.col("l_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("l_suppkey") % 50).alias("owner"), F.col("l_partkey").alias("part"),
    )


#: The same views in SQL; a query takes those that it names.
CTE = {
    "trades": """select event_type as instrument_id, value as price, (1 + event_id % 10)::double as size,
        case when event_id % 2 = 0 then 'BUYER' else 'SELLER' end as aggressor_side, epoch_us(ts) * 1000 as ts_event, event_id as seq from events""",
    "quotes": """select event_type as instrument_id, value as bid_price, value + 0.01::double * (1 + event_id % 5) as ask_price, (1 + event_id % 10)::double as bid_size,
        (1 + (event_id // 10) % 10)::double as ask_size, epoch_us(ts) * 1000 as ts_event, event_id as seq from events""",
    "partial_quotes": """select instrument_id, case when seq % 7 <> 0 then bid_price end as bid_price, case when seq % 11 <> 0 then ask_price end as ask_price,
        case when seq % 7 <> 0 then bid_size end as bid_size, case when seq % 11 <> 0 then ask_size end as ask_size, ts_event, seq from quotes""",
    "deltas": """select event_type as instrument_id, case when event_id % 499 = 0 then 'CLEAR' when event_id % 7 = 0 then 'DELETE' else 'UPDATE' end as action,
        case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, round(value) as price, (event_id % 7)::double as size,
        case when event_id % 5 = 4 then 128 else 0 end as flags, epoch_us(ts) * 1000 as ts_event, event_id as seq from events""",
    "fills": """select o_custkey % 20 as account_id, o_orderpriority as instrument_id, case when o_orderkey % 2 = 0 then 'BUY' else 'SELL' end as order_side,
        (1 + o_orderkey % 50)::double as last_qty, o_totalprice / 1000 as last_px, case when o_orderkey % 3 = 0 then 'MAKER' else 'TAKER' end as liquidity_side,
        epoch_us(o_orderdate) * 1000 as ts_event, o_orderkey as seq from orders""",
    "order_events": """select o_orderkey as order_id, o_orderpriority as instrument_id, o_custkey % 20 as account_id,
        case when o_orderkey % 2 = 0 then 'BUY' else 'SELL' end as order_side, (1 + o_orderkey % 50)::double as quantity, o_totalprice / 1000 as price, event,
        case when event = 'FILLED' then (1 + o_orderkey % 50)::double end as last_qty, case when event = 'FILLED' then o_totalprice / 1000 end as last_px,
        epoch_us(o_orderdate) * 1000 + k * 1000000000 as ts_event, k as seq
        from (select *, unnest([0::bigint, 1, 2, 3]) as k, unnest(['INITIALIZED', 'SUBMITTED', 'ACCEPTED',
              case o_orderstatus when 'F' then 'FILLED' when 'O' then 'CANCELED' else 'EXPIRED' end]) as event from orders)""",
    "returns": """select series, day, ret from (select series, day, 0.01::double * ln(x / lag(x) over (partition by series order by day)) as ret from
        (select o_orderpriority as series, o_orderdate::date as day, sum(o_totalprice::decimal(18,2))::double as x from orders group by 1, 2)) where ret is not null""",
    "benchmark_returns": """select day, ret from (select day, 0.01::double * ln(x / lag(x) over (order by day)) as ret from
        (select o_orderdate::date as day, sum(o_totalprice::decimal(18,2))::double as x from orders group by 1)) where ret is not null""",
    "event_log": """select event_id % 4 as run_id, event_id // 4 as seq, 'data.' || event_type || '.' || user_id::varchar as topic, props as payload,
        epoch_us(ts) * 1000 as ts_init, case when event_id >= 10 then event_id - 10 end as causation_id, event_id as entry_id from events where event_id % 37 <> 0""",
    "swaps": """select p_brand as pool, epoch_us(l_shipdate::timestamp) // 86400000000 as block, l_orderkey as transaction_index, l_linenumber::bigint as log_index,
        l_quantity::double as base, l_extendedprice::double as quote, case when l_orderkey % 2 = 0 then 'BUY' else 'SELL' end as side, l_suppkey % 50 as owner, l_partkey as part
        from lineitem join part on p_partkey = l_partkey""",
}
_NEEDS = {"partial_quotes": ["quotes"]}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over the named views; `more` adds expressions of its own in order."""
    parts = [f"{n} as ({CTE[n]})" for name in names for n in [*_NEEDS.get(name, []), name]] + [f"{k} as ({v})" for k, v in more.items()]
    parts = list(dict.fromkeys(parts))
    return (f"with {', '.join(parts)} " if parts else "") + body


def recursive(body: str, *names: str, **more: str) -> str:
    """sql() whose expressions may build on themselves."""
    return "with recursive" + sql(body, *names, **more)[len("with") :]
