"""Queries over the event log, pools and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, eventlog, pools
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import sql

Q: dict = {}
S: dict = {}
log = views.event_log
FIELDS = ("run_id", "seq", "topic", "payload")

Q["sequence_gaps"] = lambda spark, d: eventlog.gaps(log(spark, d))
S["sequence_gaps"] = sql("select run_id, seq + 1 as first, n - 1 as last from (select run_id, seq, lead(seq) over (partition by run_id order by seq) as n from event_log) where n - seq > 1", "event_log")
_DIG = "sha256(" + " || ".join(f"strlen(coalesce({c}::varchar, ''))::varchar || ':' || coalesce({c}::varchar, '')" for c in FIELDS) + ")"
Q["entry_digests"] = lambda spark, d: log(spark, d).select("entry_id", eventlog.digest(FIELDS).alias("digest"))
S["entry_digests"] = sql(f"select entry_id, {_DIG} as digest from event_log", "event_log")
Q["hash_mismatches"] = lambda spark, d: eventlog.hash_mismatches(log(spark, d).withColumn("entry_hash", eventlog.digest(FIELDS)).withColumn("payload", F.when(F.col("entry_id") % 100 == 1, F.lit("changed")).otherwise(F.col("payload"))), FIELDS).select("entry_id")
S["hash_mismatches"] = sql("select entry_id from event_log where entry_id % 100 = 1", "event_log")


def _manifest(spark, d):
    e = views.table(spark, d, "events").select((F.col("event_id") % 4).alias("run_id"), F.floor(F.col("event_id") / 4).alias("seq"), "event_id").where("event_id % 37 <> 0 or run_id = 2")
    return e.groupBy("run_id").agg(F.count("*").alias("stated_entries"), F.max("seq").alias("stated_high"))


Q["manifest_mismatches"] = lambda spark, d: eventlog.manifest_mismatches(log(spark, d), _manifest(spark, d)).select("run_id", "entries", "high", "stated_entries", "stated_high")
S["manifest_mismatches"] = sql("select a.run_id, a.entries, a.high, m.stated_entries, m.stated_high from (select run_id, count(*) as entries, max(seq) as high from event_log group by 1) a join (select event_id % 4 as run_id, count(*) as stated_entries, max(event_id // 4) as stated_high from events where event_id % 37 <> 0 or event_id % 4 = 2 group by 1) m using (run_id) where entries <> stated_entries or high <> stated_high", "event_log")
Q["cause_chains"] = lambda spark, d: eventlog.causes(log(spark, d)).select("entry_id", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))
S["cause_chains"] = f"""with recursive event_log as ({views.CTE['event_log']}), r as (select entry_id, causation_id as at, '' as chain, 0 as n from event_log
    union all select r.entry_id, l.causation_id, case when n = 0 then '' else chain || '>' end || l.entry_id::varchar, n + 1 from r join event_log l on l.entry_id = r.at)
    select entry_id, arg_max(chain, n) as chain from r group by 1"""
Q["stream_cursors"] = lambda spark, d: eventlog.cursors(log(spark, d), 1000, ["run_id", "topic"])
S["stream_cursors"] = sql("select run_id, topic, max(seq) as seq, arg_max(ts_init, seq) as ts_init from event_log where seq <= 1000 group by 1, 2", "event_log")
Q["replay_slice"] = lambda spark, d: eventlog.replay(log(spark, d), eventlog.cursors(log(spark, d), 500, ["topic"]), eventlog.cursors(log(spark, d), 1500, ["topic"]), ["topic"]).select("entry_id", "topic", "seq")
S["replay_slice"] = sql("select l.entry_id, l.topic, l.seq from event_log l where l.seq > coalesce((select max(seq) from event_log a where a.topic = l.topic and a.seq <= 500), -1) and l.seq <= (select max(seq) from event_log a where a.topic = l.topic and a.seq <= 1500)", "event_log")


def _runs(spark, d):
    e = views.table(spark, d, "events")
    return e.groupBy((F.col("event_id") % 40).alias("run_id")).agg(F.count("*").alias("n")).withColumns({"sealed": F.col("run_id") % 3 != 0, "good": F.col("run_id") % 11 == 0})


Q["retention_plan"] = lambda spark, d: eventlog.retention(_runs(spark, d), 5).select("run_id")
S["retention_plan"] = "select run_id from (select distinct event_id % 40 as run_id from events) where run_id % 3 <> 0 and run_id < 33 and run_id <= 34"
Q["run_listing"] = lambda spark, d: log(spark, d).groupBy("run_id").agg(F.min("ts_init").alias("first_ts"), F.max("ts_init").alias("last_ts"), F.count("*").alias("n"))
S["run_listing"] = sql("select run_id, min(ts_init) as first_ts, max(ts_init) as last_ts, count(*) as n from event_log group by 1", "event_log")

# pools
_SPOT = "select *, quote / base as execution, quote / base * (1 + log_index / 100.0::double) as spot from swaps where base > 0"


def swaps(spark, d):
    return views.swaps(spark, d)


Q["swap_trades"] = lambda spark, d: rounded(pools.as_trades(swaps(spark, d).select("pool", "part", "transaction_index", "log_index", F.lit("USD").alias("token0"), F.col("pool").alias("token1"), F.col("quote").alias("amount0"), (-F.col("base")).alias("amount1")), ["USD", "EUR"]).groupBy("base_token", "quote_token", "trade_side").agg(F.count("*").alias("n"), F.sum(F.col("base_qty").cast("decimal(18,2)")).cast("double").alias("base"), F.max("execution_price").alias("top")))
S["swap_trades"] = sql("select pool as base_token, 'USD' as quote_token, 'BUY' as trade_side, count(*) as n, sum(base::decimal(18,2))::double as base, round(max(quote / base), 6) as top from swaps group by 1", "swaps")
Q["price_impact"] = lambda spark, d: rounded(pools.impacts(swaps(spark, d).withColumns({"execution": F.col("quote") / F.col("base"), "spot": F.col("quote") / F.col("base") * (1 + F.col("log_index") / 100)}), ("block", "transaction_index", "log_index", "part", "base", "quote")).groupBy("pool").agg(F.max("impact_bps").alias("impact"), F.max("slippage_bps").alias("slippage"), F.count("impact_bps").alias("n")))
S["price_impact"] = sql("select pool, round(max(abs(spot - b) / b * 10000), 6) as impact, round(max(abs(execution - b) / b * 10000), 6) as slippage, count(b) as n from (select *, lag(spot) over (partition by pool order by block, transaction_index, log_index, part, base, quote) as b from x) group by 1", "swaps", x=_SPOT)
Q["block_order"] = lambda spark, d: swaps(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("pool").orderBy("block", "transaction_index", "log_index", "part", "base", "quote")).cast("long")).select("pool", "block", "transaction_index", "log_index", "n")
S["block_order"] = sql("select pool, block, transaction_index, log_index, row_number() over (partition by pool order by block, transaction_index, log_index, part, base, quote) as n from swaps", "swaps")
_KIND = "select *, case transaction_index % 10 when 0 then 'mint' when 1 then 'burn' when 2 then 'collect' when 3 then 'flash' else 'swap' end as kind, base as liquidity, (part % 20) as lower, (part % 20) + 1 + log_index as upper, base as amount from swaps"


def pool_events(spark, d):
    k = F.col("transaction_index") % 10
    kind = F.when(k == 0, "mint").when(k == 1, "burn").when(k == 2, "collect").when(k == 3, "flash").otherwise("swap")
    return swaps(spark, d).withColumns({"kind": kind, "liquidity": F.col("base"), "lower": F.col("part") % 20, "upper": F.col("part") % 20 + 1 + F.col("log_index"), "amount": F.col("base")})


Q["pool_activity"] = lambda spark, d: rounded(pools.activity(pool_events(spark, d)))
S["pool_activity"] = sql("select pool, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}s" for k in ("swap", "mint", "burn", "collect", "flash")) + ", sum(case when kind = 'mint' then amount else 0 end) as deposited, sum(case when kind = 'collect' then amount else 0 end) as collected from x group by 1", "swaps", x=_KIND)
_LIQ = "select pool, owner, lower, upper, sum(case kind when 'mint' then liquidity when 'burn' then -liquidity else 0 end) as liquidity, count(*) as events from x group by 1, 2, 3, 4"
Q["liquidity_positions"] = lambda spark, d: rounded(pools.liquidity_positions(pool_events(spark, d)))
S["liquidity_positions"] = sql(_LIQ, "swaps", x=_KIND)
Q["tick_map"] = lambda spark, d: rounded(pools.tick_map(pools.liquidity_positions(pool_events(spark, d))))
S["tick_map"] = sql("select *, sum(net) over (partition by pool order by tick rows unbounded preceding) as active from (select pool, tick, sum(abs(net)) as gross, sum(net) as net from (select pool, lower as tick, liquidity as net from p union all select pool, upper, -liquidity from p) group by 1, 2)", "swaps", x=_KIND, p=_LIQ)
Q["liquidity_utilisation"] = lambda spark, d: rounded(pools.utilisation(pools.liquidity_positions(pool_events(spark, d)), F.lit(10)))
S["liquidity_utilisation"] = sql("select pool, round(sum(case when lower <= 10 and 10 < upper then liquidity else 0 end) / nullif(sum(liquidity), 0), 6) as utilisation from p group by 1", "swaps", x=_KIND, p=_LIQ)
Q["block_gaps"] = lambda spark, d: pools.last_continuous_block(swaps(spark, d))
S["block_gaps"] = sql("select pool, coalesce(min(case when n > block + 1 then block end), max(block)) as continuous, max(block) as latest from (select pool, block, lead(block) over (partition by pool order by block) as n from (select distinct pool, block from swaps)) group by 1", "swaps")
Q["pool_state_differences"] = lambda spark, d: asof.differences(pools.activity(pool_events(spark, d)), pools.activity(pool_events(spark, d).where("part % 97 <> 0")), ["pool"]).select("pool", "side", "fields")
_ACT = "select pool, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}s" for k in ("swap", "mint", "burn", "collect", "flash")) + ", sum(case when kind = 'mint' then amount else 0 end) as deposited, sum(case when kind = 'collect' then amount else 0 end) as collected from x"
_NAMES = ("swaps", "mints", "burns", "collects", "flashs", "deposited", "collected")
S["pool_state_differences"] = sql("select a.pool, 'both' as side, concat_ws(',', " + ", ".join(f"case when a.{n} <> b.{n} then '{n}' end" for n in _NAMES) + f") as fields from ({_ACT} group by 1) a join ({_ACT} where part % 97 <> 0 group by 1) b using (pool) where " + " or ".join(f"a.{n} <> b.{n}" for n in _NAMES), "swaps", x=_KIND)

# scalar functions
Q["epoch_round_trip"] = lambda spark, d: views.trades(spark, d).select("seq", (scalars.from_timestamp(scalars.to_timestamp(F.col("ts_event") + 789))).alias("ns"))
S["epoch_round_trip"] = "select event_id as seq, epoch_us(ts) * 1000 as ns from events"
Q["iso8601"] = lambda spark, d: views.trades(spark, d).select("seq", scalars.iso8601(F.col("ts_event") + 789).alias("nanos"), scalars.iso8601(F.col("ts_event"), 3).alias("millis"))
S["iso8601"] = "select event_id as seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '789Z' as nanos, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as millis from events"
Q["optional_time_bounds"] = lambda spark, d: views.trades(spark, d).select("seq", scalars.latest_of(F.when(F.col("seq") % 3 == 0, F.col("ts_event")), F.lit(1704800000000000000)).alias("latest"), scalars.earliest_of(F.when(F.col("seq") % 3 == 0, F.col("ts_event")), F.lit(1704800000000000000)).alias("earliest"))
S["optional_time_bounds"] = "select event_id as seq, greatest(case when event_id % 3 = 0 then epoch_us(ts) * 1000 end, 1704800000000000000) as latest, least(case when event_id % 3 = 0 then epoch_us(ts) * 1000 end, 1704800000000000000) as earliest from events"
Q["fixed_precision"] = lambda spark, d: views.table(spark, d, "orders").select("o_orderkey", scalars.precision(F.col("o_totalprice")).cast("long").alias("digits"), scalars.add_prices(F.col("o_totalprice"), F.lit(0.001)).alias("total"), scalars.negative_quantity(F.col("o_totalprice"), F.lit(50000.0)).alias("negative"))
S["fixed_precision"] = "select o_orderkey, length(regexp_extract(o_totalprice::decimal(28,9)::varchar, '\\.(\\d*?)0*$', 1)) as digits, (o_totalprice::decimal(28,9) + 0.001)::double as total, o_totalprice < 50000 as negative from orders"
Q["identifier_parts"] = lambda spark, d: views.table(spark, d, "part").select("p_partkey", scalars.symbol(F.concat("p_brand", F.lit(".A.XNAS"))).alias("symbol"), scalars.venue(F.concat("p_brand", F.lit(".A.XNAS"))).alias("venue"), scalars.safe_identifier(F.concat("p_brand", F.lit("/USD"))).alias("safe"))
S["identifier_parts"] = "select p_partkey, p_brand || '.A' as symbol, 'XNAS' as venue, p_brand || 'USD' as safe from part"
Q["name_cases"] = lambda spark, d: views.table(spark, d, "region").select("r_regionkey", scalars.snake_case(F.lit("OrderBookDelta10Depth")).alias("snake"), scalars.title_case(F.lit("order_book_delta")).alias("title"))
S["name_cases"] = "select r_regionkey, 'order_book_delta10_depth' as snake, 'OrderBookDelta' as title from region"
Q["basis_points"] = lambda spark, d: rounded(views.table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.max(scalars.basis_points(F.col("l_discount") * 100)).alias("fraction")))
S["basis_points"] = "select l_linestatus, round(max(l_discount * 100 / 10000), 6) as fraction from lineitem group by 1"
Q["json_access"] = lambda spark, d: views.table(spark, d, "events").groupBy("event_type").agg(F.sum(scalars.json_number(F.col("props"), "$.k")).alias("k"))
S["json_access"] = "select event_type, sum((props->>'$.k')::double) as k from events group by 1"
Q["event_json_columns"] = lambda spark, d: views.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("text"))
S["event_json_columns"] = """select event_id, (props->>'$.k')::int as k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as text from events"""
Q["depth_arrays"] = lambda spark, d: rounded(views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size")))).alias("levels")).select("l_orderkey", scalars.depth_totals(F.col("levels")).alias("total"), F.element_at("levels", 1)["price"].alias("best")))
S["depth_arrays"] = "select l_orderkey, sum(l_quantity) as total, min(l_extendedprice) as best from lineitem group by 1"
Q["utc_times"] = lambda spark, d: views.trades(spark, d).select("seq", F.unix_micros(scalars.to_utc(F.timestamp_micros(F.expr("ts_event div 1000")), "Asia/Tokyo")).alias("utc"))
S["utc_times"] = "select event_id as seq, epoch_us(ts - interval 9 hours) as utc from events"
