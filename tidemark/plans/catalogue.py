"""Queries over catalogs: scans, coverage, loaders, wranglers. Catalogs that a query writes lie in the shared folder."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.operators.windows import rounded
from tidemark.plans.market import HOUR, LEFT, _bars
from tidemark.sources import catalog, views
from tidemark.sources.catalog import Catalog
from tidemark.sources.views import sql

Q: dict = {}
S: dict = {}
MID = 1705363200000000000


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or, where that is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"


def trades(spark: SparkSession, d: str) -> DataFrame:
    return views.trades(spark, d).withColumn("ts_init", F.col("ts_event"))


def filled(spark: SparkSession, d: str) -> Catalog:
    """A catalog with the trades of both halves of the month, written one after the other."""
    c = Catalog(spark, scratch(spark))
    t = trades(spark, d)
    c.write(t.where(F.col("ts_init") < MID), "trades")
    c.write(t.where(F.col("ts_init") >= MID), "trades")
    return c


def _query(spark, d):
    return filled(spark, d).query("trades", ["view", "click"], MID - 10 * HOUR, MID + 10 * HOUR, "price > 5", ordered=False).drop("ts_init")


Q["catalog_query"] = _query
S["catalog_query"] = sql(f"select * from trades where instrument_id in ('view', 'click') and ts_event between {MID - 10 * HOUR} and {MID + 10 * HOUR} and price > 5", "trades")
Q["catalog_bounds"] = lambda spark, d: filled(spark, d).bounds("trades")
S["catalog_bounds"] = sql("select instrument_id as identifier, min(ts_event) as first, max(ts_event) as last from trades group by 1", "trades")
Q["catalog_intervals"] = lambda spark, d: filled(spark, d).intervals("trades")
S["catalog_intervals"] = sql(f"select instrument_id as identifier, min(ts_event) as first, max(ts_event) as last from trades group by instrument_id, ts_event < {MID}", "trades")


def _consolidated(spark, d):
    c = filled(spark, d)
    c.extend("trades", "view", 0, 1)
    c.consolidate("trades")
    return c.query("trades", ordered=False).groupBy("instrument_id").agg(F.count("*").alias("n"), F.max("ts_init").alias("last"))


Q["catalog_consolidated"] = _consolidated
S["catalog_consolidated"] = sql("select instrument_id, count(*) as n, max(ts_event) as last from trades group by 1", "trades")


def _deleted(spark, d):
    c = filled(spark, d)
    c.delete_range("trades", MID - 100 * HOUR, MID + 100 * HOUR)
    return c.query("trades", ordered=False).groupBy("instrument_id").agg(F.count("*").alias("n"))


Q["catalog_deleted_range"] = _deleted
S["catalog_deleted_range"] = sql(f"select instrument_id, count(*) as n from trades where ts_event not between {MID - 100 * HOUR} and {MID + 100 * HOUR} group by 1", "trades")


def _periods(spark, d):
    c = filled(spark, d)
    c.consolidate_by_period("trades", 24 * HOUR)
    return c._read(c._data("trades")).groupBy("identifier", F.col("period").cast("long").alias("period")).agg(F.count("*").alias("n"))


Q["catalog_periods"] = _periods
S["catalog_periods"] = sql(f"select instrument_id as identifier, ts_event // {24 * HOUR} as period, count(*) as n from trades group by 1, 2", "trades")


def _missing(spark, d):
    f = views.fills(spark, d).select((F.col("seq") % 10).cast("string").alias("identifier"), F.expr("seq div 1000").alias("file"), "seq").where("file % 3 <> 1")
    i = f.groupBy("identifier", "file").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    return catalog.missing_intervals(i.drop("file"), 500, 20000)


Q["catalog_missing"] = _missing
S["catalog_missing"] = sql("""select identifier, first, last from (select identifier, coalesce(lag(last) over (partition by identifier order by first) + 1, 500) as first, first - 1 as last from i union all select identifier, max(last) + 1, 20000 from i group by 1) where first <= last""",
    "fills", i="select (seq % 10)::varchar as identifier, min(seq) as first, max(seq) as last from fills where (seq // 1000) % 3 <> 1 group by seq % 10, seq // 1000 having max(seq) >= 500 and min(seq) <= 20000")


def _custom(spark, d):
    c = Catalog(spark, scratch(spark))
    c.write_custom(trades(spark, d).select("instrument_id", "price", "ts_event", "ts_init"), "Signal")
    return c.custom("Signal", ordered=False).groupBy("data_type").agg(F.count("*").alias("n"))


Q["catalog_custom_data"] = _custom
S["catalog_custom_data"] = """select '{"type":"Signal","fields":["instrument_id","price","ts_event","ts_init"]}' as data_type, count(*) as n from events"""


def _instruments(spark, d):
    c = Catalog(spark, scratch(spark))
    p = views.table(spark, d, "part").withColumns({"ts_init": F.lit(0).cast("long"), "instrument_id": F.concat("p_brand", F.lit("/X"))})
    c.write(p.where("p_size < 10").select("instrument_id", "p_partkey", "ts_init", "p_size"), "equity")
    c.write(p.where("p_size >= 40").select("instrument_id", "p_partkey", "ts_init", F.col("p_retailprice").alias("strike")), "option")
    return c.instruments(["equity", "option", "future"]).groupBy("class").agg(F.count("*").alias("n"), F.count("strike").alias("strikes"), F.count("p_size").alias("sizes"))


Q["catalog_instruments"] = _instruments
S["catalog_instruments"] = "select case when p_size < 10 then 'equity' else 'option' end as class, count(*) as n, count(case when p_size >= 40 then 1 end) as strikes, count(case when p_size < 10 then 1 end) as sizes from part where p_size < 10 or p_size >= 40 group by 1"
Q["deduplicated_rows"] = lambda spark, d: views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates().groupBy("l_linenumber").agg(F.count("*").alias("n"))
S["deduplicated_rows"] = "select l_linenumber, count(distinct l_orderkey) as n from lineitem group by 1"
Q["display_values"] = lambda spark, d: rounded(catalog.display(views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("price"), "l_partkey", "l_suppkey"), {"price": 2}, -1))
S["display_values"] = "select l_orderkey, l_linenumber, case when l_partkey % 7 <> 0 then round(round(l_extendedprice * 100) / 100, 6) end as price, l_partkey, l_suppkey from lineitem"
_FOUR = "unnest([open, high, low, close]) as price, unnest([60000000, 40000000, 20000000, 0]) as back"


def _bar_table(spark, d):
    return rounded(bars.time_bars(views.trades(spark, d), HOUR))


Q["quotes_from_bars"] = lambda spark, d: rounded(catalog.quotes_from_bars(_bar_table(spark, d), _bar_table(spark, d).withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})))
S["quotes_from_bars"] = sql(f"select instrument_id, price as bid_price, round(price + 1, 6) as ask_price, 250000.0::double as bid_size, 250000.0::double as ask_size, ts_event - back as ts_event, ts_event - back as ts_init from (select instrument_id, ts_event, {_FOUR} from b)", "trades", b=_bars(LEFT))
Q["trades_from_bars"] = lambda spark, d: rounded(catalog.trades_from_bars(_bar_table(spark, d)).drop("k"))
S["trades_from_bars"] = sql(f"select instrument_id, price, size, ts_event - back as ts_event, ts_event - back as ts_init from (select instrument_id, volume / 4 as size, ts_event, {_FOUR} from b)", "trades", b=_bars(LEFT))
Q["wrangled_ticks"] = lambda spark, d: catalog.wrangled(views.trades(spark, d).select((F.col("price") / 3).alias("price"), "ts_event", "seq"), "A.B", {"price": 3}, 5)
S["wrangled_ticks"] = "select 'A.B' as instrument_id, round(value / 3, 3) as price, epoch_us(ts) * 1000 as ts_event, epoch_us(ts) * 1000 + 5 as ts_init, event_id as seq from events"


def _csv(spark, d):
    path = scratch(spark)
    views.trades(spark, d).select("instrument_id", "price", "size", F.col("ts_event").alias("time")).write.csv(path, header=True)
    return catalog.load_ticks_csv(spark, path, "instrument_id string, price double, size double, time string", "time").groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("ts_event").alias("first"), F.sum("size").alias("size"))


Q["csv_ticks"] = _csv
S["csv_ticks"] = sql("select instrument_id, count(*) as n, min(ts_event) as first, sum(size) as size from trades group by 1", "trades")


def _vendor(spark, d):
    path = scratch(spark)
    t = views.deltas(spark, d).where("action <> 'CLEAR'")
    side = F.when(F.col("side") == "BUY", "bid").otherwise("ask")
    t.select(F.lit("xv").alias("exchange"), F.col("instrument_id").alias("symbol"), F.expr("ts_event div 1000").alias("timestamp"), F.expr("ts_event div 1000 + 5").alias("local_timestamp"), (F.col("seq") % 100 == 0).alias("is_snapshot"), side.alias("side"), "price", F.col("size").alias("amount")).write.csv(path, header=True)
    return catalog.load_vendor_deltas(spark, path, {"view": "VIEW"}).groupBy("instrument_id", "action", "side").agg(F.count("*").alias("n"), F.max("ts_init").alias("last"))


Q["vendor_deltas"] = _vendor
S["vendor_deltas"] = sql("select case when instrument_id = 'view' then 'VIEW' else instrument_id end || '.XV' as instrument_id, case when size = 0 then 'DELETE' when seq % 100 = 0 then 'ADD' else 'UPDATE' end as action, side, count(*) as n, max(ts_event + 5000) as last from deltas where action <> 'CLEAR' group by 1, 2, 3", "deltas")


def _rates(spark, d):
    o = views.table(spark, d, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("currency"), F.expr("cast(cast(o_orderdate as timestamp_ntz) as date)").alias("day"), "o_orderkey", "o_totalprice")
    rates = o.groupBy("currency", F.trunc("day", "month").alias("day")).agg(F.max("o_totalprice").alias("rate"))
    return catalog.short_rate(o.select("currency", "day", "o_orderkey"), rates).select("o_orderkey", "rate")


Q["short_rates"] = _rates
S["short_rates"] = """with o as (select (o_orderkey % 3)::varchar as currency, o_orderdate::date as day, o_orderkey, o_totalprice from orders), r as (select currency, date_trunc('month', day)::date as m, max(o_totalprice) as rate from o group by 1, 2)
    select o.o_orderkey, r.rate from (select *, date_trunc('month', day)::date as m from o) o asof left join r on o.currency = r.currency and o.m <= r.m"""
Q["predicate_combination"] = lambda spark, d: filled(spark, d).query("trades", where=(F.col("price") >= 10) & (F.col("size") < 5) | (F.col("aggressor_side") == "SELLER") & (F.col("price") < 1), ordered=False).select("seq")
S["predicate_combination"] = sql("select seq from trades where price >= 10 and size < 5 or aggressor_side = 'SELLER' and price < 1", "trades")


def _typed(spark, d):
    """One catalog with four types, each read back by its own scan."""
    c = Catalog(spark, scratch(spark))
    both = lambda df: df.withColumn("ts_init", F.col("ts_event"))
    c.write(both(views.quotes(spark, d)), "quotes")
    c.write(both(views.trades(spark, d)), "trades")
    c.write(both(_bar_table(spark, d)), "bars")
    c.write(both(views.deltas(spark, d)), "deltas")
    return c


def _typed_scans(spark, d):
    c, k = _typed(spark, d), {"start": MID - 100 * HOUR, "end": MID + 100 * HOUR, "ordered": False}
    value = {"quotes": c.quotes(**k).withColumn("value", F.col("bid_price")), "trades": c.trades(**k).withColumn("value", F.col("price")), "bars": c.bars(**k).withColumn("value", F.col("volume")), "deltas": c.deltas(**k).withColumn("value", F.col("size"))}
    out = [df.groupBy("instrument_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most")).withColumn("kind", F.lit(name)) for name, df in value.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_BETWEEN = f"ts_event between {MID - 100 * HOUR} and {MID + 100 * HOUR}"
Q["catalog_typed_scans"] = _typed_scans
S["catalog_typed_scans"] = sql(" union all ".join(f"select '{kind}' as kind, instrument_id, count(*) as n, round(max({value}), 6) as most from {source} where {_BETWEEN} group by 2"
    for kind, source, value in (("quotes", "quotes", "bid_price"), ("trades", "trades", "price"), ("bars", "b", "volume"), ("deltas", "deltas", "size"))), "quotes", "trades", "deltas", b=_bars(LEFT))


def _listing(spark, d):
    c = _typed(spark, d)
    kinds = [r["kind"] for r in c.kinds().collect()]
    files = [c.files(k).withColumn("kind", F.lit(k)) for k in kinds]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out.groupBy("kind", "identifier").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("n"))


Q["catalog_listing"] = _listing
S["catalog_listing"] = sql(" union all ".join(f"select '{k}' as kind, instrument_id as identifier, min(ts_event) as first, max(ts_event) as last, count(*) as n from {t} group by 2" for k, t in (("quotes", "quotes"), ("trades", "trades"), ("bars", "b"), ("deltas", "deltas"))), "quotes", "trades", "deltas", b=_bars(LEFT))


def _file_pruning(spark, d):
    """Rows in [MID, end) read from only the files that a range of time needs: those of the second write."""
    c = filled(spark, d)
    return c.files_between("trades", MID, 1 << 62).groupBy("identifier").agg(F.sum("rows").alias("n"), F.min("first").alias("first"))


Q["catalog_file_pruning"] = _file_pruning
S["catalog_file_pruning"] = sql(f"select instrument_id as identifier, count(*) as n, min(ts_event) as first from trades where ts_event >= {MID} group by 1", "trades")


def _extended(spark, d):
    """A range without rows counts as covered until the intervals are read anew from the rows."""
    c = filled(spark, d)
    c.extend("trades", "view", 0, 1000)
    before = c.intervals("trades").groupBy("identifier").agg(F.count("*").alias("intervals"), F.min("first").alias("first")).withColumn("state", F.lit("extended"))
    kept = before.collect()
    c.consolidate("trades", partitions=2)
    c.reset_coverage("trades")
    after = c.intervals("trades").groupBy("identifier").agg(F.min("first").alias("first")).select("identifier", F.lit(None).cast("long").alias("intervals"), "first", F.lit("reset").alias("state"))
    return spark.createDataFrame(kept, before.schema).unionByName(after)


Q["catalog_extended_coverage"] = _extended
S["catalog_extended_coverage"] = sql(f"""select 'extended' as state, identifier, count(*) as intervals, min(first) as first from (select instrument_id as identifier, min(ts_event) as first from trades group by instrument_id, ts_event < {MID} union all select 'view', 0) group by 2
    union all select 'reset', instrument_id, null, min(ts_event) from trades group by 2""", "trades")  # fmt: skip


def _parquet(spark, d):
    path = scratch(spark)
    views.trades(spark, d).select("instrument_id", "price", "size", F.timestamp_micros(F.expr("ts_event div 1000")).alias("time")).write.parquet(path)
    return catalog.load_ticks_parquet(spark, path, "time").groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("ts_event").alias("first"), F.max("ts_init").alias("last"), F.sum("size").alias("size"))


Q["parquet_ticks"] = _parquet
S["parquet_ticks"] = sql("select instrument_id, count(*) as n, min(ts_event) as first, max(ts_event) as last, sum(size) as size from trades group by 1", "trades")


def _mirrored(spark, d):
    """Fills written to a database and read back in four ranges of their sequence, without those that the database filters.

    The database is Derby, which comes with Spark, within the one process of a local session.
    """
    url, driver = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    fills = views.fills(spark, d).withColumn("last_px", F.col("last_px").cast("decimal(20,8)")).select("instrument_id", "order_side", "last_qty", "last_px", "ts_event", "seq")
    catalog.write_mirror(fills, url, "fills", partitions=4, keys=["instrument_id", "order_side"], driver=driver)
    back = catalog.read_mirror(spark, url, "fills", ["last_px"], "seq", 4, "\"order_side\" = 'BUY'", driver=driver)
    return back.where("last_qty > 10").withColumn("last_px", F.round(F.col("last_px").cast("double"), 6))


Q["mirror_round_trip"] = _mirrored
S["mirror_round_trip"] = sql("select instrument_id, order_side, last_qty, round(last_px, 6) as last_px, ts_event, seq from fills where order_side = 'BUY' and last_qty > 10", "fills")


def _vendor_files(spark, d):
    """Vendor quotes, trades and tickers written as CSV and loaded; some sides, sizes and rates are missing."""
    head = [F.lit("xv").alias("exchange"), F.col("instrument_id").alias("symbol"), F.expr("ts_event div 1000").alias("timestamp"), F.expr("ts_event div 1000 + 5").alias("local_timestamp")]
    q, t = views.quotes(spark, d), views.trades(spark, d)
    gone = lambda c, m: F.when(F.col("seq") % m != 0, F.col(c))
    folders = [scratch(spark) for _ in range(3)]
    q.select(*head, gone("ask_size", 5).alias("ask_amount"), gone("ask_price", 5).alias("ask_price"), "bid_price", F.col("bid_size").alias("bid_amount")).write.option("header", True).csv(folders[0])
    t.select(*head, F.col("seq").alias("id"), F.when(F.col("seq") % 9 == 0, "unknown").when(F.col("aggressor_side") == "BUYER", "buy").otherwise("sell").alias("side"), "price", F.when(F.col("seq") % 7 == 0, 0.0).otherwise(F.col("size")).alias("amount")).write.option("header", True).csv(folders[1])
    ticker = [F.lit(None).cast("long").alias("funding_timestamp"), gone("size", 3).alias("funding_rate"), *[F.lit(None).cast("double").alias(c) for c in ("predicted_funding_rate", "open_interest", "last_price")], gone("price", 4).alias("index_price"), F.col("price").alias("mark_price")]
    t.select(*head, *ticker).write.option("header", True).csv(folders[2])
    quotes, trades_ = catalog.load_vendor_quotes(spark, folders[0], {"view": "VIEW"}), catalog.load_vendor_trades(spark, folders[1], {"view": "VIEW"})
    loaded = {"quotes": (quotes, "ask_price"), "trades": (trades_.where("aggressor_side <> 'NO_AGGRESSOR'"), "size")}
    loaded |= {k: (df, "rate" if k == "funding_rates" else "value") for k, df in catalog.load_vendor_derivatives(spark, folders[2], {"view": "VIEW"}).items()}
    out = [df.groupBy("instrument_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col(c).cast("double")), 4).alias("total"), F.max("ts_init").alias("last")).withColumn("kind", F.lit(k)) for k, (df, c) in loaded.items()]
    return functools.reduce(DataFrame.unionByName, out)


_NAMED = "case when instrument_id = 'view' then 'VIEW' else instrument_id end || '.XV' as instrument_id"
Q["vendor_files"] = _vendor_files
S["vendor_files"] = sql(" union all ".join(f"select '{kind}' as kind, {_NAMED}, count(*) as n, round(sum({value}), 4) as total, max(ts_event + 5000) as last from {source} where {rows} group by 2" for kind, value, source, rows in (
    ("quotes", "case when seq % 5 = 0 then 0 else ask_price end", "quotes", "true"), ("trades", "size", "trades", "seq % 7 <> 0 and seq % 9 <> 0"), ("funding_rates", "size", "trades", "seq % 3 <> 0"),
    ("mark_prices", "price", "trades", "true"), ("index_prices", "price", "trades", "seq % 4 <> 0"))), "quotes", "trades")


def _more_scans(spark, d):
    """Types of which few rows are kept, each by its own scan."""
    c, t = Catalog(spark, scratch(spark)), trades(spark, d)
    value, times = F.col("price").alias("value"), ("ts_event", "ts_init")
    tables = {
        "mark_prices": t.select("instrument_id", value, *times), "index_prices": t.where("seq % 2 = 0").select("instrument_id", value, *times),
        "funding_rates": t.where("seq % 3 = 0").select("instrument_id", F.col("size").cast("decimal(38,16)").alias("rate"), F.lit(8).alias("interval"), F.col("ts_event").alias("next_funding_ns"), *times),
        "instrument_status": t.where("seq % 5 = 0").select("instrument_id", F.lit("TRADING").alias("action"), (F.col("seq") % 2 == 0).alias("is_trading"), *times),
        "instrument_closes": t.where("seq % 7 = 0").select("instrument_id", F.lit("END_OF_SESSION").alias("close_type"), F.col("price").alias("close_price"), *times),
        "option_greeks": t.where("seq % 11 = 0").select("instrument_id", F.lit(0.5).alias("delta"), *times),
    }
    for kind, df in tables.items():
        c.write(df, kind)
    out = [getattr(c, kind)(identifiers=["view", "click"], start=MID - 100 * HOUR, ordered=False).groupBy("instrument_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind in tables]
    return functools.reduce(DataFrame.unionByName, out)


Q["catalog_more_scans"] = _more_scans
S["catalog_more_scans"] = sql(" union all ".join(f"select '{kind}' as kind, instrument_id, count(*) as n from trades where instrument_id in ('view', 'click') and ts_event >= {MID - 100 * HOUR} and seq % {m} = 0 group by 2"
    for kind, m in (("mark_prices", 1), ("index_prices", 2), ("funding_rates", 3), ("instrument_status", 5), ("instrument_closes", 7), ("option_greeks", 11))), "trades")


def _loaded_rates(spark, d):
    """Monthly rates as an agency's XML, loaded, and looked up by the orders of each month."""
    folder = scratch(spark)
    o = views.table(spark, d, "orders").select(F.expr("cast(cast(o_orderdate as timestamp_ntz) as date)").alias("day"), "o_orderkey", F.lit("USD").alias("currency"))
    months = o.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg((F.max("o_orderkey") % 900).alias("r"))
    line = F.format_string('<generic:Obs><generic:ObsDimension value="%s"/><generic:ObsValue value="%s"/></generic:Obs>', "month", (F.col("r") / 100).cast("string"))
    months.agg(F.concat(F.lit("<data>"), F.array_join(F.collect_list(line), ""), F.lit("</data>"))).write.text(folder)  # a few dozen months
    return catalog.short_rate(o, catalog.load_rates(spark, folder, "USD")).select("o_orderkey", F.round("rate", 6).alias("rate"))


Q["rates_from_xml"] = _loaded_rates
S["rates_from_xml"] = "select o_orderkey, round((max(o_orderkey) over (partition by date_trunc('month', o_orderdate)) % 900) / 100 / 100, 6) as rate from orders"
