"""Queries over orders, fills, positions and accounts, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, ledger
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import recursive, sql

Q: dict = {}
S: dict = {}
BY = ["account_id", "instrument_id"]
AT = 852_076_800_000_000_000
_W = "(partition by account_id, instrument_id order by ts_event, seq rows unbounded preceding)"


def _state(where: str = "") -> str:
    return f"""select order_id, arg_max(event, (ts_event, seq)) as status, coalesce(sum(last_qty), 0) as filled_qty, round(sum(last_qty * last_px) / sum(last_qty), 6) as avg_px, min(ts_event) as ts_init, max(ts_event) as ts_last, count(*) as events
        from order_events {where} group by 1"""


events, fills = views.order_events, views.fills
Q["order_state"] = lambda spark, d: rounded(ledger.order_state(events(spark, d)))
S["order_state"] = sql(_state(), "order_events")
Q["order_state_at"] = lambda spark, d: rounded(ledger.order_state(events(spark, d), AT))
S["order_state_at"] = sql(_state(f"where ts_event <= {AT}"), "order_events")
Q["illegal_transitions"] = lambda spark, d: ledger.illegal_transitions(events(spark, d).where("seq <> 2 or order_id % 10 <> 0"))
S["illegal_transitions"] = sql("select order_id, ts_event, before, event from (select *, lag(event) over (partition by order_id order by ts_event, seq) as before from order_events where seq <> 2 or order_id % 10 <> 0) where before = 'SUBMITTED' and event in ('FILLED', 'EXPIRED')", "order_events")
Q["execution_quality"] = lambda spark, d: rounded(ledger.execution_quality(events(spark, d), F.round("price")))
S["execution_quality"] = sql("select order_id, round(case when order_side = 'BUY' then 1 else -1 end * (avg_px - ref), 6) as slippage, f - s as latency from (select order_id, order_side, sum(last_qty * last_px) / sum(last_qty) as avg_px, max(round(price)) as ref, min(case when event = 'SUBMITTED' then ts_event end) as s, max(case when event = 'FILLED' then ts_event end) as f from order_events group by 1, 2) where avg_px is not null", "order_events")
Q["order_group_rollup"] = lambda spark, d: rounded(events(spark, d).groupBy((F.col("order_id") % 100).alias("spawn_id")).agg(F.sum(F.when(F.col("seq") == 0, F.col("quantity"))).alias("total"), F.sum("last_qty").alias("filled")).withColumn("leaves", F.col("total") - F.coalesce("filled", F.lit(0.0))))
S["order_group_rollup"] = sql("select order_id % 100 as spawn_id, sum(case when seq = 0 then quantity end) as total, sum(last_qty) as filled, sum(case when seq = 0 then quantity end) - coalesce(sum(last_qty), 0) as leaves from order_events group by 1", "order_events")

_CYCLES = f"""select *, sum((before = 0)::int) over (partition by account_id, instrument_id order by ts_event, seq, part rows unbounded preceding)::bigint as cycle from (
    select account_id, instrument_id, ts_event, seq, last_px, p.part as part, p.b - p.a as qty, p.a as before, p.b as after from (select *, unnest(case when b * a < 0 then [{{'part': 0, 'a': b, 'b': 0.0::double}}, {{'part': 1, 'a': 0.0::double, 'b': a}}] else [{{'part': 0, 'a': b, 'b': a}}] end) as p
    from (select *, a - q as b from (select *, sum(q) over {_W} as a from (select *, case when order_side = 'BUY' then last_qty else -last_qty end as q from fills)))))"""
_POS = """select account_id, instrument_id, cycle, case when arg_min(qty, (ts_event, seq, part)) > 0 then 'LONG' else 'SHORT' end as entry, arg_max(after, (ts_event, seq, part)) as signed_qty, max(abs(after)) as peak_qty,
    sum((abs(qty) * last_px)::decimal(28,9)) filter (before * qty >= 0)::double / sum(abs(qty)) filter (before * qty >= 0) as avg_px_open, sum((abs(qty) * last_px)::decimal(28,9)) filter (before * qty < 0)::double / sum(abs(qty)) filter (before * qty < 0) as avg_px_close, -sum((qty * last_px)::decimal(28,9))::double as cash,
    min(ts_event) as ts_opened, max(ts_event) as l, arg_min(seq, (ts_event, seq, part)) as opening_order, arg_max(seq, (ts_event, seq, part)) as last_order, count(*) as fills from c group by 1, 2, 3"""
_POSITIONS = f"""select account_id, instrument_id, cycle, entry, signed_qty, peak_qty, round(avg_px_open, 8) as avg_px_open, round(avg_px_close, 8) as avg_px_close, ts_opened, opening_order, case when signed_qty = 0 then last_order end as closing_order, fills,
    case when signed_qty = 0 then round(cash, 8) end as realized_pnl, case when signed_qty = 0 then round(case when entry = 'LONG' then 1 else -1 end * (avg_px_close - avg_px_open) / avg_px_open, 8) end as realized_return,
    case when signed_qty = 0 then l end as ts_closed, case when signed_qty = 0 then l - ts_opened end as duration_ns from ({_POS})"""


def positions(spark, d):
    return ledger.positions(fills(spark, d), BY, bucket=4 * _QTR)


Q["positions_netting"] = lambda spark, d: rounded(positions(spark, d), 8)
S["positions_netting"] = sql(_POSITIONS, "fills", c=_CYCLES)
Q["positions_hedging"] = lambda spark, d: rounded(ledger.positions(fills(spark, d).withColumn("position_id", F.col("seq") % 500), ["position_id", *BY]).groupBy("entry").agg(F.count("*").alias("n"), F.sum("peak_qty").alias("peak")))
S["positions_hedging"] = sql(f"select entry, count(*) as n, sum(peak_qty) as peak from ({_POS}) group by 1", "fills", h="select * replace (account_id || '-' || seq % 500 as account_id) from fills", c=_CYCLES.replace("from fills", "from h"))
Q["position_events"] = lambda spark, d: ledger.cycles(fills(spark, d), BY).groupBy("account_id", F.when(F.col("before") == 0, "OPENED").when(F.col("after") == 0, "CLOSED").otherwise("CHANGED").alias("event")).agg(F.count("*").alias("n"))
S["position_events"] = sql("select account_id, case when before = 0 then 'OPENED' when after = 0 then 'CLOSED' else 'CHANGED' end as event, count(*) as n from c group by 1, 2", "fills", c=_CYCLES)
Q["cost_basis"] = lambda spark, d: rounded(ledger.cost_basis(fills(spark, d), BY).select(*BY, "seq", "part", "cycle", "after", "avg_px_open", "realized_pnl", "event"), 10)
#: Cost of the open quantity, walked fill by fill within a cycle.
_COSTS = {
    "c": _CYCLES, "m": "select *, row_number() over (partition by account_id, instrument_id, cycle order by ts_event, seq, part) as n from c",
    "f": """select account_id, instrument_id, cycle, n, qty * last_px as cost, 0::double as was from m where n = 1 union all
        select m.account_id, m.instrument_id, m.cycle, m.n, case when m.before * m.qty >= 0 then f.cost + m.qty * m.last_px else m.after / m.before * f.cost end, f.cost
        from f join m on m.account_id = f.account_id and m.instrument_id = f.instrument_id and m.cycle = f.cycle and m.n = f.n + 1""",
    "b": """select *, case when after <> 0 then cost / after end as avg_px_open, case when before * qty < 0 then -qty * (last_px - was / before) else 0 end as realized_pnl,
        case when before = 0 then 'OPENED' when after = 0 then 'CLOSED' else 'CHANGED' end as event from m join f using (account_id, instrument_id, cycle, n)""",
}
S["cost_basis"] = recursive("select account_id, instrument_id, seq, part, cycle, after, round(avg_px_open, 10) as avg_px_open, round(realized_pnl, 10) as realized_pnl, event from b", "fills", **_COSTS)
Q["realized_pnl_total"] = lambda spark, d: rounded(positions(spark, d).where("signed_qty = 0").groupBy("account_id").agg(F.sum("realized_pnl").alias("realized_pnl"), F.count("*").alias("closed")))
S["realized_pnl_total"] = sql(f"select account_id, round(sum(cash), 6) as realized_pnl, count(*) as closed from ({_POS}) where signed_qty = 0 group by 1", "fills", c=_CYCLES)

_MARK = "select instrument_id, arg_max(last_px, (ts_event, seq)) as mark from fills group by 1"


def marks(spark, d):
    return fills(spark, d).groupBy("instrument_id").agg(F.max_by("last_px", F.struct("ts_event", "seq")).alias("mark"))


def unrealized(rows, marks_):
    """Result at the mark of every open position: the open quantity at what it cost on average, from the last row of its fills."""
    open_ = rows.groupBy(*BY).agg(F.max_by(F.struct("after", "avg_px_open"), F.struct("ts_event", "seq", "part")).alias("p")).select(*BY, "p.*").where("after <> 0")
    of = lambda inverse: ledger.pnl(F.col("avg_px_open"), F.col("mark"), F.col("after"), F.lit(1.0), F.lit(inverse))
    return open_.join(marks_, "instrument_id").select(*BY, of(False).alias("unrealized"), of(True).alias("unrealized_inverse"))


Q["unrealized_pnl"] = lambda spark, d: rounded(unrealized(ledger.cost_basis(fills(spark, d), BY), marks(spark, d)))
S["unrealized_pnl"] = recursive(f"""select account_id, instrument_id, round((mark - avg_px_open) * after, 6) as unrealized, round(after * (1 / avg_px_open - 1 / mark), 6) as unrealized_inverse from (
    select account_id, instrument_id, last(after order by ts_event, seq, part) as after, last(avg_px_open order by ts_event, seq, part) as avg_px_open from b group by 1, 2) join ({_MARK}) using (instrument_id) where after <> 0""", "fills", **_COSTS)  # fmt: skip
Q["realized_pnl_kinds"] = lambda spark, d: rounded(positions(spark, d).where("signed_qty = 0").select(*BY, "cycle", ledger.pnl(F.col("avg_px_open"), F.col("avg_px_close"), F.when(F.col("entry") == "LONG", F.col("peak_qty")).otherwise(-F.col("peak_qty")), F.lit(2.0), F.lit(False)).alias("standard"), ledger.pnl(F.col("avg_px_open"), F.col("avg_px_close"), F.when(F.col("entry") == "LONG", F.col("peak_qty")).otherwise(-F.col("peak_qty")), F.lit(2.0), F.lit(True)).alias("inverse")))
S["realized_pnl_kinds"] = sql(f"select account_id, instrument_id, cycle, round((avg_px_close - avg_px_open) * q * 2, 6) as standard, round(q * 2 * (1 / avg_px_open - 1 / avg_px_close), 6) as inverse from (select *, case when entry = 'LONG' then peak_qty else -peak_qty end as q from ({_POS}) where signed_qty = 0)", "fills", c=_CYCLES)
Q["notional_value"] = lambda spark, d: rounded(fills(spark, d).select("seq", ledger.notional(F.col("last_qty"), F.col("last_px"), F.lit(10.0), F.col("seq") % 2 == 0).alias("notional")))
S["notional_value"] = sql("select seq, round(case when seq % 2 = 0 then last_qty * 10 / last_px else last_qty * 10 * last_px end, 6) as notional from fills", "fills")

_FEE = "last_qty * last_px * case when liquidity_side = 'MAKER' then 0.0002::double else 0.0005::double end"
Q["maker_taker_fees"] = lambda spark, d: rounded(fills(spark, d).groupBy(*BY).agg(F.sum(ledger.fee(0.0002, 0.0005)).alias("commission")))
S["maker_taker_fees"] = sql(f"select account_id, instrument_id, round(sum({_FEE}), 6) as commission from fills group by 1, 2", "fills")
Q["commissions_by_currency"] = lambda spark, d: rounded(ledger.commissions(fills(spark, d).withColumn("currency", F.concat(F.lit("C"), (F.col("seq") % 3).cast("string"))), ledger.fee(0.0002, 0.0005), BY))
S["commissions_by_currency"] = sql(f"select account_id, instrument_id, 'C' || (seq % 3) as currency, round(sum({_FEE}), 6) as commission, count(*) as fills from fills group by 1, 2, 3", "fills")
Q["fixed_fees"] = lambda spark, d: rounded(fills(spark, d).withColumn("list", F.floor(F.col("seq") / 3)).withColumn("fee", ledger.fixed_fee(1.5, "list")).groupBy("account_id").agg(F.sum("fee").alias("fees")))
S["fixed_fees"] = sql("select account_id, round(sum(case when n = 1 then 1.5::double else 0 end), 6) as fees from (select *, row_number() over (partition by seq // 3 order by ts_event, seq) as n from fills) group by 1", "fills")
Q["option_fees"] = lambda spark, d: rounded(fills(spark, d).select("seq", F.col("last_qty").alias("quantity"), F.col("last_px").alias("underlying"), (F.col("last_px") * (F.col("seq") % 7) / 1000).alias("premium")).select("seq", ledger.option_fee(0.0003).alias("fee")), 12)
S["option_fees"] = sql("select seq, round(least(last_qty * last_px * 0.0003::double, last_qty * (last_px * (seq % 7) / 1000) * 0.125::double), 12) as fee from fills", "fills")
Q["net_of_base_commission"] = lambda spark, d: rounded(fills(spark, d).withColumn("last_qty", F.col("last_qty") * F.when(F.col("order_side") == "BUY", 1 - 0.001).otherwise(1.0)).groupBy(*BY).agg(F.sum("last_qty").alias("quantity")))
S["net_of_base_commission"] = sql("select account_id, instrument_id, round(sum(last_qty * case when order_side = 'BUY' then 0.999::double else 1 end), 6) as quantity from fills group by 1, 2", "fills")

_MOVES = "(select account_id, ts_event, seq, unnest(['BASE', 'QUOTE']) as currency, unnest([s * last_qty, -s * last_qty * last_px]) as change from (select *, case when order_side = 'BUY' then 1.0::double else -1 end as s from fills))"
Q["running_balances"] = lambda spark, d: rounded(ledger.running_balances(ledger.balance_changes(fills(spark, d), F.lit("BASE"), F.lit("QUOTE")), bucket=_QTR).select("account_id", "seq", "currency", "change", "balance"))
S["running_balances"] = sql(f"select account_id, seq, currency, round(change, 6) as change, round(sum(change) over (partition by account_id, currency order by ts_event, seq rows unbounded preceding), 6) as balance from {_MOVES}", "fills")
Q["locked_balances"] = lambda spark, d: rounded(ledger.locked(events(spark, d).where("event = 'ACCEPTED'")))
S["locked_balances"] = sql("select account_id, case when order_side = 'BUY' then 'QUOTE' else 'BASE' end as currency, round(sum(case when order_side = 'BUY' then quantity * price else quantity end), 6) as locked from order_events where event = 'ACCEPTED' group by 1, 2", "order_events")
Q["margins"] = lambda spark, d: rounded(ledger.margins(fills(spark, d).select(*BY, (F.col("last_qty") * F.col("last_px")).alias("notional")), 0.05, 0.025, 10.0), 9).withColumn("scope", F.col("scope").cast("long"))
S["margins"] = sql("select account_id, instrument_id, round(sum(last_qty * last_px / 10 * 0.05::double), 9) as initial, round(sum(last_qty * last_px / 10 * 0.025::double), 9) as maintenance, grouping_id(account_id, instrument_id) as scope from fills group by rollup (account_id, instrument_id)", "fills")

_NET = f"select f.account_id, f.instrument_id, sum(case when order_side = 'BUY' then last_qty else -last_qty end) as net_qty, max(mark) as mark from fills f join ({_MARK}) m using (instrument_id) group by 1, 2"
_SIDE = "case when net_qty > 0 then 'LONG' when net_qty < 0 then 'SHORT' else 'FLAT' end"


def exposures(spark, d):
    return ledger.exposures(fills(spark, d), BY, marks(spark, d))


Q["net_exposures"] = lambda spark, d: rounded(exposures(spark, d).select(*BY, "net_qty", "side", "exposure"))
S["net_exposures"] = sql(f"select account_id, instrument_id, net_qty, {_SIDE} as side, round(net_qty * mark, 6) as exposure from ({_NET})", "fills")
Q["conversion_sides"] = lambda spark, d: rounded(exposures(spark, d).groupBy("account_id").agg(ledger.conversion_side().alias("at"), F.sum("exposure").alias("exposure")))
S["conversion_sides"] = sql(f"select account_id, case when min(side) = max(side) then case when min(side) = 'LONG' then 'BID' else 'ASK' end else 'MID' end as at, round(sum(net_qty * mark), 6) as exposure from (select *, {_SIDE} as side from ({_NET})) group by 1", "fills")


def _mark_values(spark, d):
    p = exposures(spark, d).select(*BY, "net_qty", "mark")
    quote = F.when(F.col("account_id") % 2 == 0, F.col("mark"))
    last = F.when(F.col("account_id") % 3 == 0, F.col("mark") * 0.99)
    return p.withColumn("px", F.coalesce(quote, last)).select(*BY, (F.col("net_qty") * F.col("px")).alias("value"))


Q["mark_values"] = lambda spark, d: rounded(_mark_values(spark, d))
S["mark_values"] = sql(f"select account_id, instrument_id, round(net_qty * coalesce(case when account_id % 2 = 0 then mark end, case when account_id % 3 = 0 then mark * 0.99::double end), 6) as value from ({_NET})", "fills")
Q["missing_prices"] = lambda spark, d: _mark_values(spark, d).where("value is null").select(*BY)
S["missing_prices"] = sql(f"select account_id, instrument_id from ({_NET}) where account_id % 2 <> 0 and account_id % 3 <> 0", "fills")
Q["equity"] = lambda spark, d: rounded(_mark_values(spark, d).groupBy("account_id").agg(F.sum("value").alias("v")).join(fills(spark, d).groupBy("account_id").agg(F.sum(F.when(F.col("order_side") == "BUY", -1).otherwise(1) * F.col("last_qty") * F.col("last_px")).alias("cash")), "account_id").select("account_id", (F.col("cash") + F.coalesce("v", F.lit(0.0))).alias("equity")), 7)
S["equity"] = sql(f"select a.account_id, round(a.cash + coalesce(b.v, 0), 7) as equity from (select account_id, sum(case when order_side = 'BUY' then -1 else 1 end * last_qty * last_px) as cash from fills group by 1) a join (select account_id, sum(net_qty * coalesce(case when account_id % 2 = 0 then mark end, case when account_id % 3 = 0 then mark * 0.99::double end)) as v from ({_NET}) group by 1) b using (account_id)", "fills")

_QTR = 90 * 86_400_000_000_000


def _snapshots(spark, d):
    """Cash balance of each account as of each quarter's grid time."""
    f = fills(spark, d)
    cash = f.withColumn("change", F.when(F.col("order_side") == "BUY", -1).otherwise(1) * F.col("last_qty") * F.col("last_px"))
    balances = ledger.running_balances(cash, ["account_id"]).select("account_id", "ts_event", "seq", "balance")
    grid = f.select("account_id").distinct().select("account_id", F.explode(F.sequence(F.lit(757382400000000000), F.lit(757382400000000000 + 20 * _QTR), F.lit(_QTR))).alias("ts_event")).withColumn("seq", F.lit(1 << 60))
    return asof.asof_join(grid, balances, ["account_id"]).select("account_id", "ts_event", F.col("r_balance").alias("balance"))


Q["portfolio_snapshots"] = lambda spark, d: rounded(_snapshots(spark, d))
S["portfolio_snapshots"] = sql(f"""select g.account_id, g.ts_event, round(b.balance, 6) as balance from (select account_id, 757382400000000000 + i * {_QTR} as ts_event from (select distinct account_id from fills), range(21) r(i)) g asof left join
    (select account_id, ts_event, max_by(balance, seq) as balance from (select account_id, ts_event, seq, sum(case when order_side = 'BUY' then -1 else 1 end * last_qty * last_px) over (partition by account_id order by ts_event, seq rows unbounded preceding) as balance from fills) group by 1, 2) b
    on g.account_id = b.account_id and g.ts_event >= b.ts_event""", "fills")  # fmt: skip
Q["pnl_by_level"] = lambda spark, d: rounded(positions(spark, d).where("signed_qty = 0").cube("account_id", "instrument_id").agg(F.sum("realized_pnl").alias("pnl")).where("account_id is null or instrument_id is null"))
S["pnl_by_level"] = sql(f"select account_id, instrument_id, round(sum(cash), 6) as pnl from ({_POS}) where signed_qty = 0 group by cube (account_id, instrument_id) having account_id is null or instrument_id is null", "fills", c=_CYCLES)
Q["risk_sizes"] = lambda spark, d: rounded(fills(spark, d).select("seq", ledger.risk_size(F.lit(100000.0), 0.01, F.col("last_px"), F.round(F.col("last_px") * 0.99, 2), 0.01, 0.0002, batch=10, maximum=5000).alias("size")))
S["risk_sizes"] = sql("select seq, case when round(abs(last_px - s) / 0.01::double) > 0 then least(floor(1000 * (1 - 2 * 0.0002::double) / 1 / round(abs(last_px - s) / 0.01::double) / 0.01::double / 1 / 10) * 10, 5000) else 0 end::double as size from (select seq, last_px, round(last_px * 0.99::double, 2) as s from fills)", "fills")
Q["order_faults"] = lambda spark, d: fills(spark, d).select("seq", ledger.order_faults("last_px", "last_qty", 0.01, 5.0, 5, 45, 10000.0).alias("reason")).where("reason is not null")
S["order_faults"] = sql("select * from (select seq, case when last_px <= 0 then 'price not positive' when abs(last_px / 0.01::double - round(last_px / 0.01::double)) > 1e-6 then 'price precision' when abs(last_qty / 5 - round(last_qty / 5)) > 1e-6 then 'quantity precision' when last_qty < 5 then 'quantity below minimum' when last_qty > 45 then 'quantity above maximum' when last_px * last_qty > 10000 then 'notional above maximum' end as reason from fills) where reason is not null", "fills")
Q["rate_breaches"] = lambda spark, d: ledger.rate_breaches(views.trades(spark, d), 2, 600_000_000_000, ["instrument_id"]).select("instrument_id", "seq", "n")
S["rate_breaches"] = sql("select instrument_id, seq, n from (select *, count(*) over (partition by instrument_id order by ts_event range between 600000000000 preceding and current row) as n from trades) where n > 2", "trades")
_TIERS = [(0.0, 0.01), (10.0, 0.05), (30.0, 0.25)]
Q["tick_rounding"] = lambda spark, d: rounded(views.trades(spark, d).select("seq", ledger.tick_round(F.col("price"), 0.25, False, 1).alias("next_bid"), ledger.tick_round(F.col("price"), ledger.tier_tick(F.col("price"), _TIERS), True, 2).alias("next_ask")))
S["tick_rounding"] = sql("select seq, round((floor(round(price / 0.25::double, 9)) - 1) * 0.25::double, 6) as next_bid, round((ceil(round(price / t, 9)) + 2) * t, 6) as next_ask from (select *, case when price >= 30 then 0.25::double when price >= 10 then 0.05::double else 0.01::double end as t from trades)", "trades")


def _reconcile(spark, d):
    net = exposures(spark, d).select(*BY, "net_qty")
    theirs = net.where("account_id % 7 <> 0").withColumn("net_qty", F.when(F.col("account_id") % 5 == 0, F.col("net_qty") + 1).otherwise(F.col("net_qty")))
    return ledger.reconcile(net, theirs, BY)


Q["position_reconciliation"] = lambda spark, d: rounded(_reconcile(spark, d))
S["position_reconciliation"] = sql(f"select account_id, instrument_id, net_qty as ours, case when account_id % 7 <> 0 then net_qty + (account_id % 5 = 0)::int end as theirs, net_qty - coalesce(case when account_id % 7 <> 0 then net_qty + (account_id % 5 = 0)::int end, 0) as difference from ({_NET}) where account_id % 7 = 0 and net_qty <> 0 or account_id % 7 <> 0 and account_id % 5 = 0", "fills")

# reports


def _orders_report(spark, d):
    e = events(spark, d)
    first = e.where("seq = 0").select("order_id", "instrument_id", "order_side", "quantity")
    return ledger.order_state(e).join(first, "order_id").select("order_id", "instrument_id", "order_side", "quantity", "status", "filled_qty", "avg_px")


_OR = f"select s.order_id, o.instrument_id, o.order_side, o.quantity, s.status, s.filled_qty, s.avg_px from ({_state()}) s join (select * from order_events where seq = 0) o using (order_id)"
Q["orders_report"] = lambda spark, d: rounded(_orders_report(spark, d))
S["orders_report"] = sql(_OR, "order_events")
Q["order_fills_report"] = lambda spark, d: rounded(_orders_report(spark, d).where("filled_qty > 0"))
S["order_fills_report"] = sql(f"select * from ({_OR}) where filled_qty > 0", "order_events")
Q["fills_report"] = lambda spark, d: rounded(events(spark, d).where("event = 'FILLED'").select("order_id", "instrument_id", "order_side", "last_qty", "last_px", "ts_event"))
S["fills_report"] = sql("select order_id, instrument_id, order_side, last_qty, round(last_px, 6) as last_px, ts_event from order_events where event = 'FILLED'", "order_events")


def _positions_report(spark, d):
    p = positions(spark, d)
    newest = F.max("cycle").over(Window.partitionBy(*BY))
    return p.withColumn("is_snapshot", F.col("cycle") < newest).select(*BY, "cycle", "entry", "signed_qty", "ts_opened", "is_snapshot")


Q["positions_report"] = _positions_report
S["positions_report"] = sql(f"select account_id, instrument_id, cycle, entry, signed_qty, ts_opened, cycle < max(cycle) over (partition by account_id, instrument_id) as is_snapshot from ({_POS})", "fills", c=_CYCLES)


def _account_states(spark, d):
    """Balances of each account after each fill, as decimals, exact to eight places."""
    b = ledger.running_balances(ledger.balance_changes(fills(spark, d), F.lit("BASE"), F.lit("QUOTE")), bucket=_QTR, digits=8)
    return b.groupBy("account_id", "ts_event", "seq").agg(F.sort_array(F.collect_list(F.struct("currency", F.col("balance").alias("total")))).alias("balances"))


Q["account_report"] = lambda spark, d: rounded(_account_states(spark, d).select("account_id", "seq", F.explode("balances").alias("b")).select("account_id", "seq", "b.currency", F.col("b.total").cast("double").alias("total")))
S["account_report"] = sql(f"select account_id, seq, currency, round(sum(change) over (partition by account_id, currency order by ts_event, seq rows unbounded preceding), 6) as total from {_MOVES}", "fills")
Q["account_state_json"] = lambda spark, d: _account_states(spark, d).select("account_id", "seq", F.to_json(F.transform("balances", lambda b: F.struct(b["currency"].alias("currency"), F.round(b["total"]).cast("long").alias("total")))).alias("balances"))
S["account_state_json"] = sql(f"""select account_id, seq, '[' || string_agg('{{"currency":"' || currency || '","total":' || round(total)::bigint || '}}', ',' order by currency) || ']' as balances from (select account_id, seq, currency, sum(change) over (partition by account_id, currency order by ts_event, seq rows unbounded preceding) as total from {_MOVES}) group by 1, 2""", "fills")


def _netted(spark, d):
    sub = ledger.positions(fills(spark, d).withColumn("position_id", F.col("seq")), ["position_id", *BY]).drop("cycle")
    return ledger.netted(sub, BY).select(*BY, "net_qty")


Q["hedged_positions_netted"] = lambda spark, d: rounded(_netted(spark, d))
S["hedged_positions_netted"] = sql("select account_id, instrument_id, sum(case when order_side = 'BUY' then last_qty else -last_qty end) as net_qty from fills group by 1, 2", "fills")
