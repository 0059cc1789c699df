"""Queries over returns and results: statistics and the tables behind a tearsheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.operators.windows import rounded
from tidemark.sources import views
from tidemark.sources.views import sql

Q: dict = {}
S: dict = {}
BY = ["series"]


def _one(name: str, expr: str) -> None:
    """A query of one return statistic by series."""
    Q[name] = lambda spark, d: rounded(views.returns(spark, d).groupBy(*BY).agg(stats.return_statistics()[name].alias(name)))
    S[name] = sql(f"select series, round({expr}, 6) as {name} from returns group by 1", "returns")


_SD = "nullif(stddev_samp(ret), 0)"
_one("cagr", "pow(product(1 + ret), 252.0::double / count(*)) - 1")
_one("sharpe", f"avg(ret) / {_SD} * sqrt(252)")
_one("sortino", "avg(ret) / sqrt(sum(case when ret < 0 then ret * ret else 0 end) / count(*)) * sqrt(252)")
_one("volatility", f"{_SD} * sqrt(252)")
_one("risk_return", f"avg(ret) / {_SD}")
_one("avg_return", "avg(ret)")
_one("avg_win", "avg(case when ret > 0 then ret end)")
_one("avg_loss", "avg(case when ret < 0 then ret end)")
_one("profit_factor", "abs(sum(case when ret > 0 then ret else 0 end) / sum(case when ret < 0 then ret else 0 end))")

_PNL = "(select c_mktsegment as currency, c_acctbal - 4500 as pnl, c_custkey as position_id from customer)"


def pnls(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("currency"), (F.col("c_acctbal") - 4500).alias("pnl"), F.col("c_custkey").alias("position_id"))


def _pnl(name: str, expr: str) -> None:
    Q[f"pnl_{name}"] = lambda spark, d: rounded(pnls(spark, d).groupBy("currency").agg(stats.pnl_statistics()[name].alias(name)))
    S[f"pnl_{name}"] = f"select currency, round({expr}, 6) as {name} from {_PNL} group by 1"


_pnl("win_rate", "sum(case when pnl > 0 then 1 else 0 end) / count(*)::double")
_pnl("expectancy", "coalesce(avg(case when pnl > 0 then pnl end), 0) * count(case when pnl > 0 then 1 end) / count(case when pnl <> 0 then 1 end) + coalesce(avg(case when pnl < 0 then pnl end), 0) * count(case when pnl < 0 then 1 end) / count(case when pnl <> 0 then 1 end)")
for _n, _e in {"avg_winner": "avg(case when pnl > 0 then pnl end)", "max_winner": "max(case when pnl > 0 then pnl end)", "min_winner": "min(case when pnl > 0 then pnl end)", "avg_loser": "avg(case when pnl < 0 then pnl end)", "max_loser": "min(case when pnl < 0 then pnl end)", "min_loser": "max(case when pnl < 0 then pnl end)"}.items():
    _pnl(_n, _e)

Q["daily_returns"] = lambda spark, d: rounded(stats.daily_returns(views.table(spark, d, "events").select("event_type", "ts", ((F.col("value") - 20) / 10000).alias("ret")), F.expr("cast(cast(ts as timestamp_ntz) as date)"), ["event_type"]))
S["daily_returns"] = "select event_type, ts::date as day, round(product(1 + (value - 20) / 10000) - 1, 6) as ret from events group by 1, 2"
Q["returns_std"] = lambda spark, d: rounded(views.returns(spark, d).groupBy("series").agg(F.stddev_samp("ret").alias("std")))
S["returns_std"] = sql("select series, round(stddev_samp(ret), 6) as std from returns group by 1", "returns")

_CURVE = "(select *, exp(sum(ln(1 + ret)) over (partition by series order by day rows unbounded preceding)) as equity from returns)"
_DD = f"(select *, (equity - peak) / peak as dd from (select *, greatest(1, max(equity) over (partition by series order by day rows unbounded preceding)) as peak from {_CURVE}))"
Q["max_drawdown_calmar"] = lambda spark, d: rounded(stats.max_drawdown(views.returns(spark, d), BY))
S["max_drawdown_calmar"] = sql(f"select series, round(min(dd), 6) as max_drawdown, round((pow(arg_max(equity, day), 252.0::double / count(*)) - 1) / abs(min(dd)), 6) as calmar from {_DD} group by 1", "returns")
Q["equity_and_drawdown"] = lambda spark, d: rounded(stats.drawdowns(views.returns(spark, d), BY).select("series", "day", "equity", "drawdown"))
S["equity_and_drawdown"] = sql(f"select series, day, round(equity, 6) as equity, round(dd, 6) as drawdown from {_DD}", "returns")

_BOTH = "(select r.series, r.ret, b.ret as b from returns r join benchmark_returns b using (day))"
Q["benchmark_statistics"] = lambda spark, d: rounded(stats.benchmark_statistics(views.returns(spark, d), views.returns(spark, d, grouped=False), BY, rf=0.0001))
S["benchmark_statistics"] = sql(f"""select series, round(beta, 6) as beta, round(pow(1 + m - 0.0001::double - beta * (mb - 0.0001::double), 252) - 1, 6) as alpha, round(ir * sqrt(252), 6) as information_ratio, round(te * sqrt(252), 6) as tracking_error,
    round((m - 0.0001::double) * 252 / beta, 6) as treynor from (select series, covar_samp(ret, b) / var_samp(b) as beta, avg(ret) as m, avg(b) as mb, avg(ret - b) / stddev_samp(ret - b) as ir, stddev_samp(ret - b) as te from {_BOTH} group by 1)""", "returns", "benchmark_returns")  # fmt: skip


def _registry(spark, d):
    e = stats.return_statistics()
    return rounded(stats.statistics(views.returns(spark, d), BY, {n: e[n] for n in ("avg_return", "avg_win", "avg_loss", "profit_factor")}))


Q["statistics_registry"] = _registry
S["statistics_registry"] = sql("""select series, unnest(['avg_return', 'avg_win', 'avg_loss', 'profit_factor']) as statistic, unnest([round(avg(ret), 6), round(avg(case when ret > 0 then ret end), 6), round(avg(case when ret < 0 then ret end), 6),
    round(abs(sum(case when ret > 0 then ret else 0 end) / sum(case when ret < 0 then ret else 0 end)), 6)]) as value from returns group by series""", "returns")  # fmt: skip

_BAL = "(select account_id, ts_event, seq, make_timestamp(ts_event // 1000)::date as day, 1000000 + sum(case when order_side = 'BUY' then -1 else 1 end * last_qty * last_px) over (partition by account_id order by ts_event, seq rows unbounded preceding) as balance from fills)"


def balances(spark, d):
    from tidemark.operators.windows import running

    f = views.fills(spark, d)
    cash = F.when(F.col("order_side") == "BUY", -1).otherwise(1) * F.col("last_qty") * F.col("last_px")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(ts_event div 86400000000000 as int)"))
    return f.select("account_id", "ts_event", "seq", day.alias("day"), (1_000_000 + F.sum(cash).over(running(["account_id"]))).alias("balance"))


Q["total_pnl"] = lambda spark, d: rounded(balances(spark, d).groupBy("account_id").agg((F.max_by("balance", F.struct("ts_event", "seq")) - 1_000_000).alias("pnl"), (100 * (F.max_by("balance", F.struct("ts_event", "seq")) - 1_000_000) / 1_000_000).alias("pnl_percent")))
S["total_pnl"] = sql(f"select account_id, round(arg_max(balance, (ts_event, seq)) - 1000000, 6) as pnl, round(100 * (arg_max(balance, (ts_event, seq)) - 1000000) / 1000000, 6) as pnl_percent from {_BAL} group by 1", "fills")
Q["portfolio_returns"] = lambda spark, d: rounded(stats.balance_returns(balances(spark, d), ["account_id"]))
S["portfolio_returns"] = sql(f"select account_id, day, round(balance, 6) as balance, round(ret, 6) as ret from (select *, balance / lag(balance) over (partition by account_id order by day) - 1 as ret from (select account_id, day, arg_max(balance, (ts_event, seq)) as balance from {_BAL} group by 1, 2)) where ret is not null", "fills")

Q["monthly_grid"] = lambda spark, d: rounded(stats.monthly_grid(views.returns(spark, d), BY))
S["monthly_grid"] = sql("select series, year(day)::int as year, " + ", ".join(f"round(product(1 + ret) filter (month(day) = {m}) - 1, 6) as m{m}" for m in range(1, 13)) + ", round(product(1 + ret) - 1, 6) as total from returns group by 1, 2", "returns")
Q["returns_distribution"] = lambda spark, d: stats.histogram(views.returns(spark, d), -0.02, 0.02, 20, BY)
S["returns_distribution"] = sql("select series, (case when ret < -0.02 then 0 when ret >= 0.02 then 21 else floor((ret + 0.02::double) / 0.04::double * 20) + 1 end)::bigint as bin, count(*) as n from returns group by 1, 2", "returns")
Q["rolling_sharpe"] = lambda spark, d: rounded(stats.rolling_sharpe(views.returns(spark, d), 60, BY).select("series", "day", "rolling_sharpe"))
S["rolling_sharpe"] = sql("select series, day, case when row_number() over (partition by series order by day) >= 60 then round(avg(ret) over w / stddev_samp(ret) over w * sqrt(252), 6) end as rolling_sharpe from returns window w as (partition by series order by day rows 59 preceding)", "returns")
Q["yearly_returns"] = lambda spark, d: rounded(views.returns(spark, d).groupBy("series", F.year("day").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")))
S["yearly_returns"] = sql("select series, year(day)::int as year, round(product(1 + ret) - 1, 6) as ret from returns group by 1, 2", "returns")
Q["statistics_rollup"] = lambda spark, d: rounded(pnls(spark, d).withColumn("parity", (F.col("position_id") % 2).cast("string")).rollup("currency", "parity").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n")).select(F.coalesce("currency", F.lit("total")).alias("currency"), F.coalesce("parity", F.lit("total")).alias("parity"), "pnl", "n"))
S["statistics_rollup"] = f"select coalesce(currency, 'total') as currency, coalesce(parity, 'total') as parity, round(sum(pnl), 6) as pnl, count(*) as n from (select *, (position_id % 2)::varchar as parity from {_PNL}) group by rollup (currency, parity)"
Q["long_ratio"] = lambda spark, d: rounded(views.fills(spark, d).groupBy("account_id").agg(F.round(F.avg((F.col("order_side") == "BUY").cast("double")), 2).alias("long_ratio")))
S["long_ratio"] = sql("select account_id, round(avg(case when order_side = 'BUY' then 1.0::double else 0 end), 2) as long_ratio from fills group by 1", "fills")
