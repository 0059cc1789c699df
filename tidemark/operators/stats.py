"""Performance statistics as aggregate expressions; every one works for any grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def daily_returns(df: DataFrame, day: Column, by: Iterable[str] = (), ret: str = "ret") -> DataFrame:
    """Returns compounded within each day."""
    return df.withColumn("day", day).groupBy(*by, "day").agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


def _safe(top: Column, below: Column) -> Column:
    return F.when(F.abs(below) > 1e-15, top / below)


def _mean(c) -> Column:
    return F.avg(c)


#: Statistics of a column `ret` of daily returns: name -> expression.
def return_statistics(ret: str = "ret", period: int = YEAR) -> dict[str, Column]:
    r = F.col(ret)
    root = F.sqrt(F.lit(float(period)))
    std = F.stddev_samp(r)
    downside = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(r))
    return {
        "cagr": F.pow(F.product(1 + r), F.lit(float(period)) / F.count(r)) - 1,
        "sharpe": _safe(F.avg(r), std) * root,
        "sortino": _safe(F.avg(r), downside) * root,
        "volatility": std * root,
        "risk_return": _safe(F.avg(r), std),
        "avg_return": F.avg(r),
        "avg_win": F.avg(F.when(r > 0, r)),
        "avg_loss": F.avg(F.when(r < 0, r)),
        "profit_factor": F.abs(_safe(F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, r).otherwise(0.0)))),
    }


def pnl_statistics(pnl: str = "pnl") -> dict[str, Column]:
    """Statistics of realised results: expectancy leaves out zero results."""
    p = F.col(pnl)
    wins, losses = F.sum((p > 0).cast("int")), F.sum((p < 0).cast("int"))
    both = wins + losses
    win, loss = F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0))
    return {
        "win_rate": wins / F.count(p),
        "expectancy": _safe(win * wins + loss * losses, both.cast("double")),
        "avg_winner": F.avg(F.when(p > 0, p)), "max_winner": F.max(F.when(p > 0, p)), "min_winner": F.min(F.when(p > 0, p)),
        "avg_loser": F.avg(F.when(p < 0, p)), "max_loser": F.min(F.when(p < 0, p)), "min_loser": F.max(F.when(p < 0, p)),
        "total_pnl": F.sum(p),
    }


def statistics(df: DataFrame, by: Iterable[str], exprs: dict[str, Column]) -> DataFrame:
    """One aggregate with all the statistics, as rows (statistic, value) of each group."""
    by = list(by)
    wide = df.groupBy(*by).agg(*[c.cast("double").alias(n) for n, c in exprs.items()])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in exprs])).alias("s")).select(*by, "s.statistic", "s.value")


REGISTRY: dict[str, Callable[[], Column]] = {}


def register(name: str, make: Callable[[], Column]) -> None:
    """Adds a user's statistic: a function that makes an aggregate expression."""
    REGISTRY[name] = make


def drawdowns(df: DataFrame, by: Iterable[str] = (), order: str = "day", ret: str = "ret") -> DataFrame:
    """Equity curve and drawdown of each day; the curve and its peak start at 1."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return df.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def max_drawdown(df: DataFrame, by: Iterable[str], order: str = "day", ret: str = "ret", period: int = YEAR) -> DataFrame:
    """Largest drawdown and the Calmar ratio (null without a drawdown)."""
    r = F.pow(F.max_by("equity", order), F.lit(float(period)) / F.count(ret)) - 1
    out = drawdowns(df, by, order, ret).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), r.alias("_cagr"))
    return out.withColumn("calmar", _safe(F.col("_cagr"), F.abs("max_drawdown"))).drop("_cagr")


def benchmark_statistics(df: DataFrame, benchmark: DataFrame, by: Iterable[str], period: int = YEAR, rf: float = 0.0) -> DataFrame:
    """Beta, alpha, information ratio, tracking error and Treynor ratio on the days that both have."""
    both = df.join(benchmark.select("day", F.col("ret").alias("_b")), "day").withColumn("_a", F.col("ret") - F.col("_b"))
    agg = both.groupBy(*by).agg(
        _safe(F.covar_samp("ret", "_b"), F.var_samp("_b")).alias("beta"), F.avg("ret").alias("_m"), F.avg("_b").alias("_mb"),
        _safe(F.avg("_a"), F.stddev_samp("_a")).alias("_ir"), F.stddev_samp("_a").alias("_te"),
    )
    root = F.sqrt(F.lit(float(period)))
    return agg.select(
        *by, "beta", (F.pow(1 + F.col("_m") - rf - F.col("beta") * (F.col("_mb") - rf), F.lit(float(period))) - 1).alias("alpha"),
        (F.col("_ir") * root).alias("information_ratio"), (F.col("_te") * root).alias("tracking_error"),
        _safe((F.col("_m") - rf) * period, F.col("beta")).alias("treynor"),
    )


def monthly_grid(df: DataFrame, by: Iterable[str] = (), ret: str = "ret") -> DataFrame:
    """A row for each year with the compound return of each month, m1 to m12, and of the year."""
    r = 1 + F.col(ret)
    month = [(F.product(F.when(F.month("day") == m, r)) - 1).alias(f"m{m}") for m in range(1, 13)]
    return df.groupBy(*by, F.year("day").alias("year")).agg(*month, (F.product(r) - 1).alias("total"))


def histogram(df: DataFrame, lo: float, hi: float, bins: int, by: Iterable[str] = (), ret: str = "ret") -> DataFrame:
    return df.groupBy(*by, F.width_bucket(ret, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def rolling_sharpe(df: DataFrame, k: int = 60, by: Iterable[str] = (), ret: str = "ret", period: int = YEAR) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(1 - k, 0)
    value = _safe(F.avg(ret).over(w), F.stddev_samp(ret).over(w)) * F.sqrt(F.lit(float(period)))
    return df.withColumn("rolling_sharpe", F.when(F.row_number().over(Window.partitionBy(*by).orderBy("day")) >= k, value))


def balance_returns(balances: DataFrame, by: Iterable[str] = (), balance: str = "balance", time: str = "ts_event", day: str = "day") -> DataFrame:
    """Daily change of each day's last balance."""
    ends = balances.groupBy(*by, day).agg(F.max_by(balance, F.struct(time, "seq")).alias("balance"))
    w = Window.partitionBy(*by).orderBy(day)
    return ends.withColumn("ret", _safe(F.col("balance"), F.lag("balance").over(w)) - 1).where("ret is not null")


def bars_with_fills(bars: DataFrame, fills: DataFrame, by: Iterable[str] = ("instrument_id",), interval: int = 3_600_000_000_000) -> DataFrame:
    """Bars (stamped on their close) with the fills of each interval: count, bought and sold quantity."""
    end = F.call_function("div", F.col("ts_event") - 1, F.lit(interval)) * interval + interval
    buy = F.col("order_side") == "BUY"
    own = fills.groupBy(*by, end.alias("ts_event")).agg(F.count("*").alias("fills"), F.sum(F.when(buy, F.col("last_qty")).otherwise(0.0)).alias("bought"), F.sum(F.when(~buy, F.col("last_qty")).otherwise(0.0)).alias("sold"))
    return bars.join(own, [*by, "ts_event"], "left").fillna(0, ["fills"]).fillna(0.0, ["bought", "sold"])
