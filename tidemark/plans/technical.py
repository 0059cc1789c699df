"""Queries over hourly bars: indicators. The SQL of recursive ones walks each instrument row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars, indicators
from tidemark.operators.indicators import Indicators
from tidemark.operators.windows import rounded
from tidemark.plans.market import HOUR, LEFT, _bars
from tidemark.sources import views
from tidemark.sources.views import recursive, sql

Q: dict = {}
S: dict = {}

HLC = "(high + low + close) / 3"
#: Recursive averages are carried from week to week.
WEEK = 7 * 24 * HOUR


def over(k: int | None = None, end: int = 0) -> str:
    frame = "" if k is None else f" rows between {k - 1} preceding and {'current row' if not end else f'{end} preceding'}"
    return f"over (partition by instrument_id order by ts_event{frame})"


RUN = "over (partition by instrument_id order by ts_event rows between unbounded preceding and current row)"


#: What each query makes.
MADE: dict = {}


def query(name: str, columns: list[str], make, exprs: list[str] | None = None, source: str = "b", **more: str):
    """make(Indicators) -> Indicators; exprs: SQL of the columns over `source`."""

    def run(spark, d):
        b = rounded(bars.time_bars(views.trades(spark, d), HOUR))
        b = b.withColumn("week", F.call_function("div", F.col("ts_event"), F.lit(WEEK)))
        return rounded(make(Indicators(b, chunk="week")).df.select("instrument_id", "ts_event", *columns))

    Q[name], MADE[name] = run, (columns, make)
    if exprs is not None:
        picked = ", ".join(f"{e} as {c}" for e, c in zip(exprs, columns, strict=True))
        S[name] = sql(f"select instrument_id, ts_event, {picked} from {source}", "trades", b=_bars(LEFT), **more)


def r(e: str) -> str:
    return f"round({e}, 6)"


query("sma", ["sma", "sma_initialized"], lambda i: i.sma("close", 10), [r(f"avg(close) {over(10)}"), f"row_number() {over()} >= 10"])
query("wma", ["wma"], lambda i: i.wma("close", 4), [r("(" + " + ".join(f"coalesce({4 - i} * lag(close, {i}) {over()}, 0)" for i in range(4)) + ") / (4 + " + " + ".join(f"case when lag(close, {i}) {over()} is null then 0 else {4 - i} end" for i in range(1, 4)) + ")")])


def _wma(x: str, k: int) -> str:
    top = " + ".join(f"coalesce({k - i} * lag({x}, {i}) {over()}, 0)" for i in range(k))
    below = " + ".join(f"case when lag({x}, {i}) {over()} is null then 0 else {k - i} end" for i in range(k))
    return f"({top}) / ({below})"


query("hma", ["hma"], lambda i: i.hma("close", 9), [r(_wma("d", 3))], "h2", h1=f"select instrument_id, ts_event, {_wma('close', 4)} as h, {_wma('close', 9)} as k from b", h2="select instrument_id, ts_event, 2 * h - k as d from h1")
query("vwap", ["vwap"], lambda i: i.vwap(F.expr("(ts_event - 1) div 86400000000000"), "close", "volume"), [r("sum(close * volume) over w / sum(volume) over w")], "(select *, (ts_event - 1) // 86400000000000 as day from b) window w as (partition by instrument_id, day order by ts_event rows unbounded preceding)")
query("linreg", ["lr_slope", "lr_value", "lr_intercept", "lr_r2", "lr_cfo"], lambda i: i.linreg("close", 8), [r(f"case when n >= 8 then regr_slope(close, n) {over(8)} end"), r(f"case when n >= 8 then regr_intercept(close, n) {over(8)} + n * regr_slope(close, n) {over(8)} end"), r(f"case when n >= 8 then regr_intercept(close, n) {over(8)} + (n - 8) * regr_slope(close, n) {over(8)} end"),
    r(f"case when n >= 8 then regr_r2(close, n) {over(8)} end"), r(f"case when n >= 8 then 100 * (close - regr_intercept(close, n) {over(8)} - n * regr_slope(close, n) {over(8)}) / close end")], "x", x=f"select *, row_number() {over()} as n from b")
query("efficiency_ratio", ["er"], lambda i: i.efficiency_ratio("close", 10), [r(f"coalesce(abs(close - first_value(close) {over(10)}) / nullif(sum(c) {over(9)}, 0), 0)")], "x", x=f"select *, abs(close - lag(close) {over()}) as c from b")
query("macd_simple", ["macd"], lambda i: i.macd("close", 5, 12), [r(f"avg(close) {over(5)} - avg(close) {over(12)}")])
_GAIN = f"select *, greatest(coalesce(close - lag(close) {over()}, 0), 0) as up, greatest(coalesce(lag(close) {over()} - close, 0), 0) as down from b"
query("rsi_simple", ["rsi"], lambda i: i.rsi("close", 10, kind="simple"), [r(f"case when avg(up) {over(10)} + avg(down) {over(10)} > 0 then avg(up) {over(10)} / (avg(up) {over(10)} + avg(down) {over(10)}) else 0.5 end")], "x", x=_GAIN)
query("cmo_simple", ["cmo"], lambda i: i.cmo("close", 10, kind="simple"), [r(f"case when avg(up) {over(10)} + avg(down) {over(10)} > 0 then 100 * (avg(up) {over(10)} - avg(down) {over(10)}) / (avg(up) {over(10)} + avg(down) {over(10)}) else 0 end")], "x", x=_GAIN)
query("roc", ["roc"], lambda i: i.roc("close", 6), [r(f"(close - first_value(close) {over(6)}) / first_value(close) {over(6)}")])
query("roc_log", ["roc"], lambda i: i.roc("close", 6, log=True), [r(f"ln(close / first_value(close) {over(6)})")])
query("stochastics", ["stoch_k", "stoch_d"], lambda i: i.stochastics(10, 3), [r("100 * n / nullif(g, 0)"), r(f"100 * sum(n) {over(3)} / nullif(sum(g) {over(3)}, 0)")], "x", x=f"select *, close - min(low) {over(10)} as n, max(high) {over(10)} - min(low) {over(10)} as g from b")
query("stochastics_slowed", ["stoch_k", "stoch_d"], lambda i: i.stochastics(10, 3, 4, "simple", "moving_average"), [r("k"), r(f"avg(k) {over(3)}")], "y",
    x=f"select *, 100 * (close - min(low) {over(10)}) / nullif(max(high) {over(10)} - min(low) {over(10)}, 0) as raw from b", y=f"select *, avg(raw) {over(4)} as k from x")
query("cci", ["cci"], lambda i: i.cci(10), [r("(tp - m) / (0.015::double * nullif(list_sum(list_transform(l, lambda v: abs(v - m))) / len(l), 0))")], "x2", x=f"select *, {HLC} as tp from b", x2=f"select *, avg(tp) {over(10)} as m, list(tp) {over(10)} as l from x")
query("bollinger", ["bb_upper", "bb_middle", "bb_lower"], lambda i: i.bollinger(12), [r(f"avg(tp) {over(12)} + 2 * stddev_pop(tp) {over(12)}"), r(f"avg(tp) {over(12)}"), r(f"avg(tp) {over(12)} - 2 * stddev_pop(tp) {over(12)}")], "x", x=f"select *, {HLC} as tp from b")
query("bias", ["bias"], lambda i: i.bias("close", 7), [r(f"close / avg(close) {over(7)} - 1")])
query("psychological_line", ["psl"], lambda i: i.psychological_line("close", 12), [r(f"100 * avg(u) {over(12)}")], "x", x=f"select *, case when close > lag(close) {over()} then 1 else 0 end as u from b")
_DM = f"select *, coalesce(high - lag(high) {over()}, 0) as u, coalesce(lag(low) {over()} - low, 0) as d from b"
query("directional_movement_simple", ["dm_plus", "dm_minus"], lambda i: i.directional_movement(10, "simple"), [r(f"avg(case when u > d and u > 0 then u else 0 end) {over(10)}"), r(f"avg(case when d > u and d > 0 then d else 0 end) {over(10)}")], "x", x=_DM)
query("aroon", ["aroon_up", "aroon_down", "aroon"], lambda i: i.aroon(10), [r(f"100 * (10 - (n - arg_max(n, (high, -n)) {over(11)})) / 10"), r(f"100 * (10 - (n - arg_min(n, (low, n)) {over(10)})) / 10"), r(f"10 * (arg_max(n, (high, -n)) {over(11)} - arg_min(n, (low, n)) {over(10)})::double")], "x", x=f"select *, row_number() {over()} as n from b")
_MID = lambda k: f"(max(high) {over(k)} + min(low) {over(k)}) / 2"
query("ichimoku", ["tenkan", "kijun", "senkou_a", "senkou_b"], lambda i: i.ichimoku(), [r("t"), r("k"), r(f"lag((t + k) / 2, 26) {over()}"), r(f"lag(s, 26) {over()}")], "x", x=f"select *, {_MID(9)} as t, {_MID(26)} as k, {_MID(52)} as s from b")
_STEP = f"select *, coalesce(sign({HLC} - coalesce(lag({HLC}) {over()}, 0)), 0) * volume as v, row_number() {over()} as n from b"
query("klinger_simple", ["kvo_raw", "kvo"], lambda i: i.klinger(5, 12, 4), [r("raw"), r(f"coalesce(avg(case when n >= 12 then raw end) {over(4)}, 0)")], "x2", x=_STEP, x2=f"select *, avg(v) {over(5)} - avg(v) {over(12)} as raw from x")
_OBV = "case when close > open then volume when close < open then -volume else 0 end"
query("obv", ["obv", "obv_all"], lambda i: i.obv(20).obv(0, "obv_all"), [r(f"sum({_OBV}) {over(20)}"), r(f"sum({_OBV}) {RUN}")])
_TR = f"select *, greatest(high, coalesce(lag(close) {over()}, close)) - least(low, coalesce(lag(close) {over()}, close)) as tr from b"
query("atr", ["atr"], lambda i: i.atr(14), [r(f"avg(tr) {over(14)}")], "x", x=_TR)
_PRESSURE = "coalesce(((close - low) - (high - close)) / nullif(case when a > 0 then a else abs(high - low) end, 0) * (volume / nullif(m, 0)), 0)"
query("pressure_simple", ["pressure", "pressure_total"], lambda i: i.pressure(10, kind="simple"), [r("p"), r(f"sum(p) {RUN}")], "x2", x=f"select *, avg(high - low) {over(10)} as a, avg(volume) {over(10)} as m from b", x2=f"select *, {_PRESSURE} as p from x")
query("donchian", ["dc_upper", "dc_lower", "dc_middle"], lambda i: i.donchian(20), [f"max(high) {over(20)}", f"min(low) {over(20)}", r(f"(max(high) {over(20)} + min(low) {over(20)}) / 2")])
query("keltner_channel", ["kc_upper", "kc_middle", "kc_lower", "kc_position"], lambda i: i.keltner(10, 1.5), [r("m + 1.5::double * a"), r("m"), r("m - 1.5::double * a"), r("case when a > 0 then (close - m) / (1.5::double * a) else 0 end")], "x2", x=_TR, x2=f"select *, avg({HLC}) {over(10)} as m, avg(tr) {over(10)} as a from x")
query("rvi_simple", ["rvi"], lambda i: i.rvi("close", 10), [r(f"case when avg(u) {over(10)} + avg(d) {over(10)} > 0 then 100 * avg(u) {over(10)} / (avg(u) {over(10)} + avg(d) {over(10)}) else 0 end")], "x2", x=f"select *, coalesce(stddev_samp(close) {over(10)}, 0) as s, lag(close) {over()} as p from b", x2="select *, case when close > p then s else 0 end as u, case when close < p then s else 0 end as d from x")
query("volatility_ratio", ["vr"], lambda i: i.volatility_ratio(5, 20), [r(f"avg(tr) {over(20)} / nullif(avg(tr) {over(5)}, 0)")], "x", x=_TR)
query("vertical_horizontal_filter", ["vhf"], lambda i: i.vhf("close", 10), [r(f"coalesce((max(close) {over(10)} - min(close) {over(10)}) / 10 / nullif(avg(c) {over(10)}, 0), 0)")], "x", x=f"select *, coalesce(abs(close - lag(close) {over()}), 0) as c from b")
query("fuzzy_direction", ["candle_direction"], lambda i: i.fuzzy_candles(10), ["sign(close - open)::int"])
query("rolling_mean_std_mad", ["roll_mean", "roll_std", "roll_mad"], lambda i: i._with(indicators.rolling_stats(i.df, "close", 10)), [r("m"), r(f"stddev_pop(close) {over(10)}"), r("list_sum(list_transform(l, lambda v: abs(v - m))) / len(l)")], "x", x=f"select *, avg(close) {over(10)} as m, list(close) {over(10)} as l from b")
_AMAT = f"select *, case when n - 10 >= 20 then lag(f, 10) {over()} else max(case when n = 20 then f end) {RUN} end as front from x"
query("amat_simple", ["amat_long", "amat_short"], lambda i: i.amat("close", 5, 20, 10, "simple"), [f"coalesce(bool_or(f > front) {RUN}, false)", f"coalesce(bool_or(f < front) {RUN}, false)"], "x2", x=f"select *, avg(close) {over(5)} as f, row_number() {over()} as n from b", x2=_AMAT)

query("swings", ["swing_direction", "swing_changed", "swing_high", "swing_low", "swing_length", "swing_since_high", "swing_since_low", "swing_duration"], lambda i: i.swings(5))
# the walk: a step's direction, extremes and counts, then what follows from these
S["swings"] = recursive("""select instrument_id, ts_event, d as swing_direction, changed as swing_changed, round(hi, 6) as swing_high, round(lo, 6) as swing_low, length as swing_length, sh as swing_since_high, sl as swing_since_low, duration as swing_duration
    from f where n > 0""", "trades", b=_bars(LEFT),
    m=f"select *, row_number() {over()} as n, max(high) {over(5)} as top, min(low) {over(5)} as bottom from b",
    x="select instrument_id, ts_event, n, high, low, top, high >= top and low >= bottom as up, high <= top and low <= bottom as down from m",
    f="""select distinct instrument_id, null::bigint as ts_event, 0::bigint as n, 0 as d, false as changed, 0::double as hi, 0::double as lo, 0::bigint as sh, 0::bigint as sl, 0::bigint as length, 0::bigint as duration from x
        union all select instrument_id, ts_event, n, d, changed, hi, lo, sh, sl, case when hi <> 0 and lo <> 0 then floor(abs(hi - lo) + 0.5)::bigint else length end,
            case when hi <> 0 and lo <> 0 then (case d when 1 then sl when -1 then sh else 0 end) else duration end
        from (select x.instrument_id, x.ts_event, x.n, case when up and not down then 1 when down and not up then -1 else f.d end as d,
            (up and not down and f.d = -1) or (down and not up and f.d = 1) as changed,
            case when up and down then (case when f.hi = 0 then high else f.hi end) when up then greatest(high, f.hi) when down and f.hi = 0 then top else f.hi end as hi,
            case when down and not up and (low < f.lo or f.lo = 0) then low else f.lo end as lo,
            case when up and not down then 0 else f.sh + 1 end as sh, case when down and not up then 0 else f.sl + 1 end as sl, f.length, f.duration
            from f join x on x.instrument_id = f.instrument_id and x.n = f.n + 1)""")  # fmt: skip
_HURST = """select w.instrument_id, w.ts_event, round(s.slope, 6) as hurst from w left join s using (instrument_id, ts_event)"""
query("hurst", ["hurst"], lambda i: i.hurst("close", 32))
S["hurst"] = sql(_HURST, "trades", b=_bars(LEFT), q=f"select *, ln(close / lag(close) {over()}) as x from b", w=f"select instrument_id, ts_event, list(x) filter (x is not null) {over(32)} as x from q",
    v="select instrument_id, ts_event, n, p, p // n as part, x[p + 1] as x from w, (values (4), (8), (16)) as l(n), range(32) as r(p) where len(x) = 32",
    d="select *, sum(x - m) over (partition by instrument_id, ts_event, n, part order by p) as c from (select *, avg(x) over (partition by instrument_id, ts_event, n, part) as m from v)",
    e="select instrument_id, ts_event, n, avg((hi - lo) / nullif(s, 0)) as rs from (select instrument_id, ts_event, n, part, max(c) as hi, min(c) as lo, stddev_pop(x) as s from d group by all) group by all",
    s="select instrument_id, ts_event, case when count(*) > 1 then regr_slope(ln(rs), ln(n)) end as slope from e where rs > 0 group by all")


def _ladder(x: str) -> str:
    m, s = f"avg({x}) {over(10)}", f"stddev_pop({x}) {over(10)}"
    return f"case when {x} = 0 then 0 when round({x} - {m} + {s}, 9) <= 0 then 1 when round({x} - {m} - 0.5::double * {s}, 9) <= 0 then 2 when round({x} - {m} - 2 * {s}, 9) <= 0 then 3 else 4 end"


query("fuzzy_candles", ["candle_direction", "candle_size", "candle_body", "candle_upper", "candle_lower"], lambda i: i.fuzzy_candles(10), ["sign(close - open)::int", *map(_ladder, ("size", "body", "upper", "lower"))], "x",
    x="""select *, coalesce(abs(open - close) / nullif(size, 0), 0) as body, coalesce((high - greatest(open, close)) / nullif(size, 0), 0) as upper, coalesce((least(open, close) - low) / nullif(size, 0), 0) as lower
    from (select *, high - low as size from b)""")  # fmt: skip


def walk(name: str, source: str, keep: str = "", **columns: tuple[str, str]) -> str:
    """CTEs: columns y = (1 - a) * y_before + a * x over each instrument's rows of source, from (x, a) by name; y is the first
    x that isn't null, and stays where x is null. keep: further columns of source."""
    more = "".join(f", {c}" for c in keep.split()) if keep else ""
    of = lambda t: "".join(f", {t}.{c}" for c in keep.split())
    put = ", ".join(f"({x})::double as x_{c}, ({a})::double as a_{c}" for c, (x, a) in columns.items())
    first = ", ".join(f"x_{c} as {c}" for c in columns)
    then = ", ".join(f"case when s.x_{c} is null then e.{c} when e.{c} is null then s.x_{c} else (1 - s.a_{c}) * e.{c} + s.a_{c} * s.x_{c} end" for c in columns)
    return f"""{name}_in as (select instrument_id, ts_event, n{more}, {put} from {source}),
        {name} as (select instrument_id, ts_event, n{more}, {first} from {name}_in where n = 1 union all
            select s.instrument_id, s.ts_event, s.n{of('s')}, {then} from {name} e join {name}_in s on s.instrument_id = e.instrument_id and s.n = e.n + 1)"""


def recursive(name: str, columns: list[str], make, exprs: list[str], source: str, *ctes: str):
    query(name, columns, make)
    picked = ", ".join(f"{e} as {c}" for e, c in zip(exprs, columns, strict=True))
    base = f"with recursive trades as ({views.CTE['trades']}), b as ({_bars(LEFT)}), n as (select *, row_number() {over()} as n, greatest(coalesce(close - lag(close) {over()}, 0), 0) as up, greatest(coalesce(lag(close) {over()} - close, 0), 0) as down from b)"
    S[name] = f"{', '.join([base, *ctes])} select instrument_id, ts_event, {picked} from {source}"


def ema(k: int) -> str:
    return f"2 / {k + 1}::double"


_CMO = "coalesce(100 * (g - l) / nullif(g + l, 0), 0)"
_GAINS = walk("e", "n", "close", g=("up", "0.1"), l=("down", "0.1"))
recursive("ema", ["ema"], lambda i: i.ema("close", 10), [r("y")], "e", walk("e", "n", y=("close", ema(10))))
recursive("wilder_average", ["wilder"], lambda i: i.wilder("close", 10), [r("y")], "e", walk("e", "n", y=("close", "0.1")))
recursive("dema", ["dema"], lambda i: i.dema("close", 10), [r("2 * y - z")], "f", walk("e", "n", y=("close", ema(10))), walk("f", "e", "y", z=("y", ema(10))))
_ER = f"er as (select *, coalesce(abs(close - first_value(close) {over(10)}) / nullif(sum(c) {over(9)}, 0), 0) as er from (select *, abs(close - lag(close) {over()}) as c from n))"
recursive("adaptive_average", ["ama"], lambda i: i.ama("close", 10, 2, 30), [r("y")], "e", _ER, walk("e", "er", y=("close", "pow(er * (2 / 3::double - 2 / 31::double) + 2 / 31::double, 2)")))
recursive("vidya", ["vidya"], lambda i: i.vidya("close", 10), [r("y")], "f", _GAINS, walk("f", "e", y=("case when n = 1 then 0 else close end", f"case when n > 10 then abs({_CMO}) / 100 * {ema(10)} else 0 end")))
recursive("macd", ["macd"], lambda i: i.macd("close", 12, 26, "exponential"), [r("f - s")], "e", walk("e", "n", f=("close", ema(12)), s=("close", ema(26))))
recursive("rsi", ["rsi"], lambda i: i.rsi("close", 10), [r("coalesce(g / nullif(g + l, 0), 0.5)")], "e", walk("e", "n", g=("up", ema(10)), l=("down", ema(10))))
recursive("cmo", ["cmo"], lambda i: i.cmo("close", 10), [r(_CMO)], "e", _GAINS)
_MOVES = f"m as (select *, coalesce(high - lag(high) {over()}, 0) as u, coalesce(lag(low) {over()} - low, 0) as d from n)"
recursive("directional_movement", ["dm_plus", "dm_minus"], lambda i: i.directional_movement(10), [r("p"), r("q")], "e", _MOVES, walk("e", "m", p=("case when u > d and u > 0 then u else 0 end", ema(10)), q=("case when d > u and d > 0 then d else 0 end", ema(10))))
recursive(
    "klinger", ["kvo_raw", "kvo"], lambda i: i.klinger(5, 12, 4, "exponential"), [r("f - s"), r("coalesce(y, 0)")], "g", f"v as ({_STEP})",
    walk("e", "v", f=("v", ema(5)), s=("v", ema(12))), walk("g", "e", "f s", y=("case when n >= 12 then f - s end", ema(4))),
)
recursive("pressure", ["pressure"], lambda i: i.pressure(10), [r(_PRESSURE)], "e", walk("e", "n", "high low close volume", a=("high - low", ema(10)), m=("volume", ema(10))))
recursive(
    "average_cross", ["cross"], lambda i: i.cross("close", 5, 20), ["(case when g <> before and g <> 0 then g else 0 end)::int"], "x", walk("e", "n", f=("close", ema(5)), s=("close", ema(20))),
    f"x as (select *, lag(g) {over()} as before from (select *, sign(round(f - s, 12)) as g from e))",
)


def _spread(spark, d):
    return rounded(indicators.spread_analyzer(views.quotes(spark, d), 10).select("instrument_id", "seq", "spread", "spread_avg"))


Q["spread_analyzer"] = _spread
S["spread_analyzer"] = sql("select instrument_id, seq, round(ask_price - bid_price, 6) as spread, round(avg(ask_price - bid_price) over (partition by instrument_id order by ts_event, seq rows 9 preceding), 6) as spread_avg from quotes", "quotes")
Q["book_imbalance_ratio"] = lambda spark, d: rounded(views.quotes(spark, d).select("seq", indicators.book_imbalance_ratio().alias("ratio")))
S["book_imbalance_ratio"] = sql("select seq, round(least(bid_size, ask_size) / greatest(bid_size, ask_size), 6) as ratio from quotes", "quotes")
Q["imbalance_trigger"] = lambda spark, d: Indicators(views.quotes(spark, d), order=("ts_event", "seq")).imbalance_trigger(8, 0.3, 6 * HOUR).select("instrument_id", "seq")
S["imbalance_trigger"] = views.recursive("select instrument_id, seq from f where hit", "quotes",
    t="select instrument_id, seq, ts_event, row_number() over (partition by instrument_id order by ts_event, seq) as n from quotes where greatest(bid_size, ask_size) >= 8 and least(bid_size, ask_size) / greatest(bid_size, ask_size) < 0.3::double",
    f=f"""select instrument_id, seq, n, ts_event as since, true as hit from t where n = 1 union all
        select t.instrument_id, t.seq, t.n, case when t.ts_event - f.since >= {6 * HOUR} then t.ts_event else f.since end, t.ts_event - f.since >= {6 * HOUR} from f join t on t.instrument_id = f.instrument_id and t.n = f.n + 1""")  # fmt: skip


def _vpin(spark, d):
    t = views.trades(spark, d)
    b = bars.threshold_bars(t, F.round(F.col("price") * F.col("size"), 6), 5000, sums={"buy": F.col("aggressor_side") == "BUYER"}, bucket=24 * HOUR)
    return rounded(Indicators(b, order=("bar",)).vpin(10).df.select("instrument_id", "bar", "vpin", "vpin_signed"))


Q["vpin"] = _vpin
S["vpin"] = sql("""select instrument_id, bar, round(avg(abs(s)) over w, 6) as vpin, round(avg(s) over w, 6) as vpin_signed from (select instrument_id, bar, (2 * sum(case when aggressor_side = 'BUYER' then part else 0 end)::double - 5000) / 5000 as s
    from (select *, least(hi, (bar + 1) * 5000) - greatest(hi - x, bar * 5000) as part from (select *, unnest(range(floor((hi - x) / 5000)::bigint, ceil(hi / 5000)::bigint)) as bar
    from (select *, sum(x) over (partition by instrument_id order by ts_event, seq rows unbounded preceding) as hi from (select *, (round(price * size, 6))::decimal(18,6) as x from trades))))
    group by 1, 2 having sum(part) = 5000) window w as (partition by instrument_id order by bar rows 9 preceding)""", "trades")  # fmt: skip

#: Indicators over the last rows, from spans that many tasks share; a span holds so many rows.
SPAN_ROWS = 64


def _in_spans(name: str):
    columns, make = MADE[name]

    def run(spark, d):
        b = Indicators(rounded(bars.time_bars(views.trades(spark, d), HOUR)))
        return rounded(b.in_spans(make, WEEK, SPAN_ROWS).df.select("instrument_id", "ts_event", *columns))

    Q[f"{name}_in_spans"], S[f"{name}_in_spans"] = run, S[name]


for _name in ("sma", "hma", "linreg", "stochastics_slowed", "bollinger", "aroon", "ichimoku", "atr"):
    _in_spans(_name)
