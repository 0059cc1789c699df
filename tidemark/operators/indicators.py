"""Technical indicators as window expressions; recursive ones as affine recurrences.

Each takes a table of ticks or bars ordered by `order` within `by` and adds its columns. Values of the first rows use the rows
that are there; `<name>_initialized` tells when the window is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import BY, affine, fold, last, ordered, running, running_sum

ORDER = ("ts_event",)


class Indicators:
    """Indicators of one table: `Indicators(bars).sma("close", 5)`; the keys and the order are given once."""

    def __init__(self, df: DataFrame, by: Iterable[str] = BY, order: Iterable[str] = ORDER, chunk: str | None = None):
        self.df, self.by, self.order, self.chunk = df, list(by), list(order), chunk

    def _with(self, df: DataFrame) -> Indicators:
        return Indicators(df, self.by, self.order, self.chunk)

    def in_spans(self, make: Callable[[Indicators], Indicators], bucket: int, rows: int = 1 << 16) -> Indicators:
        """make(self) with every key cut into spans of so many rows, which many tasks share.

        For indicators over the last k rows. Each span also gets the last rows of the span before, as many as all frames of make
        reach back together, and these don't come out again. bucket: a length in units of the first order column for counting
        the key's rows (see windows.running_sum). Recursive indicators and those over all rows so far refuse; the former spread
        by `chunk`.
        """
        reach = [0]
        make(_Spanned(self.df.withColumn("_place", F.lit(0).cast("long")), self.by, self.order, reach))
        rows, back = max(rows, reach[0]), reach[0]
        df = running_sum(self.df, "_place", F.lit(1).cast("long"), self.by, self.order, bucket)
        span = F.expr(f"(_place - 1) div {rows}")
        own, next_ = F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))
        handed = F.when((F.col("_place") - 1) % rows >= rows - back, F.array(own, next_)).otherwise(F.array(own))
        df = df.withColumn("_at", F.explode(handed)).withColumns({"_span": F.col("_at.span"), "_own": F.col("_at.own")}).drop("_at")
        out = make(_Spanned(df, [*self.by, "_span"], self.order, reach)).df
        return self._with(out.where("_own").drop("_place", "_span", "_own"))

    def add(self, **columns: Column) -> Indicators:
        return self._with(self.df.withColumns(columns))

    def frame(self, k: int):
        return last(k, self.by, self.order)

    @property
    def rows(self):
        return ordered(self.by, self.order)

    @property
    def so_far(self):
        return running(self.by, self.order)

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(c, k).over(self.rows)

    def n(self) -> Column:
        return F.row_number().over(self.rows)

    # averages

    def sma(self, x: str, k: int, out: str = "sma") -> Indicators:
        return self.add(**{out: F.avg(x).over(self.frame(k)), f"{out}_initialized": self.n() >= k})

    def _recursive(self, x: str, alpha: Column | float, out: str) -> Indicators:
        a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
        df = self.df.withColumns({"a": 1 - a, "b": a * F.col(x), "seed": F.col(x).cast("double")})
        return self._with(affine(df, out, self.by, self.order, self.chunk))

    def ema(self, x: str, k: int, out: str = "ema") -> Indicators:
        """Seeded with the first value; alpha = 2 / (k + 1)."""
        return self._recursive(x, 2 / (k + 1), out)

    def wilder(self, x: str, k: int, out: str = "wilder") -> Indicators:
        return self._recursive(x, 1 / k, out)

    def dema(self, x: str, k: int, out: str = "dema") -> Indicators:
        two = self.ema(x, k, "_e1").ema("_e1", k, "_e2")
        return two._with(two.df.withColumn(out, 2 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2"))

    def wma(self, x: str, k: int, out: str = "wma", weights: list[float] | None = None) -> Indicators:
        """The newest value gets the last weight; a short window takes the last weights anew."""
        w = weights or [float(i + 1) for i in range(k)]
        values = [self.lag(x, i) if i else F.col(x) for i in range(k)]
        self_ = self.df.withColumns({f"_v{i}": v for i, v in enumerate(values)})
        top = sum(F.coalesce(F.col(f"_v{i}") * w[k - 1 - i], F.lit(0.0)) for i in range(k))
        below = sum(F.when(F.col(f"_v{i}").isNotNull(), w[k - 1 - i]).otherwise(0.0) for i in range(k))
        return self._with(self_.withColumn(out, top / below).drop(*[f"_v{i}" for i in range(k)]))

    def hma(self, x: str, k: int, out: str = "hma") -> Indicators:
        half, root = max(1, k // 2), max(1, math.isqrt(k))
        two = self.wma(x, half, "_h").wma(x, k, "_k").add(_d=2 * F.col("_h") - F.col("_k")).wma("_d", root, out)
        return two._with(two.df.drop("_h", "_k", "_d"))

    def average(self, kind: str, x: str, k: int, out: str) -> Indicators:
        """simple, exponential, wilder, double, hull or weighted."""
        makers = {"simple": self.sma, "exponential": self.ema, "wilder": self.wilder, "double": self.dema, "hull": self.hma, "weighted": self.wma}
        made = makers[kind](x, k, out)
        return made._with(made.df.drop(f"{out}_initialized"))

    def efficiency_ratio(self, x: str, k: int, out: str = "er") -> Indicators:
        """Net change over the sum of absolute changes within the last k values; 0 where nothing moves."""
        step = self.add(_abs=F.abs(F.col(x) - self.lag(x)))
        net = F.abs(F.col(x) - F.first(x).over(self.frame(k)))
        total = F.sum("_abs").over(self.frame(max(1, k - 1)))
        return self._with(step.df.withColumn(out, F.coalesce(F.when(total > 0, net / total), F.lit(0.0))).drop("_abs"))

    def ama(self, x: str, er: int, fast: int, slow: int, out: str = "ama") -> Indicators:
        af, as_ = 2 / (fast + 1), 2 / (slow + 1)
        ratio = self.efficiency_ratio(x, er, "_er")
        made = ratio._recursive(x, F.pow(F.col("_er") * (af - as_) + as_, F.lit(2.0)), out)
        return made._with(made.df.drop("_er"))

    def vidya(self, x: str, k: int, out: str = "vidya") -> Indicators:
        """alpha |CMO| / 100, recursive from the row after the CMO has k values; 0 before."""
        made = self.cmo(x, k, "_cmo").add(_n=self.n())
        a = F.when(F.col("_n") > k, F.abs(F.col("_cmo")) / 100 * (2 / (k + 1))).otherwise(0.0)
        df = made.df.withColumns({"a": 1 - a, "b": a * F.col(x), "seed": F.lit(0.0)})
        return self._with(affine(df, out, self.by, self.order, self.chunk).drop("_cmo", "_n"))

    def vwap(self, day: Column, price: str = "price", size: str = "size", out: str = "vwap") -> Indicators:
        """Running value over running volume of each day."""
        df = self.df.withColumn("_day", day)
        w = running([*self.by, "_day"], self.order)
        value, volume = F.sum(F.col(price) * F.col(size)).over(w), F.sum(size).over(w)
        return self._with(df.withColumn(out, F.when(volume > 0, value / volume).otherwise(F.col(price))).drop("_day"))

    def linreg(self, x: str, k: int) -> Indicators:
        """Slope, intercept (on 1..k), value at k, r2 of the last k values; null before."""
        df = self.df.withColumn("_x", self.n().cast("double"))
        w = self.frame(k)
        slope = F.regr_slope(x, "_x").over(w)
        fitted = F.regr_intercept(x, "_x").over(w) + slope * F.col("_x")
        full = F.col("_x") >= k
        out = {"lr_slope": slope, "lr_value": fitted, "lr_intercept": fitted - slope * k, "lr_r2": F.regr_r2(x, "_x").over(w), "lr_cfo": 100 * (F.col(x) - fitted) / F.col(x)}
        return self._with(df.withColumns({n: F.when(full, c) for n, c in out.items()}).drop("_x"))

    # momentum

    def macd(self, x: str, fast: int, slow: int, kind: str = "simple", out: str = "macd") -> Indicators:
        two = self.average(kind, x, fast, "_f").average(kind, x, slow, "_s")
        return two._with(two.df.withColumn(out, F.col("_f") - F.col("_s")).drop("_f", "_s"))

    def _gains(self, x: str) -> Indicators:
        d = F.coalesce(F.col(x) - self.lag(x), F.lit(0.0))
        return self._with(self.df.withColumn("_d", d).withColumns({"_up": F.greatest("_d", F.lit(0.0)), "_down": F.greatest(-F.col("_d"), F.lit(0.0))}).drop("_d"))

    def rsi(self, x: str, k: int, out: str = "rsi", kind: str = "exponential") -> Indicators:
        """Average gain over gains and losses, 0 to 1; 1 without losses (0.5 if nothing moved)."""
        two = self._gains(x).average(kind, "_up", k, "_g").average(kind, "_down", k, "_l")
        total = F.col("_g") + F.col("_l")
        return two._with(two.df.withColumn(out, F.when(total > 0, F.col("_g") / total).otherwise(0.5)).drop("_g", "_l", "_up", "_down"))

    def cmo(self, x: str, k: int, out: str = "cmo", kind: str = "wilder") -> Indicators:
        two = self._gains(x).average(kind, "_up", k, "_g").average(kind, "_down", k, "_l")
        total = F.col("_g") + F.col("_l")
        return two._with(two.df.withColumn(out, F.when(total > 0, 100 * (F.col("_g") - F.col("_l")) / total).otherwise(0.0)).drop("_g", "_l", "_up", "_down"))

    def roc(self, x: str, k: int, log: bool = False, out: str = "roc") -> Indicators:
        first = F.first(x).over(self.frame(k))
        return self.add(**{out: F.log(F.col(x) / first) if log else (F.col(x) - first) / first})

    def stochastics(self, k: int, d: int, slowing: int = 1, kind: str = "exponential", d_method: str = "ratio") -> Indicators:
        """%K, averaged over `slowing` rows by `kind` where that is above 1, and %D: of the last d rows (ratio) the sum of closes
        above the lowest low over the sum of ranges, or (moving_average) the average of the slowed %K."""
        low, high = F.min("low").over(self.frame(k)), F.max("high").over(self.frame(k))
        made = self._with(self.df.withColumns({"_n": F.col("close") - low, "_r": high - low}))
        made = made.add(stoch_k=F.when(F.col("_r") != 0, 100 * F.col("_n") / F.col("_r")))
        if slowing > 1:
            made = made.average(kind, "stoch_k", slowing, "_slow")
            made = made._with(made.df.drop("stoch_k").withColumnRenamed("_slow", "stoch_k"))
        if d_method == "ratio":
            top, below = F.sum("_n").over(self.frame(d)), F.sum("_r").over(self.frame(d))
            made = made.add(stoch_d=F.when(below != 0, 100 * top / below))
        else:
            made = made.average(kind, "stoch_k", d, "stoch_d")
        return self._with(made.df.drop("_n", "_r"))

    def cci(self, k: int, scalar: float = 0.015, out: str = "cci", kind: str = "simple") -> Indicators:
        df = self.add(_tp=(F.col("high") + F.col("low") + F.col("close")) / 3).average(kind, "_tp", k, "_m").df
        df = df.withColumn("_list", F.collect_list("_tp").over(self.frame(k)))
        mad = F.aggregate("_list", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("_m"))) / F.size("_list")
        return self._with(df.withColumn("_mad", mad).withColumn(out, F.when(F.col("_mad") > 0, (F.col("_tp") - F.col("_m")) / (scalar * F.col("_mad")))).drop("_tp", "_m", "_list", "_mad"))

    def bollinger(self, k: int, width: float = 2.0, kind: str = "simple") -> Indicators:
        """Bands around an average of the typical price; the deviation of the last k prices is the one about that average."""
        df = self.add(_tp=(F.col("high") + F.col("low") + F.col("close")) / 3).average(kind, "_tp", k, "_m").df
        m, mean = F.col("_m"), F.avg("_tp").over(self.frame(k))
        df = df.withColumn("_s", F.sqrt(F.var_pop("_tp").over(self.frame(k)) + (mean - m) * (mean - m)))
        return self._with(df.withColumns({"bb_upper": m + width * F.col("_s"), "bb_middle": m, "bb_lower": m - width * F.col("_s")}).drop("_tp", "_m", "_s"))

    def bias(self, x: str, k: int, out: str = "bias", kind: str = "simple") -> Indicators:
        made = self.average(kind, x, k, "_m")
        return made._with(made.df.withColumn(out, F.col(x) / F.col("_m") - 1).drop("_m"))

    def psychological_line(self, x: str, k: int, out: str = "psl", kind: str = "simple") -> Indicators:
        made = self.add(_up=F.when(F.col(x) > self.lag(x), 1.0).otherwise(0.0)).average(kind, "_up", k, "_mean")
        return made._with(made.df.withColumn(out, 100 * F.col("_mean")).drop("_up", "_mean"))

    def directional_movement(self, k: int, kind: str = "exponential") -> Indicators:
        up, down = F.col("high") - self.lag("high"), self.lag("low") - F.col("low")
        df = self.df.withColumns({"_u": F.coalesce(up, F.lit(0.0)), "_w": F.coalesce(down, F.lit(0.0))})
        df = df.withColumns({
            "_p": F.when((F.col("_u") > F.col("_w")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0),
            "_m": F.when((F.col("_w") > F.col("_u")) & (F.col("_w") > 0), F.col("_w")).otherwise(0.0),
        })
        made = self._with(df.drop("_u", "_w")).average(kind, "_p", k, "dm_plus").average(kind, "_m", k, "dm_minus")
        return made._with(made.df.drop("_p", "_m"))

    def aroon(self, k: int) -> Indicators:
        """How long ago the high of the last k + 1 bars and the low of the last k were, the earlier among equals."""
        df = self.df.withColumn("_n", self.n())
        high = F.max_by("_n", F.struct(F.col("high"), -F.col("_n"))).over(self.frame(k + 1))
        low = F.min_by("_n", F.struct(F.col("low"), F.col("_n"))).over(self.frame(k))
        up, down = 100 * (k - (F.col("_n") - high)) / k, 100 * (k - (F.col("_n") - low)) / k
        return self._with(df.withColumns({"aroon_up": up, "aroon_down": down, "aroon": up - down}).drop("_n"))

    def ichimoku(self, tenkan: int = 9, kijun: int = 26, senkou: int = 52, shift: int = 26) -> Indicators:
        mid = lambda k: (F.max("high").over(self.frame(k)) + F.min("low").over(self.frame(k))) / 2
        df = self.df.withColumns({"tenkan": mid(tenkan), "kijun": mid(kijun), "_b": mid(senkou)}).withColumn("_a", (F.col("tenkan") + F.col("kijun")) / 2)
        return self._with(df.withColumns({"senkou_a": self.lag("_a", shift), "senkou_b": self.lag("_b", shift)}).drop("_a", "_b"))

    def klinger(self, fast: int, slow: int, signal: int, kind: str = "simple") -> Indicators:
        """Fast less slow average of volume signed by the typical price's step (kvo_raw), averaged over `signal` rows from the
        row on where the slow average is full; 0 before. The first row's price is a step up from 0."""
        df = self.df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        step = F.col("_tp") - F.coalesce(self.lag("_tp"), F.lit(0.0))
        made = self._with(df.withColumn("_v", F.signum(step) * F.col("volume"))).average(kind, "_v", fast, "_f").average(kind, "_v", slow, "_s")
        made = made.add(kvo_raw=F.col("_f") - F.col("_s"), _fed=F.when(self.n() >= slow, F.col("_f") - F.col("_s"))).average(kind, "_fed", signal, "kvo")
        return made._with(made.df.withColumn("kvo", F.coalesce(F.nanvl("kvo", F.lit(0.0)), F.lit(0.0))).drop("_tp", "_v", "_f", "_s", "_fed"))

    def obv(self, k: int = 0, out: str = "obv") -> Indicators:
        """Volume signed by close against open, over the last k bars (0: all)."""
        df = self.df.withColumn("_v", F.when(F.col("close") > F.col("open"), F.col("volume")).when(F.col("close") < F.col("open"), -F.col("volume")).otherwise(0.0))
        return self._with(df.withColumn(out, F.sum("_v").over(self.frame(k) if k else self.so_far)).drop("_v"))

    def pressure(self, k: int, floor: float = 0.0, kind: str = "exponential") -> Indicators:
        """Buying less selling pressure of a bar by its range against the mean range (at least floor) and its volume against
        the mean volume; 0 where either is 0. pressure_total sums it up."""
        made = self.add(_range=F.col("high") - F.col("low")).average(kind, "_range", k, "_atr").average(kind, "volume", k, "_mv")
        atr = F.greatest("_atr", F.lit(float(floor)))
        scale = F.when(atr > 0, atr).otherwise(F.greatest(F.abs("_range"), F.lit(float(floor))))
        ratio = (F.col("close") - F.col("low") - (F.col("high") - F.col("close"))) / F.col("_scale") * (F.col("volume") / F.col("_mv"))
        df = made.df.withColumn("_scale", scale).withColumn("pressure", F.coalesce(F.when((F.col("_scale") > 0) & (F.col("_mv") != 0), ratio), F.lit(0.0)))
        return self._with(df.withColumn("pressure_total", F.sum("pressure").over(self.so_far)).drop("_range", "_atr", "_mv", "_scale"))

    def swings(self, k: int) -> Indicators:
        """Direction (1 high, -1 low), whether it turned, the highest swing high and lowest swing low with their times, their
        distance in whole units, bars since either, and the bars that the present leg has taken.

        A bar is a swing high if neither its high nor its low is passed within the last k bars, and a swing low in the same way;
        one that is both only counts bars.
        """
        df = self.df.withColumns({"_top": F.max("high").over(self.frame(k)), "_h": F.col("high") >= F.max("high").over(self.frame(k)), "_l": F.col("low") <= F.min("low").over(self.frame(k))})
        df = df.withColumns({"_up": F.col("_h") & (F.col("low") >= F.min("low").over(self.frame(k))), "_down": F.col("_l") & (F.col("high") <= F.max("high").over(self.frame(k)))}).drop("_h", "_l")
        plain = [f for f in self.df.schema.fields]
        more = T.StructType.fromDDL(
            "swing_direction int, swing_changed boolean, swing_high double, swing_low double, swing_high_time long, swing_low_time long, swing_length long, "
            "swing_since_high long, swing_since_low long, swing_duration long"
        )
        t = self.order[0]

        def step(s, pdf):
            rows = []
            for h, low, top, up, down, time in zip(*(pdf[c].to_numpy() for c in ("high", "low", "_top", "_up", "_down", t)), strict=True):
                changed = False
                s["since_high"] += 1
                s["since_low"] += 1
                if up and down:
                    if s["high"] == 0:
                        s["high"], s["high_t"] = h, time
                elif up:
                    changed = s["d"] == -1
                    if h > s["high"]:
                        s["high"], s["high_t"] = h, time
                    s["d"], s["since_high"] = 1, 0
                elif down:
                    changed = s["d"] == 1
                    if s["high"] == 0:
                        s["high"], s["high_t"] = top, time
                    if low < s["low"] or s["low"] == 0:
                        s["low"], s["low_t"] = low, time
                    s["d"], s["since_low"] = -1, 0
                if s["high"] and s["low"]:
                    s["length"] = int(abs(s["high"] - s["low"]) + 0.5)
                    s["duration"] = {1: s["since_low"], -1: s["since_high"], 0: 0}[s["d"]]
                rows.append((s["d"], changed, s["high"], s["low"], s["high_t"], s["low_t"], s["length"], s["since_high"], s["since_low"], s["duration"]))
            out = pdf[[f.name for f in plain]].reset_index(drop=True)
            return pd.concat([out, pd.DataFrame(rows, columns=more.fieldNames())], axis=1), s

        start = lambda: {"d": 0, "high": 0.0, "low": 0.0, "high_t": 0, "low_t": 0, "length": 0, "since_high": 0, "since_low": 0, "duration": 0}
        return self._with(fold(df, self.by, self.order, start, step, T.StructType([*plain, *more.fields])))

    # volatility

    def atr(self, k: int, out: str = "atr", use_previous: bool = True, floor: float = 0.0) -> Indicators:
        """Mean of the true range, at least floor."""
        before = F.coalesce(self.lag("close"), F.col("close"))
        tr = F.greatest("high", before) - F.least("low", before) if use_previous else F.col("high") - F.col("low")
        df = self.df.withColumn("_tr", tr)
        return self._with(df.withColumn(out, F.greatest(F.avg("_tr").over(self.frame(k)), F.lit(float(floor)))).drop("_tr"))

    def donchian(self, k: int) -> Indicators:
        high, low = F.max("high").over(self.frame(k)), F.min("low").over(self.frame(k))
        return self.add(dc_upper=high, dc_lower=low, dc_middle=(high + low) / 2)

    def keltner(self, k: int, width: float, kind: str = "simple") -> Indicators:
        """Channel around the average typical price, and where the close stands in it (0 where it has no width)."""
        made = self.add(_tp=(F.col("high") + F.col("low") + F.col("close")) / 3).average(kind, "_tp", k, "kc_middle").atr(k, "_atr")
        half = width * F.col("_atr")
        out = {"kc_upper": F.col("kc_middle") + half, "kc_lower": F.col("kc_middle") - half, "kc_position": F.when(half > 0, (F.col("close") - F.col("kc_middle")) / half).otherwise(0.0)}
        return made._with(made.df.withColumns(out).drop("_tp", "_atr"))

    def rvi(self, x: str, k: int, scalar: float = 100.0, out: str = "rvi", kind: str = "simple") -> Indicators:
        df = self.df.withColumns({"_s": F.coalesce(F.stddev_samp(x).over(self.frame(k)), F.lit(0.0)), "_p": self.lag(x)})
        df = df.withColumns({"_up": F.when(F.col(x) > F.col("_p"), F.col("_s")).otherwise(0.0), "_down": F.when(F.col(x) < F.col("_p"), F.col("_s")).otherwise(0.0)})
        made = self._with(df).average(kind, "_up", k, "_a").average(kind, "_down", k, "_b")
        total = F.col("_a") + F.col("_b")
        return made._with(made.df.withColumn(out, F.when(total > 0, scalar * F.col("_a") / total).otherwise(0.0)).drop("_s", "_p", "_up", "_down", "_a", "_b"))

    def volatility_ratio(self, fast: int, slow: int, out: str = "vr") -> Indicators:
        made = self.atr(fast, "_f").atr(slow, "_s")
        return made._with(made.df.withColumn(out, F.when(F.col("_f") > 0, F.col("_s") / F.col("_f"))).drop("_f", "_s"))

    def vhf(self, x: str, k: int, out: str = "vhf", kind: str = "simple") -> Indicators:
        made = self.add(_c=F.coalesce(F.abs(F.col(x) - self.lag(x)), F.lit(0.0))).average(kind, "_c", k, "_mean")
        spread = F.max(x).over(self.frame(k)) - F.min(x).over(self.frame(k))
        return self._with(made.df.withColumn(out, F.when(F.col("_mean") > 0, spread / k / F.col("_mean")).otherwise(0.0)).drop("_c", "_mean"))

    def amat(self, x: str, fast: int, slow: int, signal: int, kind: str = "exponential") -> Indicators:
        """Long and short trend flags: whether the fast average has ever stood above (below) its value `signal` rows before,
        or that of the row where the slow average became full, if that is later."""
        two = self.average(kind, x, fast, "_f").add(_n=self.n())
        begin = F.max(F.when(F.col("_n") == slow, F.col("_f"))).over(self.so_far)
        df = two.df.withColumn("_front", F.when(F.col("_n") - signal >= slow, F.lag("_f", signal).over(self.rows)).otherwise(begin))
        flag = lambda c: F.max(F.coalesce((F.col("_n") >= slow) & c, F.lit(False)).cast("int")).over(self.so_far) == 1
        return self._with(df.withColumns({"amat_long": flag(F.col("_f") > F.col("_front")), "amat_short": flag(F.col("_f") < F.col("_front"))}).drop("_n", "_front", "_f"))

    def fuzzy_candles(self, k: int, t1: float = 0.5, t2: float = 1.0, t3: float = 2.0) -> Indicators:
        """Direction, and classes of the candle's length, body and wicks against their means and deviations."""
        df = self.df.withColumns({"_len": F.col("high") - F.col("low"), "_body": F.abs(F.col("open") - F.col("close"))})
        ratio = lambda c: F.when(F.col("_len") > 0, c / F.col("_len")).otherwise(0.0)
        df = df.withColumns({"_bp": ratio(F.col("_body")), "_uw": ratio(F.col("high") - F.greatest("open", "close")), "_lw": ratio(F.least("open", "close") - F.col("low"))})
        m, s = (lambda c: F.avg(c).over(self.frame(k))), (lambda c: F.stddev_pop(c).over(self.frame(k)))

        def ladder(c: str) -> Column:
            x = F.col(c)
            above = lambda t: F.round(x - m(c) - s(c) * t, 9)  # noqa: E731  (of two rows one lies just on the border)
            return F.when(x == 0, 0).when(above(-t2) <= 0, 1).when(above(t1) <= 0, 2).when(above(t3) <= 0, 3).otherwise(4)

        out = {"candle_direction": F.signum(F.col("close") - F.col("open")).cast("int"), "candle_size": ladder("_len"), "candle_body": ladder("_bp"), "candle_upper": ladder("_uw"), "candle_lower": ladder("_lw")}
        return self._with(df.withColumns(out).drop("_len", "_body", "_bp", "_uw", "_lw"))

    def hurst(self, x: str, k: int, lags: tuple[int, ...] = (4, 8, 16), out: str = "hurst") -> Indicators:
        """Slope of log rescaled range on log lag over the last k returns (null before): a bounded array for each row."""

        @F.pandas_udf("double")
        def slope(windows: pd.Series) -> pd.Series:
            def one(values) -> float:
                a = np.asarray(values, float)
                if len(a) < k:
                    return np.nan
                points = []
                for n in lags:
                    parts = a[: len(a) // n * n].reshape(-1, n)
                    dev = np.cumsum(parts - parts.mean(1, keepdims=True), axis=1)
                    s = parts.std(1)
                    rs = (dev.max(1) - dev.min(1))[s > 0] / s[s > 0]
                    if len(rs) and rs.mean() > 0:
                        points.append((np.log(n), np.log(rs.mean())))
                return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) > 1 else np.nan

            return windows.map(one)

        df = self.df.withColumn("_r", F.log(F.col(x) / self.lag(x)))
        df = df.withColumn("_w", F.collect_list("_r").over(self.frame(k)))
        return self._with(df.withColumn(out, F.nanvl(slope("_w"), F.lit(None).cast("double"))).drop("_r", "_w"))

    def vpin(self, k: int, buy: str = "buy", total: str = "amount", out: str = "vpin") -> Indicators:
        """Mean over the last k buckets of the absolute and of the signed share of buys less sells."""
        share = (2 * F.col(buy) - F.col(total)) / F.col(total)
        df = self.df.withColumn("_s", share)
        return self._with(df.withColumns({out: F.avg(F.abs("_s")).over(self.frame(k)), f"{out}_signed": F.avg("_s").over(self.frame(k))}).drop("_s"))

    def cross(self, x: str, fast: int, slow: int, kind: str = "exponential", out: str = "cross") -> Indicators:
        """1 or -1 where the fast average passes above or below the slow one, else 0."""
        two = self.average(kind, x, fast, "_f").average(kind, x, slow, "_s").add(_g=F.signum(F.round(F.col("_f") - F.col("_s"), 12)))
        before = self.lag("_g")
        return two._with(two.df.withColumn(out, F.when((F.col("_g") != before) & (F.col("_g") != 0), F.col("_g")).otherwise(0.0).cast("int")).drop("_f", "_s", "_g"))

    def imbalance_trigger(self, least: float, ratio: float, gap: int) -> DataFrame:
        """Quotes whose larger side is at least `least` and whose sides' ratio lies below `ratio`, `gap` time units apart."""
        hit = (F.greatest("bid_size", "ask_size") >= least) & (F.least("bid_size", "ask_size") / F.greatest("bid_size", "ask_size") < ratio)
        t = self.order[0]

        def step(s, pdf):
            keep = []
            for x in pdf[t]:
                ok = s["at"] is None or x - s["at"] >= gap
                keep.append(ok)
                s["at"] = x if ok else s["at"]
            return pdf[keep], s

        return fold(self.df.where(hit), self.by, self.order, lambda: {"at": None}, step, self.df.schema)


class _Spanned(Indicators):
    """Indicators over spans: counts how far frames reach back, numbers rows by the whole key, refuses what has no frame."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], reach: list[int]):
        super().__init__(df, by, order)
        self.reach = reach

    def _with(self, df: DataFrame) -> Indicators:
        return _Spanned(df, self.by, self.order, self.reach)

    def frame(self, k: int):
        self.reach[0] += k - 1
        return super().frame(k)

    def lag(self, c, k: int = 1) -> Column:
        self.reach[0] += k
        return super().lag(c, k)

    def n(self) -> Column:
        return F.col("_place")

    @property
    def so_far(self):
        raise ValueError("an indicator over all rows so far can't be had from spans")

    def _refused(self, *_, **__):
        raise ValueError("an indicator with a state can't be had from spans")

    _recursive = vidya = vwap = swings = imbalance_trigger = _refused


def spread_analyzer(df: DataFrame, k: int, by: Iterable[str] = BY, order: Iterable[str] = ("ts_event", "seq")) -> DataFrame:
    s = F.col("ask_price") - F.col("bid_price")
    return df.withColumn("spread", s).withColumn("spread_avg", F.avg("spread").over(last(k, by, order)))


def book_imbalance_ratio() -> Column:
    return F.least("bid_size", "ask_size") / F.greatest("bid_size", "ask_size")


def rolling_stats(df: DataFrame, x: str, k: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """Mean, deviation about it and mean absolute deviation of the last k values."""
    w = last(k, by, order)
    df = df.withColumns({"roll_mean": F.avg(x).over(w), "roll_std": F.stddev_pop(x).over(w), "_l": F.collect_list(x).over(w)})
    mad = F.aggregate("_l", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("roll_mean"))) / F.size("_l")
    return df.withColumn("roll_mad", mad).drop("_l")
