"""Synthetic prices, option chains and greeks, rates and funding."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import align_latest
from tidemark.operators.windows import fold, running


def synthetic(legs: dict[str, DataFrame], value: str, formula: Column, digits: int, by: Iterable[str] = (), bucket: int | None = None) -> DataFrame:
    """A formula over the latest value of each leg, at every update; no row unless all inputs are finite. bucket: see align_latest."""
    aligned = align_latest(legs, value, by, bucket=bucket)
    price = F.round(formula, digits)
    ok = ~F.isnan(price) & (F.abs(price) < F.lit(float("inf")))
    return aligned.withColumn("price", price).where(ok)


def atm_price(df: DataFrame, by: Iterable[str], order: Iterable[str], seed: Column | None = None) -> DataFrame:
    """The last known underlying price of a series, or the seed before it."""
    known = F.last("underlying_price", ignorenulls=True).over(running(by, order))
    return df.withColumn("atm", F.coalesce(known, seed) if seed is not None else known)


def strikes_around(chain: DataFrame, by: Iterable[str], above: int, below: int) -> DataFrame:
    """The nearest strike to atm and so many on each side."""
    strikes = chain.select(*by, "strike", "atm").distinct()
    near = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(F.col("strike") - F.col("atm")), "strike"))
    strikes = strikes.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("strike"))).withColumn("_near", near)
    centre = F.max(F.when(F.col("_near") == 1, F.col("_n"))).over(Window.partitionBy(*by))
    return strikes.withColumn("_c", centre).where((F.col("_n") <= F.col("_c") + above) & (F.col("_n") >= F.col("_c") - below)).drop("_n", "_near", "_c")


def strikes_within(chain: DataFrame, share: float) -> DataFrame:
    return chain.where(F.abs(F.col("strike") - F.col("atm")) <= share * F.col("atm"))


def strikes_by_delta(chain: DataFrame, by: Iterable[str], target: float, tolerance: float, fallback: int = 5) -> DataFrame:
    """Strikes whose delta lies near the target; `fallback` each side of atm for series without any."""
    by = list(by)
    hit = chain.where(F.abs(F.abs("delta") - target) <= tolerance).select(*by, "strike", "atm").distinct()
    rest = strikes_around(chain.join(hit.select(*by).distinct(), by, "left_anti"), by, fallback, fallback)
    return hit.unionByName(rest.select(*by, "strike", "atm"))


def active_strikes(atm: DataFrame, by: Iterable[str], order: Iterable[str], spacing: float, width: int, hysteresis: float, cooldown: int) -> DataFrame:
    """Changes of the centre strike: only once the price is `hysteresis` past the midpoint, and `cooldown` after the last change."""
    by, order = list(by), list(order)

    def step(s, pdf):
        out, key = [], tuple(pdf[by].iloc[0])
        for price, t in zip(pdf["atm"].tolist(), pdf[order[0]].tolist(), strict=True):
            c = s["centre"]
            new = round(price / spacing) * spacing
            if c is None or (abs(price - c) > spacing * (0.5 + hysteresis) and t - s["at"] >= cooldown):
                s["centre"], s["at"] = new, t
                out.append((*key, t, new, new - width * spacing, new + width * spacing))
        return pd.DataFrame(out, columns=[*by, order[0], "centre", "lowest", "highest"]), s

    schema = T.StructType([atm.schema[c] for c in by] + T.StructType.fromDDL(f"{order[0]} long, centre double, lowest double, highest double").fields)
    return fold(atm.select(*by, *order, "atm"), by, order, lambda: {"centre": None, "at": 0}, step, schema)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.fromiter(map(math.erf, (np.asarray(x) / math.sqrt(2)).ravel()), float, np.size(x)).reshape(np.shape(x)))


def black_scholes(s, k, t, v, r, b, call) -> dict[str, np.ndarray]:
    """Price, delta, gamma, vega (a percent), theta (a day) and the probability to end in the money, of arrays."""
    root = np.sqrt(t)
    d1 = (np.log(s / k) + (b + v * v / 2) * t) / (v * root)
    d2 = d1 - v * root
    sign = np.where(call, 1.0, -1.0)
    carry, disc = np.exp((b - r) * t), np.exp(-r * t)
    n1, n2 = _normal_cdf(sign * d1), _normal_cdf(sign * d2)
    pdf = np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    price = sign * (s * carry * n1 - k * disc * n2)
    theta = -(s * carry * pdf * v) / (2 * root) - sign * (b - r) * s * carry * n1 - sign * r * k * disc * n2
    return {"price": price, "delta": sign * carry * n1, "gamma": carry * pdf / (s * v * root), "vega": s * carry * pdf * root * 0.01, "theta": theta / 365.25, "itm_prob": n2}


GREEKS = ("price", "delta", "gamma", "vega", "theta", "itm_prob")


def greeks(df: DataFrame, spot: str = "spot", strike: str = "strike", years: str = "years", vol: str = "vol", rate: str = "rate", carry: str = "carry", call: str = "is_call") -> DataFrame:
    """Adds GREEKS to every option row. Rows without positive spot, strike, time and volatility get nulls."""
    kind = "struct<" + ",".join(f"{g}:double" for g in GREEKS) + ">"

    @F.pandas_udf(kind)
    def solve(s: pd.Series, k: pd.Series, t: pd.Series, v: pd.Series, r: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            out = pd.DataFrame(black_scholes(*(x.to_numpy(float) for x in (s, k, t, v, r, b)), c.to_numpy(bool)))
        return out.where((s > 0) & (k > 0) & (t > 0) & (v > 0))

    return df.withColumn("_g", solve(spot, strike, years, vol, rate, carry, call)).select(*df.columns, *[F.col(f"_g.{g}").alias(f"option_{g}" if g == "price" else g) for g in GREEKS])


def implied_vols(df: DataFrame, price: str = "option_price", rounds: int = 60) -> DataFrame:
    """Adds `implied_vol`: bisection of the price in volatility, all rows of a batch at once; null where no volatility fits."""
    names = ["spot", "strike", "years", "rate", "carry", "is_call"]

    @F.pandas_udf("double")
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        a = [x.to_numpy(float) for x in (s, k, t, r, b)]
        lo, hi, call = np.full(len(p), 1e-6), np.full(len(p), 10.0), c.to_numpy(bool)
        with np.errstate(all="ignore"):
            value = lambda v: black_scholes(a[0], a[1], a[2], v, a[3], a[4], call)["price"]
            want = p.to_numpy(float)
            ok = (value(lo) <= want) & (value(hi) >= want)
            for _ in range(rounds):
                mid = (lo + hi) / 2
                below = value(mid) < want
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan)).replace({np.nan: None}).astype(float)

    return df.withColumn("implied_vol", F.nanvl(solve(price, *names), F.lit(None).cast("double")))


def shocked(df: DataFrame, spot_shocks: list[float], vol_shocks: list[float], day_shocks: list[float]) -> DataFrame:
    """Greeks of every row under each combination of spot, volatility and time shocks (a short list in the plan itself)."""
    grid = F.array(*[F.struct(F.lit(a).alias("spot_shock"), F.lit(b).alias("vol_shock"), F.lit(c).alias("day_shock")) for a in spot_shocks for b in vol_shocks for c in day_shocks])
    rows = df.withColumn("_x", F.explode(grid)).select(*df.columns, "_x.*")
    moved = rows.withColumns({"spot": F.col("spot") * (1 + F.col("spot_shock")), "vol": F.col("vol") + F.col("vol_shock"), "years": F.col("years") - F.col("day_shock") / 365.25})
    return greeks(moved)


def scaled_greeks(qty: str = "quantity", multiplier: str = "multiplier", names: Iterable[str] = ("delta", "gamma", "vega", "theta")) -> list[Column]:
    return [(F.col(qty) * F.col(multiplier) * F.col(n)).alias(n) for n in names]


def weighted_delta(beta: str = "beta", spot: str = "spot", index: str = "index") -> Column:
    return F.col("delta") * F.col(beta) * F.col(spot) / F.col(index)


def weighted_vega(base_days: float, days: str = "days") -> Column:
    return F.col("vega") * F.sqrt(F.lit(base_days) / F.col(days))


def interpolated(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def curve_rate(tenor: Column, curve: list[tuple[float, float]]) -> Column:
    """Quadratic through the three nearest points of a yield curve, flat outside it."""
    out = None
    for i in range(1, len(curve) - 1):
        (a, ya), (b, yb), (c, yc) = curve[i - 1], curve[i], curve[i + 1]
        fit = ya * ((tenor - b) * (tenor - c) / ((a - b) * (a - c))) + yb * ((tenor - a) * (tenor - c) / ((b - a) * (b - c))) + yc * ((tenor - a) * (tenor - b) / ((c - a) * (c - b)))
        upto = (curve[i][0] + curve[i + 1][0]) / 2 if i < len(curve) - 2 else curve[-1][0]
        out = F.when(tenor <= upto, fit) if out is None else out.when(tenor <= upto, fit)
    return F.when(tenor <= curve[0][0], curve[0][1]).when(tenor >= curve[-1][0], curve[-1][1]).otherwise(out)


def parity_forward(strike: Column, call: Column, put: Column) -> Column:
    return strike + call - put


def rollover(date: Column, base_rate: Column, quote_rate: Column) -> Column:
    """Daily interest of an FX position per unit of notional, threefold on Wednesday and Friday."""
    times = F.when(F.dayofweek(date).isin(4, 6), 3).otherwise(1)
    return (base_rate - quote_rate) / 365 / 100 * times


def moneyness(spot: Column, strike: Column, call: Column, start: Column, expiry: Column) -> dict[str, Column]:
    days = F.datediff(expiry, start)
    return {"days": days, "years": days / 365.25, "intrinsic": F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))}
