"""Golden values and plain loops for operators that SQL doesn't express."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import asof, bars, book, derived, ledger, stats
from tidemark.operators.indicators import Indicators
from tidemark.operators.windows import affine, rounded, running_sum
from tidemark.plans import registry
from tidemark.sources import views
from tidemark.sources.catalog import Catalog, OverlapError, merged_intervals, missing_intervals

RNG = random.Random(7)
PRICES = [round(10 + 5 * math.sin(i / 7) + RNG.random(), 2) for i in range(300)]


@pytest.fixture(scope="module")
def series(spark):
    rows = [("A", i, i // 50, p, p + 0.5, p - 0.4, float(1 + i % 9)) for i, p in enumerate(PRICES)] + [("B", i, 0, 5.0, 5.0, 5.0, 1.0) for i in range(10)]
    return spark.createDataFrame(rows, "instrument_id string, ts_event long, chunk long, close double, high double, low double, volume double")


def of(df, column, key="A"):
    return [r[column] for r in df.where(F.col("instrument_id") == key).orderBy("ts_event").collect()]


def ema(xs, alpha):
    out = []
    for x in xs:
        out.append(x if not out else (1 - alpha) * out[-1] + alpha * x)
    return out


def test_ema_is_the_loop_whatever_the_chunks(series):
    want = ema(PRICES, 2 / 11)
    assert of(Indicators(series).ema("close", 10).df, "ema") == pytest.approx(want)
    assert of(Indicators(series, chunk="chunk").ema("close", 10).df, "ema") == pytest.approx(want, rel=1e-12)
    assert of(Indicators(series).wilder("close", 10).df, "wilder") == pytest.approx(ema(PRICES, 0.1))
    two = ema(want, 2 / 11)
    assert of(Indicators(series).dema("close", 10).df, "dema") == pytest.approx([2 * a - b for a, b in zip(want, two, strict=True)])


def test_running_sum_is_the_same_in_spans(spark):
    rows = [(k, t, i, float(i % 7)) for i, (k, t) in enumerate([("a", 5), ("a", 95), ("a", 105), (None, 3), (None, 250), ("b", None), ("b", 7), ("a", 105), ("a", -20)])]
    df = spark.createDataFrame(rows, "instrument_id string, ts_event long, seq long, x double")
    plain = sorted(map(tuple, running_sum(df, "y", F.col("x")).collect()), key=str)
    assert len(plain) == len(rows)
    for bucket in (1, 10, 100, 10_000):
        assert sorted(map(tuple, running_sum(df, "y", F.col("x"), bucket=bucket).collect()), key=str) == plain
    assert running_sum(df.limit(0), "y", F.col("x"), bucket=10).count() == 0


def test_affine_keeps_rows_without_a_key(spark):
    rows = [(None, t, t // 3, 0.5, 1.0, 2.0) for t in range(9)]
    df = spark.createDataFrame(rows, "instrument_id string, ts_event long, chunk long, a double, b double, seed double")
    whole = affine(df, "y", order=["ts_event"]).orderBy("ts_event").collect()
    parts = affine(df, "y", order=["ts_event"], chunk="chunk").orderBy("ts_event").collect()
    assert [r.y for r in parts] == [r.y for r in whole] and parts[0].y == 2.0


def test_affine_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("A", 1, 0.5, 1.0, 1.0), ("A", 2, 0.5, None, None), ("A", 3, 0.5, 4.0, 4.0), (None, 1, 0.5, 2.0, 2.0)], "instrument_id string, ts_event long, a double, b double, seed double")
    rows = affine(df, "y", order=["ts_event"]).orderBy("instrument_id", "ts_event").collect()
    assert [r["y"] for r in rows] == [2.0, 1.0, 1.0, 4.5]
    assert affine(df.limit(0), "y", order=["ts_event"]).count() == 0


def test_rsi_and_cmo(series):
    up = [0.0] + [max(b - a, 0) for a, b in zip(PRICES, PRICES[1:], strict=False)]
    down = [0.0] + [max(a - b, 0) for a, b in zip(PRICES, PRICES[1:], strict=False)]
    g, lo = ema(up, 2 / 11), ema(down, 2 / 11)
    want = [a / (a + b) if a + b > 0 else 0.5 for a, b in zip(g, lo, strict=True)]
    assert of(Indicators(series).rsi("close", 10).df, "rsi") == pytest.approx(want)
    assert set(of(Indicators(series).cmo("close", 10).df, "cmo", "B")) == {0.0}


def test_golden_stochastics_and_rate_of_change(spark):
    rows = [("A", i, float(i), float(i), float(i - 1), float(i) - 0.0) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "instrument_id string, ts_event long, x double, high double, low double, close double")
    out = Indicators(df).stochastics(14, 3).df
    assert of(out, "stoch_k")[-1] == 100.0
    prices = [1.0000, 1.00003]
    two = spark.createDataFrame([("A", i, p) for i, p in enumerate(prices)], "instrument_id string, ts_event long, close double")
    assert of(Indicators(two).roc("close", 2, log=True).df, "roc")[-1] == pytest.approx(2.999955e-05)


def test_daily_compounding(spark):
    df = spark.createDataFrame([(0.01,), (-0.012376237623762376,)], "ret double")
    day = stats.daily_returns(df, F.lit("2024-01-01").cast("date")).first()
    assert day["ret"] == pytest.approx(-0.0025)


FILLS = "account_id long, instrument_id string, order_side string, last_qty double, last_px double, ts_event long, seq long"


def test_netting_example(spark):
    f = spark.createDataFrame([(1, "X", "BUY", 100.0, 50.0, 1, 1), (1, "X", "SELL", 100.0, 55.0, 2, 2), (1, "X", "SELL", 50.0, 54.0, 3, 3), (1, "X", "BUY", 50.0, 52.0, 4, 4)], FILLS)
    got = ledger.positions(f, ["account_id"]).orderBy("cycle").collect()
    assert [(r["entry"], r["realized_pnl"]) for r in got] == [("LONG", 500.0), ("SHORT", 100.0)]


def test_cost_basis_is_the_loop(spark):
    rng = random.Random(3)
    rows = [(1, "X", rng.choice(["BUY", "SELL"]), float(rng.randint(1, 9)), float(rng.randint(10, 30)), i, i) for i in range(200)]
    out = ledger.cost_basis(spark.createDataFrame(rows, FILLS), ["account_id"]).groupBy("seq").agg(F.sum("realized_pnl").alias("pnl")).orderBy("seq").collect()
    q = avg = 0.0
    want = []
    for _, _, side, size, px, _, _ in rows:
        x = size if side == "BUY" else -size
        pnl = 0.0
        if q * x < 0:
            closed = min(abs(q), abs(x))
            pnl = closed * (px - avg) * (1 if q > 0 else -1)
            avg = px if abs(x) > abs(q) else avg
        else:
            avg = (avg * abs(q) + px * abs(x)) / (abs(q) + abs(x))
        q += x
        want.append(pnl)
    assert [r["pnl"] for r in out] == pytest.approx(want)


def test_margin_example(spark):
    p = spark.createDataFrame([(1, "X", 110_000.0)], "account_id long, instrument_id string, notional double")
    initial = lambda lev: ledger.margins(p, 0.03, 0.03, lev).where("scope = 3").first()["initial"]
    assert initial(1.0) == pytest.approx(3300) and initial(50.0) == pytest.approx(66)


def test_sequential_bars_are_the_loop(spark):
    t = views.trades(spark, SF)
    rows = {}
    for r in t.orderBy("ts_event", "seq").collect():
        rows.setdefault(r["instrument_id"], []).append(r)
    want, runs = [], []
    for key, own in rows.items():
        total = n = run = 0
        side = None
        for r in own:
            s = 1 if r["aggressor_side"] == "BUYER" else -1
            total += s
            n += 1
            if abs(total) >= 4:
                want.append((key, n, r["price"]))
                total = n = 0
            run, side = (run + 1 if s == side else 1), s
            if run >= 3:
                runs.append((key, r["price"]))
                run, side = 0, None
    got = [(r["instrument_id"], r["count"], r["close"]) for r in bars.imbalance_bars(t, 4).collect()]
    assert sorted(got) == sorted(want)
    assert sorted((r["instrument_id"], r["close"]) for r in bars.runs_bars(t, 3).collect()) == sorted(runs)
    assert sorted((r["instrument_id"], r["close"]) for r in bars.tick_runs_bars(t, 3).collect()) == sorted(runs)


def test_renko_bricks_touch(spark):
    got = bars.renko_bars(views.trades(spark, SF), 10.0).orderBy("instrument_id", "bar").collect()
    assert got and all(abs(r["close"] - r["open"]) == pytest.approx(10.0) for r in got)


def test_derived_quotes_are_the_loop(spark):
    want, state = [], {}
    for r in views.deltas(spark, SF).orderBy("ts_event", "seq").collect():
        s = state.setdefault(r["instrument_id"], {"BUY": {}, "SELL": {}, "last": None})
        if r["action"] == "CLEAR":
            s["BUY"], s["SELL"] = {}, {}
        elif r["action"] == "DELETE":
            s[r["side"]].pop(r["price"], None)
        else:
            s[r["side"]][r["price"]] = r["size"]
        if r["flags"] & 128 and s["BUY"] and s["SELL"]:
            b, a = max(s["BUY"]), min(s["SELL"])
            if (b, a, s["BUY"][b], s["SELL"][a]) != s["last"]:
                s["last"] = (b, a, s["BUY"][b], s["SELL"][a])
                want.append((r["instrument_id"], r["seq"], b, a))
    got = [(r["instrument_id"], r["seq"], r["bid_price"], r["ask_price"]) for r in book.derived_quotes(views.deltas(spark, SF)).collect()]
    assert sorted(got) == sorted(want)


def test_implied_volatility_round_trip(spark):
    df = spark.createDataFrame([(100.0, k, 0.5, v, 0.02, 0.02, c) for k in (80.0, 100.0, 120.0) for v in (0.1, 0.4) for c in (True, False)] + [(100.0, 90.0, 0.0, 0.2, 0.0, 0.0, True)], "spot double, strike double, years double, vol double, rate double, carry double, is_call boolean")
    out = derived.implied_vols(derived.greeks(df)).collect()
    for r in out:
        if r["years"] == 0:
            assert r["delta"] is None and r["implied_vol"] is None
        elif r["vega"] > 1e-4:
            assert r["implied_vol"] == pytest.approx(r["vol"], abs=1e-6)
    both = {(r["strike"], r["vol"], r["is_call"]): r["delta"] for r in out if r["years"]}
    assert both[(100.0, 0.4, True)] - both[(100.0, 0.4, False)] == pytest.approx(1.0)


def test_catalog_intervals_and_overlap(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    make = lambda *ts: spark.createDataFrame([("A/B", float(t), t) for t in ts], "instrument_id string, value double, ts_init long")
    c.write(make(1, 2), "marks")
    c.write(make(3), "marks")
    spans = lambda: sorted((r["first"], r["last"]) for r in c.intervals("marks").collect())
    assert spans() == [(1, 2), (3, 3)]
    with pytest.raises(OverlapError):
        c.write(make(2), "marks")
    c.consolidate("marks")
    assert spans() == [(1, 3)] and c.query("marks").count() == 3
    c.extend("marks", "AB", 10, 20)
    assert sorted((r["first"], r["last"]) for r in c.missing("marks", 0, 25).collect()) == [(0, 0), (4, 9), (21, 25)]
    c.delete_range("marks", 2, 2)
    assert [r["ts_init"] for r in c.query("marks").collect()] == [1, 3]
    assert c.query("marks", ["A/B"], start=2, where="value > 0").count() == 1
    with pytest.raises(ValueError):
        c.query("nothing")


def test_intervals_of_empty_tables(spark):
    none = spark.createDataFrame([], "identifier string, first long, last long")
    assert merged_intervals(none).count() == 0 and missing_intervals(none, 0, 9).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 7, 1000])
def test_time_buckets_change_no_join(spark, bucket):
    rng = random.Random(bucket)
    rows = lambda n, keys: [(rng.choice(keys), rng.randrange(-20, 40), i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]
    schema = "instrument_id string, ts_event long, seq long, value double"
    left = spark.createDataFrame(rows(80, ["A", "B", "C", None]), schema)
    right = spark.createDataFrame(rows(25, ["A", "B", "D", None]), schema)
    text = lambda df: sorted(map(str, df.collect()))
    for more in ({}, {"forward": True}, {"tolerance": 5}, {"forward": True, "tolerance": 2}, {"keep_unmatched": False}):
        assert text(asof.asof_join(left, right, bucket=bucket, **more)) == text(asof.asof_join(left, right, **more))
    legs = {"x": left, "y": right}
    for by in ((), ("instrument_id",)):
        want = text(asof.align_latest(legs, "value", by))
        assert want and text(asof.align_latest(legs, "value", by, bucket=bucket)) == want
    assert asof.asof_join(left.limit(0), right, bucket=bucket).count() == 0
    assert asof.asof_join(left, right.limit(0), bucket=bucket).where("r_seq is not null").count() == 0


def test_unrealized_result_of_all_open_positions(spark):
    """Against a plain loop over the fills: also positions built, reduced and turned by several fills."""
    f = views.fills(spark, SF).select("account_id", "instrument_id", "order_side", "last_qty", "last_px", "ts_event", "seq").collect()
    state, mark, several = {}, {}, 0
    for r in sorted(f, key=lambda r: (r["ts_event"], r["seq"])):
        key = (r["account_id"], r["instrument_id"])
        qty, cost, n = state.get(key, (0.0, 0.0, 0))
        q = r["last_qty"] if r["order_side"] == "BUY" else -r["last_qty"]
        after = round(qty + q, 9)
        if qty * q >= 0:
            cost, n = cost + q * r["last_px"], n + 1
        elif after * qty > 0:
            cost, n = cost * after / qty, n + 1
        else:
            cost, n = after * r["last_px"], 1
        state[key] = (after, cost, n)
        mark[r["instrument_id"]] = r["last_px"]
    want = {}
    for key, (qty, cost, n) in state.items():
        if qty:
            px, m = cost / qty, mark[key[1]]
            want[key] = ((m - px) * qty, qty * (1 / px - 1 / m))
            several += n > 1
    got = {(r["account_id"], r["instrument_id"]): (r["unrealized"], r["unrealized_inverse"]) for r in registry.QUERIES["unrealized_pnl"](spark, SF).collect()}
    assert several and set(got) == set(want)
    for key, pair in want.items():
        assert all(abs(a - b) <= 1e-5 * max(1, abs(b)) for a, b in zip(got[key], pair, strict=True)), key


def test_catalog_is_whole_after_cut_off_writes(spark, tmp_path):
    root = f"{tmp_path}/catalog"
    c = Catalog(spark, f"file://{root}")
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("'A.X' as instrument_id", "id as ts_init", "double(id) as price")
    c.write(rows(0, 10), "trades")
    with pytest.raises(OverlapError):
        c.write(rows(5, 15), "trades")
    with pytest.raises(Exception, match="raised"):
        c.write(rows(20, 30).withColumn("price", F.raise_error(F.lit("raised")).cast("double")), "trades")
    assert c.trades().count() == 10 and [tuple(r) for r in c.intervals("trades").collect()] == [("A.X", 0, 9)]
    c.write(rows(0, 0), "trades")
    assert not any((tmp_path / "catalog" / "staging").iterdir())
    data = tmp_path / "catalog" / "data" / "trades"
    data.rename(f"{data}.old")  # as if cut off before the new table came in
    assert c.trades().count() == 10
    rows(0, 3).withColumn("identifier", F.col("instrument_id")).write.partitionBy("identifier").parquet(f"file://{data}.new")
    data.rename(f"{data}.old")
    assert c.trades().count() == 3
    with pytest.raises(ValueError, match="none of"):
        c.instruments(["equity"])


def test_indicators_in_spans_are_those_of_whole_keys(spark):
    """All indicators over the last rows, with short spans, long frames and a key of few rows; others refuse."""
    b = bars.time_bars(views.trades(spark, SF), 3_600_000_000_000).withColumn("instrument_id", F.when(F.col("ts_event") % 1_000_000_000_000 == 0, "few").otherwise("many")).dropDuplicates(["instrument_id", "ts_event"])
    make = lambda i: (
        i.sma("close", 5).wma("close", 4).efficiency_ratio("close", 7).linreg("close", 6).macd("close", 3, 9).rsi("close", 5, kind="simple").cmo("close", 5, kind="simple").roc("close", 5)
        .cci(5).bias("close", 4).psychological_line("close", 6).directional_movement(5, "simple").obv(8).donchian(9).keltner(5, 2.0).rvi("close", 6).volatility_ratio(3, 8).vhf("close", 6).fuzzy_candles(6)
        .klinger(3, 6, 4).cross("close", 3, 8, "simple").stochastics(5, 3, 3, "simple", "moving_average")
    )
    i = Indicators(b)
    whole, spans = rounded(make(i).df), rounded(i.in_spans(make, 86_400_000_000_000, 10).df)
    assert sorted(whole.columns) == sorted(spans.columns)
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert key(whole) == key(spans)
    for bad in (lambda x: x.ema("close", 3), lambda x: x.obv(), lambda x: x.swings(3), lambda x: x.vwap(F.lit(1), "close", "volume")):
        with pytest.raises(ValueError):
            i.in_spans(bad, 1, 10)


def test_stochastics_of_rising_and_falling_bars(spark):
    for rising, want in ((True, (80.0, 75.0)), (False, (20.0, 25.0))):
        lows = [1.0 + 0.0001 * (k if rising else 3 - k) for k in range(4)]
        df = spark.createDataFrame([("A", k, x + 0.0002, x, x + 0.0001) for k, x in enumerate(lows)], "instrument_id string, ts_event long, high double, low double, close double")
        last_ = Indicators(df).stochastics(14, 3).df.orderBy("ts_event").collect()[-1]
        assert (round(last_["stoch_k"], 6), round(last_["stoch_d"], 6)) == want


def test_mirror_is_read_in_ranges(spark):
    """Four ranges of rows, filters in the database, exact decimals, an empty table and null ranges."""
    from decimal import Decimal

    from tidemark.sources.catalog import read_mirror, write_mirror

    url, driver = "jdbc:derby:memory:ranges;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("k"), F.col("id") % 7).alias("name"), (F.col("id").cast("decimal(38,16)") / 3).cast("decimal(38,16)").alias("x"))
    write_mirror(df, url, "t", keys=["name"], driver=driver)
    back = read_mirror(spark, url, "t", ["x"], "id", 4, "\"name\" <> 'k3'", driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.where("name <> 'k3'").collect()))
    plan = back.where("id > 900")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,900)]" in plan
    assert back.where("id = 1").collect()[0]["x"] == Decimal("0.3333333333333333")
    write_mirror(df.limit(0), url, "no_rows", keys=["name"], driver=driver)
    assert read_mirror(spark, url, "no_rows", ["x"], "id", 4, driver=driver).count() == 0


def test_balances_are_exact_at_halves(spark, tmp_path):
    """A balance of 2952.5, for which doubles sum up to 2952.4999999999995."""
    rows = [(100 * k + 1, 20, "1-URGENT", price, f"2024-01-01 00:00:0{k}") for k, price in enumerate([636273.88, 839837.57, 138.55])]  # sells of two, of a thousandth
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderdate string")
    df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(2 * (r[3] / 1000) for r in rows) < 2952.5
    got = {r["seq"]: r["balances"] for r in registry.QUERIES["account_state_json"](spark, str(tmp_path)).collect()}
    assert got[201] == '[{"currency":"BASE","total":-6},{"currency":"QUOTE","total":2953}]'
