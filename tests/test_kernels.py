"""Kernels over batches and streams: sides of a book, clocks, states to go on from, how large a state gets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import kernels
from tidemark.sources import views
from tidemark.streaming import streams
from tidemark.streaming.keyed import keyed

ROWS = "instrument_id string, price double, size double, aggressor_side string, ts timestamp, seq long"


def started(df, path, name, **trigger):
    return df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(**(trigger or {"availableNow": True})).start()


def test_best_prices_are_those_of_a_plain_dict():
    rng = random.Random(1)
    for sign in (-1, 1):
        side, plain = kernels.Side(sign, {}), {}
        for _ in range(20_000):
            price = float(rng.randint(1, 40))
            if rng.random() < 0.5:
                plain.pop(price, None)
                side.remove(price)
            elif rng.random() < 0.001:
                plain.clear()
                side.clear()
            else:
                plain[price] = side_size = rng.random()
                side.put(price, side_size)
            assert side.best == (None if not plain else max(plain) if sign < 0 else min(plain)) and side.levels == plain
        assert side._heap is None or len(side._heap) <= 2 * 40 + 66


def test_an_update_costs_the_same_in_a_deep_book():
    """The best level goes and comes back, above 10 and above 10,000 others."""

    def seconds(levels):
        kernel = kernels.BookQuotes()
        book = kernel.start()
        kernel.update(book, [("ADD", side, 1000.0 + sign * (2 + i), 1.0, 0, 0, 0) for side, sign in (("BUY", -1), ("SELL", 1)) for i in range(levels)])
        rows = [(("ADD", "DELETE")[i % 2], "BUY", 999.0, 1.0, 128, i, i) for i in range(20_000)]
        kernel.update(book, rows[:2])
        best = []
        for _ in range(3):
            began = time.perf_counter()
            kernel.update(book, rows)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(10_000) < 4 * seconds(10)


def test_states_go_on_where_they_were(spark):
    """Any cut: the rows before it, then those after it from the state between, give what one pass gives."""
    t = views.trades(spark, SF)
    every = kernels.Together({"runs": kernels.RunsBars(3), "value": kernels.ImbalanceBars(900.0, "value"), "mean": kernels.Recent(7, lambda x: (float(x.mean()),)), "bricks": kernels.RenkoBars(10.0)})
    rows = {}
    for r in t.orderBy("ts_event", "seq").collect():
        rows.setdefault(r["instrument_id"], []).append(tuple(r[c] for c in every.reads))
    ends = {r["instrument_id"]: r for r in kernels.states(t, every).collect()}
    for key, own in rows.items():
        whole = every.start()
        want = every.update(whole, own)
        parts = every.start()
        got = every.update(parts, own[:50]) + every.update(parts, own[50:51]) + every.update(parts, []) + every.update(parts, own[51:])
        assert sorted(got, key=repr) == sorted(want, key=repr) and parts == whole
        assert list(ends[key])[1:] == whole
        every.reset(whole)
        assert whole == every.start()


def test_one_state_row_a_key_and_a_level(spark, tmp_path):
    """A kernel's state is one row for each key, whatever its rows; a book has one more for each level that stands."""
    n = 3000
    t = spark.range(4 * n).select(F.concat(F.lit("k"), F.col("id") % n).alias("instrument_id"), F.lit(1.5).alias("price"), F.lit(1.0).alias("size"), F.lit("BUYER").alias("aggressor_side"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    t.repartition(2).write.parquet(f"{tmp_path}/in")
    q = started(keyed(streams.read_files(spark, f"{tmp_path}/in", ROWS), kernels.ImbalanceBars(1e9)), tmp_path, "out")
    q.awaitTermination()
    last = q.recentProgress[-1]["stateOperators"][0]
    assert last["numRowsTotal"] == n and last["memoryUsedBytes"] < 100_000_000
    deltas = spark.range(3000).select(F.lit("A").alias("instrument_id"), F.lit("ADD").alias("action"), F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("id") % 60).cast("double").alias("price"),
        F.when(F.col("id") % 60 < 20, 0.0).otherwise(1.0).alias("size"), F.lit(0).alias("flags"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    deltas.coalesce(1).write.parquet(f"{tmp_path}/deltas")
    q = started(streams.book_quotes(streams.read_files(spark, f"{tmp_path}/deltas", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deltas.schema))), tmp_path, "book")
    q.awaitTermination()
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1 + 40


def test_a_clock_of_the_machines_strikes_without_rows(spark, tmp_path):
    t = spark.createDataFrame([("A", 1.0, 2.0, "BUYER", "2024-01-01 00:00:00", 1), ("A", 3.0, 4.0, "BUYER", "2024-01-01 00:00:01", 2)], ROWS.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = keyed(streams.read_files(spark, f"{tmp_path}/in", ROWS), kernels.Latest("price double, seq long"), every=1_000_000_000, idle=2)
    q = started(out, tmp_path, "out", processingTime="500 milliseconds")
    rows = []
    for _ in range(80):
        time.sleep(0.5)
        q.exception()
        rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
        if len(rows) >= 3:
            break
    time.sleep(3)
    q.stop()
    rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert [(r["instrument_id"], r["price"], r["seq"]) for r in rows] == [("A", 3.0, 2)] * 3  # one, and two without rows
    times = sorted(r["ts_event"] for r in rows)
    assert [b - a for a, b in zip(times[:-1], times[1:], strict=True)] == [1_000_000_000] * 2


def test_old_states_go(spark, tmp_path):
    """With a ttl the state of a key without rows is dropped, and its next row begins anew."""

    def put(k):
        row = spark.createDataFrame([("A", 1.0, 1.0, "BUYER", k)], "instrument_id string, price double, size double, aggressor_side string, seq long").withColumn("ts", F.timestamp_seconds(F.lit(k)))
        row.coalesce(1).select("instrument_id", "price", "size", "aggressor_side", "ts", "seq").write.mode("append").parquet(f"{tmp_path}/in")

    def seen(out, n):
        for _ in range(60):
            got = sorted(r["seq"] for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
            if len(got) >= n:
                break
            time.sleep(0.5)
        return got

    put(1)
    out = keyed(streams.read_files(spark, f"{tmp_path}/in", ROWS), kernels.Changed(), ttl=3000)
    q = started(out, tmp_path, "out", processingTime="500 milliseconds")
    try:
        assert seen(out, 1) == [1]
        time.sleep(5)
        put(2)  # the same price, which the state would know
        assert seen(out, 2) == [1, 2]
    finally:
        q.stop()
    with pytest.raises(ValueError):
        keyed(streams.read_files(spark, f"{tmp_path}/in", ROWS), kernels.Changed(), delay="1 hour", ttl=3000)


def test_spans_give_what_one_pass_gives(spark, monkeypatch):
    """Spans in which the runs meet at once, late (so that the walk is done again) or never, empty keys and one row."""
    t = views.trades(spark, SF)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    hour = 3_600_000_000_000
    for kernel, bucket, closes in ((kernels.ImbalanceBars(3), 24 * hour, 1), (kernels.RunsBars(40.0, "volume"), 48 * hour, 2), (kernels.ImbalanceBars(500.0, "value"), 7 * 24 * hour, 1), (kernels.TickBars(7), 24 * hour, 1), (kernels.ImbalanceBars(5), hour, 4)):
        assert key(kernels.folded_in_spans(t, kernel, bucket, closes=closes)) == key(kernels.folded(t, kernel))
    odd = t.withColumn("instrument_id", F.when(F.col("instrument_id") != "view", F.col("instrument_id"))).withColumn("aggressor_side", F.when(F.col("seq") % 5 != 0, F.col("aggressor_side")))
    assert key(kernels.folded_in_spans(odd, kernels.RunsBars(2), 24 * hour, closes=1)) == key(kernels.folded(odd, kernels.RunsBars(2)))
    assert key(kernels.folded_in_spans(t.limit(0), kernels.TickBars(2), hour)) == [] and key(kernels.folded_in_spans(t.limit(1), kernels.TickBars(1), hour)) == key(kernels.folded(t.limit(1), kernels.TickBars(1)))
