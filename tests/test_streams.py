"""A stream over several files gives what the batch operator gives on the whole table."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import bars, book
from tidemark.plans import streams as plans
from tidemark.plans.streams import run
from tidemark.sources import views
from tidemark.streaming import streams


def test_imbalance_bars(spark):
    got = run(spark, SF, lambda s: streams.imbalance_bars(s, 4)).collect()
    want = bars.imbalance_bars(views.trades(spark, SF), 4).collect()
    key = lambda r: (r["instrument_id"], r["bar"], r["open"], r["high"], r["low"], r["close"], r["volume"], r["count"])
    assert want and sorted(map(key, got)) == sorted(map(key, want))


def test_book_quotes(spark, tmp_path):
    d = views.deltas(spark, SF).withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_event"), F.lit(1000)))).drop("ts_event")
    for k in range(3):
        d.where(F.floor((F.dayofmonth("ts") - 1) / 11) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = streams.book_quotes(streams.read_files(spark, f"{tmp_path}/in", d.schema.simpleString()[7:-1].replace(":", " ")))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["instrument_id"], r["seq"], r["bid_price"], r["ask_price"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    want = sorted((r["instrument_id"], r["seq"], r["bid_price"], r["ask_price"]) for r in book.derived_quotes(views.deltas(spark, SF)).collect())
    assert want and got == want


def test_late_rows_go_aside(spark, tmp_path):
    rows = [("A", 1.0, 1.0, "BUYER", "2024-01-01 00:10:00", 1), ("A", 1.0, 1.0, "BUYER", "2024-01-01 00:00:00", 2), ("A", 1.0, 1.0, "BUYER", "2024-01-01 00:09:00", 3)]
    df = spark.createDataFrame(rows, "instrument_id string, price double, size double, aggressor_side string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("seq = 1").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("seq > 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    writer = streams.with_late_rows(streams.read_files(spark, f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/late", 120)
    writer.trigger(availableNow=True).start().awaitTermination()
    ids = lambda p: sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/{p}").collect())
    assert ids("out") == [1, 3] and ids("late") == [2]
    # started anew, and after the last trigger was lost: the bound is remembered and no row is there twice
    df.where("seq = 2").withColumn("seq", F.lit(4).cast("long")).unionByName(df.where("seq = 1").withColumns({"seq": F.lit(5).cast("long"), "ts": F.lit(None).cast("timestamp")})).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        again = streams.with_late_rows(streams.read_files(spark, f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/late", 120)
        again.trigger(availableNow=True).start().awaitTermination()
        assert ids("out") == [1, 3, 5] and ids("late") == [2, 4]
        for f in (tmp_path / "state" / "commits").glob("*2*"):
            f.unlink()


def test_rows_of_any_time_are_streamed(spark):
    """Rows before and after the months of the test tables and without a time; the parts are in order of time."""
    rows = [("A", 1.0, 1.0, "BUYER", ts, k) for k, ts in enumerate(["2031-05-01 00:00:00", "1999-01-01 00:00:00", "2024-01-15 00:00:00", None, "2024-02-01 00:00:00", "2023-12-31 23:59:59"])]
    df = spark.createDataFrame(rows, "instrument_id string, price double, size double, aggressor_side string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["seq"] for r in plans.replay(spark, df, lambda s: s).collect()) == [0, 1, 2, 3, 4, 5]
    bars_ = plans.replay(spark, df, lambda s: streams.time_bars(s, "1 hour", "10 minutes")).select("start").collect()
    assert len(bars_) == 5 and plans.replay(spark, df.limit(0), lambda s: s).count() == 0


def test_a_replay_goes_on_with_the_slice_it_was_cut_off_in(spark, tmp_path):
    from tidemark.sources.catalog import Catalog

    c = Catalog(spark, f"{tmp_path}/catalog")
    t = spark.range(40).select(F.lit("A").alias("instrument_id"), F.col("id").cast("double").alias("price"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_event"), (F.col("id") * 10).alias("ts_init"))
    c.write(t, "trades")
    seen, fails = [], [True]

    def handle(rows, n):
        if n == 2 and fails.pop() if fails else False:
            raise RuntimeError("cut off")
        seen.append((n, sorted((r["stream"], r["seq"]) for r in rows.collect())))

    try:
        streams.replayed(c, ["trades"], 0, 399, 100, handle, f"{tmp_path}/state")
    except Exception as e:  # noqa: BLE001
        assert "cut off" in str(e)
    assert [n for n, _ in seen] == [0, 1]
    assert streams.replayed(c, ["trades"], 0, 399, 100, handle, f"{tmp_path}/state") == 4
    assert [n for n, _ in seen] == [0, 1, 2, 3] and [x for _, rows in seen for x in rows] == [("trades", k) for k in range(40)]


def test_a_trigger_holds_so_many_rows(spark, monkeypatch):
    """Parts of more rows than a trigger should have are cut in order of time, with equal times together and none lost."""
    seen = []
    read = streams.read_files
    monkeypatch.setattr(streams, "read_files", lambda spark, path, schema, files: (seen.append(files), read(spark, path, schema, files))[1])
    t = views.trades(spark, SF).withColumn("ts", F.timestamp_micros(F.expr("ts_event div 1000"))).drop("ts_event")
    t = t.withColumn("ts", F.when(F.col("seq") % 50 != 0, F.date_trunc("hour", "ts")))  # ties, and rows without a time
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    once = key(plans.replay(spark, t, streams.position_fold, parts=1, end=False))
    assert key(plans.replay(spark, t, streams.position_fold, parts=1, end=False, rows=300)) == once and len(once) == t.count()
    assert seen == [(1 << 31) - 1, 1]


def test_waiting_rows_are_taken_pack_by_pack(spark, monkeypatch, tmp_path):
    """Packs that overlap in time, ties, several watermarks: what is taken out is in order and each row comes once."""
    import random

    import pyarrow as pa

    from tidemark.streaming import keyed

    class Value:
        def __init__(self):
            self.x = None

        def exists(self):
            return self.x is not None

        def get(self):
            return self.x

        def update(self, x):
            self.x = x

    class Map(dict):
        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        getMapState = getValueState = lambda self, name, *_: Value() if name == "packs_made" else Map()

    monkeypatch.setattr(keyed, "PACK", 7)
    waiting, rng, schema = keyed._Waiting(Handle(), None), random.Random(2), pa.schema([("at_ns", pa.int64()), ("row_seq", pa.int64())])
    rows, got, largest = [], [], 0
    for wave in range(30):
        new = [(wave * 10 + rng.randint(0, 25), len(rows) + i) for i in range(rng.randint(1, 40))]
        rows += new
        waiting.add([pa.Table.from_pylist([{"at_ns": a, "row_seq": b} for a, b in part], schema) for part in (new[::2], new[1::2])])
        if wave % 3 == 0:
            for table in waiting.until(wave * 10 - 20):
                largest = max(largest, table.num_rows)
                got += [r for part in keyed._slices(table, True) for r in part]
            assert sorted(got) == sorted(r for r in rows if r[0] <= wave * 10 - 20)
    got += [r for table in waiting.until(1 << 60) for part in keyed._slices(table, True) for r in part]
    assert got == sorted(rows) and not waiting.index and not waiting.packs and largest < 150


def test_a_store_is_emptied_once_a_trigger(spark):
    """Many clears of a book cost one of its store."""
    from tidemark.streaming.keyed import _StoredLevels

    class Store(dict):
        cleared = 0
        getValue, updateValue, removeKey, containsKey = dict.__getitem__, dict.__setitem__, dict.__delitem__, dict.__contains__

        def clear(self):
            self.cleared += 1
            dict.clear(self)

    store = Store({(1.0,): (5.0,), (2.0,): (6.0,)})
    levels = _StoredLevels(store, 2)
    for k in range(50):
        levels.clear()
        levels[3.0], levels[4.0] = 1.0, float(k)
        del levels[3.0]
        assert dict(levels) == {4.0: float(k)}
    levels.flush()
    assert store == {(4.0,): (49.0,)} and store.cleared == 1


def test_files_of_one_period_are_written_by_many_tasks(spark, tmp_path):
    t = spark.range(2000).select(F.lit("A").alias("instrument_id"), F.lit(1.0).alias("price"), F.lit(1.0).alias("size"), F.lit("BUYER").alias("aggressor_side"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    streams.rotating_sink(streams.read_files(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", 5).trigger(availableNow=True).start().awaitTermination()
    out = streams.read_sink(spark, f"{tmp_path}/out")
    files = out.groupBy("file").agg(F.count("*").alias("n")).collect()
    assert sorted(r["seq"] for r in out.select("seq").collect()) == list(range(2000)) and max(r["n"] for r in files) == 5
    tasks = {r["file"].rsplit("/", 1)[1].split("-")[1] for r in files}
    assert len(tasks) > 8 and len(files) < 400 * 1.1
