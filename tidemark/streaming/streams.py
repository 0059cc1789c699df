"""Structured Streaming operators over ticks: bars with watermarks, keyed state, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frames, kernels
from tidemark.streaming.keyed import keyed

TRADES = "instrument_id string, price double, size double, aggressor_side string, ts timestamp, seq long"
#: Full files that a share of a period has at least where rotating_sink() deals one out.
FILES = 16


def read_files(spark: SparkSession, path: str, schema: str = TRADES, files_per_trigger: int = 1) -> DataFrame:
    """Rows of a folder as a stream, so many files a trigger: also the replay of a stored, time-sorted range."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribed(stream: DataFrame, pattern: str, topic: str = "instrument_id") -> DataFrame:
    return stream.where(frames.topic_matches(F.col(topic), pattern))


def _bar_columns():
    at = F.struct("ts", "seq")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("count")]


def time_bars(stream: DataFrame, interval: str, delay: str) -> DataFrame:
    """Closed bars of [start, end); ticks up to `delay` late still count, later ones are dropped."""
    bars = stream.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", interval)).agg(*_bar_columns())
    return bars.select("instrument_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume", "count")


def chained_bars(stream: DataFrame, short: str, long: str, delay: str) -> DataFrame:
    """Bars of bars: a second window over the first one's time."""
    bars = stream.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", short)).agg(*_bar_columns())
    bars = bars.withColumn("t", F.window_time("window"))
    at = F.col("t")
    out = bars.groupBy("instrument_id", F.window("t", long)).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("instrument_id", F.col("window.end").alias("end"), "open", "high", "low", "close", "volume")


def deduplicated(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """Spells of activity of each instrument that end after a gap."""
    out = stream.withWatermark("ts", delay).groupBy("instrument_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return out.select("instrument_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "volume")


def rate_monitor(stream: DataFrame, interval: str, slide: str, limit: int, delay: str) -> DataFrame:
    """Sliding windows with more rows than the limit."""
    out = stream.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", interval, slide)).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return out.select("instrument_id", F.col("window.end").alias("end"), "n")


def imbalance_bars(stream: DataFrame, step: float) -> DataFrame:
    """Bars that close when buys less sells reach `step`; one open bar is kept for each instrument."""
    return keyed(stream, kernels.ImbalanceBars(step)).drop("ts_event")


def ema(stream: DataFrame, k: int) -> DataFrame:
    """The exponential average at every tick."""
    return keyed(stream, kernels.Average(2 / (k + 1), name="ema"))


def position_fold(stream: DataFrame) -> DataFrame:
    """Net quantity, average open price and realised result after each trade, of size signed by aggressor."""
    return keyed(stream, kernels.Positions())


class _Legs(kernels.Kernel):
    """The latest prices of two legs at each update of either, once both are known."""

    reads = ("leg", "price", "seq")
    output = "seq long, first double, second double"
    state = "first double, second double"

    def __init__(self, first: str):
        self.first = first

    def start(self):
        return [None, None]

    def update(self, state, rows):
        out = []
        for leg, price, seq in rows:
            state[leg != self.first] = price
            if None not in state:
                out.append((seq, *state))
        return out


def latest_legs(stream: DataFrame, legs: tuple[str, str]) -> DataFrame:
    """The latest price of two legs at each update of either, once both are known; one key holds the pair."""
    pair = stream.where(F.col("instrument_id").isin(*legs)).withColumns({"leg": F.col("instrument_id"), "instrument_id": F.lit("pair")})
    return keyed(pair, _Legs(legs[0]))


def changed_prices(stream: DataFrame) -> DataFrame:
    """Rows whose price differs from the one before."""
    return keyed(stream, kernels.Changed())


def rotating_sink(stream: DataFrame, path: str, checkpoint: str, rows: int = 1_000_000, every: int | None = None, offset: int = 0, include: list[str] | None = None, by: tuple[str, ...] = ()):
    """A writer of Parquet files that rotate; start() it. read_sink() reads what is whole.

    A file holds `rows` rows at most (size), rows of one period of `every` nanoseconds of ts only (interval; with an offset a
    schedule, such as each day at 17:00) and of one value of the columns `by`. include: patterns of instrument_id (`*`, `?`) that
    are kept. Each trigger replaces its own folder and then its line of the manifest, so one that runs again after a failure
    leaves every row once. Rows without a time have a null period.
    """

    def write(batch: DataFrame, n: int) -> None:
        if include is not None:
            batch = batch.where(reduce(lambda a, b: a | b, [frames.topic_matches(F.col("instrument_id"), x) for x in include]))
        period = F.floor((F.unix_micros("ts") * 1000 - offset) / every).cast("long") if every else F.lit(0).cast("long")
        rows_ = batch.withColumn("period", period)
        folder = f"{path}/data/batch={n}"
        spark = batch.sparkSession
        # what a task costs is its files, so a period of many is dealt out; a share has FILES or more, as each ends in one that isn't full
        count, groups = rows_.agg(F.count("*"), F.approx_count_distinct(F.struct("period", *by))).first()
        shares = max(1, count // (rows * FILES * max(1, groups)))
        share = F.pmod(F.xxhash64(*batch.columns), F.lit(shares))
        dealt = rows_.repartition(max(1, min(groups * shares, 8 * spark.sparkContext.defaultParallelism)), "period", *by, share)
        # tasks put their files in place themselves, since the driver would do so one by one: a task that runs again makes files of
        # the same names, and what a trigger left before it failed isn't in the manifest
        placed = dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        placed.option("maxRecordsPerFile", rows).partitionBy("period", *by).parquet(folder)
        spark.range(1).select(F.lit(n).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/line={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a rotating_sink() whose trigger the manifest has, with period, batch and file."""
    done = spark.read.parquet(f"{path}/manifest").select("batch")
    return spark.read.parquet(f"{path}/data").withColumn("file", F.col("_metadata.file_path")).join(F.broadcast(done), "batch")  # a line for each trigger


def with_late_rows(stream: DataFrame, checkpoint: str, table: str, late_table: str, delay_seconds: int):
    """Writes rows to `table`, and those later than the delay behind the newest row of all earlier triggers to `late_table`.

    Each trigger overwrites its own partition (`batch`), and the newest time so far is kept beside the checkpoint, so a trigger
    that runs again after a failure or a restart leaves the same rows. Rows without a time are never late.
    """

    def write(batch: DataFrame, n: int) -> None:
        times = batch.select(F.col("ts").alias("newest"))
        late = F.lit(False)
        if n:
            before = batch.sparkSession.read.schema(times.schema).parquet(f"{checkpoint}-newest/batch={n - 1}")
            times = times.unionByName(before)
            newest = before.first()[0]
            if newest is not None:
                late = F.coalesce(F.col("ts") < F.lit(newest) - F.expr(f"interval {delay_seconds} seconds"), late)
        batch.where(late).write.mode("overwrite").parquet(f"{late_table}/batch={n}")
        batch.where(~late).write.mode("overwrite").parquet(f"{table}/batch={n}")
        times.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{checkpoint}-newest/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def book_quotes(stream: DataFrame) -> DataFrame:
    """Quotes from book updates (action, side, price, size, flags): after each F_LAST, when both sides stand and have changed.

    Levels are entries of map state. An update costs the logarithm of the number of levels; they are read as a whole only in a
    trigger in which a best level goes.
    """
    return keyed(stream, kernels.BookQuotes()).drop("ts_event")


def snapshots(stream: DataFrame, interval: str, delay: str) -> DataFrame:
    """The last row of each instrument in every interval, given out when the interval is over."""
    last = F.max_by(F.struct("price", "size", "seq"), F.struct("ts", "seq")).alias("x")
    out = stream.withWatermark("ts", delay).groupBy("instrument_id", F.window("ts", interval)).agg(last)
    return out.select("instrument_id", F.col("window.end").alias("end"), "x.price", "x.size", "x.seq")


def replayed(catalog, kinds: list[str], start: int, end: int, step: int, handle, checkpoint: str, slices: int | None = None, **query) -> int:
    """Gives the catalog's rows with ts_init in [start, end] to handle(rows, slice) in order of time, `step` nanoseconds a trigger.

    rows: all kinds together, the kind in `stream`; of a slice only its files' row groups are read, as catalog.query() does. The
    offset is the slice's number, kept in the checkpoint: a replay that was stopped, or cut off within a slice, goes on with that
    slice, so handle should replace what it wrote for it before. slices: stop after so many (in all). Returns how many are done.
    """
    spark = catalog.spark
    todo = max(0, -(-(end - start + 1) // step))
    todo = todo if slices is None else min(todo, slices)

    over = "all slices are done"

    def one(batch: DataFrame, n: int) -> None:
        if n >= todo:  # ends the query without an offset for this slice
            raise StopIteration(over)
        lo = start + n * step
        rows = {k: catalog.query(k, start=lo, end=min(lo + step - 1, end), ordered=False, **query) for k in kinds}
        handle(frames.merged(rows, order=None), n)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    try:
        ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start().awaitTermination()
    except StreamingQueryException as e:
        if over not in str(e):
            raise
    return todo
