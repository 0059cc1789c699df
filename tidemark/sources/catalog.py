"""A catalog of market data: Parquet tables by type, partitioned by identifier, with their covered intervals beside them.

`<root>/data/<type>/identifier=<id>/part-*.parquet` holds rows, `<root>/coverage/<type>` the intervals that writes covered, also
those without rows. Everything is read and written by Spark, so the root may be any path that Spark reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.scalars import safe_identifier

TIME = "ts_init"

#: Column lists of the built-in types, as Spark schemas.
SCHEMAS = {
    "quotes": "instrument_id string, bid_price double, ask_price double, bid_size double, ask_size double, ts_event long, ts_init long",
    "trades": "instrument_id string, price double, size double, aggressor_side string, trade_id string, ts_event long, ts_init long",
    "bars": "instrument_id string, bar_type string, open double, high double, low double, close double, volume double, ts_event long, ts_init long",
    "deltas": "instrument_id string, action string, side string, price double, size double, order_id long, flags int, sequence long, ts_event long, ts_init long",
    "mark_prices": "instrument_id string, value double, ts_event long, ts_init long",
    "index_prices": "instrument_id string, value double, ts_event long, ts_init long",
    "funding_rates": "instrument_id string, rate decimal(38,16), interval int, next_funding_ns long, ts_event long, ts_init long",
    "option_greeks": "instrument_id string, delta double, gamma double, vega double, theta double, rho double, mark_iv double, bid_iv double, ask_iv double, underlying_price double, open_interest double, ts_event long, ts_init long",
    "instrument_status": "instrument_id string, action string, reason string, trading_event string, is_trading boolean, is_quoting boolean, ts_event long, ts_init long",
    "instrument_closes": "instrument_id string, close_type string, close_price double, ts_event long, ts_init long",
}


class OverlapError(ValueError):
    """A write covers an interval that the catalog has already."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _data(self, kind: str) -> str:
        return f"{self.root}/data/{kind}"

    def _coverage(self, kind: str) -> str:
        return f"{self.root}/coverage/{kind}"

    def _fs(self, path: str):
        """The file system of a path, and a maker of its paths."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def _recover(self, path: str) -> None:
        """Ends a replacement that was cut off between its two moves: the new table if it is whole, else the old one."""
        fs, at = self._fs(path)
        if not fs.exists(at(path)):
            if fs.exists(at(f"{path}.new/_SUCCESS")):
                fs.rename(at(f"{path}.new"), at(path))
            elif fs.exists(at(f"{path}.old")):
                fs.rename(at(f"{path}.old"), at(path))

    def _read(self, path: str) -> DataFrame | None:
        self._recover(path)
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(path)
        except AnalysisException:
            return None

    # reading

    def query(self, kind: str, identifiers: Iterable[str] | None = None, start: int | None = None, end: int | None = None, where: str | Column | None = None, ordered: bool = True) -> DataFrame:
        """Rows of a type: partitions of the identifiers, pushed-down bounds of ts_init (both included), a free predicate."""
        df = self._read(self._data(kind))
        if df is None:
            raise ValueError(f"the catalog has no {kind}")
        if identifiers is not None:
            df = df.where(F.col("identifier").isin([x.replace("/", "") for x in identifiers]))
        if start is not None:
            df = df.where(F.col(TIME) >= start)
        if end is not None:
            df = df.where(F.col(TIME) <= end)
        if where is not None:
            df = df.where(where)
        df = df.drop("identifier", "written")
        return df.orderBy(TIME) if ordered else df

    def quotes(self, **k) -> DataFrame:
        return self.query("quotes", **k)

    def trades(self, **k) -> DataFrame:
        return self.query("trades", **k)

    def bars(self, **k) -> DataFrame:
        return self.query("bars", **k)

    def deltas(self, **k) -> DataFrame:
        return self.query("deltas", **k)

    def depth10(self, **k) -> DataFrame:
        return self.query("depth10", **k)

    def mark_prices(self, **k) -> DataFrame:
        return self.query("mark_prices", **k)

    def index_prices(self, **k) -> DataFrame:
        return self.query("index_prices", **k)

    def funding_rates(self, **k) -> DataFrame:
        return self.query("funding_rates", **k)

    def option_greeks(self, **k) -> DataFrame:
        return self.query("option_greeks", **k)

    def instrument_status(self, **k) -> DataFrame:
        return self.query("instrument_status", **k)

    def instrument_closes(self, **k) -> DataFrame:
        return self.query("instrument_closes", **k)

    def kinds(self) -> DataFrame:
        """(kind) of every type that the catalog has rows of."""
        fs, at = self._fs(self.root)
        data = at(f"{self.root}/data")
        names = [x.getPath().getName() for x in fs.listStatus(data)] if fs.exists(data) else []
        return self.spark.createDataFrame([(n,) for n in sorted(names) if not n.endswith((".new", ".old"))], "kind string")

    def custom(self, name: str, **k) -> DataFrame:
        return self.query(f"custom_{name}", **k)

    def instruments(self, kinds: Iterable[str], identifiers: Iterable[str] | None = None) -> DataFrame:
        """Instruments of all the given classes in one table; columns that a class lacks are null."""
        kinds = list(kinds)
        frames = [self.query(k, identifiers, ordered=False).withColumn("class", F.lit(k)) for k in kinds if self._read(self._data(k)) is not None]
        if not frames:
            raise ValueError(f"the catalog has none of {', '.join(kinds)}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def files(self, kind: str) -> DataFrame:
        """(identifier, file, first, last, rows) of every file."""
        df = self._read(self._data(kind)).select("identifier", F.col("_metadata.file_path").alias("file"), TIME)
        return df.groupBy("identifier", "file").agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"), F.count("*").alias("rows"))

    def identifiers(self, kind: str) -> DataFrame:
        return self._read(self._data(kind)).select("identifier").distinct()

    def bounds(self, kind: str) -> DataFrame:
        """First and last ts_init of each identifier."""
        return self._read(self._data(kind)).groupBy("identifier").agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"))

    def intervals(self, kind: str) -> DataFrame:
        """Covered intervals of each identifier: one for each write or marked range."""
        df = self._read(self._coverage(kind))
        return df if df is not None else self.spark.createDataFrame([], "identifier string, first long, last long")

    def missing(self, kind: str, start: int, end: int) -> DataFrame:
        return missing_intervals(self.intervals(kind), start, end)

    # writing

    def write(self, df: DataFrame, kind: str, by: str = "instrument_id", check_overlap: bool = True) -> None:
        """Appends rows; refuses if an identifier's new interval meets one that is covered.

        df is computed once: its rows go to a folder of their own, from which the intervals are read, and only then move, files
        as they are, into the table and the coverage. A write that fails before that leaves the catalog as it was.
        """
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        fs, at = self._fs(self.root)
        try:
            rows = df.withColumn("identifier", safe_identifier(F.col(by))).sortWithinPartitions("identifier", TIME)
            rows.write.partitionBy("identifier").parquet(f"{staged}/data")
            new = self._read(f"{staged}/data")
            if new is None or "identifier" not in new.columns:
                return
            new = new.groupBy(F.col("identifier").cast("string").alias("identifier")).agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"))
            new.coalesce(1).write.parquet(f"{staged}/coverage")
            if check_overlap:
                have = self.intervals(kind).select("identifier", F.col("first").alias("_a"), F.col("last").alias("_b"))
                clash = self._read(f"{staged}/coverage").join(have, "identifier").where((F.col("first") <= F.col("_b")) & (F.col("last") >= F.col("_a"))).first()
                if clash:
                    raise OverlapError(f"{kind} of {clash['identifier']} is covered from {clash['_a']} to {clash['_b']}")
            self._move(f"{staged}/data", self._data(kind))
            self._move(f"{staged}/coverage", self._coverage(kind))
        finally:
            fs.delete(at(staged), True)

    def _move(self, source: str, target: str) -> None:
        """Moves a table's files into another of the same partitions; Spark's file names are unique."""
        self._recover(target)
        fs, at = self._fs(target)
        files = fs.listFiles(at(source), True)
        folder = fs.getFileStatus(at(source)).getPath().toString()
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().startswith("part-"):
                to = at(target + path.toString()[len(folder) :])
                fs.mkdirs(to.getParent())
                if not fs.rename(path, to):
                    raise OSError(f"{path.toString()} can't be moved to {to.toString()}")
        self.spark.catalog.refreshByPath(target)

    def write_custom(self, df: DataFrame, name: str, by: str = "instrument_id") -> None:
        """Rows of a user's own type, with the type's name and columns as JSON in `data_type`."""
        tag = '{"type":"%s","fields":[%s]}' % (name, ",".join(f'"{c}"' for c in df.columns))
        self.write(df.withColumn("data_type", F.lit(tag)), f"custom_{name}", by)

    def extend(self, kind: str, identifier: str, first: int, last: int) -> None:
        """Marks a range without rows as covered."""
        self.spark.createDataFrame([(identifier, first, last)], "identifier string, first long, last long").write.mode("append").parquet(self._coverage(kind))

    def _swap(self, df: DataFrame, path: str, *by: str) -> None:
        """Replaces a table by df, which may read the table: written beside it first, then both are moved.

        Until the new table is whole the old one stays; a job that is cut off between the moves is ended by the next read.
        """
        fs, at = self._fs(path)
        out = df.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{path}.new")
        fs.delete(at(f"{path}.old"), True)
        fs.rename(at(path), at(f"{path}.old"))
        fs.rename(at(f"{path}.new"), at(path))
        fs.delete(at(f"{path}.old"), True)
        self.spark.catalog.refreshByPath(path)

    def consolidate(self, kind: str, deduplicate: bool = False, partitions: int | None = None) -> None:
        """Few large files, sorted by time within an identifier; adjacent intervals become one."""
        df = self._read(self._data(kind))
        df = df.dropDuplicates() if deduplicate else df
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._swap(df.repartitionByRange(n, "identifier", TIME).sortWithinPartitions("identifier", TIME), self._data(kind), "identifier")
        self._swap(merged_intervals(self.intervals(kind)), self._coverage(kind))

    def consolidate_by_period(self, kind: str, period: int) -> None:
        """Files that each hold one period of an identifier, in the folder of the period."""
        df = self._read(self._data(kind)).withColumn("period", F.call_function("div", F.col(TIME), F.lit(period)))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._swap(df.repartitionByRange(n, "identifier", "period").sortWithinPartitions("identifier", "period", TIME), self._data(kind), "identifier", "period")

    def delete_range(self, kind: str, start: int, end: int, identifiers: list[str] | None = None) -> None:
        """Drops rows of [start, end] and cuts the covered intervals."""
        out = F.col(TIME).between(start, end)
        out = out if identifiers is None else out & F.col("identifier").isin(identifiers)
        self._swap(self._read(self._data(kind)).where(~F.coalesce(out, F.lit(False))), self._data(kind), "identifier")
        self.reset_coverage(kind)

    def reset_coverage(self, kind: str) -> None:
        """Recomputes the intervals from the files' rows."""
        self._swap(self.files(kind).select("identifier", "first", "last"), self._coverage(kind))

    def files_between(self, kind: str, start: int, end: int) -> DataFrame:
        """files() that hold rows of [start, end]."""
        return self.files(kind).where((F.col("first") <= end) & (F.col("last") >= start))

    def convert_stream(self, path: str, kind: str, by: str = "instrument_id") -> None:
        """Takes the files of a stream's sink into the catalog."""
        self.write(self.spark.read.parquet(path), kind, by)


def merged_intervals(intervals: DataFrame, gap: int = 1) -> DataFrame:
    """Intervals that overlap or follow one another without a gap, as one."""
    w = Window.partitionBy("identifier").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.when(before.isNull() | (F.col("first") > before + gap), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("identifier", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


def missing_intervals(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """What of [start, end] no interval covers, by identifier."""
    w = Window.partitionBy("identifier").orderBy("first")
    rows = merged_intervals(intervals.where((F.col("last") >= start) & (F.col("first") <= end)))
    rows = rows.withColumns({"_before": F.coalesce(F.lag("last").over(w) + 1, F.lit(start)), "_last": F.lead("first").over(w).isNull()})
    gaps = rows.select("identifier", F.col("_before").alias("first"), (F.col("first") - 1).alias("last"))
    tail = rows.where("_last").select("identifier", (F.col("last") + 1).alias("first"), F.lit(end).alias("last"))
    none = intervals.select("identifier").distinct().join(rows.select("identifier"), "identifier", "left_anti").select("identifier", F.lit(start).alias("first"), F.lit(end).alias("last"))
    return gaps.unionByName(tail).unionByName(none).where("first <= last")


# loaders


def load_ticks_csv(spark: SparkSession, path: str, schema: str, time: str, pattern: str | None = None) -> DataFrame:
    """CSV with a header; the time column (a timestamp text, or nanoseconds without a pattern) becomes ts_event and ts_init."""
    df = spark.read.csv(path, header=True, schema=schema)
    ns = F.unix_micros(F.to_timestamp(F.col(time), pattern)) * 1000 if pattern else F.col(time).cast("long")
    return df.withColumns({"ts_event": ns, "ts_init": ns}).drop(time)


def load_ticks_parquet(spark: SparkSession, path: str, time: str) -> DataFrame:
    return spark.read.parquet(path).withColumns({"ts_event": F.unix_micros(F.col(time)) * 1000, "ts_init": F.unix_micros(F.col(time)) * 1000}).drop(time)


def _vendor(spark: SparkSession, path: str, columns: str, symbols: dict[str, str] | None) -> DataFrame:
    """A vendor's CSV: the columns that all its files have (times in microseconds become nanoseconds), then its own."""
    df = spark.read.csv(path, header=True, schema=f"exchange string, symbol string, timestamp long, local_timestamp long, {columns}")
    known = F.create_map(*[F.lit(x) for kv in (symbols or {}).items() for x in kv])[F.col("symbol")] if symbols else F.lit(None).cast("string")
    name = F.concat(F.coalesce(known, F.col("symbol")), F.lit("."), F.upper("exchange"))
    return df.withColumns({"instrument_id": name, "ts_event": F.col("timestamp") * 1000, "ts_init": F.col("local_timestamp") * 1000}).drop("exchange", "symbol", "timestamp", "local_timestamp")


def load_vendor_quotes(spark: SparkSession, path: str, symbols: dict[str, str] | None = None) -> DataFrame:
    """Vendor quotes; a missing side is 0."""
    df = _vendor(spark, path, "ask_amount double, ask_price double, bid_price double, bid_amount double", symbols)
    value = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select("instrument_id", value("bid_price").alias("bid_price"), value("ask_price").alias("ask_price"), value("bid_amount").alias("bid_size"), value("ask_amount").alias("ask_size"), "ts_event", "ts_init")


def load_vendor_trades(spark: SparkSession, path: str, symbols: dict[str, str] | None = None) -> DataFrame:
    """Vendor trades; side is that of the aggressor, trades without a size go."""
    df = _vendor(spark, path, "id string, side string, price double, amount double", symbols).where("amount > 0")
    side = F.when(F.col("side") == "buy", "BUYER").when(F.col("side") == "sell", "SELLER").otherwise("NO_AGGRESSOR")
    return df.select("instrument_id", "price", F.col("amount").alias("size"), side.alias("aggressor_side"), F.col("id").alias("trade_id"), "ts_event", "ts_init")


def load_vendor_derivatives(spark: SparkSession, path: str, symbols: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A vendor's ticker of derivatives as funding_rates, mark_prices and index_prices, each of the rows that have one."""
    columns = "funding_timestamp long, funding_rate decimal(38,16), predicted_funding_rate double, open_interest double, last_price double, index_price double, mark_price double"
    df = _vendor(spark, path, columns, symbols)
    rates = df.where("funding_rate is not null").select("instrument_id", F.col("funding_rate").alias("rate"), F.lit(None).cast("int").alias("interval"), (F.col("funding_timestamp") * 1000).alias("next_funding_ns"), "ts_event", "ts_init")
    prices = {f"{k}_prices": df.where(f"{k}_price is not null").select("instrument_id", F.col(f"{k}_price").alias("value"), "ts_event", "ts_init") for k in ("mark", "index")}
    return {"funding_rates": rates, **prices}


def load_rates(spark: SparkSession, path: str, currency: str) -> DataFrame:
    """(currency, day, rate) of a table of monthly interest rates in percent, in the statistical agencies' generic XML: `Obs`
    elements with the month and the value as attributes. day is the month's first."""
    obs = spark.read.format("xml").option("rowTag", "generic:Obs").schema("`generic:ObsDimension` struct<_value:string>, `generic:ObsValue` struct<_value:double>").load(path)
    return obs.select(F.lit(currency).alias("currency"), F.to_date(F.concat(F.col("`generic:ObsDimension`._value"), F.lit("-01"))).alias("day"), (F.col("`generic:ObsValue`._value") / 100).alias("rate"))


def load_vendor_deltas(spark: SparkSession, path: str, symbols: dict[str, str] | None = None) -> DataFrame:
    """Vendor book updates: microseconds to nanoseconds, amount 0 is a DELETE, a snapshot's first row of a time a CLEAR before it."""
    schema = "exchange string, symbol string, timestamp long, local_timestamp long, is_snapshot boolean, side string, price double, amount double"
    df = spark.read.csv(path, header=True, schema=schema)
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in (symbols or {}).items() for x in kv])[F.col("symbol")], F.col("symbol")) if symbols else F.col("symbol")
    return df.select(
        F.concat(name, F.lit("."), F.upper("exchange")).alias("instrument_id"), F.when(F.col("amount") == 0, "DELETE").when(F.col("is_snapshot"), "ADD").otherwise("UPDATE").alias("action"),
        F.when(F.col("side") == "bid", "BUY").otherwise("SELL").alias("side"), "price", F.col("amount").alias("size"), (F.col("timestamp") * 1000).alias("ts_event"), (F.col("local_timestamp") * 1000).alias("ts_init"),
    )


def load_vendor_depth(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Wide vendor snapshots (asks[i].price, asks[i].amount, bids...) as rows with arrays of (price, size)."""
    cols = [f"`{s}[{i}].{f}` double" for i in range(levels) for s in ("asks", "bids") for f in ("price", "amount")]
    df = spark.read.csv(path, header=True, schema="exchange string, symbol string, timestamp long, local_timestamp long, " + ", ".join(cols), enforceSchema=False)
    side = lambda s: F.filter(F.array(*[F.struct(F.col(f"`{s}[{i}].price`").alias("price"), F.col(f"`{s}[{i}].amount`").alias("size")) for i in range(levels)]), lambda x: x["price"].isNotNull())
    return df.select(F.concat("symbol", F.lit("."), F.upper("exchange")).alias("instrument_id"), side("bids").alias("bids"), side("asks").alias("asks"), (F.col("timestamp") * 1000).alias("ts_event"), (F.col("local_timestamp") * 1000).alias("ts_init"))


#: Digits of a decimal that is kept as text, its sign and point.
_TEXT = 48


def read_mirror(spark: SparkSession, url: str, table: str, decimals: Iterable[str] = (), column: str | None = None, partitions: int = 1, where: str | None = None, **options: str) -> DataFrame:
    """A table of the relational mirror over JDBC; numbers kept as text become decimals.

    column: a whole number, date or time by which the table is read in so many partitions, each a range of its values; the ends
    of the whole are asked from the database first, of the rows that `where` (in its SQL) keeps. Further filters and the columns
    that are used go down to the database.
    """
    source = f"(select * from {table} where {where}) t" if where else table
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is not None:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
        low, high = spark.read.format("jdbc").options(url=url, query=f"select min({name}) as low, max({name}) as high from {source}", **options).load().first()
        if low is not None:
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)
    df = reader.option("dbtable", source).load()
    return df.withColumns({c: F.col(c).cast("decimal(38,16)") for c in decimals})


def write_mirror(df: DataFrame, url: str, table: str, partitions: int = 8, batch: int = 10_000, keys: Iterable[str] = (), **options: str) -> None:
    """Appends df to a table of the mirror, so many rows a batch over so many connections at most; decimals are kept as text.

    keys: text columns that the database should be able to compare (made as varchar).
    """
    exact = [f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"]
    kinds = ", ".join([f"{c} varchar({_TEXT})" for c in exact] + [f"{c} varchar(256)" for c in keys])
    made = {"createTableColumnTypes": kinds} if kinds else {}
    df = df.withColumns({c: F.col(c).cast("string") for c in exact})
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, numPartitions=partitions, **made, **options).mode("append").save()


# conversions


def display(df: DataFrame, scales: dict[str, int], undefined: int | None = None) -> DataFrame:
    """Fixed-point integers as doubles; the value that means "undefined" becomes null."""
    def plain(c: str, s: int) -> Column:
        x = F.col(c)
        return (F.when(x != undefined, x) if undefined is not None else x) / F.lit(float(10**s))

    return df.withColumns({c: plain(c, s) for c, s in scales.items()})


def quotes_from_bars(bid: DataFrame, ask: DataFrame, size: float = 1_000_000.0, step: int = 20_000_000, by: str = "instrument_id") -> DataFrame:
    """Four quotes of each pair of bid and ask bars: open, high, low, close, ending at the bar's time."""
    sides = bid.select(by, "ts_event", *[F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close")]).join(ask.select(by, "ts_event", *[F.col(c).alias(f"a_{c}") for c in ("open", "high", "low", "close")]), [by, "ts_event"])
    four = F.array(*[F.struct((F.col("ts_event") - (3 - i) * step).alias("t"), F.col(f"b_{c}").alias("bid_price"), F.col(f"a_{c}").alias("ask_price")) for i, c in enumerate(("open", "high", "low", "close"))])
    out = sides.select(by, F.explode(four).alias("q")).select(by, "q.bid_price", "q.ask_price", F.lit(size / 4).alias("bid_size"), F.lit(size / 4).alias("ask_size"), F.col("q.t").alias("ts_event"))
    return out.withColumn("ts_init", F.col("ts_event"))


def trades_from_bars(bars: DataFrame, step: int = 20_000_000, by: str = "instrument_id") -> DataFrame:
    """Four trades of each bar, a quarter of its volume each."""
    four = F.array(*[F.struct(F.lit(i).alias("k"), (F.col("ts_event") - (3 - i) * step).alias("t"), F.col(c).alias("price")) for i, c in enumerate(("open", "high", "low", "close"))])
    out = bars.select(by, (F.col("volume") / 4).alias("size"), F.explode(four).alias("q")).select(by, "q.price", "size", F.col("q.t").alias("ts_event"), F.col("q.k").alias("k"))
    return out.withColumn("ts_init", F.col("ts_event"))


def wrangled(df: DataFrame, instrument: str, digits: dict[str, int], delay: int = 0) -> DataFrame:
    """Plain frames as canonical rows: named, rounded to precision, ts_init a delay after ts_event."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumns({"instrument_id": F.lit(instrument), "ts_init": F.col("ts_event") + delay})


def short_rate(times: DataFrame, rates: DataFrame) -> DataFrame:
    """The rate of each time's month: the first that is dated in or after it."""
    from tidemark.operators.asof import asof_join

    month = times.withColumns({"currency": F.col("currency"), "m": F.trunc("day", "month")})
    asked = month.select("currency", "m").distinct().withColumn("t", F.datediff("m", F.lit("1970-01-01").cast("date")).cast("long"))
    known = rates.select("currency", F.datediff(F.trunc("day", "month"), F.lit("1970-01-01").cast("date")).cast("long").alias("t"), "rate")
    found = asof_join(asked, known, ["currency"], "t", None, forward=True).select("currency", "m", F.col("r_rate").alias("rate"))
    return month.join(found, ["currency", "m"], "left").drop("m")
