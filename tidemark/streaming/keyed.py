"""Keyed state of streams: kernels over each key's rows with transformWithStateInPandas.

The state lives in RocksDB: a kernel's plain values as one value for each key, a book's levels as one map entry for each, rows
that wait for the watermark as sorted packs. Spark checkpoints it, and a lost executor's state is read again from there.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.kernels import BookState, Kernel, Side, names_of, rows_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Nanoseconds in a millisecond, which watermarks and timers count.
MS = 1_000_000
#: Rows that are plain Python values at a time, and that a pack of waiting rows has; waiting rows that are sorted at a time.
PACK, RUN = 10_000, 1 << 18


def _sorted(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).sort_by([("at_ns", "ascending"), ("row_seq", "ascending")])


def _cut(table: pa.Table, time: int) -> tuple[pa.Table, pa.Table]:
    """The rows of a sorted table up to a time, and those after it."""
    n = int(np.searchsorted(table["at_ns"].to_numpy(), time, side="right"))
    return table.slice(0, n), table.slice(n)


def _slices(table: pa.Table, nulls: bool) -> Iterator[list[tuple]]:
    """Rows of plain Python values, so many at a time; missing numbers as None, or as pandas has them."""
    for i in range(0, table.num_rows, PACK):
        part = table.slice(i, PACK)
        yield list(zip(*(_values(c, nulls) for c in part.columns), strict=True))


def _values(column: pa.ChunkedArray, nulls: bool) -> list:
    if nulls and column.null_count:
        return column.to_pylist()
    values = column.to_pandas().tolist()
    return _plain(values) if nulls and pa.types.is_nested(column.type) else values


class _Plain:
    """A kernel's state as one value."""

    def __init__(self, handle: StatefulProcessorHandle, kernel: Kernel, ttl: int | None):
        self.kernel, self.value, self.doubles = kernel, handle.getValueState("state", kernel.state, ttl), ()

    def load(self) -> list:
        return _plain(self.value.get()) if self.value.exists() else self.kernel.start()

    def save(self, state: list) -> None:
        for i in self.doubles:  # Spark takes a whole number for a double as null
            state[i] = None if state[i] is None else float(state[i])
        self.value.update(tuple(state))


def _plain(row) -> list:
    return [list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) else v for v in row]


class _StoredLevels(MutableMapping):
    """Sizes by price in map state. Reads go to the store until all are needed, once at most in a trigger; changes are written
    by flush(), each price once however often it changed."""

    def __init__(self, state, size: int):
        self.state, self.size, self.changed, self.whole, self.emptied = state, size, {}, False, False

    def _all(self) -> dict:
        if not self.whole:
            self.whole = {} if self.size == 0 else {k[0]: v[0] for k, v in self.state.iterator()}
            for p, s in self.changed.items():
                self.whole.pop(p, None) if s is None else self.whole.__setitem__(p, s)
        return self.whole

    def _get(self, price):
        if self.whole is not False:
            return self.whole.get(price)
        if price not in self.changed:
            return self.state.getValue((price,))[0] if self.size and self.state.containsKey((price,)) else None
        return self.changed[price]

    def __contains__(self, price):
        return self._get(price) is not None

    def __getitem__(self, price):
        found = self._get(price)
        if found is None:
            raise KeyError(price)
        return found

    def __setitem__(self, price, size):
        self.size += price not in self
        self.changed[price] = size
        if self.whole is not False:
            self.whole[price] = size

    def __delitem__(self, price):
        if price not in self:
            raise KeyError(price)
        self.size -= 1
        self.changed[price] = None
        if self.whole is not False:
            del self.whole[price]

    def __iter__(self) -> Iterator[float]:
        return iter(list(self._all()))

    def __len__(self):
        return self.size

    def clear(self):
        self.size, self.changed, self.whole, self.emptied = 0, {}, {}, True

    def flush(self):
        if self.emptied:  # once, however often it was cleared: until now nothing has been written
            self.state.clear()
        for price, size in self.changed.items():
            if size is not None:
                self.state.updateValue((price,), (size,))
            elif not self.emptied and self.state.containsKey((price,)):
                self.state.removeKey((price,))


class _Book:
    """A book's levels as map entries of each side; best prices, numbers of levels and the last quote as one value."""

    def __init__(self, handle: StatefulProcessorHandle, kernel: Kernel, ttl: int | None):
        self.value = handle.getValueState("state", f"{kernel.state}, bids int, asks int", ttl)
        self.maps = [handle.getMapState(name, "price double", "size double", ttl) for name in ("bids", "asks")]

    def load(self) -> BookState:
        bid, ask, last, bids, asks = self.value.get() if self.value.exists() else (None, None, None, 0, 0)
        sides = [Side(sign, _StoredLevels(m, n), best) for sign, m, n, best in zip((-1, 1), self.maps, (bids, asks), (bid, ask), strict=True)]
        return BookState(*sides, None if last is None or not len(last) else tuple(last))

    def save(self, book: BookState) -> None:
        for side in (book.bids, book.asks):
            side.levels.flush()
        self.value.update((book.bids.best, book.asks.best, list(book.last or ()), len(book.bids.levels), len(book.asks.levels)))


class _Waiting:
    """Rows that wait, in packs that are sorted by themselves; a pack is read when the time of its first row has come, so those
    in memory are the ones that overlap in time."""

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None):
        self.index = handle.getMapState("waiting", "first long, number long", "count long", ttl)
        self.packs = handle.getMapState("packs", "number long", "packed binary", ttl)
        self.made = handle.getValueState("packs_made", "number long", ttl)

    def add(self, tables: list[pa.Table]) -> None:
        table, made = _sorted(tables), self.made.get()[0] if self.made.exists() else 0
        for i in range(0, table.num_rows, PACK):
            self._put(made, table.slice(i, PACK))
            made += 1
        self.made.update((made,))

    def _put(self, number: int, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.combine_chunks())
        self.packs.updateValue((number,), (sink.getvalue().to_pybytes(),))
        self.index.updateValue((table["at_ns"][0].as_py(), number), (table.num_rows,))

    def until(self, time: int) -> Iterator[pa.Table]:
        """Takes out the rows up to a time, in order."""
        held = None
        for first, number in sorted(tuple(k) for k in self.index.keys() if k[0] <= time):
            if held is not None:
                ready, held = _cut(held, first - 1)
                if ready.num_rows:
                    yield ready
            pack, rest = _cut(pa.ipc.open_stream(bytes(self.packs.getValue((number,))[0])).read_all(), time)
            self.index.removeKey((first, number))
            if rest.num_rows:
                self._put(number, rest)
            else:
                self.packs.removeKey((number,))
            held = pack if held is None or not held.num_rows else _sorted([held, pack])
        if held is not None and held.num_rows:
            yield held


class _Processor(StatefulProcessor):
    """Runs a kernel over each key's rows; see keyed()."""

    def __init__(self, kernel: Kernel, keys: list[str], rows: str, waits: bool, every: int | None, idle: int, ttl: int | None):
        self.kernel, self.keys, self.waits, self.every, self.idle, self.ttl = kernel, keys, waits, every, idle, ttl
        # names and types are read off here, since that takes a session
        self.rows, self.out, self.values = to_arrow_schema(T.StructType.fromDDL(rows)), [*keys, *names_of(kernel.output)], names_of(kernel.state)
        self.doubles = [i for i, f in enumerate(T.StructType.fromDDL(kernel.state)) if isinstance(f.dataType, T.DoubleType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = (_Book if hasattr(self.kernel, "levels") else _Plain)(handle, self.kernel, self.ttl)
        self.store.doubles = self.doubles
        if self.waits:
            self.waiting = _Waiting(handle, self.ttl)
        if self.every:
            self.clock = handle.getValueState("clock", "next long, empty int", self.ttl)

    def _table(self, key, out) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.out, dtype=object)

    def _read(self, rows) -> Iterator[pa.Table]:
        """A key's rows batch by batch, as compact columns."""
        for pdf in rows:
            if len(pdf):
                yield pa.Table.from_pandas(pdf[self.rows.names], schema=self.rows, preserve_index=False)

    def _folded(self, key, tables, until: int | None) -> Iterator[pd.DataFrame]:
        """Takes sorted tables, so many rows at a time; what they give out, then the clock's snapshots up to a time."""
        state = self.store.load()
        clock = list(self.clock.get()) if self.every and self.clock.exists() else [None, 0]
        for table in tables:
            for rows in _slices(table, self.waits):
                yield from self._table(key, self._taken(state, rows, clock))
        if self.every:
            yield from self._table(key, self._taken(state, [], clock, until))
            self.clock.update(tuple(clock))
            if clock[0] is not None:
                self.handle.registerTimer(clock[0] // MS)
        self.store.save(state)

    def _taken(self, state, rows: list[tuple], clock: list, until: int | None = None) -> list[tuple]:
        """Rows in order, (time, seq, what the kernel reads); between them the clock's snapshots, and after them up to a time."""
        if not self.every:
            return self.kernel.update(state, (r[2:] for r in rows))
        strike, empty = clock
        out, at = [], 0
        while True:
            if strike is None and at < len(rows):
                strike = (rows[at][0] // self.every + 1) * self.every
            end = at
            while end < len(rows) and (strike is None or rows[end][0] < strike):
                end += 1
            out += self.kernel.update(state, (r[2:] for r in rows[at:end]))
            empty = 0 if end > at else empty
            at = end
            if strike is None or at == len(rows) and (until is None or strike > until):
                break
            if empty > self.idle:  # the clock stands until the next row
                strike = None
                if at == len(rows):
                    break
                continue
            out += self.kernel.snapshot(state, strike)
            strike, empty = strike + self.every, empty + 1
        clock[:] = strike, empty
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.waits:  # they are folded once the watermark has passed them
            held, count, newest = [], 0, None
            for table in self._read(rows):
                last = int(table["at_ns"].to_numpy().max())
                newest = last if newest is None else max(newest, last)
                held.append(table)
                count += table.num_rows
                if count >= RUN:
                    self.waiting.add(held)
                    held, count = [], 0
            if held:
                self.waiting.add(held)
            if newest is not None:
                self.handle.registerTimer(-(-newest // MS))
            return
        tables = list(self._read(rows))
        yield from self._folded(key, [_sorted(tables)] if tables else [], timerValues.getCurrentProcessingTimeInMs() * MS if self.every else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waits:
            until = timerValues.getCurrentWatermarkInMs() * MS
            tables = self.waiting.until(until)
            first = next(tables, None)
            tables = [] if first is None else chain([first], tables)
        else:
            until, tables = timerValues.getCurrentProcessingTimeInMs() * MS, []
        if tables or self.every:
            yield from self._folded(key, tables, until)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in rows_of(initialState, self.values):
            self.store.save(_plain(row))

    def close(self) -> None:
        pass


def keyed(
    stream: DataFrame, kernel: Kernel, by: tuple[str, ...] = ("instrument_id",), delay: str | None = None, every: int | None = None, idle: int = 10,
    initial: DataFrame | None = None, ttl: int | None = None,
) -> DataFrame:
    """The key's columns and what the kernel gives out over each key's rows, in order of (ts, seq).

    Without delay a trigger's rows of a key are sorted and taken as they come; rows of earlier triggers are not taken back. With
    delay rows wait until the watermark (that much behind the newest row) has passed them, so they are in order over all
    triggers, and later ones are dropped. every: a clock in nanoseconds; at its times the kernel's snapshot is given out, with or
    without rows in between, up to `idle` times without any, after which it waits for the next row. With delay the clock follows
    the rows' time (event time); without it follows the machines' (processing time), and rows count from when they come. initial:
    states by key, as kernels.states() gives them, of keys the stream goes on from. ttl: milliseconds (of processing time) after
    which the state of a key without rows goes; not together with delay. With ttl or a clock of processing time a query goes on
    until it is stopped, also with the trigger availableNow. Rows without a time are left out with delay or a clock.
    The state store is set to RocksDB if it is still Spark's default.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)
    if ttl is not None and delay is not None:
        raise ValueError("ttl counts processing time, delay event time: one of them")
    wall = every is not None and delay is None
    nanos = F.unix_micros("ts") * 1000 if not wall else F.unix_micros(F.current_timestamp()) * 1000
    if delay is not None:
        stream = stream.withWatermark("ts", delay)
    if delay is not None or every is not None:
        stream = stream.where("ts is not null")
    stream = stream.withColumns({"at_ns": F.coalesce(nanos, F.lit(-(1 << 62))), "ts_event": F.unix_micros("ts") * 1000})
    fields = [stream.schema[c] for c in kernel.reads]
    rows = "at_ns long, row_seq long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)
    chosen = stream.select(*by, *(["ts"] if delay is not None else []), "at_ns", F.col("seq").alias("row_seq"), *kernel.reads)
    output = T.StructType([stream.schema[c] for c in by] + T.StructType.fromDDL(kernel.output).fields)
    mode = "EventTime" if delay is not None else "ProcessingTime" if wall or ttl is not None else "None"
    processor = _Processor(kernel, list(by), rows, delay is not None, every, idle, ttl)
    return chosen.groupBy(*by).transformWithStateInPandas(processor, output, "Append", mode, None if initial is None else initial.groupBy(*by))
