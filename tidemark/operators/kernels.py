"""Kernels: state carried along a key's rows, written once and run in batch (folded) and on streams (streaming.keyed).

A kernel says which columns it reads, what it gives out and what its state holds; update() walks rows in order and changes the
state in place. A user's own indicator is a subclass.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import BY, ORDER, fold, settled

TICK = ("price", "size", "aggressor_side", "ts_event")


class Kernel:
    """reads: the columns of a row; output and state: names and types, as DDL, of what is given out and of the state's values."""

    reads: tuple[str, ...] = ()
    output = ""
    state = ""

    def start(self) -> list:
        """The state before a key's first row."""
        raise NotImplementedError

    def update(self, state: list, rows: Iterable[tuple]) -> list[tuple]:
        """Takes rows in order; what they give out."""
        raise NotImplementedError

    def snapshot(self, state: list, time: int) -> list[tuple]:
        """What is given out at a time (nanoseconds) that a clock strikes; the state is that of all rows before."""
        return []

    def reset(self, state: list) -> None:
        state[:] = self.start()


def names_of(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames() if ddl else []


def rows_of(pdf: pd.DataFrame, columns: Iterable[str]) -> Iterator[tuple]:
    """Rows of plain Python values."""
    return zip(*(pdf[c].tolist() for c in columns), strict=True)


def folded(df: DataFrame, kernel: Kernel, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """The key's columns and what the kernel gives out over each key's rows in order."""
    by, order = list(by), list(order)
    names = [*by, *names_of(kernel.output)]

    def step(state, pdf):
        key = tuple(pdf[by].iloc[0])
        return pd.DataFrame([(*key, *x) for x in kernel.update(state, rows_of(pdf, kernel.reads))], columns=names, dtype=object), state

    schema = T.StructType([df.schema[c] for c in by] + T.StructType.fromDDL(kernel.output).fields)
    return fold(df.select(*dict.fromkeys([*by, *order, *kernel.reads])), by, order, kernel.start, step, schema)


def states(df: DataFrame, kernel: Kernel, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> DataFrame:
    """The key's columns and the kernel's state after each key's last row: where a stream that goes on may start."""
    by, order = list(by), list(order)
    names = [*by, *names_of(kernel.state)]

    def step(state, pdf):
        kernel.update(state, rows_of(pdf, kernel.reads))
        return (), state

    def end(key, state):
        return pd.DataFrame([(*key, *state)], columns=names)

    schema = T.StructType([df.schema[c] for c in by] + T.StructType.fromDDL(kernel.state).fields)
    return fold(df.select(*dict.fromkeys([*by, *order, *kernel.reads])), by, order, kernel.start, step, schema, end)


def folded_in_spans(df: DataFrame, kernel: Kernel, bucket: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER, closes: int = 8) -> DataFrame:
    """folded() of a kernel that begins anew with each output, one key spread over many tasks.

    kernel.counter is the place of the number of outputs so far, in its state and as the first output column; just after an
    output the rest of the state is that of start(). Each span of `bucket` units of the first order column is run on its own, as
    if it began with a fresh state. Where a run from the state that really comes in has an output at the same row, the two go on
    alike. So only the rows before a span's first `closes` outputs are walked again in order, by one task a key, until the runs
    meet; the rest of the span is taken as it is, its numbers moved. If they don't meet within these rows the walk is done again
    with eight times as many, at worst with all.
    """
    by, order = list(by), list(order)
    counter, names, outputs = kernel.counter, names_of(kernel.output), T.StructType.fromDDL(kernel.output).fields
    keys = [df.schema[c] for c in by]
    places = [T.StructField(f"_o{i}", df.schema[c].dataType) for i, c in enumerate(order)]
    at = [f.name for f in places]
    span = F.call_function("div", F.col(order[0]), F.lit(bucket))
    rows = df.select(*dict.fromkeys([*by, *order, *kernel.reads])).withColumn("_span", F.coalesce(span, F.lit(-(1 << 62))))
    columns = [*by, "_span", "_k", *at, "_state", *names]

    def speculate(state, pdf):
        held, n = state
        out = []
        own = tuple(pdf[[*by, "_span"]].iloc[0])
        for place, row in zip(rows_of(pdf, order), rows_of(pdf, kernel.reads), strict=True):
            for x in kernel.update(held, (row,)):
                n += 1
                out.append((*own, n, *place, None, *x))
        return pd.DataFrame(out, columns=columns), (held, n)

    def ended(key, state):
        return pd.DataFrame([(*key, state[1], *[None] * len(at), json.dumps(state[0]), *[None] * len(names))], columns=columns)

    schema = T.StructType([*keys, T.StructField("_span", T.LongType()), T.StructField("_k", T.LongType()), *places, T.StructField("_state", T.StringType()), *outputs])
    alone = settled(fold(rows, [*by, "_span"], order, lambda: (kernel.start(), 0), speculate, schema, ended))
    made = alone.where("_state is null")

    def same(other: str) -> list:
        return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in (*by, "_span")]

    def renamed(some: DataFrame, other: str) -> DataFrame:
        return some.withColumnsRenamed({c: f"{other}{c}" for c in (*by, "_span", "_k")})

    def zero(kind: str) -> Column:
        return F.lit(None if kind in ("string", "boolean", "timestamp") else 0).cast(kind)

    def filled(some: DataFrame) -> DataFrame:
        """With the columns that rows have; whole numbers as 0, since pandas would make doubles of a column with nulls."""
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"_state": "string"}
        return some.withColumns({c: zero(k) for c, k in kinds.items() if c not in some.columns})

    found = ["_span", "_what", "_k", "_by"]
    walked = T.StructType([*keys, *T.StructType.fromDDL("_span long, _what string, _k long, _by long").fields, *outputs])
    nothing = [None] * len(names)
    while True:
        limits = renamed(made.where(F.col("_k") == closes).select(*by, "_span", *at), "_l")
        before = F.struct(*order) <= F.struct(*at)
        first = rows.join(limits, same("_l"), "left").where(F.col(at[0]).isNull() | before).drop(*limits.columns)
        first = first.withColumns({"_late": F.lit(0), "_kind": F.lit(0)})
        marks = made.where(F.col("_k") <= closes).select(*by, "_span", "_k", *[F.col(a).alias(c) for a, c in zip(at, order, strict=True)], F.lit(0).alias("_late"), F.lit(1).alias("_kind"))
        ends = alone.where("_state is not null").select(*by, "_span", "_k", "_state", F.lit(1).alias("_late"), F.lit(2).alias("_kind"))
        first = first.withColumns({"_k": zero("long"), "_state": F.lit(None).cast("string")})
        events = first.unionByName(filled(marks)).unionByName(filled(ends))

        def walk(s, pdf, closes=closes):
            out, own = [], tuple(pdf[by].iloc[0])
            for number, kind, k, final, row in zip(*(pdf[c].tolist() for c in ("_span", "_kind", "_k", "_state")), rows_of(pdf, kernel.reads), strict=True):
                if s["failed"]:
                    break
                if kind == 2:
                    if s["moved"] is not None:
                        s["state"] = json.loads(final)
                        s["state"][counter] += s["moved"]
                    elif k >= closes:  # the rows end before the runs have met
                        s["failed"] = True
                        out.append((*own, number, "failed", None, None, *nothing))
                    s["moved"] = None
                elif s["moved"] is None and kind == 0:
                    new = kernel.update(s["state"], (row,))
                    s["closed"] = bool(new)
                    out += [(*own, number, "row", None, None, *x) for x in new]
                elif s["moved"] is None and s["closed"]:
                    s["moved"] = s["state"][counter] - int(k)
                    out.append((*own, number, "met", int(k), s["moved"], *nothing))
            return pd.DataFrame(out, columns=[*by, *found, *names], dtype=object), s

        start = lambda: {"state": kernel.start(), "moved": None, "closed": False, "failed": False}
        again = settled(fold(events, by, ["_span", "_late", *order, "_kind"], start, walk, walked))
        if again.where("_what = 'failed'").isEmpty():
            break
        closes *= 8
    met = renamed(again.where("_what = 'met'").select(*by, "_span", "_k", "_by"), "_m")
    rest = made.join(met, same("_m")).where(F.col("_k") > F.col("_m_k")).withColumn(names[0], F.col(names[0]) + F.col("_by"))
    return again.where("_what = 'row'").select(*by, *names).unionByName(rest.select(*by, *names))


class Together(Kernel):
    """Several kernels over the same rows; each row of output has the name of its kernel in front. Outputs are those of the widest
    kernel; what another lacks is null."""

    def __init__(self, kernels: dict[str, Kernel], label: str = "kind"):
        self.kernels = kernels
        self.reads = tuple(dict.fromkeys(c for k in kernels.values() for c in k.reads))
        fields: dict[str, str] = {}
        for k in kernels.values():
            fields |= {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(k.output).fields}
        self.output = f"{label} string, " + ", ".join(f"{n} {t}" for n, t in fields.items())
        self.state = ", ".join(f"{name}_{f.name} {f.dataType.simpleString()}" for name, k in kernels.items() for f in T.StructType.fromDDL(k.state).fields)
        places = {n: i for i, n in enumerate(fields)}
        self._parts, at = [], 0
        for name, k in kernels.items():
            size = len(names_of(k.state))
            reads = [self.reads.index(c) for c in k.reads]
            self._parts.append((name, k, slice(at, at + size), reads, [places[n] for n in names_of(k.output)]))
            at += size
        self._width = len(fields)

    def start(self) -> list:
        return [v for k in self.kernels.values() for v in k.start()]

    def _spread(self, name, places, rows):
        out = []
        for row in rows:
            wide = [None] * self._width
            for p, v in zip(places, row, strict=True):
                wide[p] = v
            out.append((name, *wide))
        return out

    def update(self, state, rows):
        rows, out = list(rows), []
        for name, k, own, reads, places in self._parts:
            part = state[own]
            out += self._spread(name, places, k.update(part, ([row[i] for i in reads] for row in rows)))
            state[own] = part
        return out

    def snapshot(self, state, time):
        return [x for name, k, own, _, places in self._parts for x in self._spread(name, places, k.snapshot(state[own], time))]


# bars


class _Bars(Kernel):
    """Bars of whole ticks whose end depends on the ticks since the last one. State: the number of the open bar, its ticks, open,
    high, low, close, volume, and two values of a subclass."""

    reads = TICK
    output = "bar long, open double, high double, low double, close double, volume double, count long, ts_event long"
    state = "bar long, n long, o double, h double, l double, c double, v double, x double, y double"
    counter = 0

    def start(self):
        return [0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]

    def closes(self, x: float, y: float, sign: int, price: float, size: float) -> tuple[bool, float, float]:
        """Whether a tick ends the bar, and the subclass's values after it."""
        raise NotImplementedError

    def update(self, state, rows):
        bar, n, o, h, lo, c, v, x, y = state
        out = []
        for price, size, side, t in rows:
            if not n:
                o = h = lo = price
            h, lo, c, v, n = max(h, price), min(lo, price), price, v + size, n + 1
            done, x, y = self.closes(x, y, 1 if side == "BUYER" else -1 if side == "SELLER" else 0, price, size)
            if done:
                out.append((bar, o, h, lo, c, v, n, t))
                bar, n, v = bar + 1, 0, 0.0
                o = h = lo = c = 0.0
        state[:] = [bar, n, o, h, lo, c, v, x, y]
        return out


class TickBars(_Bars):
    """Bars of so many ticks."""

    def __init__(self, step: int):
        self.step = step

    def closes(self, x, y, sign, price, size):
        return (True, 0.0, y) if x + 1 >= self.step else (False, x + 1, y)


class _OfAmount(_Bars):
    def __init__(self, step: float, kind: str = "tick"):
        """kind: what a tick counts, one (tick), its size (volume) or its size times its price (value)."""
        self.step, self.kind = step, kind

    def amount(self, price: float, size: float) -> float:
        return 1 if self.kind == "tick" else size if self.kind == "volume" else size * price


class ImbalanceBars(_OfAmount):
    """Bars that close when buys less sells reach the step either way. Ticks without an aggressor don't count."""

    def closes(self, x, y, sign, price, size):
        if sign:
            x += sign * self.amount(price, size)
        return (True, 0.0, y) if sign and abs(x) >= self.step else (False, x, y)


class RunsBars(_OfAmount):
    """Bars that close when a run of one side reaches the step; a change of side or a close begins a new run."""

    def closes(self, x, y, sign, price, size):
        if not sign:
            return False, x, y
        x = self.amount(price, size) + (x if y == sign else 0)
        return (True, 0.0, 0.0) if x >= self.step else (False, x, float(sign))


class ThresholdBars(Kernel):
    """Bars of an exact amount; a tick that crosses is split. Amounts and the step are whole units (a column `column` of longs)."""

    output = "bar long, open double, high double, low double, close double, count long, ts_event long"
    state = "bar long, n long, o double, h double, l double, c double, filled long"

    def __init__(self, step: int, column: str):
        self.step, self.reads = step, ("price", column, "ts_event")

    def start(self):
        return [0, 0, 0.0, 0.0, 0.0, 0.0, 0]

    def update(self, state, rows):
        bar, n, o, h, lo, c, filled = state
        out = []
        for price, amount, t in rows:
            while amount > 0:
                if not n:
                    o = h = lo = price
                h, lo, c, n = max(h, price), min(lo, price), price, n + 1
                part = min(amount, self.step - filled)
                amount, filled = amount - part, filled + part
                if filled == self.step:
                    out.append((bar, o, h, lo, c, n, t))
                    bar, n, filled = bar + 1, 0, 0
        state[:] = [bar, n, o, h, lo, c, filled]
        return out


class RenkoBars(Kernel):
    """A bar for each brick that the price moves from the last brick's close; one tick may give several."""

    reads = ("price", "ts_event")
    output = "bar long, open double, close double, ts_event long"
    state = "bar long, begun boolean, at double"

    def __init__(self, brick: float):
        self.brick = brick

    def start(self):
        return [0, False, 0.0]

    def update(self, state, rows):
        bar, begun, at = state
        out = []
        for price, t in rows:
            at = at if begun else price
            begun = True
            while abs(price - at) >= self.brick:
                new = at + (self.brick if price > at else -self.brick)
                out.append((bar, at, new, t))
                bar, at = bar + 1, new
        state[:] = [bar, begun, at]
        return out


# indicators


class Recent(Kernel):
    """A function of the last k values of a column, at every row once there are k (or from the first on, with partial=True).

    f takes an array of the values, oldest first, and gives the values of `output`.
    """

    state = "n long, recent array<double>"

    def __init__(self, k: int, f: Callable[[np.ndarray], tuple], column: str = "price", output: str = "value double", partial: bool = False):
        self.k, self.f, self.partial = k, f, partial
        self.reads, self.output = (column, "seq"), f"seq long, {output}"

    def start(self):
        return [0, []]

    def update(self, state, rows):
        rows = list(rows)
        before = list(state[1])
        values = np.array([*before, *(r[0] for r in rows)], float)
        out = []
        for i, (_, seq) in enumerate(rows, len(before) + 1):
            if i >= self.k or self.partial:
                out.append((seq, *self.f(values[max(0, i - self.k) : i])))
        state[:] = [state[0] + len(rows), values[max(0, len(values) - self.k + 1) :].tolist() if self.k > 1 else []]
        return out


class Average(Kernel):
    """The exponential average with weight alpha on the newest value, begun with the first."""

    state = "y double, begun boolean"

    def __init__(self, alpha: float, column: str = "price", name: str = "value"):
        self.alpha, self.reads, self.output = alpha, (column, "seq"), f"seq long, {name} double"

    def start(self):
        return [0.0, False]

    def update(self, state, rows):
        y, begun = state
        out = []
        for x, seq in rows:
            y = (1 - self.alpha) * y + self.alpha * x if begun else x
            begun = True
            out.append((seq, y))
        state[:] = [y, begun]
        return out


class Changed(Kernel):
    """Rows whose price differs from the one before."""

    reads = ("price", "seq")
    output = "seq long, price double"
    state = "price double, begun boolean"

    def start(self):
        return [0.0, False]

    def update(self, state, rows):
        out = []
        for price, seq in rows:
            if not state[1] or price != state[0]:
                out.append((seq, price))
            state[:] = [price, True]
        return out


class Positions(Kernel):
    """Net quantity, average open price and realised result after each trade, of size signed by aggressor; at a clock's time
    with the result of closing at the last price as well."""

    reads = ("price", "size", "aggressor_side", "seq")
    output = "seq long, net double, avg_px double, realized double"
    state = "q double, a double, p double, last double"

    def start(self):
        return [0.0, 0.0, 0.0, 0.0]

    def update(self, state, rows):
        q, avg, pnl, last = state
        out = []
        for price, size, side, seq in rows:
            x, last = size if side == "BUYER" else -size, price
            if q * x >= 0:
                avg = (avg * abs(q) + price * abs(x)) / (abs(q) + abs(x)) if q + x else 0.0
            else:
                pnl += min(abs(q), abs(x)) * (price - avg) * (1 if q > 0 else -1)
                avg = price if abs(x) > abs(q) else avg
            q += x
            out.append((seq, q, avg, pnl))
        state[:] = [q, avg, pnl, last]
        return out


class Valued(Positions):
    """Positions at the times of a clock only: net quantity, realised and open result at the last price."""

    output = "ts_event long, net double, realized double, unrealized double"

    def update(self, state, rows):
        super().update(state, rows)
        return []

    def snapshot(self, state, time):
        q, avg, pnl, last = state
        return [(time, q, pnl, q * (last - avg))]


class Latest(Kernel):
    """The last values of some columns at the times of a clock."""

    def __init__(self, columns: str):
        """columns: names and types."""
        self.reads = tuple(names_of(columns))
        self.output, self.state = f"ts_event long, {columns}", columns

    def start(self):
        return [None] * len(self.reads)

    def update(self, state, rows):
        for row in rows:
            state[:] = row
        return []

    def snapshot(self, state, time):
        return [(time, *state)]


# order books


class Side:
    """Levels of one side of a book, with the best price at hand.

    Prices lie in a heap; those of levels that are gone are dropped when they come up, or all at once when they outnumber the
    levels, so an update costs the logarithm of the number of levels and the best price nothing. The heap is made only when a
    best level goes: until then the best price is known from the updates. levels may be any mapping of prices to sizes.
    """

    def __init__(self, sign: int, levels: MutableMapping, best: float | None = None):
        self.sign, self.levels, self.best, self._heap = sign, levels, best, None

    def put(self, price: float, size: float) -> None:
        if self._heap is not None and price not in self.levels:
            heapq.heappush(self._heap, self.sign * price)
        self.levels[price] = size
        if self.best is None or self.sign * price < self.sign * self.best:
            self.best = price

    def remove(self, price: float) -> None:
        self.levels.pop(price, None)
        if price == self.best:
            self.best = self._next()

    def _next(self) -> float | None:
        if self._heap is None or len(self._heap) > 2 * len(self.levels) + 64:
            self._heap = [self.sign * p for p in self.levels]
            heapq.heapify(self._heap)
        while self._heap and self.sign * self._heap[0] not in self.levels:
            heapq.heappop(self._heap)
        return self.sign * self._heap[0] if self._heap else None

    def clear(self) -> None:
        self.levels.clear()
        self.best, self._heap = None, None


class BookState:
    """Both sides and the last quote that was given out."""

    def __init__(self, bids: Side, asks: Side, last: tuple | None = None):
        self.bids, self.asks, self.last = bids, asks, last


class BookQuotes(Kernel):
    """Quotes after each F_LAST update, when both sides stand and the best prices or sizes have changed; at a clock's times the
    best levels that stand. An update of size 0 deletes; a CLEAR empties both sides."""

    reads = ("action", "side", "price", "size", "flags", "ts_event", "seq")
    output = "bid_price double, ask_price double, bid_size double, ask_size double, ts_event long, seq long"
    state = "bid double, ask double, last array<double>"
    #: Levels are kept beside the plain state, one entry each.
    levels = "price double, size double"
    F_LAST = 128

    def start(self):
        return BookState(Side(-1, {}), Side(1, {}))

    def top(self, book: BookState) -> tuple | None:
        b, a = book.bids.best, book.asks.best
        return None if b is None or a is None else (b, a, book.bids.levels[b], book.asks.levels[a])

    def update(self, book, rows):
        out = []
        for action, side, price, size, flags, t, seq in rows:
            if action == "CLEAR":
                book.bids.clear()
                book.asks.clear()
            else:
                own = book.bids if side == "BUY" else book.asks
                if action == "DELETE" or size == 0:
                    own.remove(price)
                else:
                    own.put(price, size)
            if flags & self.F_LAST and (new := self.top(book)) and new != book.last:
                book.last = new
                out.append((*new, t, seq))
        return out


class BookTops(BookQuotes):
    """The best levels of a book at the times of a clock only, null where a side is empty."""

    output = "ts_event long, bid_price double, ask_price double, bid_size double, ask_size double"

    def update(self, book, rows):
        super().update(book, rows)
        return []

    def snapshot(self, book, time):
        b, a = book.bids.best, book.asks.best
        return [(time, b, a, None if b is None else book.bids.levels[b], None if a is None else book.asks.levels[a])]
