"""Frames that the operators share, and folds: state carried along each key's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY = ("instrument_id",)
ORDER = ("ts_event", "seq")


def running(by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> WindowSpec:
    """All rows of the key up to the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ordered(by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def last(k: int, by: Iterable[str] = BY, order: Iterable[str] = ORDER) -> WindowSpec:
    """The last k rows of the key, the current one included."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - k, Window.currentRow)


def running_sum(df: DataFrame, out: str, x: Column, by: Iterable[str] = BY, order: Iterable[str] = ORDER, bucket: int | None = None) -> DataFrame:
    """Adds the sum of x over the key's rows up to the current one.

    With `bucket`, a length in units of the first order column, only rows of one key and span are sorted together: each span is
    first summed, and a row for each key and span brings the sum of all earlier ones, so that one hot key spreads over many
    tasks. Null keys are one key, rows without a time come first.
    """
    by, order = list(by), list(order)
    if bucket is None:
        return df.withColumn(out, F.sum(x).over(running(by, order)))
    rows = df.withColumns({"_x": x, "_span": F.call_function("div", F.col(order[0]), F.lit(bucket))})
    spans = rows.groupBy(*by, "_span").agg(F.sum("_x").alias("_x"))
    earlier = F.sum("_x").over(ordered(by, ["_span"]).rowsBetween(Window.unboundedPreceding, -1))
    brought = spans.select(*by, "_span", earlier.alias("_x")).withColumn("_row", F.lit(False))
    both = rows.withColumn("_row", F.lit(True)).unionByName(brought, allowMissingColumns=True)
    return both.withColumn(out, F.sum("_x").over(running([*by, "_span"], ["_row", *order]))).where("_row").drop("_x", "_span", "_row")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, for rounds that build on it: a checkpoint in the shared folder, which also ends the lineage; where
    no folder is set, kept by the executors and computed anew if one is lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def fold(df: DataFrame, by: Iterable[str], order: Iterable[str], start: Callable, step: Callable, schema, end: Callable | None = None) -> DataFrame:
    """Carries state along each key's rows: step(state, rows) -> (output rows, state), for consecutive rows of one key; end(key,
    state) -> output rows, after a key's last.

    Spark sorts (and spills) each partition, and a task sees its rows batch by batch, so no key is ever held as a whole.
    Null keys are one key.
    """
    by, order = list(by), list(order)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[by].astype(object).where(pdf[by].notna(), None)
            new = (keys != keys.shift()).any(axis=1) & ~((keys.isna() & keys.shift().isna()).all(axis=1))
            cuts = [0, *[i for i in np.flatnonzero(new.to_numpy()) if i], len(pdf)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = tuple(keys.iloc[a])
                if own != key or state is None:
                    if end and state is not None:
                        yield end(key, state)
                    key, state = own, start()
                out, state = step(state, pdf.iloc[a:b])
                if len(out):
                    yield out
        if end and state is not None:
            yield end(key, state)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def affine(df: DataFrame, out: str, by: Iterable[str] = BY, order: Iterable[str] = ORDER, chunk: str | None = None) -> DataFrame:
    """Adds y where y = a * y_before + b, and y = seed in a key's first row; a, b and seed are columns of df and are dropped.

    With a chunk column (that rises with the order) one key spreads over many tasks: each chunk is first reduced to one map
    (A, B), the few maps of a key are composed in order, and each chunk is replayed from the value carried into it. Results
    agree with one pass but for the last bits. A null seed or b leaves the value as it was.
    """
    by, order = list(by), list(order)
    plain = T.StructType([f for f in df.schema.fields if f.name not in ("a", "b", "seed")])
    schema = T.StructType([*plain.fields, T.StructField(out, T.DoubleType())])

    def replay(y, pdf):
        values = np.empty(len(pdf))
        for i, (a, b, seed) in enumerate(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["seed"].tolist(), strict=True)):
            new = seed if y is None else a * y + b
            y = y if new != new else new
            values[i] = np.nan if y is None else y
        rest = pdf[[f.name for f in plain.fields]].copy()
        rest[out] = values
        return rest, _Carry(y)

    if chunk is None:
        return fold(df, by, order, lambda: _Carry(None), lambda s, pdf: replay(s.y, pdf), schema)

    keys = T.StructType([f for f in df.schema.fields if f.name in (*by, chunk)])
    part = T.StructType([*keys.fields, T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType()), T.StructField("_first", T.DoubleType())])

    def reduce(batches):
        key, total = None, None
        names = [f.name for f in keys.fields]

        def row():
            return pd.DataFrame([[*key, total[0], total[1], np.nan if total[2] is None else total[2]]], columns=[*names, "_a", "_b", "_first"])

        for pdf in batches:
            for own, a, b, seed in zip(pdf[names].itertuples(index=False, name=None), pdf["a"], pdf["b"], pdf["seed"], strict=True):
                if own != key:
                    if key is not None:
                        yield row()
                    key, total = own, [1.0, 0.0, None]
                if b == b:
                    total[0], total[1] = a * total[0], a * total[1] + b
                new = seed if total[2] is None else a * total[2] + b
                total[2] = total[2] if new != new else new
        if key is not None:
            yield row()

    cut = df.repartition(*by, chunk).sortWithinPartitions(*by, chunk, *order)
    maps = cut.select(*keys.fieldNames(), "a", "b", "seed").mapInPandas(reduce, part)

    def compose(y, pdf):
        values = np.empty(len(pdf))
        for i, (a, b, first) in enumerate(zip(pdf["_a"], pdf["_b"], pdf["_first"], strict=True)):
            values[i] = np.nan if y is None else y
            new = first if y is None else a * y + b
            y = y if new != new else new
        rest = pdf[keys.fieldNames()].copy()
        rest["_in"] = values
        return rest, _Carry(y)

    carried = fold(maps, by, [chunk], lambda: _Carry(None), lambda s, pdf: compose(s.y, pdf), T.StructType([*keys.fields, T.StructField("_in", T.DoubleType())]))

    def resume(s, pdf):
        y = s.y
        if not s.begun:
            x = pdf["_in"].iloc[0]
            y = None if x != x else x
        rest, after = replay(y, pdf)
        after.begun = True
        return rest, after

    names = {c: f"_{i}" for i, c in enumerate(keys.fieldNames())}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = df.join(carried.withColumnsRenamed(names), same).drop(*names.values())
    return fold(joined, [*by, chunk], order, lambda: _Carry(None), resume, schema)


class _Carry:
    """A value carried along a key; None before the first."""

    def __init__(self, y):
        self.y, self.begun = y, False


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero and NaN as 0 and null, for comparing results."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        out.append((F.when(~F.isnan(c), F.round(c, digits) + 0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*out)
