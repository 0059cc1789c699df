"""A trie of conversation prefixes by van Emde Boas recursion, in rounds of joins that halve the height.

A subproblem is the part of the trie below a node of depth a, 2^(k+1) high; its strings are the distinct sequences there, each
by its smallest conversation and its number of conversations. It is cut at half its height: prefixes up to the cut are named by
their smallest conversation; the names are the strings of the upper trie, what follows a cut prefix is a string of the lower
trie below that name. All subproblems of one height are rows of one table, so a round is a join and an aggregate; after as many
rounds as the height has bits every string is one edge. Prefixes are compared by hashes of aligned blocks of turns, made
bottom-up by pairs.

Totals are grafted upward over the same cuts: first every root of a subproblem gets the sum over the subproblem, lower ones
added to their roots' cuts; then, from the tallest down, what hangs below the bottom of a node's own subproblem.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import finished, part, stored

#: How many first turns a conversation takes from another one at most, less one; conversations that share such turns.
TURNS, FAMILY = 9, 5
#: Bytes of one piece of a long list of ids.
PIECE = 1 << 16


def _hashes(*columns, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), *columns).alias("k1"), F.xxhash64(F.lit(~seed), *columns).alias("k2")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, bytes): turns in order from 0, a turn's hashes and its text's UTF-8 bytes.

    Rows are sorted by ranges, so that one long conversation spreads over tasks; a row for each task brings what the
    conversation at its start had before.
    """

    def count(batches):
        task, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = conv[0] != last
            heads = np.flatnonzero(new)
            start = np.zeros(len(conv), np.int64)
            start[heads] = heads
            index = np.arange(len(conv)) - np.maximum.accumulate(start)
            index[: heads[0] if len(heads) else len(conv)] += at
            last, at = conv[-1], int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), task, np.int32)), pa.array(index), *batch.columns], names=["task", "index", *batch.schema.names])

    order = ["conv_id", "turn", "role", "text", "salt"]
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("salt")
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *_hashes(F.octet_length("role"), "role", "text", seed=1), F.octet_length("text").alias("bytes"))
    rows = stored(rows.mapInArrow(count, "task int, index long, conv_id long, k1 long, k2 long, bytes int"), "turns")
    tasks = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    later = stored(tasks.withColumn("before", before).where("before > 0").select("conv_id", "task", "before"), "later")  # a row for each task at most
    return rows.join(F.broadcast(later), ["conv_id", "task"], "left").select("conv_id", (F.col("index") + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and (conv_id, pos, k1, k2, bytes) of its turns, once its first turns have given
    way to those of the first of its family."""
    turns = stored(turns, "numbered")
    own = stored(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "lengths")
    # the crc32 of decimal digits
    named = own.withColumns({"h": part("conv_id", TURNS), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    first = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = named.join(heads, "base", "left").select("conv_id", "base", "h", first.alias("first"), (first + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))
    convs = stored(convs, "convs")
    taken = turns.where((F.col("pos") < TURNS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos < h")
    fewer = convs.where("first < h").select("conv_id", (F.col("h") - F.col("first")).alias("less"))
    kept = turns.where(F.col("pos") >= part("conv_id", TURNS)).join(fewer, "conv_id", "left").withColumn("pos", F.col("pos") - F.coalesce("less", F.lit(0)))
    columns = ["conv_id", "pos", "k1", "k2", "bytes"]
    return convs.select("conv_id", "length"), stored(taken.select(columns).unionByName(kept.select(columns)), "rebuilt")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """(conv_id, j, k1, k2, size) of the aligned blocks of 2^k turns, for each k up to levels: hashes of a block's turns."""
    out = [turns.select("conv_id", F.col("pos").alias("j"), "k1", "k2", F.lit(1).cast("long").alias("size"))]
    odd = F.col("j") % 2 == 1
    for k in range(1, levels + 1):
        sides = [F.max(F.when(odd if right else ~odd, F.col(c))).alias(f"{c}_{right}") for right in (0, 1) for c in ("k1", "k2")]
        pairs = out[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(*sides, F.sum("size").alias("size"))
        out.append(stored(pairs.select("conv_id", "j", *_hashes("k1_0", "k2_0", "k1_1", "k2_1", seed=1 + k), "size"), "blocks"))
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, member): members in order, joined by commas. Lists go on from task
    to task in pieces, so a node of many members is neither sorted nor held by one task."""

    def pieces(batches):
        task = TaskContext.get().partitionId()
        node, held, size, number, whole = None, [], 0, 0, False  # whole: nothing of it went out, and it isn't the task's first
        out: list[tuple] = []

        def close(last: bool):
            text = ",".join(map(str, held))
            out.append((*node, task, number, text, None) if last or not whole else (*node, task, number, None, hashlib.sha256(text.encode()).hexdigest()))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        kinds, names = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()], ["conv_id", "depth", "task", "number", "text", "ends_sha256"]
        for batch in batches:
            conv, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])
            cuts = [*np.flatnonzero(new).tolist(), len(conv)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = (int(conv[a]), int(depth[a]))
                if now != node:
                    if node:
                        close(False)
                    whole, node, held, size, number = node is not None, now, [], 0, 0
                held += member[a:b].tolist()
                size += 8 * (b - a)
                if size > PIECE:
                    out.append((*node, task, number, ",".join(map(str, held)), None))
                    held, size, number, whole = [], 0, number + 1, False
            if out:
                yield batch_of(out)
                out.clear()
        if node:
            close(True)
            yield batch_of(out)

    def joined(batches):
        node, digest, empty = None, None, True
        for batch in batches:
            out = []
            for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text")), strict=True):
                if (conv, depth) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest, empty = (conv, depth), hashlib.sha256(), True
                if text:
                    digest.update((text if empty else f",{text}").encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), x, strict=True)) for x in out])
        if node:
            yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": digest.hexdigest()}])

    order = ["conv_id", "depth", "member"]
    ranges = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    made = stored(ranges.mapInArrow(pieces, "conv_id long, depth long, task int, number int, text string, ends_sha256 string"), "pieces")
    rest = made.where("ends_sha256 is null").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "task", "number").select("conv_id", "depth", "text")
    return made.where("ends_sha256 is not null").select("conv_id", "depth", "ends_sha256").unionByName(rest.mapInArrow(joined, "conv_id long, depth long, ends_sha256 string"))


def _recursion(top: DataFrame, levels: list[DataFrame], root: int) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Edges, terminals and cuts of the strings (rep, n, len).

    Edges: (root, a, rep, n): node rep at depth a + 1 below node root. Terminals: (rep, name, len): where a string ends. Cuts, by
    the bits of their height: (name, root, a), and (below, name, depth) of nodes a whole height below a cut prefix.
    """
    key = ["root", "a", "k1", "k2"]
    strings = top.select(F.lit(root).cast("long").alias("root"), F.lit(0).cast("long").alias("a"), "rep", "n", "len", F.lit(True).alias("own"))
    terminals, cuts = None, []
    for k in reversed(range(len(levels) - 1)):
        half = 1 << k
        reach = F.col("len") >= F.col("a") + half
        block = levels[k].select(F.col("conv_id").alias("rep"), F.shiftleft("j", k).alias("a"), "k1", "k2")
        keyed = stored(strings.where(reach).join(block, ["rep", "a"]), "keyed")
        named = stored(keyed.groupBy(*key).agg(F.min("rep").alias("name"), F.sum("n").alias("n")), "named")
        cut = stored(keyed.join(named.select(*key, "name"), key).select("root", "a", "name", "rep", "n", "len", "own"), "cut")
        ends = cut.where((F.col("len") == F.col("a") + half) & F.col("own")).select("rep", "name", "len")
        terminals = ends if terminals is None else terminals.unionByName(ends)
        below = cut.where(F.col("len") == F.col("a") + 2 * half).select(F.col("rep").alias("below"), "name", (F.col("a") + half).alias("depth"))
        cuts.append((named.select("name", "root", "a"), below))
        upper = named.select("root", "a", F.col("name").alias("rep"), "n", (F.col("a") + half).alias("len"), F.lit(False).alias("own"))
        lower = cut.where(F.col("len") > F.col("a") + half).select(F.col("name").alias("root"), (F.col("a") + half).alias("a"), "rep", "n", "len", "own")
        strings = stored(strings.where(~reach).unionByName(upper).unionByName(lower), "strings")
    return strings, terminals, cuts[::-1]


def _grafted(nodes: DataFrame, cuts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(conv_id, depth, leaves, saved) summed over subtrees, of nodes' own (conv_id, depth, leaves, saved)."""
    at, sums = ["conv_id", "depth"], [F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")]

    def added(some: DataFrame, more: DataFrame) -> DataFrame:
        plus = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        return some.join(more.groupBy(*at).agg(*sums), at, "left").select(*at, *plus)

    now, waiting = nodes, []
    for k, (named, _) in enumerate(cuts):
        half = 1 << k
        links = named.select(F.col("name").alias("conv_id"), (F.col("a") + half).alias("depth"), "root", "a")
        more = links.join(now, at).select(F.col("root").alias("conv_id"), F.col("a").alias("depth"), "leaves", "saved")
        waiting.append(now.where(F.col("depth") % (2 * half) != 0))
        now = stored(added(now.where(F.col("depth") % (2 * half) == 0), more), "sums")
    for k in reversed(range(len(cuts))):
        links = cuts[k][1].select(F.col("below").alias("conv_id"), (F.col("depth") + (1 << k)).alias("depth"), "name")
        more = links.join(now, at).select(F.col("name").alias("conv_id"), (F.col("depth") - (1 << k)).alias("depth"), "leaves", "saved")
        now = now.unionByName(stored(added(waiting[k], more), "sums"))
    return now


def _trie(conversations: DataFrame) -> DataFrame:
    convs, turns = rebuilt(numbered(conversations))
    facts = convs.agg(F.min("conv_id").alias("root"), F.max("length").alias("longest"), F.count("*").alias("n")).first()
    root = facts["root"] or 0
    levels = blocks(turns, (facts["longest"] or 0).bit_length())
    whole = levels[-1].select("conv_id", "k1", "k2", "size")
    top = stored(whole.groupBy("k1", "k2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("len")), "top")
    edges, terminals, cuts = _recursion(top, levels, root)

    depth = (F.col("a") + 1).alias("depth")
    bytes_of = turns.select(F.col("conv_id").alias("rep"), F.col("pos").alias("a"), "bytes")
    children = edges.groupBy(F.col("root").alias("conv_id"), F.col("a").alias("depth")).agg(F.count("*").alias("n_children"))
    inner = edges.join(bytes_of, ["rep", "a"]).select(F.col("rep").alias("conv_id"), depth, F.col("root").alias("parent_conv_id"), F.col("n").alias("n_convs"), "bytes")
    above = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null").selectExpr("conv_id", "0L as depth", "cast(null as long) as parent_conv_id", "n_convs", "0 as bytes")
    nodes = inner.unionByName(above).join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = stored(nodes, "nodes")
    own = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    ends = convs.where("length = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    if terminals is not None:
        places = stored(top.select("k1", "k2", "rep").join(terminals, "rep").select("k1", "k2", "name", "len"), "places")
        ends = ends.unionByName(whole.join(places.hint("merge"), ["k1", "k2"]).select(F.col("name").alias("conv_id"), F.col("len").alias("depth"), F.col("conv_id").alias("member")))
    out = nodes.join(_grafted(own, cuts), ["conv_id", "depth"]).join(_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Turns are in order of turn (null first), then role, then text; null roles and texts are empty; repeated rows are turns of
    their own; rows without conv_id are left out; other columns are not read. The first crc32(conv_id) modulo TURNS turns of a
    conversation are replaced by as many of the first of its family of FAMILY (fewer or none, if it has no more). A node is a
    distinct sequence of first turns, the root being the empty one: conv_id (its smallest member), depth, parent_conv_id, n_convs
    (members), n_children, n_leaves and saved_tokens (over its subtree, with itself; bytes of the last turn's text for every
    member but one), ends_sha256 (of the members that end here, in numerical order, joined by commas). An empty table has no
    nodes.
    """
    return finished(conversations.sparkSession, lambda: _trie(conversations), "trie")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
