"""Removal of repeated passages with a sorted array of suffixes, kept to those that can have an equal.

Two equal strings of SPAN bytes hold the same anchor, the first of their ANCHOR-byte pieces with the least hash, at the same
place. A document is cut into runs of suffixes with one anchor, some sixteen each. Chunks of documents first ask shards whether
their anchors are in another document; the suffixes of others have no equal and stay where they are. The rest, as runs of
SPAN - 1 bytes more than they have suffixes, are range-partitioned by their leading bytes from the anchor on, with splitters
that Spark samples, and sorted within each bucket by a multikey quicksort, eight bytes at a time, which gives each suffix the
smallest document with an equal one. Equal leading bytes are never split between buckets, so that no equal suffixes lie across a
boundary. Anchors with more than CROWD runs go as single suffixes under all their bytes, each once a chunk, so that no bucket
has many different suffixes under one leading key.

Messages between chunks and shards hold many anchors each as long as CHUNK / SHARD of the texts is well above a thousandth of a
percent (up to about a TB); beyond that they become a row for each anchor.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import finished, shared_dir, stored
from tidemark.llm.lm_score import _packed as packed_counts
from tidemark.llm.lm_score import _unpacked as unpacked_counts

#: Bytes of a string whose repetition counts, and of the piece that anchors it.
SPAN, ANCHOR = 50, 20
WIDTH = SPAN - ANCHOR + 1
#: Runs under one anchor, in all documents, from which on its suffixes go one by one.
CROWD = 4096
#: Bytes of texts in a chunk, and in all texts for a shard and a bucket of the table of chunks (about).
CHUNK, SHARD, BUCKET = 1 << 22, 1 << 24, 1 << 25
#: Bytes whose anchors are found at once, and rows of a bucket that are sorted at once (about).
AT_ONCE, ROWS = 1 << 19, 20_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number in the order of the bytes; zeros follow the end."""
    return np.ndarray(len(data), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))


class Runs:
    """Runs of suffixes with one anchor: the anchor's place and hash, the first suffix, how many."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, docs: np.ndarray):
        """data holds texts at bounds; those at the places docs count."""
        found = [tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))]
        starts, ends = bounds[docs], bounds[docs + 1]
        for a in range(0, len(data), AT_ONCE):
            found.append(self._of(data[a : a + AT_ONCE + SPAN - 1], a, np.clip(starts - a, 0, AT_ONCE), np.clip(ends - SPAN + 1 - a, 0, AT_ONCE)))
        self.anchor, self.key, self.first, self.n = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.searchsorted(bounds, self.first, "right") - 1
    
    @staticmethod
    def _of(data, at, starts, ends):
        suffixes = len(data) - SPAN + 1
        full = starts < ends
        if suffixes <= 0 or not full.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        word = _words(data).astype(np.uint64)
        m = len(data) - ANCHOR + 1
        key = chars.mix(word[:m] * _A + word[8 : m + 8] * _B + word[ANCHOR - 8 : m + ANCHOR - 8] * _C)
        value, place, width = (key >> np.uint64(32)).astype(np.uint32), np.arange(m, dtype=np.int32), 1
        while width < WIDTH:  # the first of the least in twice as many places, and at last in WIDTH
            step = min(width, WIDTH - width)
            left, right = value[:-step], value[step:]
            place = np.where(left <= right, place[:-step], place[step:])
            value = np.minimum(left, right)
            width += step
        change = np.zeros(suffixes + AT_ONCE + 1, np.int32)
        np.add.at(change, starts[full], 1)
        np.add.at(change, ends[full], -1)
        counts = np.cumsum(change)[:suffixes] > 0
        new = counts.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~counts[:-1]
        first = np.flatnonzero(new)
        before = np.append(0, np.cumsum(counts))
        n = np.diff(np.append(before[first], before[-1]))
        return place[first].astype(np.int64) + at, key[place[first]], first + at, n


def _buffer(docs: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk's documents, their bytes in a row, and where each begins."""
    table = pa.ipc.open_stream(docs).read_all()
    text = table.column("text").combine_chunks().cast(pa.large_binary())
    text = text.fill_null(b"")
    bounds = np.append(0, np.cumsum(pc.binary_length(text).to_numpy())).astype(np.int64)
    return table, np.frombuffer(b"".join(text.to_pylist()), np.uint8), bounds


def _chunks(documents: DataFrame) -> DataFrame:
    """(chunk, bytes, ids, t1, t2, docs): documents of about CHUNK bytes as one Arrow message; their ids and hashes beside it."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def packed():
            docs = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.select(["doc_id", "text"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(docs.select(["doc_id", "text"]))
            lists = [pa.ListArray.from_arrays([0, len(docs)], docs.column(c).combine_chunks()) for c in ("doc_id", "t1", "t2")]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([size]), *lists, pa.array([sink.getvalue().to_pybytes()])], names=["chunk", "bytes", "ids", "t1", "t2", "docs"])

        for batch in batches:
            start = 0
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for i, n in enumerate(lengths):
                if size and size + n > CHUNK:
                    held.append(batch.slice(start, i - start))
                    yield packed()
                    held, start, size, number = [], i, 0, number + 1
                size += n
            held.append(batch.slice(start))
        if sum(b.num_rows for b in held):
            yield packed()

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(77), "text").alias("t2"))
    return named.mapInArrow(run, "chunk long, bytes long, ids array<long>, t1 array<long>, t2 array<long>, docs binary")


def _copies(chunks: DataFrame) -> DataFrame:
    """(chunk, copies): places of documents whose whole text is that of one with a smaller doc_id."""
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "t1", "t2")).alias("place", "d")).select("chunk", "place", "d.*").where("ids is not null")
    rows = stored(rows, "ids")
    first = stored(rows.groupBy("t1", "t2").agg(F.min("ids").alias("least"), F.max("ids").alias("most")).where("least < most").select("t1", "t2", "least"), "firsts")
    return rows.join(first, ["t1", "t2"]).where("ids > least").groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias("copies"))


def _asking(runs: Runs, shards: int):
    """The runs' distinct keys by shard: (shard of each key, 32 bits of it, the key's number for each run).

    Keys are mixed once more: anchors have the least hashes, most of which would be the first shard's.
    """
    keys, at = np.unique(chars.mix(runs.key), return_inverse=True)
    return (keys >> np.uint64(32)).astype(np.int64) * shards >> 32, keys.astype(np.uint32), at


def _open(docs: bytes, copies: list[int] | None):
    table, data, bounds = _buffer(docs)
    ids = table.column("doc_id").combine_chunks()
    counts = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False)).copy()
    counts[copies or []] = False
    counts &= np.diff(bounds) >= SPAN
    return data, bounds, ids.fill_null(0).to_numpy(), Runs(data, bounds, np.flatnonzero(counts))


_ASKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _ask(shards: int):
    """For each chunk and shard the chunk's keys there; twice a key's runs, and one more if several documents have it."""

    def run(batches):
        for batch in batches:
            for chunk, docs, copies in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "copies")), strict=True):
                runs = _open(docs, copies)[-1]
                shard, keys, at = _asking(runs, shards)
                low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
                np.minimum.at(low, at, runs.doc)
                np.maximum.at(high, at, runs.doc)
                n = 2 * np.bincount(at, minlength=len(keys)) + (low < high)
                bounds = np.searchsorted(shard, np.arange(shards + 1))
                full = np.flatnonzero(np.diff(bounds)).tolist()
                parts = [slice(bounds[s], bounds[s + 1]) for s in full]
                columns = [full, [chunk] * len(full), [keys[p].tobytes() for p in parts], [packed_counts(n[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each message whether its keys are in one document (0), several (1), or several and under more than CROWD runs (2)."""
    lists = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in lists]
    _, at, messages = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    n = np.concatenate([unpacked_counts(x, k) for x, k in zip(table.column("n").to_pylist(), sizes, strict=True)])
    runs = np.bincount(at, n >> 1)
    several = (messages > 1) | (np.bincount(at, n & 1) > 0)
    code = (several * (1 + (runs > CROWD))).astype(np.uint8)[at]
    answers = [zlib.compress(x.tobytes(), 1) for x in np.split(code, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("chunk"), table.column("shard"), pa.array(answers, pa.binary())], names=["chunk", "shard", "codes"])


def _identity(data: np.ndarray, first: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes [first, first + length) and the anchor's place among them."""
    word = _words(np.concatenate([data, np.zeros(SPAN + WIDTH, np.uint8)]))
    one, two = (chars.mix(length.astype(np.uint64) << np.uint64(8) | at.astype(np.uint64) + k) for k in (np.uint64(1), np.uint64(1 << 60)))
    for k in range(0, SPAN + WIDTH - 1, 8):
        left = np.clip(length - k, 0, 8).astype(np.uint64)
        w = word[first + k].astype(np.uint64)
        w = np.where(left > 0, w >> (np.uint64(64) - np.maximum(left, 1) * np.uint64(8)), np.uint64(0))
        one, two = chars.mix(one * _A + w), chars.mix(two * _B + chars.mix(w ^ _C))
    return one, two


_FOUND = "chunk long, number int, place int, first int, doc long, content binary, at int, single boolean, last long"


def _send(left: pa.Table, right: pa.Table) -> pa.Table:
    """Runs and single suffixes of a chunk that may have an equal in another document; equal ones have one number, and the first
    of them the content."""
    out = []
    for chunk, docs, copies in zip(*(left.column(c).to_pylist() for c in ("chunk", "docs", "copies")), strict=True):
        data, bounds, ids, runs = _open(docs, copies)
        _, keys, at = _asking(runs, 1)
        right = right.sort_by("shard")
        codes = np.frombuffer(b"".join(zlib.decompress(x) for x in right.column("codes").to_pylist()), np.uint8)
        code = codes[at] if len(keys) else np.empty(0, np.uint8)
        whole, each = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        spread = np.repeat(each, runs.n[each])
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(runs.n[each]) - runs.n[each], runs.n[each])
        row = np.concatenate([whole, spread])
        single = np.arange(len(row)) >= len(whole)
        first = runs.first[row] + np.concatenate([np.zeros(len(whole), np.int64), inner])
        length = np.where(single, SPAN, runs.n[row] + SPAN - 1)
        place = runs.anchor[row] - first
        h1, h2 = _identity(data, first, length, place)
        doc = ids[runs.doc[row]]
        order = np.lexsort((doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(order)) - 1 if len(order) else np.empty(0, np.int64)
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        last = np.zeros(len(order), np.int64)
        last[order[new]] = doc[order[ends]]
        sent = np.zeros(len(order), bool)
        sent[order[new]] = True
        text = data.tobytes()
        content = [text[f : f + n] if s else None for f, n, s in zip(first.tolist(), length.tolist(), sent.tolist(), strict=True)]
        columns = [np.full(len(row), chunk), number, runs.doc[row].astype(np.int32), (first - bounds[runs.doc[row]]).astype(np.int32), doc]
        out.append(pa.table([*map(pa.array, columns), pa.array(content, pa.binary()), pa.array(place.astype(np.int32)), pa.array(single), pa.array(last)], names=[x.split()[0] for x in _FOUND.split(", ")]))
    return pa.concat_tables(out)


def sorted_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes at start in which equal ones (the same group and the same SPAN bytes) stand together, and which
    of that order begin another one.

    Multikey quicksort with eight bytes as a character: suffixes with equal bytes so far are a segment; a segment that differs in
    the next bytes is sorted by these and parts into smaller ones, others go on to the next bytes as they are.
    """
    word = _words(data)
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
        segment = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        value = word[start[order] + k].astype(np.uint64)
        differs = value != value[heads][segment]
        if not differs.any():
            continue
        mixed = np.zeros(len(heads), bool)
        mixed[segment[differs]] = True
        rows = np.flatnonzero(mixed[segment])
        by = rows[np.lexsort((value[rows], segment[rows]))]
        order[rows], value[rows] = order[by], value[by]
        new[1:] |= (value[1:] != value[:-1]) & (segment[1:] == segment[:-1])
    return order, new


_TOLD = "chunk long, number int, from int, to int, doc long"


def _compared(table: pa.Table) -> pa.Table:
    """For which suffixes [from, to) of a chunk's run which smallest document has an equal one, of the runs that are there in a
    document with a larger doc_id. Equal rows stand together and are compared as one."""
    table = table.combine_chunks()
    differs = {c: pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)).to_numpy() for c in ("key", "content", "at")}
    heads = np.append(0, np.flatnonzero(differs["key"] | differs["content"] | differs["at"]) + 1)
    members = np.diff(np.append(heads, table.num_rows))
    lowest = np.minimum.reduceat(table.column("doc").to_numpy(), heads)
    new = np.append(True, differs["key"])[heads]
    content = table.column("content").take(pa.array(heads)).combine_chunks()
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    data = np.frombuffer(content.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    n = np.diff(offsets) - SPAN + 1
    row = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    inner = np.arange(len(row)) - begin[row]
    anchor = table.column("at").to_numpy()[heads][row] - inner
    order, first = sorted_groups(data, offsets[:-1][row] + inner, (np.cumsum(new) - 1)[row] * SPAN + anchor)
    doc = lowest[row]
    least = np.empty(len(row), np.int64)
    least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    # stretches of a run's suffixes with one smallest document, and those that each of the run's equal rows is told
    starts = inner == 0
    starts[1:] |= least[1:] != least[:-1]
    at = np.flatnonzero(starts)
    to = np.append(at[1:], len(row)) - begin[row[at]]
    count = np.bincount(row[at], minlength=len(n))
    each = np.repeat(count, members)
    of = np.repeat(np.arange(table.num_rows), each)
    stretch = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(np.cumsum(count) - count, members), each)
    told = least[at[stretch]] < table.column("last").to_numpy()[of]
    of, stretch = of[told], stretch[told]
    columns = [table.column(c).to_numpy()[of] for c in ("chunk", "number")] + [inner[at[stretch]].astype(np.int32), to[stretch].astype(np.int32), least[at[stretch]]]
    return pa.table([*map(pa.array, columns)], names=[x.split()[0] for x in _TOLD.split(", ")])


def _buckets(batches) -> Iterator[pa.RecordBatch]:
    """_compared() for the sorted rows of a bucket, about ROWS at a time; rows of one key stay together."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < ROWS:
            continue
        table = pa.concat_tables(held).combine_chunks()
        key = table.column("key")
        same = pc.equal(key, key[len(key) - 1]).to_numpy()
        cut = len(same) - int(same.sum())  # the last key's rows may go on
        if cut:
            yield from _compared(table.slice(0, cut)).combine_chunks().to_batches()
        held = [table.slice(cut)]
        size = held[0].num_rows
    if size:
        yield from _compared(pa.concat_tables(held)).combine_chunks().to_batches()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


_GONE = "chunk long, place int, start int, length int"


def _spread(left: pa.Table, right: pa.Table) -> pa.Table:
    """What all rows of a chunk that have an equal in an earlier document lose: the bytes of the right's suffixes, as maximal
    stretches of each document."""
    right = right.sort_by([("number", "ascending")])
    number, begin, to, least = (right.column(c).to_numpy() for c in ("number", "from", "to", "doc"))
    own = left.column("number").to_numpy()
    low = np.searchsorted(number, own, "left")
    each = np.searchsorted(number, own, "right") - low
    row = np.repeat(np.arange(len(own)), each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + low[row]
    kept = least[at] < left.column("doc").to_numpy()[row]
    row, at = row[kept], at[kept]
    start = left.column("place").to_numpy()[row].astype(np.int64) << 32 | (left.column("first").to_numpy()[row] + begin[at])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + to[at] - begin[at] + SPAN - 1)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    length = end[np.append(heads[1:], len(start)) - 1] - start[heads] if len(heads) else heads
    place, start = start[heads] >> 32, start[heads] & 0xFFFFFFFF
    columns = [np.full(len(heads), left.column("chunk")[0].as_py() if len(own) else 0), place.astype(np.int32), start.astype(np.int32), length.astype(np.int32)]
    return pa.table([*map(pa.array, columns)], names=[x.split()[0] for x in _GONE.split(", ")])


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """What is left of each document of a chunk without the spans of right and without copies."""
    rows: list[tuple] = []
    for docs, copies in zip(left.column("docs").to_pylist(), left.column("copies").to_pylist(), strict=True):
        table, data, bounds = _buffer(docs)
        change = np.zeros(len(data) + 1, np.int32)
        begins = bounds[right.column("place").to_numpy()] + right.column("start").to_numpy()
        np.add.at(change, begins, 1)
        np.add.at(change, begins + right.column("length").to_numpy(), -1)
        gone = np.cumsum(change[:-1]) > 0
        copied = set(copies or [])
        for i, doc_id in enumerate(table.column("doc_id").to_pylist()):
            text, out = data[bounds[i] : bounds[i + 1]], gone[bounds[i] : bounds[i + 1]]
            if i in copied and len(text) >= SPAN:
                out = np.ones(len(text), bool)
            n = int(out.sum())
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if n else 0
            rows.append((doc_id, len(text), n, spans, hashlib.sha256((text[~out] if n else text).tobytes()).hexdigest()))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _removed(documents: DataFrame, name: str) -> DataFrame:
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    # a bucketed table: answers and spans come to the chunks, which are never moved
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    _chunks(documents).write.bucketBy(buckets, "chunk").option("path", shared_dir(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)
    copies = stored(_copies(chunks), "copies")
    marked = chunks.select("chunk", "docs").join(copies, "chunk", "left")
    asked = marked.mapInArrow(_ask(shards), "shard int, chunk long, keys binary, n binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answer, "chunk long, shard int, codes binary"), "answers")
    # the same for found: what a chunk is told of its runs comes to them, by their numbers
    found = marked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send, _FOUND)
    found.write.bucketBy(buckets, "chunk").option("path", shared_dir(spark, "found")).saveAsTable(f"{name}_found")
    found = spark.table(f"{name}_found")

    key = F.when(F.col("single"), F.concat(F.expr(f"substring(content, at + 1, {ANCHOR})"), "content")).otherwise(F.expr(f"substring(content, at + 1, {ANCHOR})"))
    rows = found.where("content is not null").select("content", "at", "single", "doc", "last", "chunk", "number")
    ranges = rows.repartitionByRange(key).withColumn("key", key).drop("single").sortWithinPartitions("key", "content", "at")
    told = stored(ranges.mapInArrow(_buckets, _TOLD), "told")
    gone = found.select("chunk", "number", "place", "first", "doc").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_spread, _GONE)
    return marked.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_cut, _RESULT)


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents (doc_id, text).

    A byte goes if it is covered by SPAN bytes of its own text that also start somewhere in a text with a smaller doc_id, both as
    they are before anything is removed; n_spans is the number of maximal runs of such bytes, kept_sha256 the hash of what is
    left. Texts are UTF-8 bytes, null ones empty; shorter ones than SPAN lose nothing. Rows of one doc_id lose nothing to one
    another, rows without doc_id neither lose bytes nor make others lose any. Repeated rows have equal results; other columns
    are not read.
    """
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    try:
        return finished(documents.sparkSession, lambda: _removed(documents, name), "kept")
    finally:
        for table in (name, f"{name}_found"):
            documents.sparkSession.sql(f"drop table if exists {table}")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of SPAN bytes that an earlier one has."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
