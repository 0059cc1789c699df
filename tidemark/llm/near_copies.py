"""N-gram Jaccard join by chosen paths: sets split again and again on sampled shared tokens, small buckets compared outright.

A set is a text's word shingles. Each run starts one path for all sets; a node of a path chooses some of the HASHES min-wise
coordinates by a hash of the node alone, and a set goes on to a child for each chosen coordinate and its own value there, so
sets part unless they agree. A bucket of LEAF sets or fewer, one most of whose sets agree in two more coordinates (so that its
pairs are about as many as its links), and whatever is left after DEPTH rounds, is compared outright.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import by_blocks, stored, text_slices, texts_of
from tidemark.llm.graph import components, local_roots

WORDS = 5
THRESHOLD = 0.8
#: Min-wise coordinates of a set.
HASHES = 64
LEAF, DEPTH, SAME = 64, 4, 0.6
#: Share of pairs at the threshold that may be missed, also in buckets that go through all rounds.
MISSED = 1e-4


def _shares() -> list[float]:
    """How likely a pair at the threshold agrees in 0, 1, .. HASHES coordinates."""
    return [math.comb(HASHES, m) * THRESHOLD**m * (1 - THRESHOLD) ** (HASHES - m) for m in range(HASHES + 1)]


def missed(runs: int, alike: int) -> float:
    """Share of pairs at the threshold that agree in fewer than `alike` coordinates or part in every one of the runs.

    A node's children in which a pair stays together are its chosen coordinates among those that agree, so a run is a
    branching process, and the runs are independent given the number of coordinates that agree.
    """
    out, chosen = 0.0, 1 / (THRESHOLD * HASHES)
    for m, share in enumerate(_shares()):
        parted = 0.0
        for _ in range(DEPTH):
            parted = (1 - chosen + chosen * parted) ** m
        out += share * (parted**runs if m >= alike else 1)
    return out


#: Pairs that agree in so many of the HASHES coordinates are checked exactly: of those at the threshold all but MISSED / 4.
ALIKE = next(m for m in range(HASHES + 1) if sum(_shares()[: m + 1]) > MISSED / 4)
RUNS = next(n for n in range(1, 1000) if missed(n, ALIKE) <= MISSED)
#: Sets, and shingles, in one part of a bucket (about).
PART_SETS, PART_SHINGLES = 1024, 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, sorted, and where each text's begin.

    Words are runs without white space in lower case. A text of fewer words is one shingle; an empty one has none.
    """
    h, at = chars.token_hashes([t.lower() for t in texts], chars.spaces_only())
    n = np.diff(at)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        part = h[k:] if k else h
        rolled[: len(part)] = rolled[: len(part)] * _STEP + part
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.repeat(at[:-1], size) + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    own = chars.mix(rolled[place])
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():  # all words of a short text
        value = n[i : i + 1].astype(np.uint64)
        for k in range(at[i], at[i + 1]):
            value = chars.mix(value * _STEP + h[k : k + 1])
        own[np.searchsorted(doc, i)] = value[0]
    order = np.lexsort((own, doc))
    doc, own = doc[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    doc, own = doc[new], own[new]
    return own, np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int64)


def sketches(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-wise values (sets, HASHES); rows of empty sets are 0."""
    full = at[:-1] < at[1:]
    out = np.zeros((len(at) - 1, HASHES), np.uint32)
    if full.any():
        starts = at[:-1][full]
        for k in range(HASHES):
            factor, shift = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF), np.uint64(0x2545F4914F6CDD1D * (k + 1) & 0xFFFFFFFFFFFFFFFF)
            v = (own + shift) * factor
            v ^= v >> np.uint64(29)
            out[full, k] = np.minimum.reduceat(((v * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def children(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each row's children: 1 / THRESHOLD coordinates are chosen for a node on average."""
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    pick = chars.mix(path[:, None] * np.uint64(3) + chars.mix(k)[None])
    row, col = np.nonzero(pick < np.uint64(int(2**64 / (THRESHOLD * HASHES))))
    return row, chars.mix(pick[row, col] ^ chars.mix(sketch[row, col].astype(np.uint64) + np.uint64(1)))


def probes(path: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A hash of each row's values in two coordinates that are the same for all sets of a bucket."""
    row = np.arange(len(path))
    one, two = (sketch[row, ((path >> np.uint64(s)) % np.uint64(HASHES)).astype(np.int64)].astype(np.uint64) for s in (9, 31))
    return (chars.mix(one * np.uint64(3) + chars.mix(two)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(-1, HASHES)


def sets_of(documents: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text (t1, t2), two of the set of shingles, its size and its sketch of every row; the set's
    hashes are null where there are no words."""

    def run(batches):
        for batch in batches:
            own_columns, texts = [batch.column(c) for c in ("doc_id", "t1", "t2")], texts_of(batch)
            for a, b in text_slices(texts):
                own, at = shingles(texts[a:b])
                n = np.diff(at)
                k1 = chars.segment_sums_u64(own, at).view(np.int64)
                k2 = chars.segment_sums_u64(chars.mix(own ^ _STEP), at).view(np.int64)
                sk = sketches(own, at)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in own_columns), pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(n), pa.array([x.tobytes() for x in sk], pa.binary())],
                    names=["doc_id", "t1", "t2", "k1", "k2", "size", "sketch"],
                )

    return keyed(documents).mapInArrow(run, "doc_id long, t1 long, t2 long, k1 long, k2 long, size long, sketch binary")


def keyed(documents: DataFrame, *others: str) -> DataFrame:
    """doc_id and two hashes of the text (t1, t2), which tell rows of one doc_id apart, the text, and other columns."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(77), "text").alias("t2"), "text", *others)


def buckets(sets: DataFrame) -> DataFrame:
    """(path, rep, n) of sets that share a final bucket with another one; n is the bucket's size."""
    schema = "path long, rep long, probe int"

    def split(roots: bool):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sk = _sketch(batch)
                starts = chars.mix(np.arange(1, RUNS + 1, dtype=np.uint64)) if roots else [None]
                for start in starts:
                    path = np.full(len(sk), start, np.uint64) if roots else batch.column("path").to_numpy().view(np.uint64)
                    row, child = children(path, sk)
                    columns = [pa.array(child.view(np.int64)), batch.column("rep").take(pa.array(row)), pa.array(probes(child, sk[row]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "rep", "probe"])

        return run

    now, out = sets.select("rep", "sketch").mapInArrow(split(True), schema), []
    for depth in range(1, DEPTH + 1):
        paths = stored(now, "paths")
        # stored first, so that the paths meet it in a join of two plain tables, whose hot keys Spark can split
        count = stored(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "counts")
        shared = stored(paths.join(count.hint("merge"), "path"), "shared")
        large = shared.where(F.col("n") > LEAF)
        if depth == DEPTH or large.isEmpty():
            out.append(shared)
            break
        if depth == 1:  # the sketches of those that share anything
            sets = stored(sets.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "sketch"), "sketches")
        alike = large.groupBy("path", "n", "probe").agg(F.count("*").alias("top")).groupBy("path", "n").agg(F.max("top").alias("top"))
        split_again = stored(alike.where(F.col("top") < SAME * F.col("n")).select("path"), "split")
        out += [shared.where(F.col("n") <= LEAF), large.join(split_again, "path", "left_anti")]
        more = large.join(split_again, "path", "left_semi").select("path", "rep")
        now = more.join(sets.select("rep", "sketch"), "rep").select("path", "rep", "sketch").mapInArrow(split(False), schema)
    found = out[0].select("path", "rep", "n")
    for x in out[1:]:
        found = found.unionByName(x.select("path", "rep", "n"))
    return found


def few(found: DataFrame) -> DataFrame:
    """(path, rep) of the buckets, where two sets that are alone together in several buckets keep one of these."""
    pairs = found.where("n = 2").groupBy("path").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.min("path").alias("path")).select("path", F.explode(F.array("a", "b")).alias("rep"))
    return found.where("n > 2").select("path", "rep").distinct().unionByName(pairs)


def _grid(rows: DataFrame) -> DataFrame:
    """Deals each bucket's sets to parts of bounded size, and every pair of parts to a block (path, one, two), one <= two."""
    size = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / PART_SETS), F.ceil(F.col("total") / PART_SHINGLES)).cast("int")
    many = stored(size.select("path", parts.alias("parts")).where("parts > 1"), "parts")
    rows = rows.join(many, "path", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(23), "rep"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("parts", "other")


def _met(table: pa.Table, path: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a bucket of a smaller number, and are left to it: a product of 0/1 matrices."""
    paths = table.column("paths").combine_chunks()
    flat, bounds = paths.flatten().to_numpy(), np.append(0, np.cumsum(paths.value_lengths().to_numpy()))
    row = np.repeat(np.arange(len(paths)), np.diff(bounds))
    row, flat = row[flat < path], flat[flat < path]
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1 if len(flat) else np.zeros(0, bool)
    row, code = row[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    out = np.zeros((len(left), len(right)), bool)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        x, y = np.searchsorted(code, [low, low + 4096])
        m = np.zeros((len(paths), min(4096, int(code[y - 1]) + 1 - low)), np.float32)
        m[row[x:y], code[x:y] - low] = 1
        out |= (m[left] @ m[right].T) > 0
    return out


def _candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that this block has to answer for: likely similar, and in no earlier bucket together."""
    sizes = table.column("size").to_numpy()
    if len(sizes) < 2 or len(sizes) == 2 and sizes.min() < THRESHOLD * sizes.max():
        return np.empty(0, np.int32), np.empty(0, np.int32)
    path = table.column("path")[0].as_py()
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    own = table.column("own").to_numpy()
    sk = _sketch(table)
    if len(sizes) <= 16 and one == two:  # most buckets: first see whether any sets are alike
        alike = (sk[:, None] == sk[None]).sum(2) >= ALIKE
        if alike.sum() == len(sizes):
            return np.empty(0, np.int32), np.empty(0, np.int32)
    left = np.flatnonzero(own == one)
    right = left if one == two else np.flatnonzero(own == two)
    pairs = [np.empty((2, 0), np.int32)]
    met = _met(table, path, left, right) if len(left) and len(right) else None
    for a in range(0, len(left) if met is not None else 0, 256):
        rows = left[a : a + 256]
        open_ = ~met[a : a + 256] & (rows[:, None] < right[None] if one == two else True)
        low, high = np.minimum(sizes[rows][:, None], sizes[right][None]), np.maximum(sizes[rows][:, None], sizes[right][None])
        open_ &= low >= THRESHOLD * high
        if not open_.any():
            continue
        same = np.zeros(open_.shape, np.uint8)
        for k in range(HASHES):
            same += sk[rows, k][:, None] == sk[right, k][None]
        i, j = np.nonzero(open_ & (same >= ALIKE))
        pairs.append(np.array([rows[i], right[j]], np.int32))
    a, b = np.concatenate(pairs, axis=1)
    return a, b


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common shingles of the pairs (a[i], b[i]) of sets: products of 0/1 matrices, a slab of shingles at a time."""
    out = np.zeros(len(a), np.int32)
    if len(a) <= 4 * len(sets):  # few pairs: merge them one by one
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            out[k] = (both[1:] == both[:-1]).sum()
        return out
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    rows, code = rows[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    one, at_one = np.unique(a, return_inverse=True)
    two, at_two = np.unique(b, return_inverse=True)
    for low in range(0, int((count > 1).sum()), 2048):
        x, y = np.searchsorted(code, [low, low + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[rows[x:y], code[x:y] - low] = 1
        out += (m[one] @ m[two].T).astype(np.int32)[at_one, at_two]
    return out


def _key() -> Column:
    return F.xxhash64(F.lit(5), "doc_id", "t1", "t2")


def _sieve(wanted: DataFrame):
    """A bitmap of the keys' hashes, of 16 bits a key and 4 MB at most, that keeps most other texts from being moved. Beyond
    some 30 million keys it lets ever more through; the join after it decides."""
    size = min(25, max(10, (16 * wanted.count()).bit_length()))

    def run(batches):
        bits = np.zeros(1 << size, np.uint8)
        for batch in batches:
            bits[batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - size)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], names=["bits"])

    rows = wanted.select(_key().alias("h")).coalesce(16).mapInArrow(run, "bits binary").collect()  # 16 bitmaps at most
    bits = np.zeros(1 << (size - 3), np.uint8)
    for r in rows:
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast((bits, 64 - size))


def join(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of each distinct set and the membership of documents.

    facts: k1, k2 (the set's hashes), weight (documents with it), n (documents of other sets linked to it), class (doc_id, t1
    and t2 of the first row, by these, that links lead to); membership: doc_id, t1, t2, k1, k2. Equal sets are put together
    first, so copies are never paired with one another; a set is a node by a number of its own (rep).
    """
    marked = stored(sets_of(documents), "sets")
    sets = marked.where("size > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
    )
    sets = stored(sets.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    found = stored(few(buckets(sets)), "buckets")
    lists = found.groupBy("rep").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a few dozen for each set
    known = stored(lists.join(sets.select("rep", "size", "sketch"), "rep"), "known")
    rows = found.join(known, "rep")

    nothing = pa.table({"path": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())})

    def likely(table: pa.Table) -> pa.Table:
        a, b = _candidates(table)
        if not len(a):
            return nothing
        rep = table.column("rep").to_numpy()
        both = np.unique(np.concatenate([rep[a], rep[b]]))
        return pa.table({"path": pa.array([table.column("path")[0].as_py()] * len(both), pa.int64()), "rep": pa.array(both, pa.int64())})

    block = ["path", "one", "two"]
    involved = stored(by_blocks(_grid(rows), block, likely, "path long, rep long").distinct(), "likely")

    # the shingles of those that may have a partner, and nobody else's
    wanted = involved.select("rep").distinct().join(sets.select("rep", "first", "weight"), "rep").select("rep", "weight", "first.*")
    wanted = stored(wanted, "wanted")

    sieve = _sieve(wanted)

    def own(batches):
        bits, shift = sieve.value
        for batch in batches:
            key = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(shift)
            batch = batch.filter(pa.array(np.unpackbits(bits[key >> np.uint64(3)][:, None], axis=1, bitorder="little")[np.arange(len(key)), key & np.uint64(7)] == 1))
            texts = texts_of(batch)
            for x, y in text_slices(texts):
                s, at = shingles(texts[x:y])
                columns = [batch.column(c).slice(x, y - x) for c in ("doc_id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s[at[i] : at[i + 1]].tobytes() for i in range(y - x)], pa.binary())], names=["doc_id", "t1", "t2", "shingles"])

    made = keyed(documents).where("text is not null and doc_id is not null").withColumn("h", _key()).mapInArrow(own, "doc_id long, t1 long, t2 long, shingles binary")
    bags = stored(made.join(wanted, ["doc_id", "t1", "t2"]).select("rep", "weight", "shingles").dropDuplicates(["rep"]), "bags")

    def exact(table: pa.Table) -> pa.Table:
        a, b = _candidates(table)
        rep, weight, sizes = (table.column(c).to_numpy() for c in ("rep", "weight", "size"))
        if len(a):
            bag = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
            common = _overlaps(bag, a, b)
            near = common * (1 + THRESHOLD) >= THRESHOLD * (sizes[a] + sizes[b]) - 1e-9
            a, b = a[near], b[near]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        nodes, root = local_roots(rep[a], rep[b])
        linked = np.flatnonzero(n)
        count = np.bincount(np.searchsorted(nodes, rep[linked]), weights=n[linked], minlength=len(nodes)).astype(np.int64)
        return pa.table({"id": pa.array(nodes, pa.int64()), "n": pa.array(count, pa.int64()), "root": pa.array(root, pa.int64())})

    full = _grid(involved.join(known, "rep")).join(bags, "rep")
    links = stored(by_blocks(full, block, exact, "id long, n long, root long"), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = sets.select("k1", "k2", "rep", "weight", "first").join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(groups, F.col("rep") == F.col("id"), "left")
    facts = stored(facts.select("k1", "k2", "weight", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component")), "facts")
    heads = stored(facts.groupBy("component").agg(F.min("first").alias("class")), "heads")
    return facts.join(heads, "component").select("k1", "k2", "weight", "n", "class"), marked.select("doc_id", "t1", "t2", "k1", "k2")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), class_id (the smallest doc_id that links lead to), n_links (other documents linked
    directly) and kept (true for the class's first row by doc_id, t1 and t2, and its repetitions) of every row.

    Equal sets of shingles are links too. Null and empty texts and rows without doc_id have no links, are their own class and
    are kept. Rows that repeat a doc_id with other texts are told apart by their texts.
    """
    facts, members = join(documents)
    found = members.join(facts, ["k1", "k2"], "left")
    known = F.col("doc_id").isNotNull() & F.col("class").isNotNull()
    return found.select(
        "doc_id", "t1", "t2", F.when(known, F.col("class.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(known, F.col("n") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.col("class") == F.struct("doc_id", "t1", "t2")).otherwise(True).alias("kept"),
    )


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of THRESHOLD of shingles of WORDS words."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
