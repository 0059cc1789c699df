"""Spelling variants: words one edit apart, found by probing broadcast Bloom filters with generated edits.

Filters are sharded by the words' length and blocked (a word's bits lie in 64 bytes). A word's edits are generated in one
direction only, deletions and replacements by a larger letter, so each pair of near words is met once; edits that a filter
lets through are joined with the vocabulary, which removes false positives. Filters are broadcast FILTER_BYTES at a time: a
larger vocabulary is probed in several passes, each against the next part of the filters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chars
from tidemark.llm.common import finished, stored, texts_of

#: Words have so many code points and occurrences at least; a word's form is FACTOR times as frequent as the word.
LENGTH, COUNT, FACTOR = 6, 5, 5
#: One run in about so many loses a letter.
DAMAGE = 199
#: What words consist of after A-Z are lower-cased.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
#: Words of this length and longer share a shard of the filters.
LONG = 64
#: Filter bits for a word, bits that a word sets, 64-bit words of a block, blocks of a segment (64 kB).
BITS, PROBES, BLOCK, SEGMENT = 16, 6, 8, 1024
#: Bytes of filters that are broadcast at a time.
FILTER_BYTES = 1 << 25
#: Words that one task probes, about.
PROBED = 1 << 14
#: Edits that are generated at once, words that a task counts before it hands them on, bytes of text read at once.
AT_ONCE, HELD, PIECE = 1 << 20, 1 << 17, 1 << 20

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LENGTH)
_BREAK = re.compile(rb"[^a-z\xc0-\xff]")
_STEP = 0x9E3779B97F4A7C15


def _pieces(text: str) -> Iterator[bytes]:
    """The text in Latin-1 with a-z for A-Z, other characters as marks, cut where no run is."""
    data = text.encode("latin-1", "replace").lower()  # bytes.lower() knows A-Z only
    start = 0
    while start < len(data):
        end = _BREAK.search(data, start + PIECE)
        end = end.start() if end else len(data)
        yield data[start:end]
        start = end


def _counted(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for piece in _pieces(text):
                for run, n in Counter(_RUN.findall(piece)).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                    if h % DAMAGE == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < LENGTH:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
    if held:
        yield out()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): words of LENGTH letters that occur COUNT times at least, damaged as the crc32 of `doc_id:run` says."""
    counts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length as a matrix."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _placed(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's hash."""
    return chars.mix((place.astype(np.uint64) << np.uint64(21)) + letter.astype(np.uint64) + np.uint64(1))


def _of_length(sums: np.ndarray, length: int) -> np.ndarray:
    return chars.mix(sums + np.uint64(length * _STEP & 0xFFFFFFFFFFFFFFFF))


class Layout:
    """Where each length's shard lies: blocks [first, first + count) of the filters."""

    def __init__(self, words_by_length: dict[int, int]):
        words: Counter = Counter()
        for length, n in words_by_length.items():
            words[min(length, LONG)] += n
        self.first, self.count, end = {}, {}, 0
        for length in sorted(words):
            self.first[length], self.count[length] = end, -(-words[length] * BITS // (64 * BLOCK))
            end += self.count[length]
        self.blocks = end

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The block of each hash of a word of this length."""
        shard = min(length, LONG)
        return np.int64(self.first[shard]) + ((hashes >> np.uint64(32)) * np.uint64(self.count[shard]) >> np.uint64(32)).astype(np.int64)

    def lengths(self, low: int, high: int) -> list[int]:
        """Shards that have blocks in [low, high)."""
        return [k for k in self.first if self.first[k] < high and self.first[k] + self.count[k] > low]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """PROBES bit numbers within a block for each hash."""
    h = chars.mix(hashes ^ np.uint64(_STEP))
    return np.stack([(h >> np.uint64(9 * k)) & np.uint64(511) for k in range(PROBES)])


def passes(filters: np.ndarray, block: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set; block is counted from the start of filters."""
    at = np.arange(len(hashes))
    for bit in _bits(hashes):
        bit = bit[at]
        word = filters[block[at] * BLOCK + (bit >> np.uint64(6)).astype(np.int64)]
        at = at[(word >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def _set_bits(layout: Layout, low: int, high: int):
    """Segments of the filters' blocks [low, high) of a vocabulary: rows (segment, bits of one task), combined by segment."""

    def place(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, rows in _by_length(words):
                for a in range(0, len(rows), max(1, AT_ONCE // length)):
                    some = rows[a : a + max(1, AT_ONCE // length)]
                    h = _of_length(_placed(np.arange(length), _letters([words[i] for i in some])).sum(1, dtype=np.uint64), length)
                    block = layout.block(h, length)
                    here = (block >= low) & (block < high)
                    yield pa.RecordBatch.from_arrays([pa.array((block[here] - low) // SEGMENT, pa.int32()), pa.array((block[here] - low) % SEGMENT, pa.int32()), pa.array(h[here].view(np.int64))], names=["segment", "block", "h"])

    def fill(table: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT * BLOCK, np.uint64)
        block = table.column("block").to_numpy().astype(np.int64)
        for bit in _bits(table.column("h").to_numpy().view(np.uint64)):
            np.bitwise_or.at(out, block * BLOCK + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    return place, fill


def _edits(letters: np.ndarray, layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hashes, rows, places, new letters) of edits of words of one length; new letter 0 is a deletion. Of the equal
    results of deleting one of a run of equal letters only the last is made."""
    m, length = letters.shape
    own = _placed(np.arange(length), letters)
    total = own.sum(1, dtype=np.uint64)
    step = max(1, AT_ONCE // (m * len(ALPHABET)))
    for a in range(0, length, step):  # replacements
        places = np.arange(a, min(a + step, length))
        larger = ALPHABET[None, None] > letters[:, places, None]
        row, place, new = np.nonzero(larger)
        h = (total[:, None] - own[:, places])[row, place] + _placed(places[:, None], ALPHABET[None])[place, new]
        yield length, _of_length(h, length), row, places[place], ALPHABET[new]
    if length > LENGTH:
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        shifted = _placed(np.arange(length - 1), letters[:, 1:])
        after = np.zeros_like(own)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        last = np.ones(letters.shape, bool)
        last[:, :-1] = letters[:, 1:] != letters[:, :-1]
        row, place = np.nonzero(last)
        yield length - 1, _of_length((before + after)[row, place], length - 1), row, place, np.zeros(len(row), np.uint32)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each two words of a vocabulary (word, n) with exactly one letter inserted, deleted or replaced, once."""
    spark = words.sparkSession
    sizes = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("length")).count().collect()  # LONG rows at most
    layout = Layout({r["length"]: r["count"] for r in sizes})
    found = spark.createDataFrame([], "a string, an long, b string")
    step = FILTER_BYTES // (8 * BLOCK)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["count"] for r in sizes) // PROBED)
    for low in range(0, layout.blocks, step):
        high = min(low + step, layout.blocks)
        place, fill = _set_bits(layout, low, high)
        shards = layout.lengths(low, high)
        size = F.least(F.length("word"), F.lit(LONG))
        rows = words.where(size.isin(shards)).mapInArrow(place, "segment int, block int, h long").groupBy("segment").applyInArrow(fill, "segment int, bits binary").collect()  # FILTER_BYTES at most
        bits = np.zeros((high - low) * BLOCK, np.uint64)
        for r in rows:
            part = bits[r["segment"] * SEGMENT * BLOCK : (r["segment"] + 1) * SEGMENT * BLOCK]
            part[:] = np.frombuffer(r["bits"], np.uint64)[: len(part)]
        shared = spark.sparkContext.broadcast(bits)

        def probe(batches, shared=shared, low=low, high=high):
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for length, rows in _by_length(words):
                    slab = max(1, AT_ONCE // (length * len(ALPHABET)))
                    for x in range(0, len(rows), slab):
                        some = rows[x : x + slab]
                        for size, h, row, at, new in _edits(_letters([words[i] for i in some]), layout):
                            if min(size, LONG) not in layout.first:
                                continue
                            block = layout.block(h, size)
                            here = np.flatnonzero((block >= low) & (block < high))
                            here = here[passes(shared.value, block[here] - low, h[here])]
                            if len(here):
                                source = some[row[here]]
                                made = [words[i][:p] + (chr(c) if c else "") + words[i][p + 1 :] for i, p, c in zip(source.tolist(), at[here].tolist(), new[here].tolist(), strict=True)]
                                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(source)), pa.array(n[source]), pa.array(made, pa.string())], names=["a", "an", "b"])

        probed = words.where(size.isin([*shards, *(k + 1 for k in shards)])).repartition(tasks)  # little to read, much to probe
        found = found.unionByName(stored(probed.mapInArrow(probe, "a string, an long, b string"), "edits"))
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b").select("a", "an", "b", "bn")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the last word that forms lead to. Forms mustn't lead in circles.

    Each round puts a word's root's root in its place, so that chains of length n take log n rounds.
    """
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        on = stored(now.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next")), "next")
        more = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if more.where("moved").isEmpty():
            return now
        now = more.select("word", "root")


def _variants(documents: DataFrame) -> DataFrame:
    words = stored(vocabulary(documents), "vocabulary")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m"))))
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    best = stored(best, "near")
    chosen = -F.col("best.m") >= FACTOR * F.col("n")
    facts = words.join(best, "word", "left").select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, -F.col("best.m")).alias("form_n")
    )
    facts = stored(facts, "forms")
    return facts.join(roots(facts), "word").select("word", "form", "root", "n", "n_near", "form_n")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased, of LENGTH letters or more and with COUNT
    occurrences or more in all documents. Of a run with a crc32 of `doc_id:run` that DAMAGE divides, the letter at crc32 modulo
    its length is left out first. Two words are near if one inserted, deleted or replaced letter makes one the other. A word's
    form is its near word with most occurrences (of equals the first by code points) if these are FACTOR times the word's or
    more, else null; root is the last word that forms lead to, the word itself without a form. Null and empty texts have no
    words; a null doc_id counts as an empty one; repeated rows count as often as they are there; other columns are not read.
    """
    return finished(documents.sparkSession, lambda: _variants(documents), "variants")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
