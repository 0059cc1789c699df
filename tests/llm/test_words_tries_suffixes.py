"""Spelling variants, the prefix trie and removal of repeated passages against SQL on the test tables and plain loops on odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import spelling, suffixes, trie
from tidemark.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_prefix_trie", "op13_suffix_dedup"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df, *rel.columns) == sorted(rel.fetchall(), key=repr)


# spelling


def variants_by_loops(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    letters = [chr(c) for c in spelling.ALPHABET.tolist()]
    out = {}
    for w in n:
        near = {w[:i] + a + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for a in (*letters, "")} & n.keys() - {w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    table = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        table.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(table, key=repr)


def words_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("extra")).withColumn("n", F.lit(1)).repartition(3)
    return rows_of(spelling.variants(df), "word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_odd_texts(spark):
    chain = " ".join(["kitten"] * 640 + ["kittenz"] * 125 + ["kattenz"] * 25 + ["kattens"] * 5)
    ties = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaaac"] * 25 + ["aaaaaaa"] * 5 + ["übergroß"] * 30 + ["Übergroß"] * 6)
    long = "x" * 300
    rows = [(1, chain), (2, ties), (3, None), (4, ""), (None, "kitten " * 3), (5, f"{long} {long}中{long}\U0001f600{long} {long} {long}y"), (6, "kitten"), (6, "kitten"), (7, "KITTEN KİTTEN ÀÀÀÀÀÀ " * 6)]
    rows += [(100 + i, "damage " * 10) for i in range(300)]
    assert words_of(spark, rows) == variants_by_loops(rows)
    assert words_of(spark, [(1, None)]) == []
    assert rows_of(spelling.variants(spark.createDataFrame([], "doc_id long, text string")), "word") == []


def test_very_long_words(spark):
    long = "x" * 30_000
    rows = [(1, f"{long} " * 30 + f"{long}y {long[:9000]}z{long[9000:]} {long[1:]}a " * 5)]
    words = sorted([long, f"{long}y", f"{long[:9000]}z{long[9000:]}", f"{long[1:]}a"])
    near = {long: 3}
    assert words_of(spark, rows) == sorted([(w, None if w == long else long, long, 30 if w == long else 5, near.get(w, 1), None if w == long else 30) for w in words], key=repr)


def test_filters_in_several_passes(spark, monkeypatch):
    random.seed(5)
    words = ["".join(random.choice("abé") for _ in range(random.randint(6, 9))) for _ in range(400)]
    rows = [(i, " ".join(random.choice(words) for _ in range(200))) for i in range(60)]
    monkeypatch.setattr(spelling, "FILTER_BYTES", 1 << 8)
    monkeypatch.setattr(spelling, "SEGMENT", 2)
    assert words_of(spark, rows) == variants_by_loops(rows)


def test_few_false_positives():
    """A filter with BITS bits a word lets few others through."""
    rng = np.random.default_rng(1)
    layout = spelling.Layout({10: 20_000})
    h = rng.integers(0, 1 << 64, 120_000, dtype=np.uint64)
    own, others = h[:20_000], h[20_000:]
    bits = np.zeros(layout.blocks * spelling.BLOCK, np.uint64)
    for bit in spelling._bits(own):
        np.bitwise_or.at(bits, layout.block(own, 10) * spelling.BLOCK + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    assert len(spelling.passes(bits, layout.block(own, 10), own)) == len(own)
    assert len(spelling.passes(bits, layout.block(others, 10), others)) < 0.005 * len(others)


# the trie


def trie_by_loops(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:])
    members, children, out = {}, {}, {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(x[6] for x in below)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(below), sum(x[5] for x in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("extra")).repartition(5)
    return rows_of(trie.prefix_trie(df), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_of_odd_conversations(spark):
    random.seed(3)
    rows = [(c, i if random.random() < 0.9 else None, random.choice(["u", "a", None]), random.choice(["x", "ü", None, ""])) for c in range(-7, 30) for i in range(random.randint(0, 12))]
    rows += [(5, 1, "u", "x")] * 40 + [(6, i, "u", "z" * (i % 7)) for i in range(300)] + [(None, 1, "u", "x")]
    rows += [(1000 + 5 * i, j, "u", f"same {j}") for i in range(200) for j in range(9)]  # one conversation, many times
    assert trie_of(spark, rows) == trie_by_loops(rows)
    assert trie_of(spark, [(None, 1, "u", "x")]) == []
    assert trie_of(spark, [(3, 1, "u", "x")]) == trie_by_loops([(3, 1, "u", "x")])


def test_long_lists_of_members_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 1 << 10)
    ends = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("conv_id"), (F.col("id") % 2).alias("depth"), (F.col("id") * 7 - 999).alias("member"))
    want = {}
    for r in ends.collect():
        want.setdefault((r["conv_id"], r["depth"]), []).append(r["member"])
    got = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in trie._digests(ends.repartition(7)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


# repeated passages


def cuts_by_loops(rows):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49) if doc_id is not None else ():
            first[data[p : p + 50]] = min(first.get(data[p : p + 50], doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - 49) if doc_id is not None else ():
            if first[data[p : p + 50]] < doc_id:
                gone[p : p + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cuts_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("extra")).repartition(3)
    return rows_of(suffixes.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def odd_texts():
    random.seed(11)
    letters = lambda n, of="abc é中": "".join(random.choice(of) for _ in range(n))
    passage, other = letters(200), letters(51)
    rows = [(i, letters(random.randint(0, 80)) + passage[random.randint(0, 60) : random.randint(90, 200)] + letters(30) + (other if i % 3 else "") + letters(random.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, passage) for i in range(5)] + [(7, rows[3][1]), (7, rows[7][1]), (None, passage), (None, None), (200, None), (201, ""), (202, "short"), (203, passage[:49])]
    rows += [(300, "a" * 500), (301, "a" * 49), (302, "a" * 50), (303, "a" * 120 + "b" * 120), (304, "ab" * 100), (305, "ba" * 100), (-5, "b" * 60), (306, letters(40) + "\u0000" * 70), (307, "\u0000" * 60)]
    rows += [(400 + i, "one line that nearly all of them have, up to here:" + letters(20, "0123456789")) for i in range(80)]
    return rows


@pytest.mark.parametrize("crowd, at_once, chunk", [(4096, 1 << 19, 1 << 22), (3, 1 << 19, 1 << 12), (50, 256, 1)])
def test_repeats_in_odd_texts(spark, monkeypatch, crowd, at_once, chunk):
    """Also with crowded anchors as single suffixes, texts in parts, chunks of one document and small batches in a bucket."""
    for name, value in (("CROWD", crowd), ("AT_ONCE", at_once), ("CHUNK", chunk), ("SHARD", 1 << 12), ("ROWS", 50)):
        monkeypatch.setattr(suffixes, name, value)
    rows = odd_texts()
    assert cuts_of(spark, rows) == cuts_by_loops(rows)


def test_no_texts_and_long_texts(spark):
    assert rows_of(suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")), "doc_id") == []
    assert cuts_of(spark, [(1, None), (None, "x" * 60)]) == cuts_by_loops([(1, None), (None, "x" * 60)])
    random.seed(2)
    long = "".join(random.choice("abcdefgh") for _ in range(1_300_000))
    rows = [(1, long), (2, f"{long[700_000:]}!{long[:600_000]}"), (3, f"?{long[5:5000]}?{long[-49:]}")]
    assert cuts_of(spark, rows) == cuts_by_loops(rows)


def test_order_of_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:2000] = data[:1000]
    start, group = np.arange(3900), np.arange(3900) % 3
    order, new = suffixes.sorted_groups(data, start, group)
    keys = [(int(group[i]), data[start[i] : start[i] + suffixes.SPAN].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_little_is_shuffled_for_repeats(spark):
    """Runs are moved once and without hashes; what they are told comes back by their numbers (1.12 times the text before)."""
    jvm = spark.sparkContext._jvm

    def shuffled():
        store, none = spark.sparkContext._jsc.sc().statusStore(), jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size, before = documents.selectExpr("sum(octet_length(text))").first()[0], shuffled()
    suffixes.without_repeats(documents)
    assert 0 < shuffled() - before < 0.9 * size


def test_anchors_are_dealt_out_evenly():
    """The least hashes of many are small ones; shards get equal shares all the same (most was the first one's before)."""
    data = np.random.default_rng(5).integers(97, 123, 200_000).astype(np.uint8)
    shard, keys, at = suffixes._asking(suffixes.Runs(data, np.array([0, len(data)]), np.array([0])), 30)
    shares = np.bincount(shard, minlength=30)
    assert len(keys) > 5000 and shares.sum() == len(keys) and shares.max() < 1.5 * shares.mean() and (np.diff(shard) >= 0).all()
