"""Corpus operators against brute force, exact round trips and held-out accuracy, and with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import bpe, chars, language, lm_score, near_copies, packing, quality, secrets, vectors, warc
from tidemark.llm.graph import components, local_roots
from tidemark.llm.queries import ORACLE_SQL, QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "a", "it's they're we'll 'sofa ''s don't", "<|endoftext|>a<|startoftext|>", "İstanbul ΣΑΣ Ǆ ﬁ ½ 日本語", "é é Å", "ab" * 3000 + "!" * 70, "\x00x\x7f", "1'2's", "Y̊ ꟎\U00016ea0"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "no id")], "doc_id long, text string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def test_span_hashes_depend_on_content_alone():
    h, at = chars.token_hashes(["the cat the", "", "cat"], chars.spaces_only())
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and at.tolist() == [0, 3, 3, 4]


def test_quality_held_out(spark):
    rows = quality.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(odd, labels)
    out = quality.score(odd.withColumn("quality_score", F.lit("own")), w).collect()
    assert len(out) == len(ODD) + 2 and all(0 < r["quality_score"] < 1 for r in out)
    assert quality.score(odd.limit(0), w).count() == 0
    assert (quality.train(odd, labels.limit(0)) == 0).all()


def test_quality_training_by_dictionaries():
    """The vectorised learner against per-coordinate updates written out with dictionaries."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 40 if y else 60]) for _ in range(rng.randrange(0, 30))) for y in (0, 1) * 40] + ["a a a a b"]
    labels = [float(i % 2) for i in range(len(texts))]
    model = quality.Ftrl()
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.1)

    def vector(t):
        i, _ = quality.features([t])
        return {**{k: c / math.sqrt(max(1, len(i))) for k, c in Counter(i.tolist()).items()}, quality.BUCKETS: 1.0}

    for t, y in zip(texts, labels, strict=True):
        model.learn(quality.features([t])[0], y)
        x = vector(t)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        steps = [(i, (p - y) * v, weight(i)) for i, v in x.items()]
        for i, g, w in steps:
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3
            z[i] += g - s * w
            n[i] += g * g
    assert all(model.weights()[i] == pytest.approx(weight(i), abs=1e-9) for i in z)
    got = quality.scores(texts, model.weights())
    assert got == pytest.approx([1 / (1 + math.exp(-sum(weight(i) * v for i, v in vector(t).items()))) for t in texts])


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_of_odd_rows(spark, odd):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    langs, logs = language.train(docs)
    assert langs == ["x", "y"]
    out = {r["text"]: r for r in language.identify(docs, langs, logs).collect()}
    assert all(out[t]["lang_pred"] == "und" and out[t]["lang_score"] == 0 for t in (None, "", " \n"))
    assert language.identify(docs.limit(0), langs, logs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, *language.train(docs.limit(0))).collect()} == {"und"}


def test_any_number_of_languages(spark):
    """More languages than one slice of the matrix, letterless texts, and plain naive Bayes in Python."""
    n = language.SLICE_LANGUAGES + 44
    rows = [(3 * i + k, f"l{i:03}", f"{chr(0x4E00 + i)}{chr(0x5500 + i)}ab " * (2 + k)) for i in range(n) for k in (0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs, logs = language.train(docs)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert langs == sorted({r[1] for r in learnt})
    more = spark.createDataFrame([(-1, "½ ² ①"), (-2, "12_34"), (-3, "a"), (-4, "\u3007")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language.identify(docs.drop("lang").unionByName(more), langs, logs).collect()}
    assert [out[i]["lang_pred"] for i in (-1, -2, -4)] == ["und"] * 3 and out[-3]["lang_pred"] in langs
    assert all(out[i]["lang_pred"] == lang for i, lang, _ in rows if lang in langs)
    # the posterior, from counts of n-grams in dictionaries
    bucket = lambda g: int(language.grams([g])[0][len(g) - 1][0])
    grams = lambda t: [bucket(t[k : k + o]) for o in (1, 2, 3) for k in range(len(t) - o + 1)]
    counts, number = {x: Counter() for x in langs}, Counter()
    for _, lang, t in learnt:
        counts[lang].update(grams(t))
        number[lang] += 1
    points = []
    for x in langs:
        total = counts[x].total() + 0.5 * language.BUCKETS
        points.append(sum(np.log((counts[x][g] + 0.5) / total) for g in grams("a")) / 3 + np.log(number[x] / len(learnt)))
    p = np.exp(np.array(points) - max(points))
    assert out[-3]["lang_score"] == pytest.approx(p.max() / p.sum(), rel=1e-3)


def plain_lm_scores(texts, good):
    """lm_score by dictionaries, each text scored by models that haven't counted it."""

    def words(t):
        return re.findall(r"\w+|[^\w\s]+", (t or "").lower())

    def counted(chosen):
        word, context, pair = Counter(), Counter(), Counter()
        for i in chosen:
            w = words(texts[i])
            word.update(w)
            context.update(["", *w] if w else [])
            pair.update(zip(["", *w], w, strict=False))
        return word, context, pair

    every, target = counted(range(len(texts))), counted(good)
    size = max(1, len(every[0]))
    scale = target[0].total() / every[0].total() if target[0].total() else 1.0
    out = []
    for i, t in enumerate(texts):
        w = words(t)
        own = counted([i])
        means = []
        for model, share, mine in ((every, scale, 1), (target, 1.0, int(i in good))):
            get = lambda kind, x: (model[kind][x] - mine * own[kind][x]) * share  # noqa: B023, E731
            bits = 0.0
            for b, x in zip(["", *w], w, strict=False):
                single = (get(0, x) + 0.1) / ((model[0].total() - mine * len(w)) * share + 0.1 * size)
                bits -= np.log2((get(2, (b, x)) + 4 * single) / (get(1, b) + 4))
            means.append(bits / max(1, len(w)))
        out.append((len(w), means[0], means[1], means[1] - means[0]))
    return out


def test_lm_score_by_dictionaries(spark, monkeypatch):
    """Many pairs, hot words, copies, empty texts, repeated and missing ids, clashing columns, in chunks and shards of several sizes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5_000, rng.integers(1, 600))) for _ in range(150)]
    texts += ["hot pair " * 50, None, "", "!? it's\u00e9 x_1 ½"] + ["hot pair"] * 60 + [texts[3], texts[8]]
    good = set(range(0, len(texts), 4))
    want = plain_lm_scores(texts, good)
    docs = spark.createDataFrame([(i, t, "own", i) for i, t in enumerate(texts)], "doc_id long, text string, lm_score string, is_target int")
    ids = spark.createDataFrame([(i,) for i in [*good, 0, 4, None, 99_999]], "doc_id long")
    for chunk, shard in ((1 << 21, 1 << 22), (3000, 20_000)):
        monkeypatch.setattr(lm_score, "SHARD", shard)
        monkeypatch.setattr(lm_score, "CHUNK", chunk)
        out = lm_score.score(docs.repartition(3), ids)
        assert out.columns == ["doc_id", "text", "is_target", "n_words", "background_bits", "target_bits", "lm_score"]
        rows = {r["doc_id"]: r for r in out.collect()}
        assert len(rows) == len(texts) and all(r["is_target"] == i and r["text"] == texts[i] for i, r in rows.items())
        for i, w in enumerate(want):
            assert tuple(rows[i][c] for c in ("n_words", "background_bits", "target_bits", "lm_score")) == pytest.approx(w)
    twins = [want[i][3] for i in (3, 8)]
    assert min(twins) > max(want[i][3] for i in range(150) if i not in (3, 8) and i not in good)  # a text that is there twice stands out


def test_lm_score_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    none = docs.select("doc_id").limit(0)
    assert lm_score.score(docs.limit(0), docs.select("doc_id")).count() == 0
    assert sorted(r["n_words"] for r in lm_score.score(docs, none).collect()) == [0, 1, 2, 2]
    assert lm_score.score(docs.where("doc_id = 2"), none).first()["lm_score"] == 0


def test_very_long_texts_have_the_same_tokens(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab !?é1") for _ in range(4000))
    whole = chars.token_hashes([text], chars.words_and_marks())
    monkeypatch.setattr(chars, "AT_ONCE", 64)
    for texts in ([text], ["a", text, ""]):
        h, at = chars.token_hashes(texts, chars.words_and_marks())
        assert h[at[len(texts) // 2] : at[len(texts) // 2 + 1]].tolist() == whole[0].tolist() and len(at) == len(texts) + 1


def test_bpe_matches_the_library(library):
    m = bpe.model(TOKENIZER)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("thsineraod 'é1!") for _ in range(rng.randrange(200))) for _ in range(200)]
    got = [[] for _ in texts]
    for i, ids in bpe.Encoder(m.word, m.split, m.special).stream(texts):
        got[i] += ids.tolist()
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    word = "".join(rng.choice("thsineraod") for _ in range(40_000)).encode()
    assert list(m.transduce([word[k : k + 5] for k in range(0, len(word), 5)])) == library.encode(word.decode(), add_special_tokens=False).ids


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_words_of_equal_polynomial_hashes_stay_apart(spark, library):
    """A Thue-Morse word and its complement share their hash under every odd base modulo 2**64."""
    one = thue_morse(1024)
    two = one.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").coalesce(1)
    for r in bpe.transcode(docs, TOKENIZER).collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    for r in packing.pieces(docs, TOKENIZER).collect():
        ids = [*library.encode(one if r["doc_id"] == 1 else two, add_special_tokens=False).ids, 1]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r["n_links"] for r in near_copies.classes(docs).collect()} == {0}
    h, _ = chars.token_hashes([one, two], chars.spaces_only())
    assert h[0] != h[1]


def test_windows_of_any_text(library, monkeypatch):
    """Texts cut every few characters, also within words: the same ids as in one go."""
    monkeypatch.setattr(bpe, "WINDOW", 40)
    monkeypatch.setattr(bpe, "HELD", 64)
    m = bpe.model(TOKENIZER)
    rng = random.Random(8)
    kinds = ["thsineraod", "!?'-_", "0123", "éß日本\u0301Åﬁ", "the's 'll "]
    texts = ["".join(rng.choice(rng.choice(kinds[:k])) for _ in range(rng.randrange(900))) for k in (1, 2, 3, 4, 5) for _ in range(12)]
    texts += ["".join(rng.choice("thsin") for _ in range(5000)), "日本語" * 400, "!" * 700 + "'s" * 90, "a\x1c!\x1c!" * 100, "e\u0301" * 500, "\u0301" * 300]
    got = [[] for _ in texts]
    for i, ids in bpe.Encoder(m.word, m.split, m.special, lambda: bpe.Transducer(m)).stream(texts):
        got[i] += ids.tolist()
    for t, own in zip(texts, got, strict=True):
        assert own == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_memory_does_not_grow_with_a_word(library, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(bpe, "WINDOW", 1 << 13)
    monkeypatch.setattr(bpe, "HELD", 1 << 11)

    m = bpe.model(TOKENIZER)
    bpe.word_spans(*chars.code_points(["a"]))  # tables
    rng = random.Random(9)
    text = "".join(rng.choices("thsineraod", k=1 << 18))
    peaks = []
    for size in (1 << 16, 1 << 18):
        tracemalloc.start()
        n = sum(len(ids) for _, ids in bpe.Encoder(m.word, m.split, m.special, lambda: bpe.Transducer(m)).stream([text[:size]]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > size / 6
    assert peaks[1] < 1.2 * peaks[0]


def test_bpe_query_round_trip(spark, odd, library):
    for r in bpe.transcode(odd.withColumn("n_tokens", F.lit("own")), TOKENIZER).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_byte_level_decoding_waits_for_whole_characters():
    m = bpe.model(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([m.inner[b] for b in "aé日\U0001f600".encode()])
    d = bpe.Decoder(m)
    parts = [d.feed(ids[k : k + 1]) for k in range(len(ids))] + [d.feed(ids[:0], True)]
    assert "".join(parts) == "aé日\U0001f600" and parts[1] == ""


def test_packing(spark, odd, library):
    long = spark.createDataFrame([(100 + i, "word " * n) for i, n in enumerate([5000, 4095, 4096, 1, 2000, 2095, 700])], "doc_id long, text string")
    rows = packing.pack(packing.stored(packing.pieces(odd.unionByName(long), TOKENIZER), "p")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 4096) + 1
    texts = {**{i: t for i, t in enumerate(ODD)}, **{r["doc_id"]: r["text"] for r in long.collect()}}
    for i, t in texts.items():
        if i == 3:
            continue  # there twice
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert [r["start"] for r in own] == [4096 * k for k in range(len(own))]
    assert packing.pack(packing.stored(packing.pieces(odd.limit(0), TOKENIZER), "p")).count() == 0


def test_plan_prefers_exact_complements():
    counts = np.zeros(4097, int)
    counts[[4000, 96, 3000, 1000, 2000, 48]] = [2, 1, 3, 3, 1, 5]
    plan = packing.Plan(counts)
    assert plan.left.sum() == 0 and sum(n * sum(p) for p, n in plan.patterns) == (counts * np.arange(4097)).sum()
    assert ([4000, 96], 1) in plan.patterns and ([4000, 48, 48], 1) in plan.patterns


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


_WORDS = "zebra quantity xylophone version light right kind time world major people books north company value identifier ordinary several everywhere"
ORDINARY = " ".join([_WORDS, _WORDS.title(), _WORDS.upper(), "parse_version_2024 loadUtf8Text18 Vector2Matrix31 index4value56 row78column90", _WORDS.title().replace(" ", "")]) * 20


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_spans(spark):
    key = "Zq8Xv2Lk9Rt4Wm7Pb3Nc6"
    texts = [None, "", "secret=token: abcdefgh token='abc' API_KEY : \"x.y-z/1+2=\"", "😀 password=hunter2hunter " + "a1" * 15, f"see AKIA{'Q' * 16} and AKIASHORT", "x" * 500 + " " + key, "plain words that are not secret at all", "token=abcdef token=abcdef"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    extra = spark.createDataFrame([(50 + i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"' if i % 2 else ORDINARY) for i in range(200)], "doc_id long, text string")
    ratios = secrets.train(docs.unionByName(extra))
    found = {r["doc_id"]: r for r in secrets.find(docs.withColumn("secret_spans", F.lit(1)), ratios).collect()}
    for i, t in enumerate(texts):
        got = [(s["start"], s["kind"], s["end"]) for s in found[i]["secret_spans"]]
        assert [x for x in got if x[1] < 3] == base(t or "")
        assert got == sorted(got)
    assert any(s["kind"] == 3 for s in found[5]["secret_spans"]) and not found[6]["secret_spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.find(docs, ratios)).collect()}
    assert clean[7] == "[SECRET] [SECRET]" and clean[0] is None and clean[6] == texts[6] and key not in clean[5]
    assert secrets.find(docs.limit(0), secrets.train(docs.limit(0))).count() == 0


def plain_spans(text, ratios):
    """All spans by plain Python: the rules', and candidates that overlap none and whose transitions look drawn at random."""
    found = base(text)
    for m in re.finditer(secrets.CANDIDATE, text):
        c = [ord(x) - secrets.FIRST for x in m[0]]
        total = 0.0
        for a, b in zip(c, c[1:], strict=False):
            total += ratios[a * secrets.SYMBOLS + b]
        if total >= secrets.LEAST_RATIO * (len(c) - 1) and all(m.end() <= s or e <= m.start() for s, _, e in found if _ < 3):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_secret_models_on_held_out_samples(spark):
    """Random strings and identifiers that the models haven't seen: precision and recall, and spans by a plain scorer."""
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    name = lambda: "_".join(rng.choice(_WORDS.split()) for _ in range(rng.randrange(4, 7)))
    train = spark.createDataFrame([(i, f'token = "{key(40)}"' if i % 2 else ORDINARY + " ".join(name() for _ in range(20))) for i in range(600)], "doc_id long, text string")
    ratios = secrets.train(train)
    rows, true = [], {}
    for i in range(300):
        parts = [key(rng.randrange(24, 60)) if i % 3 == 0 else name() for _ in range(4)]
        rows.append((i, " é ".join(parts) + (" secret=" + key(12) if i % 5 == 0 else "")))
        true[i] = i % 3 == 0
    odd = " ".join(["password=" + key(8), key(30)] * 700)  # more spans than one group of a scan
    rows += [(300, odd), (301, key(9000)), (302, f"token={key(30)}/{key(30)}"), (303, "x" * 30), (304, "")]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["secret_spans"]] for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()}
    assert all(got[i] == plain_spans(t, ratios) for i, t in rows)
    hits = [(true[i], any(k == 3 for _, k, _ in got[i])) for i in range(300)]
    caught = sum(a and b for a, b in hits)
    assert caught >= 0.95 * sum(a for a, _ in hits) and caught >= 0.95 * sum(b for _, b in hits)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), ratios)).collect()}
    for i, t in rows:
        out, at = [], 0
        for s, _, e in got[i]:
            if s >= at:
                out.append(t[at:s])
            at = max(at, e)
        assert clean[i] == "[SECRET]".join([*out, t[at:]])


def test_secret_scan_of_a_megabyte_is_linear(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ABCdef0123+/xyzQRS") for _ in range(1 << 20))
    ratios = secrets.train(spark.createDataFrame([(i, f"token={text[200 * i : 200 * i + 200]}" if i % 2 else ORDINARY) for i in range(200)], "doc_id long, text string"))
    times = []
    for size in (1 << 18, 1 << 20):
        df = spark.createDataFrame([(1, text[:size] + " password=abcdefgh")], "doc_id long, text string")
        began = time.perf_counter()
        spans = secrets.redact(secrets.find(df, ratios).where("size(secret_spans) > 1")).first()["text"]
        times.append(time.perf_counter() - began)
        assert spans == "[SECRET] [SECRET]"
    assert times[1] < 60 and times[1] < 10 * times[0] + 2


def test_warc(spark, tmp_path):
    big, small = "<p>é</p>" * 20, "x"
    pages = spark.createDataFrame([(3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y", small), (5, "u", small), (4, "u", None), (6, "u", big)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    archives = warc.stored(warc.write(warc.with_revisits(pages), folder), "a")
    index = warc.stored(warc.normalise(archives), "i")
    rows = {r["page_id"]: r for r in warc.read(index, folder).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in rows.items()} == {1: ("response", None), 3: ("revisit", 1), 6: ("revisit", 1), 2: ("response", None), 5: ("response", None), 4: ("response", None)}
    assert rows[3]["payload_bytes"] == len(big.encode()) and rows[4]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    again = warc.stored(warc.normalise(index.select("archive").distinct()), "again")  # members are normalised to the same records
    assert sorted(map(tuple, warc.read(again, folder).collect())) == sorted(map(tuple, rows.values()))


def test_warc_of_odd_pages(spark, tmp_path):
    """Pages without page_id, repeated ones, and none at all, against the query's SQL."""
    import duckdb

    big = "é" * 60
    rows = [(None, "a", big), (7, "b", big), (7, "c", big), (9, "d", big), (None, "e", "y" * 200), (None, "f", "y" * 200), (None, None, None), (1, "g", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("own"), "_first": F.lit(1)})
    for n, df in enumerate((pages, pages.limit(0))):
        df.write.parquet(f"file://{tmp_path}/{n}/pages.parquet")
        duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/{n}/pages.parquet/*.parquet'")
        rel = duckdb.sql(ORACLE_SQL["op7_warc"])
        order = lambda r: [str(x) for x in r]
        got = QUERIES["op7_warc"](spark, f"file://{tmp_path}/{n}").collect()
        assert sorted(rel.fetchall(), key=order) == sorted((tuple(r[c] for c in rel.columns) for r in got), key=order)


def test_warc_query_agrees_with_sql(spark):
    import duckdb

    duckdb.sql(f"create or replace view pages as select * from '{SF}/pages.parquet'")
    rel = duckdb.sql(ORACLE_SQL["op7_warc"])
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in rel.columns) for r in QUERIES["op7_warc"](spark, SF).collect())


def cloud(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, d))
    x[200:230] = x[200]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [1.0]), (None, [1.0] * d), (n + 4, [None] * d)]


def test_nearest_recall(spark):
    rows = cloud()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.nearest(df, F.col("vec_id") % 20 == 0).collect()
    x = np.array([np.float32(v) for _, v in rows[:400]], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 400, 20):
        s = u @ u[q]
        s[q] = -2
        want = set(np.lexsort((np.arange(400), -np.round(s, 12)))[:5].tolist())
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in own] == [1, 2, 3, 4, 5]
        hits += len(want & {v for _, v in own})
        total += 5
    assert hits / total >= 0.9
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_postings_give_the_footrule():
    rng = np.random.default_rng(2)
    orders = rng.random((50, 40)).argsort(1)[:, :9].astype("<u2")
    postings = vectors.Postings(orders[1:], 40)
    places = np.full((50, 40), 9)
    np.put_along_axis(places, orders.astype(int), np.arange(9)[None], 1)
    assert (9 * 10 - 2 * postings.shared(orders[0]) == np.abs(places[1:] - places[0]).sum(1)).all()


def test_nearest_in_clusters_with_outliers(spark):
    """Clustered vectors and queries far from all: each has its five, by exact cosines, with the stated recall; ties and repeats."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 32))
    x[::600] = 5 * rng.normal(size=(10, 32))
    x[101:111] = x[100]
    x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[100].tolist()), (103, x[100].tolist()), (50, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("own"))
    got: dict = {}
    for r in vectors.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert set(got) == set(range(0, 6000, 50))
    hits = 0
    for q in range(0, 6000, 50):
        own = sorted(got[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and len({v for _, v, _ in own}) == 5
        s = u @ u[q]
        if q == 50:
            s = np.maximum(s, u @ u[7])
        assert all(score == pytest.approx(max(s[v], u[7] @ u[q] if v == 50 else -1)) for _, v, score in own)
        s[50] = max(s[50], u[7] @ u[q])
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(6000), -np.round(s, 12)))[:5].tolist()) & {v for _, v, _ in own})
    assert hits / (5 * 120) >= 0.93
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]


def test_vector_links(spark):
    rows = cloud()
    out = {r["vec_id"]: r for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("vec_id is not null").collect()}
    x = np.array([np.float32(v) for _, v in rows[:400]], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    a, b = np.nonzero(near)
    roots = dict(zip(*local_roots(a, b), strict=True))
    for i in range(400):
        assert out[i]["n_links"] == near[i].sum() and out[i]["component_id"] == roots.get(i, i) and out[i]["kept"] == (out[i]["component_id"] == i)
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(400, 405))


def test_vector_links_of_correlated_vectors():
    """Pairs at cosine 0.951 that differ along few directions or coordinates: all are visited, from the smaller cell alone."""
    rng = np.random.default_rng(5)
    scale = 1 / np.sqrt(np.arange(1, 65))
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    x = unit(rng.normal(size=(4000, 64)) * scale)
    index = vectors.MultiIndex(x, 0.95)
    two = np.zeros_like(x)
    np.put_along_axis(two, rng.random(x.shape).argsort(1)[:, :2], rng.normal(size=(4000, 2)), 1)
    for aside in (rng.normal(size=x.shape), rng.normal(size=x.shape) * scale, rng.normal(size=x.shape) * (np.arange(64) < 8), two):
        aside = unit(aside - (aside * x).sum(1)[:, None] * x)
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * aside
        (a, fa, ba), (b, fb, bb) = index.visits(x), index.visits(y)
        for i in range(len(x)):
            to, firsts, bits = (b[i], fa[i], ba[i]) if a[i] <= b[i] else (a[i], fb[i], bb[i])
            at = np.flatnonzero(firsts == to // vectors.CODEWORDS)
            assert len(at) == 1 and int(bits[at[0]]) >> int(to % vectors.CODEWORDS) & 1


def test_vector_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64)) / np.sqrt(np.arange(1, 65))
    x[1500:] = x[:1500]
    for i in range(1500, 3000):
        k = rng.integers(0, 64, 2)
        x[i, k] += rng.normal(size=2) * np.linalg.norm(x[i]) * 0.22
    x = x.astype(np.float32)
    out = {r["vec_id"]: r["n_links"] for r in vectors.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(3000, dtype=bool)
    assert near.sum() > 500 and [out[i] for i in range(3000)] == near.sum(1).tolist()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes, root = local_roots(*map(np.array, zip(*links, strict=True)))
    want = {n: r for n, r in zip(nodes.tolist(), root.tolist(), strict=True)}
    assert got == {n: r for n, r in want.items() if n in got} and all(n == r for n, r in want.items() if n not in got)


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    return links


def test_near_copies_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(120)]
    passage = " ".join(words[:60])
    for k in range(40):
        t = texts[k].split()
        t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    hub = [rng.choice(words) for _ in range(300)]
    texts += [" ".join(hub[:i] + [f"x{i}"] + hub[i + 1 :]) for i in range(100)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    texts += [None, "", " \n ", "one two", "One  two", "one two three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_copies.classes(df).collect()}
    links = brute(texts)
    n = np.bincount([x for p in links for x in p], minlength=len(texts))
    roots = dict(zip(*(a.tolist() for a in local_roots(*map(np.array, zip(*links, strict=True)))), strict=True))
    assert got == {i: (roots.get(i, i), n[i]) for i in range(len(texts))}


def test_near_copies_in_a_large_group(spark):
    """A group whose buckets go through all rounds: of more than a million links near the threshold hardly any is missed."""
    rng = random.Random(7)
    hub, n = [f"h{i}" for i in range(300)], 1500
    texts, kept = [], np.ones((n, 296), np.float32)
    for i in range(n):
        own = list(hub)
        for k in rng.sample(range(5, 295), 3):
            own[k] = f"x{i}_{k}"
            kept[i, max(0, k - 4) : k + 1] = 0
        texts.append(" ".join(own))
    common = kept @ kept.T
    near = (common / (2 * 296 - common) >= 0.8 - 1e-9) & ~np.eye(n, dtype=bool)
    out = {r["doc_id"]: r for r in near_copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    got = np.array([out[i]["n_links"] for i in range(n)])
    assert near.sum() > 1_000_000 and (got <= near.sum(1)).all() and {r["class_id"] for r in out.values()} == {0}
    assert near.sum() - got.sum() <= 1e-4 * near.sum()
    assert near_copies.missed(near_copies.RUNS, near_copies.ALIKE) <= 1e-4 < near_copies.missed(14, near_copies.ALIKE)


def test_near_copies_of_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand in this one"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = near_copies.classes(df.withColumn("class_id", F.lit("own"))).collect()
    assert len(rows) == 5 and {r["class_id"] for r in rows} == {1, 2, None} and all(r["kept"] for r in rows)
    assert len({(r["t1"], r["t2"]) for r in rows if r["doc_id"] == 1}) == 2
    assert near_copies.classes(df.limit(0)).count() == 0
