"""Secret scan: rule-based spans, and spans whose characters look drawn at random rather than written as identifiers.

Two first-order character Markov models, one of values that the rules find (random strings) and one of ordinary words, give
a log-likelihood ratio. Everything runs as SQL expressions, in time proportional to a text's length and its number of spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sampled

#: Kind, pattern, group whose length counts, least length. The last two patterns leave out runs that are too short at once;
#: those can't hide or split a longer run.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the models look at: runs of this length of characters that keys are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9_]{8,}"
#: Characters from + to z.
FIRST, SYMBOLS = 43, 80
#: Documents that the models are trained on at most (about): all with rule-based spans, and a tenth for words.
TRAIN_DOCUMENTS = 20_000
#: A candidate is a secret if its mean log ratio (nats a transition) reaches this.
LEAST_RATIO = 1.0
KINDS = [*(r[0] for r in RULES), "markov"]
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _longer(n: int):
    return lambda v: F.length(v) >= n


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once although use may name it often."""
    return F.transform(F.array(value), use)[0]


#: Rows that one array grows by, and characters that are taken apart at once.
GROUP, PIECE = 256, 4096


def _scanned(rows: Column, state: Column, step, out: str) -> Column:
    """step(state, row) -> (state, array of results) over all rows in order: the results, `out` by type.

    An array grows by one copy a row, so rows go in groups of GROUP, and the groups' results are put together at the end.
    """

    def inside(acc: Column, row: Column) -> Column:
        now, more = step(acc["state"], row)
        return F.struct(now.alias("state"), F.concat(acc["out"], more).alias("out"))

    def over(r: Column) -> Column:
        def group(acc: Column, k: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), F.array().cast(out).alias("out"))
            return F.aggregate(F.slice(r, k * GROUP + 1, F.lit(GROUP)), zero, inside, lambda g: F.struct(g["state"].alias("state"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

        groups = F.sequence(F.lit(0), F.floor((F.size(r) - 1) / GROUP).cast("int"))
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
        return F.when(F.size(r) > 0, F.flatten(F.aggregate(groups, zero, group, lambda acc: acc["out"]))).otherwise(F.array().cast(out))

    return _bound(rows, over)


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of leftmost non-overlapping matches for which keep(group's text) holds, in code points."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))

    def rows(h: Column) -> Column:
        values = F.regexp_extract_all(text, p, F.lit(group)) if group else h
        return F.arrays_zip(F.transform(h, F.length).alias("hit"), F.transform(values, keep).alias("keep"), F.transform(F.slice(F.split(text, pattern), 1, F.size(h)), F.length).alias("gap"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("end")))
        return start + x["hit"], F.when(x["keep"], own).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), _scanned(_bound(hits, rows), F.lit(0), step, SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of all rules."""
    own = [_spans(text, p, k, _longer(least), group) for k, (_, p, group, least) in enumerate(RULES)]
    return F.concat(*own)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cells(piece: Column) -> Column:
    """The number of each pair of characters that follow one another."""
    codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - FIRST)
    return _bound(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * SYMBOLS + b))


def _transitions(words: DataFrame) -> dict[int, int]:
    """How often each pair of characters follows one another in the column `word`: SYMBOLS squared numbers at most."""
    pieces = words.select(F.explode(_pieces(F.col("word"))).alias("piece")).where(F.length("piece") >= 2)
    cells = pieces.select(F.explode(_cells(F.col("piece"))).alias("cell"))
    return {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def train(documents: DataFrame, bound: int = TRAIN_DOCUMENTS) -> list[float]:
    """The log-likelihood ratio of each transition, random string against ordinary word.

    Samples are labelled by the rules: the values they find are random strings, words of documents without any are ordinary.
    Every transition counts once more than seen, so without random strings these are taken as uniform.
    """
    text = F.col("text")
    flagged = text.rlike("|".join(f"({p})" for _, p, _, _ in RULES))
    docs = sampled(documents.where(text.isNotNull()).select("doc_id", "text"), "doc_id", bound)
    values = [
        F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(group)), _longer(max(least, 16))) for _, p, group, least in RULES
    ]
    random = docs.where(flagged).select(F.explode(F.concat(*values)).alias("word"))
    few = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) == 0
    ordinary = docs.where(~flagged & few).select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("word"))
    logs = []
    for counts in (_transitions(random), _transitions(ordinary)):
        row = [sum(counts.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
        logs.append([math.log((counts.get(c, 0) + 1) / (row[c // SYMBOLS] + SYMBOLS)) for c in range(SYMBOLS**2)])
    return [round(a - b, 3) for a, b in zip(*logs, strict=True)]


def markov_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of candidates that the models take for random strings."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a constant

    def random(word: Column) -> Column:
        def add(acc: Column, piece: Column) -> Column:
            cells = _cells(F.concat(acc["last"], piece))
            ratio = F.aggregate(cells, acc["sum"], lambda total, cell: total + F.element_at(table, cell + 1))
            return F.struct(ratio.alias("sum"), F.substring(piece, -1, 1).alias("last"))

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last"))
        return F.aggregate(_pieces(word), zero, add, lambda acc: acc["sum"]) >= LEAST_RATIO * (F.length(word) - 1)

    return _spans(text, CANDIDATE, len(RULES), random)


def _apart(base: Column, more: Column) -> Column:
    """Spans of more that overlap none of base: one pass each way over both in order."""
    marked = "array<struct<start:int,kind:int,end:int,bad:boolean>>"
    is_base = lambda s: s["kind"] < len(RULES)

    def forward(end: Column, s: Column) -> tuple[Column, Column]:
        own = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (end > s["start"]).alias("bad"))
        return F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end), F.array(own)

    def backward(start: Column, s: Column) -> tuple[Column, Column]:
        keep = ~is_base(s) & ~s["bad"] & (start >= s["end"])
        own = F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.when(is_base(s), s["start"]).otherwise(start), F.when(keep, own).otherwise(F.array().cast(SPAN))

    one = _scanned(F.array_sort(F.concat(base, more)), F.lit(0), forward, marked)
    two = _scanned(F.reverse(one), F.lit((1 << 31) - 1), backward, SPAN)
    return F.when((F.size(base) > 0) & (F.size(more) > 0), two).otherwise(more)


def find(documents: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """documents with `secret_spans`, by start and then kind (a number into KINDS), end exclusive; a column of that name is replaced.

    Null texts count as empty. A span of the models that overlaps one of the rules is left out; those of the rules all stay.
    """
    documents = documents.drop("secret_spans", "_base", "_more")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = documents.withColumns({"_base": base_spans(whole), "_more": markov_spans(whole, ratios)})
    return found.withColumn("secret_spans", F.array_sort(F.concat("_base", _apart(F.col("_base"), F.col("_more"))))).drop("_base", "_more")


def redact(documents: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """Puts `mark` in the place of secret_spans (overlapping ones as one) and drops them; other texts stay as they are."""
    gap = "array<struct<from:int,to:int>>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        own = F.array(F.struct(at.alias("from"), s["start"].alias("to")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, own).otherwise(F.array().cast(gap))

    end = F.length(F.col(text))
    last = F.struct(end.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))
    gaps = _scanned(F.concat("secret_spans", F.array(last)), F.lit(0), step, gap)

    def between(pieces: Column, g: Column) -> Column:
        a, b = g["from"], g["to"]
        # from a piece, so that no call walks through the text from its start
        part = lambda k: F.substring(pieces[k], F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        number = lambda x: F.floor(x / PIECE).cast("int")
        return F.when(b > a, F.array_join(F.transform(F.sequence(number(a), number(b - 1)), part), "")).otherwise("")

    clean = _bound(_pieces(F.col(text)), lambda pieces: F.array_join(F.transform(gaps, lambda g: between(pieces, g)), mark))
    return documents.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text))).drop("secret_spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by rule, a digest of the rules' spans, and all spans as text."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(documents, train(documents))
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    number = {f"n_{name}": F.size(F.filter("secret_spans", _of_kind(k))).cast("long") for k, name in enumerate(KINDS)}
    base = F.filter("secret_spans", lambda s: s["kind"] < len(RULES))
    return found.select("doc_id", *(c.alias(n) for n, c in number.items()), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
