"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as an incremental byte-to-text machine.

The tokenizer's file gives normalisation (NFC, lower case), words (contractions, letters, single numbers, marks) and merges.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chars
from tidemark.llm.common import added

#: Words, and their characters, whose ids one task remembers; beyond that it starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 1 << 19, 1 << 23
#: Longer words are encoded anew each time.
REMEMBERED_LENGTH = 256
#: Characters that are encoded at once; a longer text goes through in parts.
WINDOW = 1 << 20
#: Bytes of a word that the transducer holds, besides its lookahead.
HELD = 1 << 13

_NONE = 1 << 62
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Model:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.fast = {a << 20 | b: r << 20 | c for (a, b), (r, c) in self.merges.items()}  # pair -> rank and new symbol
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.token_bytes = self._table()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.width = {i: len(s.removesuffix(self.suffix)) if self.suffix else len(s) for i, s in self.names.items()}  # bytes
        self.lookahead, self.longest = self._lookahead()

    def _table(self) -> list[bytes]:
        back = {x: b for b, x in enumerate(byte_letters())}
        out = [b""] * (max(self.names) + 1)
        for i, s in self.names.items():
            out[i] = bytes(back[x] for x in s) if self.byte_level and all(x in back for x in s) else s.encode()
        return out

    def _lookahead(self) -> tuple[int, int]:
        """Bytes after a token's end that settle it, and the longest token's bytes.

        A merge (x, y) of rank r needs y's bytes, and that no earlier merge takes y's right end, or a part of it on the way to
        y, away to the right; such merges (a, b) in turn need as much. In order of rank each need follows from earlier ones.
        One more byte tells whether a byte is its word's last.
        """
        size = dict.fromkeys([*self.inner, *self.last], 1)
        right: dict[int, int] = {}  # a token's right part, by its first merge
        need: dict[int, int] = {}  # by left operand: the most that a merge so far needs
        most = 1
        for (a, b), (_, c) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            at, after = b, need.get(b, 0)
            while at in right:
                at = right[at]
                after = max(after, need.get(at, 0))
            own = size[b] + after
            need[a] = max(need.get(a, 0), own)
            most = max(most, own)
            size.setdefault(c, size[a] + size[b])
            right.setdefault(c, b)
        return most + 1, max(size.values())

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a row of symbols, lowest rank first, leftmost among equals."""
        get, none = self.fast.get, _NONE
        if len(ids) > 100:
            return self._merge_many(ids)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [new := best & 0xFFFFF]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], none)
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """merge() with a heap of (rank, place) and a linked list: n log n."""
        get, n = self.fast.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or get(ids[k] << 20 | ids[j]) != r:
                continue  # one of the two has merged since
            ids[k], ids[j] = r & 0xFFFFF, -1
            after[k] = i = after[j]
            if i >= 0:
                before[i] = k
                if (x := get(ids[k] << 20 | ids[i])) is not None:
                    heapq.heappush(heap, (x, k))
            if (i := before[k]) >= 0 and (x := get(ids[i] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (x, i))
        return [x for x in ids if x >= 0]

    def transduce(self, stream: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word whose bytes come in parts."""
        machine = Transducer(self)
        for more in stream:
            yield from machine.feed(more)
        yield from machine.end()

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        machine = Transducer(self)
        return machine.feed(word.encode("utf-8", "replace")) + machine.end()


class Transducer:
    """Bytes of one word in, ids out. A token leaves once `lookahead` more bytes stand after it: nothing that follows can
    change it then. Holds HELD bytes and the lookahead, however long the word is."""

    def __init__(self, m: Model):
        self.m, self.kept = m, bytearray()
        self.room = HELD + 2 * (m.lookahead + m.longest)

    def feed(self, more: bytes) -> list[int]:
        m, out = self.m, []
        for k in range(0, len(more), HELD):
            self.kept += more[k : k + HELD]
            while len(self.kept) > self.room:
                done = 0
                for i in m.merge([m.inner[b] for b in self.kept]):
                    if done + m.width[i] + m.lookahead > len(self.kept):
                        break
                    out.append(i)
                    done += m.width[i]
                del self.kept[:done]
        return out

    def end(self) -> list[int]:
        m, kept = self.m, self.kept
        self.kept = bytearray()
        return m.merge([*map(m.inner.__getitem__, kept[:-1]), m.last[kept[-1]]]) if kept else []


@functools.cache
def model(path: str) -> Model:
    """The model of a file, read once in each process."""
    return Model(path)


def normal(text: str) -> str:
    """NFC, then lower case letter by letter."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = _library()[0].normalize_str(text)
    return text.replace("Σ", "σ").lower()


def folded(text: str) -> str:
    """text with letters that Python can't fold yet folded by the library."""
    return _library()[1].normalize_str(text) if chars.recent()[chars.code_points([text])[0]].any() else text


@functools.cache
def _library():
    """The library's own tables, for the few texts that Python's may treat otherwise."""
    from tokenizers.normalizers import NFC, Lowercase

    return NFC(), Lowercase()


def word_spans(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: contractions after a lone apostrophe, letters, single numbers, other marks."""
    start, end, kind = chars.runs(c, offsets, chars.classes(), single=2)
    lone = np.flatnonzero((kind == 3) & (end - start == 1))
    lone = lone[(c[start[lone]] == 39) & (lone + 1 < len(start))] if len(lone) else lone
    drop = []
    for j in lone.tolist():
        if kind[j + 1] != 1 or start[j + 1] != end[j] or np.searchsorted(offsets, end[j], "right") != np.searchsorted(offsets, start[j], "right"):
            continue
        ahead = "".join(map(chr, c[end[j] : min(end[j] + 2, end[j + 1])]))
        for x in _CONTRACTIONS:
            if ahead.startswith(x):
                end[j] += len(x)
                start[j + 1] += len(x)
                if start[j + 1] == end[j + 1]:
                    drop.append(j + 1)
                break
    return (np.delete(start, drop), np.delete(end, drop)) if drop else (start, end)


def safe_cut(x: str, at: int, stop: int) -> tuple[int, bool]:
    """Where to cut a text from `at` on, and whether the cut parts one word.

    After white space, else before a number, or marks that follow something else; neither side's words or characters change.
    Where there is none up to `stop`, within a run of letters or of marks, between two characters that don't combine.
    """
    if m := _space.search(x, at, stop):
        return m.end(), False
    for m in _border.finditer(x, at, stop):
        return m.start() + 1, False
    table = chars.classes()
    for k in range(at, min(stop, len(x))):
        a, b = x[k - 1], x[k]
        if "'" in x[max(0, k - 3) : k + 1]:
            continue  # contractions
        if not unicodedata.combining(b) and not 0x1100 <= ord(b) < 0x1200 and (b.isascii() or unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)):
            if table[ord(a)] == table[ord(b)] != 2:
                return k, True
            if table[ord(b)] == 3:  # marks after a letter or number
                return k, False
    return len(x), False  # combining marks alone


_space = re.compile("[" + "".join(f"\\u{k:04x}" for k in chars.SPACES) + "]")
_border = re.compile(r"[\x21-\x7e](?=[0-9])|[A-Za-z0-9](?=[!-/:-@\[-`{-~])")


class Encoder:
    """Encodes many texts at once; each distinct word is encoded by `word` once and remembered."""

    def __init__(self, word: Callable[[str], list[int]], split: re.Pattern | None = None, special: dict[str, int] | None = None, transducer: Callable[[], Transducer] | None = None):
        self.word, self.split, self.special, self.transducer = word, split, special or {}, transducer
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.characters = np.zeros(1 << 14, np.uint32), 0, 0
        self.count = 0

    def _add(self, word: str) -> int:
        ids, k = self.word(word), self.count
        if k == len(self.size):
            self.begin, self.size = np.resize(self.begin, 2 * k), np.resize(self.size, 2 * k)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.begin[k], self.size[k] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += 1
        if len(word) <= REMEMBERED_LENGTH:
            self.known[word] = k
            self.characters += len(word)
        return k

    def parts(self, texts: list[str]) -> Iterator[tuple[int, str | int, bool]]:
        """Each text's parts in order: special tokens' ids, and texts of about WINDOW characters; true: the part ends within a word."""
        for i, t in enumerate(texts):
            for x in self.split.split(t) if self.split and "<|" in t else [t]:
                if x in self.special:
                    yield i, self.special[x], False
                    continue
                at = 0
                while len(x) - at > 2 * WINDOW:
                    cut, open_ = safe_cut(x, at + WINDOW, at + 2 * WINDOW)
                    yield i, normal(x[at:cut]), open_
                    at = cut
                if at < len(x):
                    yield i, normal(x[at:] if at else x), False

    def stream(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, next ids of it), in order."""
        held: list[tuple[int, str | int]] = []
        size = 0
        machine = None  # of a word that spans parts
        for i, x, open_ in self.parts(texts):
            if machine is not None or open_:
                yield from self._ids(held)
                held, size = [], 0
                first = folded(x) if isinstance(x, str) else ""
                cut = len(first)
                if machine is None:  # all but the last word of the part, which goes on
                    cut = int(word_spans(*chars.code_points([first]))[0][-1])
                    yield from self._ids([(i, first[:cut])])
                    machine = self.transducer()
                    yield i, np.array(machine.feed(first[cut:].encode("utf-8", "replace")), np.uint32)
                elif open_ and len(word_spans(*chars.code_points([first]))[0]) == 1:  # the word still goes on
                    yield i, np.array(machine.feed(first.encode("utf-8", "replace")), np.uint32)
                else:
                    _, end = word_spans(*chars.code_points([first]))
                    cut = int(end[0])
                    ids = machine.feed(first[:cut].encode("utf-8", "replace")) + machine.end()
                    yield i, np.array(ids, np.uint32)
                    machine = None
                    start, _ = word_spans(*chars.code_points([first[cut:]]))
                    last = cut + int(start[-1]) if open_ and len(start) else len(first)
                    yield from self._ids([(i, first[cut:last])])
                    if open_:
                        machine = self.transducer()
                        yield i, np.array(machine.feed(first[last:].encode("utf-8", "replace")), np.uint32)
                continue
            if size and size + (len(x) if isinstance(x, str) else 0) > WINDOW:
                yield from self._ids(held)
                held, size = [], 0
            held.append((i, x))
            size += len(x) if isinstance(x, str) else 0
        if held:
            yield from self._ids(held)

    def _ids(self, parts: list[tuple[int, str | int]]) -> Iterator[tuple[int, np.ndarray]]:
        if not parts:
            return
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS or self.used > 4 * REMEMBERED_CHARACTERS:
            self._forget()
        texts = [x if isinstance(x, str) else "" for _, x in parts]
        c, offsets = chars.code_points(texts)
        if (new := chars.recent()[c]).any():  # rare: the library folds what Python can't
            for k in np.unique(np.searchsorted(offsets, np.flatnonzero(new), "right") - 1).tolist():
                texts[k] = folded(texts[k])
            c, offsets = chars.code_points(texts)
        start, end = word_spans(c, offsets)
        whole = "".join(texts)
        words = [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(at < 0).tolist():
            found = self.known.get(words[k])
            at[k] = self._add(words[k]) if found is None else found
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[np.searchsorted(start, offsets)]
        for k, (i, x) in enumerate(parts):
            yield i, np.array([x], np.uint32) if isinstance(x, int) else ids[bounds[k] : bounds[k + 1]]


class Decoder:
    """Ids to text, part by part: bytes that don't yet make a character wait for the next ids."""

    def __init__(self, m: Model):
        self.gap = b"" if m.byte_level else b" "  # without a decoder a tokenizer puts its tokens' names in a row
        self.bytes = m.token_bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        data = self.gap.join(map(self.bytes.__getitem__, ids.tolist()))
        if self.begun and len(ids):
            data = self.gap + data
        self.begun = self.begun or len(ids) > 0
        return self.machine.decode(data, final)


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """For each id below 100,000 its decimal digits and a space as bytes in a row of 6, and which of them count."""
    table = np.full((100_000, 6), ord(" "), np.uint8)
    size = np.empty(100_000, np.int64)
    for n in range(1, 6):
        own = np.arange(10 ** (n - 1) if n > 1 else 0, 10**n)
        for k in range(n):
            table[own, k] = own // 10 ** (n - 1 - k) % 10 + 48
        size[own] = n + 1
    return table, np.arange(6) < size[:, None]


def decimals(ids: np.ndarray) -> bytes:
    """Decimal ids, each followed by a space."""
    if len(ids) and ids.max() >= 100_000:
        return "".join(f"{i} " for i in ids.tolist()).encode()
    table, counts = _decimals()
    return table[ids][counts[ids]].tobytes()


def transcode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """documents with n_tokens, ids_sha256 and decoded_sha256 of each whole text (null: empty); such columns are replaced.

    Memory, besides the row: two WINDOWs of characters, REMEMBERED words and HELD bytes of a word that is longer than a
    window, whatever the text's and its words' lengths.
    """
    documents = documents.drop("n_tokens", "ids_sha256", "decoded_sha256")
    schema = added(documents, n_tokens="long", ids_sha256="string", decoded_sha256="string")
    names = schema.fieldNames()

    def run(batches):
        m = model(path)
        encoder = Encoder(m.word, m.split, m.special, lambda: Transducer(m))
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            n, ids_hex, text_hex = [0] * len(texts), [""] * len(texts), [""] * len(texts)
            k, one, two, decoder = -1, hashlib.sha256(), hashlib.sha256(), Decoder(m)

            def close(one=None, two=None, decoder=None, k=-1):
                if k >= 0:
                    two.update(decoder.feed(np.empty(0, np.uint32), True).encode())
                    ids_hex[k], text_hex[k] = one.hexdigest(), two.hexdigest()

            for i, ids in encoder.stream(texts):
                if i != k:
                    close(one, two, decoder, k)
                    k, one, two, decoder = i, hashlib.sha256(), hashlib.sha256(), Decoder(m)
                if len(ids):
                    one.update((b" " if n[i] else b"") + decimals(ids)[:-1])
                    two.update(decoder.feed(ids).encode())
                    n[i] += len(ids)
            close(one, two, decoder, k)
            empty = hashlib.sha256().hexdigest()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array([x or empty for x in ids_hex]), pa.array([x or empty for x in text_hex])], names=names
            )

    return documents.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document (null text: empty)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return transcode(documents, public_tokenizers.path("word_bpe_49k.json")).drop("text")
