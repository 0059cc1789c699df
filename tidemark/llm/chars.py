"""Texts as arrays of code points: runs of a character class, their 64-bit hashes, n-grams of them."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

_STEP = 0x9E3779B97F4A7C15
#: White space as Unicode's White_Space property has it.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 anything else.

    Code points that Python's Unicode tables don't know yet are as the tokenizers library's patterns have them.
    """
    table = np.full(0x110000, 3, np.uint8)
    category = [unicodedata.category(chr(i)) for i in range(0x110000)]
    for i, k in enumerate(category):
        if k[0] == "L":
            table[i] = 1
        elif k[0] == "N":
            table[i] = 2
    late = [i for i in range(0x40000) if category[i] == "Cn"]  # later planes have no letters
    at = np.array(late)
    every = "".join(map(chr, late))
    for k, letters in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for _, (start, end) in Split(Regex(letters), "removed", invert=True).pre_tokenize_str(every):
            table[at[start:end]] = k
    table[SPACES] = 0
    return table


@functools.cache
def recent() -> np.ndarray:
    """Code points that Python's own Unicode tables don't know, so that it can't fold their case."""
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


@functools.cache
def words_and_marks() -> np.ndarray:
    """0 white space, 1 letters, digits and underscore, 3 anything else."""
    table = np.where(classes() == 2, 1, classes()).astype(np.uint8)
    table[ord("_")] = 1
    return table


@functools.cache
def spaces_only() -> np.ndarray:
    """0 white space, 1 anything else."""
    return np.minimum(classes(), 1).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and where each text begins (one entry more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def runs(c: np.ndarray, offsets: np.ndarray, table: np.ndarray, single: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of maximal runs of one class within one text; class `single` stands alone, class 0 is left out."""
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    k = table[c]
    new = np.empty(len(c), bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    if single >= 0:
        new |= k == single
    inner = offsets[:-1]
    new[inner[inner < len(c)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(c))
    kind = k[start]
    kept = kind != 0
    return start[kept], end[kept], kind[kept]


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, the same wherever the span stands; spans are in order and apart.

    Each code point and its place in the span give one scrambled number, and these add up: other than with powers of one
    base, no family of regular words (such as Thue-Morse words) shares a sum.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    place = np.arange(start[0], len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    each = mix((place.astype(np.uint64) << np.uint64(21)) + c[start[0] :].astype(np.uint64) + np.uint64(1))
    bounds = np.column_stack([start, end]).ravel() - start[0]
    if bounds[-1] == len(each):
        bounds = bounds[:-1]
    return mix(np.add.reduceat(each, bounds)[::2] + (end - start).astype(np.uint64) * np.uint64(_STEP))


#: Characters whose tokens are found at once.
AT_ONCE = 1 << 21


def token_hashes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, and where each text's tokens begin.

    A longer text than AT_ONCE goes through in parts that end where a token does, so working arrays stay small.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * AT_ONCE:
        out, at = [], 0
        while at < len(texts[0]):
            end = at + AT_ONCE
            while end < len(texts[0]) and table[ord(texts[0][end])] == table[ord(texts[0][end - 1])]:
                end += 1
            out.append(token_hashes([texts[0][at:end]], table)[0])
            at = end
        return np.concatenate(out), np.array([0, sum(map(len, out))], np.int64)
    if len(texts) > 1 and sum(map(len, texts)) > 2 * AT_ONCE:
        parts = [token_hashes([t], table)[0] for t in texts]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    c, offsets = code_points(texts)
    start, end, _ = runs(c, offsets, table)
    return span_hashes(c, start, end), np.searchsorted(start, offsets).astype(np.int64)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values within [bounds[i], bounds[i + 1]); 0 where that is empty."""
    out = np.zeros(len(bounds) - 1)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def segment_sums_u64(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of 64-bit words modulo 2**64 within [bounds[i], bounds[i + 1])."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out
