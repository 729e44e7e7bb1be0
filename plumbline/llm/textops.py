"""Words and shingles of whole batches of texts as numpy arrays.

A word is a run of letters, digits and marks, lower-cased character by
character; each Han or kana character is a word by itself.  Words are known by
64-bit hashes: prefix sums of a polynomial give all hashes of a block at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_CHARS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_tables: tuple[np.ndarray, np.ndarray] | None = None
_cased: tuple[np.ndarray, np.ndarray] | None = None
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Class (0 gap, 1 part of a word, 2 a word alone) and hash of each character below U+10000."""
    global _tables
    if _tables is None:
        kind = np.zeros(0x10000, np.uint8)
        low = np.arange(0x10000, dtype=np.uint64)
        for i in range(0x10000):
            c = chr(i)
            if c.isalnum() or unicodedata.category(c)[0] == "M":
                kind[i] = 1
            small = c.lower()
            if len(small) == 1:
                low[i] = ord(small)
        for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
            kind[a : b + 1] = np.where(kind[a : b + 1] == 1, 2, 0)
        kind[0xFFFF] = 1  # stands for everything from there on
        _tables = kind, mix(low + np.uint64(1))
    return _tables


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, BLOCK_CHARS * 2)
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


@dataclass
class Words:
    """Words of a block: hash, and first and past-the-end character in its text; first[i]:first[i+1] are text i's."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, with one line feed after each text, and where each text starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=base[1:])
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), base


def _runs(texts: list[str], kinds: np.ndarray, hashes: np.ndarray) -> Words:
    """Maximal runs of characters of one kind other than 0; each character of kind 2 is a run by itself."""
    cp, base = codepoints(texts)
    n = len(cp)
    short = np.minimum(cp, np.uint32(0xFFFF))
    kind = kinds[short]
    begins = kind != 0
    ends = begins.copy()
    joined = (kind[1:] == kind[:-1]) & (kind[1:] != 2)
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = hashes[short]
    far = cp > 0xFFFE
    if far.any():
        value[far] = mix(cp[far].astype(np.uint64) + np.uint64(1))
    up, down = _power(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=prefix[1:])
    found = mix((prefix[end] - prefix[start]) * down[start])
    first = np.searchsorted(start, base)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(found, start - base[owner], end - base[owner], first)


def words(texts: list[str]) -> Words:
    """The words of all texts, in order."""
    return _runs(texts, *_lookup())


def tokens(texts: list[str]) -> Words:
    """Words with their case, and runs of other visible characters."""
    global _cased
    if _cased is None:
        kind = _lookup()[0].copy()
        for i in np.flatnonzero(kind == 0).tolist():
            if not chr(i).isspace() and unicodedata.category(chr(i)) not in ("Cc", "Cf"):
                kind[i] = 3
        _cased = kind, mix(np.arange(0x10000, dtype=np.uint64) + np.uint64(1))
    return _runs(texts, *_cased)


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit characters; a longer text is a range by itself."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if i > begin and chars + len(t) > limit:
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += hashes[j : j + n]
    return mix(acc)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and offsets of each text's.

    A text of 1 to k - 1 words has one shingle, of all its words; one without
    words has none.
    """
    counts = np.diff(w.first)
    has = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(has, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    folded = fold(w.hash, k)
    full = counts >= k
    owner = np.repeat(np.arange(len(counts)), np.where(full, has, 0))
    if len(owner):
        runs = np.where(full, has, 0)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        out[offsets[owner] + within] = folded[w.first[owner] + within]
    for i in np.flatnonzero((counts > 0) & ~full):
        part = w.hash[w.first[i] : w.first[i + 1]]
        out[offsets[i]] = fold(part, len(part))[0]
    return out, offsets


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n multiply-shift hash functions."""
    rng = np.random.default_rng(seed)
    draw = np.frombuffer(rng.bytes(16 * n), np.uint64).reshape(2, n)
    return draw[0] | np.uint64(1), draw[1]


def minima(values: np.ndarray, offsets: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """For each non-empty text, in order, the upper 32 bits of each hash function's minimum."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begin), len(factors)), np.uint32)
    if not len(begin):
        return out
    h = np.empty_like(values)
    for p in range(len(factors)):
        np.multiply(values, factors[p], out=h)
        h += addends[p]
        out[:, p] = np.minimum.reduceat(h, begin) >> np.uint64(32)
    return out
