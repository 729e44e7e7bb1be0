"""Byte-level byte-pair merges of many words at once, and operator 8: token counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A file of ranks: one token a line, base64 of its bytes and its rank, which is its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 300_000  # words whose results a task keeps; it then starts afresh
_NONE = np.int32(np.iinfo(np.int32).max)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Merges:
    """A vocabulary as arrays: ids of single bytes, and a hash table of mergeable pairs."""

    byte_ids: np.ndarray
    keys: np.ndarray  # left << 32 | right, or -1
    ranks: np.ndarray
    shift: int
    pieces: list[bytes]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is the id of what it merges to; _NONE if it doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.view(np.uint64) * _FACTOR >> np.uint64(self.shift)).astype(np.int64)
        out = np.full(len(key), _NONE, np.int32)
        open_ = np.arange(len(key))
        mask = len(self.keys) - 1
        while len(open_):
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (there != -1)
            open_, slot = open_[more], slot[more] + 1 & mask
        return out


def load(path: str = VOCABULARY) -> Merges:
    """Read a file of ranks.  Its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs = {}
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = r
    bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
    keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    shift, mask = 64 - bits, (1 << bits) - 1
    for key, r in pairs.items():
        at = (key * int(_FACTOR) & (1 << 64) - 1) >> shift
        while keys[at] != -1:
            at = at + 1 & mask
        keys[at], values[at] = key, r
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        pieces[r] = token
    return Merges(np.array([ranks[bytes([i])] for i in range(256)], np.int32), keys, values, shift, pieces)


def merge(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and offsets of each word's.

    All words are one ragged array of symbols.  In each round every word
    applies its pair of least rank, wherever it stands in the word from left
    to right.  If that makes a pair of still lower rank, only the leftmost
    place is merged, so that the order is always that of single merges.
    Words that have no pair left drop out of the rounds.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words))
    final = np.zeros(len(words), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their symbols in order)
    symbols = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lens)
    ranks = np.full(len(symbols), _NONE, np.int32)  # of the pair that starts here
    if len(symbols) > 1:
        ranks[:-1] = np.where(owner[:-1] == owner[1:], m.rank(symbols[:-1], symbols[1:]), _NONE)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(starts, len(symbols)))
        least = np.minimum.reduceat(ranks, starts)
        over = least == _NONE
        if over.any():
            gone = np.repeat(over, counts)
            final[owner[starts[over]]] = counts[over]
            done.append((owner[starts[over]], symbols[gone]))
            if over.all():
                break
            symbols, owner, ranks = symbols[~gone], owner[~gone], ranks[~gone]
            least, counts = least[~over], counts[~over]
            starts = np.cumsum(counts) - counts
        goal = np.repeat(least, counts)
        hit = np.flatnonzero(ranks == goal)
        # in a chain of overlapping places every second one is merged
        fresh = np.append(True, hit[1:] != hit[:-1] + 1)
        head = np.flatnonzero(fresh)
        place = np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))
        hit = hit[place % 2 == 0]
        at = _apply(symbols, owner, goal, hit, m)
        if at is None:  # some word makes a lower rank: its leftmost place only
            first = np.append(True, owner[hit[1:]] != owner[hit[:-1]])
            at = _apply(symbols, owner, goal, hit[first], m, True)
        symbols, owner, ranks = at if at[2] is not None else (at[0], at[1], _ranks(at[0], at[1], m))
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(final, out=offsets[1:])
    out = np.empty(offsets[-1], np.int32)
    for which, ids in done:
        n = final[which]
        within = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(offsets[which], n) + within] = ids
    return out, offsets


def _ranks(symbols: np.ndarray, owner: np.ndarray, m: Merges) -> np.ndarray:
    ranks = np.full(len(symbols), _NONE, np.int32)
    if len(symbols) > 1:
        ranks[:-1] = np.where(owner[:-1] == owner[1:], m.rank(symbols[:-1], symbols[1:]), _NONE)
    return ranks


def _apply(symbols, owner, goal, hit, m, always=False):
    """Symbols, owners and ranks after merging the pairs that start at hit; None if a lower rank arises in a word of several places."""
    merged = symbols.copy()
    merged[hit] = goal[hit]
    keep = np.ones(len(symbols), bool)
    keep[hit + 1] = False
    after, who = merged[keep], owner[keep]
    ranks = _ranks(after, who, m)
    if not always:
        several = np.flatnonzero(owner[hit[1:]] == owner[hit[:-1]])
        if len(several):
            low = ranks < goal[keep]
            if low.any() and np.isin(who[low], owner[hit[several]]).any():
                return None
    return after, who, ranks


def splitter():
    """A function that splits a text into words."""
    import regex

    return regex.compile(PATTERN).findall


def finder():
    """A function that gives a text's words as matches, one at a time."""
    import regex

    return regex.compile(PATTERN).finditer


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs: tokens of text under the byte-level vocabulary of a file of ranks.

    Words (see PATTERN) that a task has met before are looked up; the new
    ones of a batch are merged together as ragged arrays.

    A null text has a null count, an empty one 0.  Names of special tokens are
    ordinary text, a lone surrogate counts as the replacement character.
    Repeated rows each have a result; a null doc_id stays null.  Other columns
    are ignored.  No documents, no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # of the vocabulary's size

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, split, known = shared.value, splitter(), {}
        for text in parts:
            out = np.zeros(len(text), np.int64)
            words = [split(t) if t else () for t in text]
            new = list(set().union(*words).difference(known))
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = list(set().union(*words))
            for a in range(0, len(new), 100_000):
                offsets = merge([w.encode("utf-8", "replace") for w in new[a : a + 100_000]], m)[1]
                known.update(zip(new[a : a + 100_000], np.diff(offsets).tolist()))
            get = known.__getitem__
            for i, w in enumerate(words):
                out[i] = sum(map(get, w))
            yield pd.Series(out)

    return docs.select("doc_id", F.when(F.col("text").isNotNull(), count("text")).alias("n_tokens"))
