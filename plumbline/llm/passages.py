"""Operator 6: passages that repeat, found by MinHash of paragraphs.

Repeated passages begin in the middle of lines as often as not, so paragraphs
are cut by content: of any ``window`` successive words that a paragraph could
start at, the one whose word pair has the least hash is a start, and a
paragraph spans a fixed number of words.  The same passage is cut alike in
every text that holds it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops
from .common import Scratch, by_group, group_starts, settled, unique_name
from .components import components
from .pairing import block_members

LENGTH = 24
WINDOW = 28
SHINGLE = 3
BANDS = 8
ROWS = 3
THRESHOLD = 0.7
WAVE = 3  # bands that go through one shuffle
BLOCK = 512
SEED = 60
FEW = 1 << 20  # keys, of 8 bytes, that may be broadcast; more are joined by a shuffle


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two paragraphs of this Jaccard similarity share a key."""
    return 1 - (1 - similarity**rows) ** bands


def anchors(pairs: np.ndarray, first: np.ndarray, window: int, length: int) -> np.ndarray:
    """Where paragraphs start: the least hash (the rightmost if tied) of each ``window`` successive words with ``length`` words to follow.

    pairs has the hash of the word pair at each word, but for the block's
    last.  A text with fewer such words has one start.  In a loop of a few
    words one least hash comes again and again; of those only as many are kept
    as leave none of the windows without a start.
    """
    valid = np.maximum(np.diff(first) - length + 1, 0)
    if not valid.any():
        return np.zeros(0, np.int64)
    pairs = np.append(pairs, pairs[-1:])
    best, size = np.arange(len(pairs)), 1

    def less(a, b):
        return np.where(pairs[b] <= pairs[a], b, a)

    wide = np.flatnonzero(valid >= window)
    n = valid[wide] - window + 1
    at = np.zeros(0, np.int64)
    if len(wide):
        # the least of each window by doubling
        while size * 2 <= window:
            best = less(best[: len(best) - size], best[size:])
            size *= 2
        if size < window:
            best = less(best[: len(best) - window + size], best[window - size :])
        at = np.unique(best[np.arange(n.sum()) + np.repeat(first[:-1][wide] - (np.cumsum(n) - n), n)])
    few = [first[t] + valid[t] - 1 - int(np.argmin(pairs[first[t] : first[t] + valid[t]][::-1])) for t in np.flatnonzero((valid > 0) & (valid < window)).tolist()]
    at = np.sort(np.concatenate([at, np.array(few, np.int64)]))
    text = np.searchsorted(first, at, side="right") - 1
    tied = np.append(False, (pairs[at[1:]] == pairs[at[:-1]]) & (text[1:] == text[:-1]) & (at[1:] - at[:-1] <= window))
    head = np.flatnonzero(~tied)
    end = np.append(head[1:], len(at))
    keep, after = np.ones(len(at), bool), np.where(np.append(text[1:] == text[:-1], False), np.append(at[1:], 0), first[text] + valid[text])
    for a, b in zip(head[end - head > 1].tolist(), end[end - head > 1].tolist()):
        while a < b - 1:
            # with the next start, or the text's end, so near, the others of the loop aren't needed
            onward = b if after[b - 1] <= at[a] + window else max(a + 1, int(np.searchsorted(at[:b], at[a] + window, side="right")) - 1)
            keep[a + 1 : onward] = False
            a = onward
    return at[keep]


def _paragraphs(texts: list[str], length: int, window: int) -> tuple[textops.Words, np.ndarray, np.ndarray]:
    """Words of the texts, the first word of each paragraph, and its text."""
    w = textops.words(texts)
    at = anchors(textops.fold(w.hash, 2), w.first, window, length)
    return w, at, np.searchsorted(w.first, at, side="right") - 1


def band_keys(w: textops.Words, at: np.ndarray, length: int, shingle: int, bands: int, rows: int, seed: int) -> np.ndarray:
    """A key for each paragraph (row) and band (column), made of the band's minima and its number."""
    factors, addends = textops.permutations(bands * rows, seed)
    runs, width = textops.fold(w.hash, shingle), length - shingle + 1
    keys = np.repeat(textops.mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(at), axis=0)
    for p in range(bands * rows):
        # least of each window of the paragraph's shingles, by doubling
        size, low = 1, runs * factors[p] + addends[p]
        while size * 2 <= width:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        least = np.minimum(low[at], low[at + width - size])
        keys[:, p // rows] = textops.mix(keys[:, p // rows] ^ (least >> np.uint64(16)))
    return keys


def _beside(keys: np.ndarray, content: np.ndarray, at: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Where a paragraph shares a key with exactly one other that overlaps it in its text, and so does that one: true for the larger content of the two."""
    many, larger, pairs = np.zeros(keys.shape, np.int16), np.zeros(keys.shape, bool), []
    for d in range(1, len(at)):
        over = (text[d:] == text[:-d]) & (at[d:] - at[:-d] < length)
        if not over.any():
            break
        same = over[:, None] & (keys[d:] == keys[:-d])
        many[d:] += same
        many[:-d] += same
        up = (content[d:] >= content[:-d])[:, None]
        larger[d:] |= same & up
        larger[:-d] |= same & ~up
        pairs.append((d, same))
    for d, same in pairs:
        more = same & ((many[d:] != 1) | (many[:-d] != 1))
        larger[d:] &= ~more
        larger[:-d] &= ~more
    return larger


def _scanned(docs: DataFrame, length: int, window: int, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, h, s, e, content, beside, k0, k1, ...) for each paragraph.

    h is a hash of the whole text, since texts can share a doc_id; s and e
    are its first and past-the-end character, content the hash of all its
    words.  A paragraph whose key in a band is that of another that overlaps
    it has this band's bit in ``beside`` if its content is the larger.
    """
    names = ["doc_id", "h", "s", "e", "content", "beside", *(f"k{b}" for b in range(bands))]

    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in textops.blocks(texts):
                w, at, text = _paragraphs(texts[a:b], length, window)
                if not len(at):
                    continue
                content = textops.fold(w.hash, length)[at].view(np.int64)
                keys = band_keys(w, at, length, shingle, bands, rows, seed)
                beside = (_beside(keys, content, at, text, length) << np.arange(bands)).sum(axis=1, dtype=np.int64)
                columns = [ids[a:b][text], hashes[a:b][text], w.start[at], w.end[at + length - 1], content, beside, *keys.T.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text"), "text")
    return source.mapInArrow(settled(run), ", ".join(f"{n} long" for n in names))


def _colliding(found: DataFrame, bands: range, scratch: Scratch) -> DataFrame:
    """(key, id): the contents that have a key of these bands in common, where not only neighbours have it.

    The keys come from an aggregate that combines before the shuffle, so that
    the paragraphs of a hot key don't meet on one task; their contents come
    from a semi-join, by broadcast if the keys are few, else one that AQE can
    split.
    """
    own = F.array(*(F.when(F.col("beside").bitwiseAND(1 << b) == 0, F.col(f"k{b}")) for b in bands))
    single = found.select("content", F.explode(own).alias("key")).where("key IS NOT NULL")
    keys = single.groupBy("key").agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least < most").select("key")
    keys = scratch.save(keys, "keys")
    few = keys.count() <= FEW
    every = found.select(F.col("content").alias("id"), F.explode(F.array(*(f"k{b}" for b in bands))).alias("key"))
    near = scratch.save(every.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("key", "id").distinct(), "near")
    scratch.drop(keys)
    return near


def shingle_sets(words: np.ndarray, shingle: int) -> np.ndarray:
    """The set of shingles of each row of word hashes: rising numbers, with 0 in place of repeats."""
    n = words.shape[1] - shingle + 1
    flat = textops.fold(words.reshape(-1), shingle) if len(words) else np.zeros(0, np.uint64)
    rows = np.append(flat, np.zeros(shingle - 1, np.uint64)).reshape(len(words), -1)[:, :n]
    rows = np.sort(np.maximum(rows, np.uint64(1)), axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
    return np.sort(rows, axis=1)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets in rows of a and b (see shingle_sets) have at least this exact Jaccard similarity."""
    both = np.concatenate([a, b], axis=1)
    both.sort(axis=1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(axis=1)
    return common >= threshold * ((a != 0).sum(axis=1) + (b != 0).sum(axis=1) - common)


def forests(starts: np.ndarray, similar) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, in each group of rows, exactly what all its similar pairs connect.

    similar(i, j) tests rows i against rows j one by one.  All groups go on
    together: in each round each compares one row, a connected one if there
    is any, with those of its rows that are not connected yet.
    """
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    rows = np.arange(len(group))
    waiting = np.zeros(len(group), bool)  # connected, but not compared
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows):
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        order = np.where(waiting[rows], 0, len(rows)) + np.arange(len(rows))
        pivot = np.minimum.reduceat(order, begin) % len(rows)
        size = np.diff(np.append(begin, len(rows)))
        against = np.repeat(rows[pivot], size)
        test = ~waiting[rows] & (rows != against)
        hit = np.zeros(len(rows), bool)
        hit[test] = similar(against[test], rows[test])
        us.append(against[hit])
        vs.append(rows[hit])
        waiting[rows[hit]] = True
        stay = rows != against
        # a group of which no row is left to find is done
        open_ = np.repeat(np.add.reduceat(stay & ~waiting[rows], begin) > 0, size)
        rows, group = rows[stay & open_], group[stay & open_]
    return np.concatenate(us), np.concatenate(vs)


def _near_edges(members: DataFrame, firsts: DataFrame, docs: DataFrame, length: int, shingle: int, threshold: float) -> DataFrame:
    """Edges (u, v) between different contents that share a key and pass the exact test, but for neighbours.

    firsts has the first place of each content.  Contents whose first places
    overlap in one text are neighbours: they share words there, and are no
    copies of each other.
    """
    grouped = firsts.groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct("content", "first.s", "first.e")).alias("places"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = texts.join(grouped, ["doc_id", "h"]).select("doc_id", "h", "text", F.col("places.content").alias("contents"), F.col("places.s").alias("starts"), F.col("places.e").alias("ends"))
    names = ["id", "doc_id", "h", "s", "e", "set"]

    def cut(batches):
        for batch in batches:
            parts, own = [], [[] for _ in range(5)]
            for doc, h, text, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                parts += [text[a:b] for a, b in zip(*lists[1:])]
                for k, x in enumerate((lists[0], [doc] * len(lists[0]), [h] * len(lists[0]), *lists[1:])):
                    own[k] += x
            for a, b in textops.blocks(parts):
                sets = shingle_sets(textops.words(parts[a:b]).hash.reshape(b - a, length), shingle)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b], pa.int64()) for x in own), pa.array([r.tobytes() for r in sets], pa.binary())], names=names)

    # a row of docs that is there twice has each set twice
    sets = found.mapInArrow(settled(cut), "id long, doc_id long, h long, s long, e long, set binary").dropDuplicates(["id"])

    def compare(table):
        starts = group_starts(table, ["key", "i", "j"])
        ids, doc, h, s, e = (table.column(c).to_numpy() for c in names[:-1])
        sets = np.frombuffer(b"".join(table.column("set").to_pylist()), np.uint64).reshape(len(ids), -1)

        def similar(i, j):
            out = ~((doc[i] == doc[j]) & (h[i] == h[j]) & (s[i] < e[j]) & (s[j] < e[i]))
            for a in range(0, len(i), 1 << 16):
                out[a : a + (1 << 16)] &= alike(sets[i[a : a + (1 << 16)]], sets[j[a : a + (1 << 16)]], threshold)
            return out

        u, v = forests(starts, similar)
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return by_group(members.join(sets, "id").select("key", "i", "j", *names), ["key", "i", "j"], compare, "u long, v long")


def occurrences(docs: DataFrame, scratch: Scratch, length: int = LENGTH, window: int = WINDOW, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(cluster, doc_id, h, s, e, removed, head, other, exact): each paragraph that another one repeats.

    head is the cluster's first occurrence by (doc_id, h, s, e); all others are
    removed.  other is the first occurrence of the same words, or the last one
    for the first itself; of the cluster where none has the same words, which
    exact tells.
    """
    # keys have no value twice
    found = scratch.save(_scanned(docs, length, window, shingle, bands, rows, seed), "paragraphs", **{"parquet.enable.dictionary": "false"})
    # a few bands at a time, so that their shuffles are not on disk together
    entries = [_colliding(found, range(b, min(b + WAVE, bands)), scratch) for b in range(0, bands, WAVE)]
    places = scratch.save(found.select("doc_id", "h", "s", "e", "content"), "places")
    scratch.drop(found)
    members = scratch.save(block_members(reduce(DataFrame.unionAll, entries), block), "members")
    for one in entries:
        scratch.drop(one)
    place = F.struct("doc_id", "h", "s", "e")
    firsts = places.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    wanted = members.select(F.col("id").alias("content")).distinct().withColumn("near", F.lit(True))
    firsts = scratch.save(firsts.join(wanted, "content", "left").where("first < last OR near"), "firsts")
    edges = scratch.save(_near_edges(members, firsts.where("near"), docs, length, shingle, threshold), "alike")
    clusters = components(edges, scratch).select(F.col("node").alias("content"), F.col("component").alias("cluster"))
    repeated = firsts.where("first < last").select("content", "first", "last")
    repeated = scratch.save(repeated.join(clusters, "content", "full").select("content", F.coalesce("cluster", "content").alias("cluster"), "first", "last"), "clusters")
    every = scratch.save(places.join(repeated, "content").select("cluster", "first", "last", "doc_id", "h", "s", "e").distinct(), "places")
    scratch.drop(places)
    # the first occurrence comes from an aggregate, not a window, so that no task holds a whole cluster
    heads = every.groupBy("cluster").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head < tail")
    removed = place != F.col("head")
    equal = F.when(place != F.col("first"), F.col("first")).otherwise(F.col("last"))
    other = F.coalesce(equal, F.when(removed, F.col("head")).otherwise(F.col("tail")))
    return every.join(heads, "cluster").select("cluster", "doc_id", "h", "s", "e", removed.alias("removed"), "head", other.alias("other"), F.col("first").isNotNull().alias("exact"))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans (doc_id, h, removed, s, e) of a text that are alike removed or kept get the same part."""
    order = Window.partitionBy("doc_id", "h", "removed").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(before >= F.col("s"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("part", part)


def _beyond(texts: list[str], at: list[int], sides: list[int], words: int) -> list[str]:
    """The ``words`` words before (side 0) or from (side 1) a place of each text, or all that there are."""
    out, reach, open_ = [""] * len(texts), 12 * words, list(range(len(texts)))
    while open_:
        parts = [texts[i][at[i] : at[i] + reach] if sides[i] else texts[i][max(0, at[i] - reach) : at[i]] for i in open_]
        again = []
        for a, b in textops.blocks(parts):
            w = textops.words(parts[a:b])
            for i, part, lo, hi in zip(open_[a:b], parts[a:b], w.first[:-1].tolist(), w.first[1:].tolist()):
                # the farthest word may be cut
                if hi - lo > words:
                    out[i] = part[: w.end[lo + words - 1]] if sides[i] else part[w.start[hi - words] :]
                elif reach >= len(texts[i]):
                    out[i] = part
                else:
                    again.append(i)
        open_, reach = again, reach * 4
    return out


def _around(asked: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(doc, h, side, pos, near): the ``words`` words before (side 0) or from (side 1) each place (doc, h, side, pos)."""
    grouped = asked.distinct().groupBy("doc", "h").agg(F.collect_list(F.struct("side", "pos")).alias("places"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), "text")
    found = texts.join(grouped, ["doc", "h"]).select("doc", "h", "text", F.col("places.side").alias("sides"), F.col("places.pos").alias("at"))
    names = ["doc", "h", "side", "pos", "near"]

    def run(batches):
        for batch in batches:
            docs, hashes, texts, sides, at = [], [], [], [], []
            for d, h, text, s, p in zip(*(c.to_pylist() for c in batch.columns)):
                docs += [d] * len(s)
                hashes += [h] * len(s)
                texts += [text] * len(s)
                sides += s
                at += p
            near = _beyond(texts, at, sides, words)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((docs, hashes, sides, at, near), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=names)

    near = found.mapInArrow(settled(run), "doc long, h long, side int, pos long, near string")
    # a row of docs that is there twice has each place twice
    return near.dropDuplicates(["doc", "h", "side", "pos"])


def _agreeing(batches):
    """How many characters further the text of each row agrees word by word with the other's."""
    for batch in batches:
        sides, own, other = (batch.column(k).to_pylist() for k in ("side", "near", "other_near"))
        more = np.zeros(len(sides), np.int64)
        own, other = [x or "" for x in own], [x or "" for x in other]
        for a, b in textops.blocks(own):
            w, o = textops.words(own[a:b]), textops.words(other[a:b])
            for i in range(b - a):
                x, y = w.hash[w.first[i] : w.first[i + 1]], o.hash[o.first[i] : o.first[i + 1]]
                n = min(len(x), len(y))
                if not n:
                    continue
                if sides[a + i]:
                    differ = x[:n] != y[:n]
                    n = int(differ.argmax()) if differ.any() else n
                    more[a + i] = w.end[w.first[i] + n - 1] if n else 0
                else:
                    differ = (x[len(x) - n :] != y[len(y) - n :])[::-1]
                    n = int(differ.argmax()) if differ.any() else n
                    more[a + i] = len(own[a + i]) - w.start[w.first[i + 1] - n] if n else 0
        names = ["doc_id", "h", "removed", "part", "side", "outer", "pos", "first_doc"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(more)], names=[*names, "more"])


def _passages(found: DataFrame, docs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(doc_id, h, removed, first_doc, start_char, end_char): paragraphs in a row as one passage, whose ends go as far as texts agree.

    An end is compared with the other occurrence of its outermost paragraph,
    of those with equal words if there are any.  Texts that agree over
    ``window`` more words have another paragraph there in common, with ends of
    its own.
    """
    text = ["doc_id", "h", "removed"]
    # the smallest and the largest order equal paragraphs before and behind others
    left, right = F.struct(~F.col("exact"), "s", "other"), F.struct("exact", "e", "other")
    ends = _merged(found.select(*text, "s", "e", "head", "other", "exact")).groupBy(*text, "part").agg(F.min(left).alias("l"), F.max(right).alias("r"), F.min("s").alias("s"), F.max("e").alias("e"), F.min("head.doc_id").alias("first_doc"))
    side = lambda k, c, p: F.struct(F.lit(k).alias("side"), F.col(p).alias("outer"), F.col(f"{c}.{p}").alias("pos"), F.col(f"{c}.other.doc_id").alias("other_doc"), F.col(f"{c}.other.h").alias("other_h"), F.col(f"{c}.other.{p}").alias("other_pos"))
    sides = ends.select(*text, "part", "first_doc", F.explode(F.array(side(0, "l", "s"), side(1, "r", "e"))).alias("x")).select(*text, "part", "first_doc", "x.*")
    sides = scratch.save(sides, "sides")
    asked = sides.select(F.col("doc_id").alias("doc"), "h", "side", "pos").union(sides.select("other_doc", "other_h", "side", "other_pos"))
    near = scratch.save(_around(asked, docs, window), "around")
    own = near.withColumnRenamed("doc", "doc_id")
    other = near.select(F.col("doc").alias("other_doc"), F.col("h").alias("other_h"), "side", F.col("pos").alias("other_pos"), F.col("near").alias("other_near"))
    both = sides.join(own, ["doc_id", "h", "side", "pos"], "left").join(other, ["other_doc", "other_h", "side", "other_pos"], "left")
    grown = both.select(*text, "part", "side", "outer", "pos", "first_doc", "near", "other_near").mapInArrow(settled(_agreeing), "doc_id long, h long, removed boolean, part long, side int, outer long, pos long, first_doc long, more long")
    begin = F.min(F.when(F.col("side") == 0, F.least("outer", F.col("pos") - F.col("more"))))
    end = F.max(F.when(F.col("side") == 1, F.greatest("outer", F.col("pos") + F.col("more"))))
    whole = grown.groupBy(*text, "part").agg(begin.alias("s"), end.alias("e"), F.min("first_doc").alias("first_doc"))
    return _merged(whole.drop("part")).groupBy(*text, "part").agg(F.min("s").alias("start_char"), F.max("e").alias("end_char"), F.min("first_doc").alias("first_doc")).drop("part")


def _found(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _passages(scratch.save(occurrences(docs, scratch, **parameters), "occurrences"), docs, scratch, parameters.get("window", WINDOW))


def repeated_passages(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """(doc_id, start_char, end_char, first_doc, removed): all passages that repeat.

    Paragraphs of ``length`` words start at one of any ``window`` successive
    words (textops has what a word is, anchors how it is chosen), so passages
    of length + window - 1 equal words have one in common.  Each gives
    ``bands`` keys of ``rows`` minima over its shingles, by default enough
    for 0.96 of the pairs at the threshold (see recall).  Paragraphs that
    share a key are compared (but not those that overlap in one text): equal
    ones repeat, others if the exact Jaccard similarity of their shingles is
    at least ``threshold``.  Clusters are connected components.  The first
    occurrence by (doc_id, text's hash, place) stays, all others are removed,
    in the same document too.  Overlapping paragraphs are merged, and both
    ends go on word by word while the texts agree: a row covers
    text[start_char:end_char], and first_doc is the least doc_id that keeps a
    copy of a part of it.

    Rows with a null doc_id or text, and texts of fewer than ``length`` words,
    have no passages; nor have repeats shorter than that.  Rows that repeat a
    doc_id with the same text count as one document; rows with different texts
    are documents of their own.  Texts and words of any length are read whole.
    Other columns are ignored.  No documents, no rows.
    """
    return _found(docs, scratch, **parameters).select("doc_id", "start_char", "end_char", "first_doc", "removed")


def cut_passages(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """docs with removed passages taken out of text, and n_chars counted again if it is there.

    No row goes: a document of which all was repeated keeps what lies between
    the passages, possibly nothing.  Rows without passages keep their text as
    it is, null included.  Edge cases: repeated_passages.
    """
    gone = scratch.save(_found(docs, scratch, **parameters).where("removed").select("doc_id", "h", "start_char", "end_char"), "removed")
    key, text_hash, column = (unique_name(docs, k) for k in ("cut_id", "cut_hash", "cut_spans"))
    spans = gone.groupBy(F.col("doc_id").alias(key), F.col("h").alias(text_hash)).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias(column))
    joined = docs.join(spans, (docs["doc_id"] == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left")
    # text from the end of each removed passage to the start of the next
    kept = F.expr(
        f"array_join(transform(sequence(0, size(`{column}`)), i -> substring(text, "
        f"cast(if(i = 0, 0, `{column}`[i - 1].end_char) as int) + 1, "
        f"cast(if(i = size(`{column}`), char_length(text), `{column}`[i].start_char) - if(i = 0, 0, `{column}`[i - 1].end_char) as int))), '')"
    )
    text = F.when(F.col(column).isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(column).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(docs.columns)
