"""Exact top-k of many queries in one pass over the points.

Each task scores its Arrow batches against all queries of a block and keeps
the best k of each, so that queries * k rows a task leave it, not points *
queries.  A window over those gives the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import PART, cosine_rows, matrix, norms, rows_of, short_units, slack

#: Bytes of query vectors that one pass has on each executor; more queries take more passes.
BLOCK_BYTES = 32 << 20
#: Bytes of vectors of 32 bits that a side of one group has at most.  The larger it is, the fewer groups each row goes to.
GROUP_BYTES = 64 << 20
TILE = 4 << 20  # scores that are held at once
WIDE = 1 << 14  # points that a block of queries is scored against at once
GROUP = 32  # scores of which only the highest is looked at to find the kth
LISTS = 1 << 16  # lists whose rows are counted on the driver
SPREAD = 8 << 20  # marks of queries and lists that are held at once


def _best(scores: np.ndarray, cids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties by canonical id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
    else:
        rows = np.arange(len(scores))
    order = sorted(rows.tolist(), key=lambda r: (-scores[r], cids[r]))
    return np.array(order[:k], np.int64)


def _kept(near: np.ndarray, held: np.ndarray, most: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The highest scores so far (held has as many as are asked for, in no order), and rows and columns of near that can be among them."""
    k = held.shape[1]
    # the kth of the groups' highest isn't above the kth of all
    tops = near.reshape(len(near), -1, GROUP).max(axis=2) if near.shape[1] % GROUP == 0 and near.shape[1] >= 4 * k * GROUP else near
    both = np.concatenate([held, tops], axis=1)
    held = np.partition(both, tops.shape[1], axis=1)[:, tops.shape[1] :]
    return held, *np.nonzero(near >= np.maximum(held[:, 0] - most, np.float32(-2))[:, None])


def winners(cids: np.ndarray | pa.ChunkedArray, x: np.ndarray, y: np.ndarray, k: int, narrow: bool = False, own: np.ndarray | None = None, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of y, rows of x and scores of the k rows of x of highest cosine for each row of y, best first, ties by canonical id.

    A product in 32 bits finds what can be among the best, up to its rounding;
    only that is scored in the order of the components, which alone decides.
    With ``narrow`` scores are rounded to 32 bits before they rank.  A row of
    y sees the rows of x whose list (``own``) its row of ``open_`` has, all
    if there is none.
    """
    return Side(cids, x, own).winners(y, k, narrow, open_)


class Side:
    """Points that many blocks of queries are scored against: x in its own numbers and, as units, in 32 bits.

    Points are looked at in parts of WIDE rows, by list if they have any, and
    a part is passed over by queries that see none of its lists.
    """

    def __init__(self, cids: np.ndarray | pa.ChunkedArray, x: np.ndarray, own: np.ndarray | None = None):
        self.own, self.rows = own, None
        if own is not None and (np.diff(own) < 0).any():
            self.rows = np.argsort(own, kind="stable")
            self.own, x = own[self.rows], x[self.rows]
        order = np.argsort(cids, kind="stable") if isinstance(cids, np.ndarray) else pc.sort_indices(cids).to_numpy()
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.place = place if self.rows is None else place[self.rows]
        self.x, self.n = x, norms(x)
        self.u = short_units(x, self.n, -(-len(x) // GROUP) * GROUP)

    def winners(self, y: np.ndarray, k: int, narrow: bool = False, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(self.x), min(k, len(self.x))
        if not n or not len(y) or k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        ny = norms(y)
        uy = short_units(y, ny, len(y))
        # scores that are equal in 32 bits are less than an ulp apart
        most = np.float32(slack(y.shape[1], np.float32) + (2.0**-22 if narrow else 0))
        step = max(1, TILE // max(min(len(self.u), WIDE), k))
        qs, rows, scores = [], [], []
        for a in range(0, len(y), step):
            tile = uy[a : a + step]
            held, parts = np.full((len(tile), k), -4, np.float32), []
            for b in range(0, n, WIDE):
                end = min(b + WIDE, n)
                who = slice(None)
                if open_ is not None:
                    lists, which = np.unique(self.own[b:end], return_inverse=True)
                    seen = open_[a : a + step][:, lists]
                    who = np.flatnonzero(seen.any(axis=1))
                    if not len(who):
                        continue
                near = tile[who] @ self.u[b : b + WIDE].T
                near[:, end - b :] = -4
                if open_ is not None and not seen[who].all():
                    np.copyto(near[:, : end - b], np.float32(-4), where=~seen[who][:, which])
                held[who], q, r = _kept(near, held[who], most)
                parts.append((q if open_ is None else who[q], r + b, near[q, r]))
            if not parts:
                continue
            q, r, near = (np.concatenate(c) for c in zip(*parts))
            real = near >= (held[:, 0] - most)[q]  # the kth is higher now than when it was found
            q, r = q[real] + a, r[real]
            s = cosine_rows(self.x, self.n, y, ny, r, q)
            if narrow:
                s = s.astype(np.float32).astype(np.float64)
            order = np.lexsort((self.place[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            qs.append(q[best])
            rows.append(r[best] if self.rows is None else self.rows[r[best]])
            scores.append(s[best])
        if not qs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(qs), np.concatenate(rows), np.concatenate(scores)


def _blocks(qids: list, vectors: list[list[float]]):
    step = max(1, BLOCK_BYTES // (8 * max(1, len(vectors[0]) if vectors else 1)))
    for a in range(0, len(qids), step):
        yield qids[a : a + step], np.array(vectors[a : a + step], np.float64)


def top_k(points: DataFrame, qids: list[int], vectors: list[list[float]], k: int) -> DataFrame:
    """(qid, rank, cid, score): the k points of highest cosine for each query.

    points has (cid, vector) and only those that pass; vectors must have the
    points' dimension.  Scores rank as doubles, ties go by canonical id.
    """
    spark = points.sparkSession
    parts = []
    for ids, matrix_ in _blocks(qids, vectors) if k > 0 else ():
        shared = spark.sparkContext.broadcast((ids, matrix_))

        def run(batches, shared=shared):
            ids, queries = shared.value
            # the best so far: query, id, vector and score
            hq, hc, hs = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                cids = np.array(batch.column(0).to_pylist(), object)
                q, r, s = winners(cids, matrix(batch.column(1), queries.shape[1]), queries, k)
                hq, hc, hs = np.concatenate([hq, q]), np.concatenate([hc, cids[r]]), np.concatenate([hs, s])
                place = np.empty(len(hc), np.int64)
                place[np.argsort(hc, kind="stable")] = np.arange(len(hc))
                order = np.lexsort((place, -hs, hq))
                best = order[np.arange(len(order)) - np.searchsorted(hq[order], hq[order]) < k]
                hq, hc, hs = hq[best], hc[best], hs[best]
            if len(hq):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[hq]), pa.array(hc.tolist(), pa.binary()), pa.array(hs)], names=["qid", "cid", "score"])

        parts.append(points.select("cid", "vector").mapInArrow(run, "qid long, cid binary, score double"))
    if not parts:
        return spark.createDataFrame([], "qid long, rank int, cid binary, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return _ranked(every, k)


_FOUND = pa.schema([("qid", pa.int64()), ("cid", pa.binary()), ("score", pa.float64())])


class _Group:
    """The points of one group, in 32 bits as they came, that its queries are scored against part by part."""

    def __init__(self, cids: pa.Array, x: np.ndarray, lists: np.ndarray | None = None):
        own = self.numbers = None
        if lists is not None:
            self.numbers, own = np.unique(lists, return_inverse=True)
        self.cids, self.dimension, self.side = cids, x.shape[1], Side(cids, x, own)

    def found(self, qids: pa.Array, vectors: pa.Array, k: int, narrow: bool, open_: np.ndarray | None) -> pa.RecordBatch:
        q, r, s = self.side.winners(rows_of(vectors, self.dimension), k, narrow, open_)
        return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), self.cids.take(pa.array(r)), pa.array(s)], schema=_FOUND)


def _blocked(left: pa.Table, right: pa.Table, k: int, narrow: bool = False) -> pa.Table:
    """Best k points (cid, vector) of left for each query (qid, vector) of right; with columns list and lists, of those in its lists.

    Both stay as they came, in Arrow; of the points there are copies of 32
    bits, of the queries those of one part.
    """
    if not left.num_rows or not right.num_rows or k <= 0:
        return _FOUND.empty_table()
    listed = "lists" in right.column_names
    vectors = left.column("vector")
    group, out = _Group(left.column("cid").combine_chunks(), rows_of(vectors, len(vectors[0])), left.column("list").to_numpy() if listed else None), []
    for a in range(0, right.num_rows, PART):
        part = right.slice(a, PART)
        open_ = _marks(group.numbers, part.column("lists").combine_chunks()) if listed else None
        out.append(group.found(part.column("qid").combine_chunks(), part.column("vector"), k, narrow, open_))
    return pa.Table.from_batches(out, _FOUND)


def _marks(numbers: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of these lists, which are sorted, each row has."""
    flat = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(numbers, flat), len(numbers) - 1)
    real = numbers[at] == flat
    out = np.zeros((len(lists), len(numbers)), bool)
    out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[real], at[real]] = True
    return out


def _bits(lists: pa.Array, numbers: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The marks of lists that spread has packed, of these numbers, all of one bin; places: all lists, and the first bin of each."""
    every, first = places
    at = np.searchsorted(every, numbers)
    rows = np.frombuffer(b"".join(lists.to_pylist()), np.uint8).reshape(len(lists), -1)
    return np.unpackbits(rows, axis=1, bitorder="little").astype(bool)[:, at - np.searchsorted(first, first[at[0]])]


def group_winners(batches, k: int, narrow: bool = False, places: tuple[np.ndarray, np.ndarray] | None = None):
    """Batches of (qid, cid, score) of one group, from those of (asked, qid, cid, vector), in which points come before queries.

    Only the points are held, so that neither the queries nor what is found
    adds to a task's memory.  With places there are also list and lists, the
    marks of a query's lists.
    """
    held, group = [], None
    for batch in batches:
        points = batch.num_rows - batch.column(0).true_count
        if points:
            held.append(batch.slice(0, points))
        if points == batch.num_rows:
            continue
        if group is None:
            if not held:
                return
            group = _held(held, places is not None)
        for a in range(points, batch.num_rows, PART):
            part = batch.slice(a, PART)
            yield group.found(part.column(1), part.column(3), k, narrow, None if places is None else _bits(part.column(5), group.numbers, places))


def _held(batches: list[pa.RecordBatch], listed: bool) -> _Group:
    """The points of these batches, which the list then lets go."""
    dimension = len(batches[0].column(3)[0])
    cids, x = pa.concat_arrays([b.column(2) for b in batches]), np.concatenate([rows_of(b.column(3), dimension) for b in batches])
    lists = np.concatenate([b.column(4).to_numpy() for b in batches]) if listed else None
    batches.clear()
    pa.default_memory_pool().release_unused()
    return _Group(cids, x, lists)


def _grouped(left: DataFrame, right: DataFrame, groups: int, k: int, narrow: bool = False, places=None) -> DataFrame:
    """(qid, cid, score): what group_winners finds of points and queries of the same number ``group``, a partition for each group.

    places: a broadcast of group_winners' places.
    """
    null = lambda kind: F.lit(None).cast(kind)
    lists = (lambda *c: []) if places is None else lambda *c: list(c)
    points = left.select("group", F.lit(False).alias("asked"), null("long").alias("qid"), "cid", "vector", *lists("list", null("binary").alias("lists")))
    asked = right.select("group", F.lit(True).alias("asked"), "qid", null("binary").alias("cid"), "vector", *lists(null("int").alias("list"), "lists"))
    rows = points.unionByName(asked).repartitionById(groups, "group").sortWithinPartitions("asked", *lists("list")).drop("group")
    return rows.mapInArrow(lambda batches: group_winners(batches, k, narrow, places and places.value), "qid long, cid binary, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "cid", "score")


def grid(points: int, queries: int, slots: int, block: int) -> tuple[int, int]:
    """Into how many blocks points and queries are cut: at most ``block`` rows each, and work for all slots.

    Points go along once for each block of queries and the other way round, so
    the side of larger blocks is cut first.
    """
    i, j = max(1, -(-points // block)), max(1, -(-queries // block))
    while i * j < slots and max(points / i, queries / j) > 64:
        if points / i >= queries / j:
            i += 1
        else:
            j += 1
    return i, j


def group_rows(queries: DataFrame) -> tuple[int, int]:
    """The number of queries, and the rows of their dimension that a side of one group has at most."""
    r = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dimension")).first()
    return r["n"], max(1, GROUP_BYTES // (4 * max(1, r["dimension"] or 1)))


def top_k_join(points: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(qid, rank, cid, score) for a table of queries (qid: long, vector), of any size.

    Both sides are cut into blocks by a hash, and each pair of blocks is one
    group, so that no task and no driver holds more than one block of points,
    by which the queries stream; of each group only winners go on.  A block has
    up to GROUP_BYTES of vectors, so that no row goes to more groups than the
    slots need until both sides have several blocks of that size.  Equal to
    top_k, which suits queries few enough for the driver.
    """
    n, most = group_rows(queries)
    i, j = grid(points.count(), n, points.sparkSession.sparkContext.defaultParallelism, block or most)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select(own("cid", i).alias("i"), each(j).alias("j"), "cid", "vector").withColumn("group", F.col("i") * j + F.col("j"))
    right = queries.select(each(i).alias("i"), own("qid", j).alias("j"), "qid", "vector").withColumn("group", F.col("i") * j + F.col("j"))
    return _ranked(_grouped(left, right, i * j, k), k)


def _bins(counts: dict[int, int], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Lists with rows, by number; the first bin of each, its number of bins, and that of all.

    Lists that follow each other share a bin as long as it has at most
    ``block`` rows; a longer one has bins of its own.
    """
    lists = sorted(c for c, n in counts.items() if n)
    first, parts, last, room = [], [], -1, 0
    for c in lists:
        n = counts[c]
        if n > block:
            parts.append(-(-n // block))
            first.append(last + 1)
            last, room = last + parts[-1], 0
            continue
        if n > room:
            last, room = last + 1, block
        room -= n
        first.append(last)
        parts.append(1)
    return np.array(lists, np.int64), np.array(first, np.int64), np.array(parts, np.int64), last + 1


def listed_join(points: DataFrame, queries: DataFrame, k: int, block: int | None = None, narrow: bool = False, copies: int = 1) -> DataFrame:
    """(qid, rank, cid, score): the best points in the lists of each query, both tables of any size.

    points has (cid, vector, list), queries (qid: long, vector, and lists: the
    numbers of its lists; without that column, all).  Lists are put together
    in bins, and a query goes once to each bin that has one of its lists, so
    that it isn't repeated for each of them.  A bin and a block of queries,
    which are cut by a hash, are one group.  ``copies`` is how many lists a
    point can be in.
    """
    spark = points.sparkSession
    counts = {r["list"]: r["n"] for r in points.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    n = sum(counts.values())
    if not n or k <= 0:
        return spark.createDataFrame([], "qid long, rank int, cid binary, score double")
    asked, most = group_rows(queries)
    i, j = grid(n, asked, spark.sparkContext.defaultParallelism, block or most)
    lists, first, parts, bins = _bins(counts, -(-n // i))
    places = F.broadcast(spark.createDataFrame(list(zip(lists.tolist(), first.tolist(), parts.tolist())), "list int, first int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.join(places, "list").select((F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts"))).cast("int").alias("bin"), each(j).alias("j"), "list", "cid", "vector")
    part = F.pmod(F.xxhash64("qid"), F.lit(j)).cast("int").alias("j")
    shared = None
    if "lists" not in queries.columns:
        right = queries.select(each(bins).alias("bin"), part, "qid", F.col("vector").alias("vector"))  # points may come of the same table
    else:
        shared = spark.sparkContext.broadcast((lists, first))
        right = queries.select("qid", "vector", "lists").mapInArrow(lambda batches: spread(batches, *shared.value, parts), "bin int, qid long, vector array<float>, lists binary").select("bin", part, "qid", "vector", "lists")
    group = F.col("bin") * j + F.col("j")
    found = _grouped(left.withColumn("group", group), right.withColumn("group", group), bins * j, k * copies, narrow, shared)
    return _ranked(found.distinct() if copies > 1 else found, k)


def spread(batches, lists: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """Batches of (bin, qid, vector, lists) from those of (qid, vector, lists): a row for each bin that has one of a query's lists.

    What it has there is a bit for each list of the bin, so that a row's marks
    in all bins together take an eighth of a byte a list.
    """
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    step = max(1, SPREAD // len(lists))
    for whole in batches:
        for a in range(0, whole.num_rows, step):
            batch = whole.slice(a, step)
            open_ = _marks(lists, batch.column(2))
            for lo, hi in zip(starts, np.append(starts[1:], len(lists))):
                rows = np.flatnonzero(open_[:, lo:hi].any(axis=1))
                if not len(rows):
                    continue
                took, marks = batch.take(pa.array(rows)), np.packbits(open_[rows, lo:hi], axis=1, bitorder="little")
                marks = pa.array([m.tobytes() for m in marks], pa.binary())
                for bin_ in range(first[lo], first[lo] + parts[lo]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), bin_, np.int32)), took.column(0), took.column(1), marks], names=["bin", "qid", "vector", "lists"])
