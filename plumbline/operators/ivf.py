"""Inverted lists around trained centroids, and the search that visits some of them."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from ..functions.vectors import closest, cosine_rows, cosines, matrix, norms

SAMPLE = 8192
ROUNDS = 4
MOST = 4096


def centroid_count(points: int) -> int:
    """A power of two near the root of the number of points, the higher one if between."""
    if points <= 0:
        return 0
    low = isqrt(points)
    # (low + 1/2) squared isn't whole, so points are never halfway
    nearest = low if points - low * low <= low else low + 1
    nearest = min(max(nearest, 1), MOST)
    below = 1 << nearest.bit_length() - 1
    above = min(2 * below, MOST)
    return below if nearest - below < above - nearest else above


def training_sample(points: DataFrame) -> DataFrame:
    """(digest, cid, vector) of the lowest digests, at most SAMPLE rows; points has those columns."""
    return points.select("digest", "cid", "vector").orderBy("digest", "cid").limit(SAMPLE)


def train(sample: np.ndarray, count: int) -> np.ndarray:
    """Centroids as 32-bit floats after a fixed number of Lloyd rounds over the sample in its order.

    Seeds stand at even distances in the sample, and a centroid without
    members stays where it is.
    """
    if not count:
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0), np.float32)
    last = len(sample) - 1
    seeds = [0] if count == 1 else [i * last // (count - 1) for i in range(count)]
    centroids = sample[seeds].astype(np.float32)
    wide = sample.astype(np.float64)
    for _ in range(ROUNDS):
        own = closest(wide, centroids.astype(np.float64))
        sums = np.zeros((count, sample.shape[1]))
        np.add.at(sums, own, wide)  # one row after the other, so sums have one order
        n = np.bincount(own, minlength=count)
        has = n > 0
        centroids[has] = (sums[has] / n[has, None]).astype(np.float32)
    return centroids


def assign(points: DataFrame, centroids: np.ndarray, column: str = "centroid") -> DataFrame:
    """points with each one's centroid.  The codebook has at most MOST rows, so every executor gets it."""
    if not len(centroids):
        return points.withColumn(column, F.lit(0))
    shared = points.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))

    @F.pandas_udf(IntegerType())
    def own(vector: pd.Series) -> pd.Series:
        x = np.array(vector.tolist(), np.float64).reshape(len(vector), -1)
        step = max(1, (8 << 20) // (8 * len(shared.value)))
        return pd.Series(np.concatenate([closest(x[a : a + step], shared.value) for a in range(0, len(x), step)]).astype(np.int32) if len(x) else [], dtype="int32")

    return points.withColumn(column, own("vector"))


@dataclass(frozen=True)
class Visit:
    """What one query reads: centroids in whole, and the first rows of at most one more."""

    whole: list[int]
    partial: int | None
    quota: int
    visited: int
    discovered: int  # in whole centroids
    scored: int
    probes_exhausted: bool


def plan_visit(vector: list[float], centroids: np.ndarray, probes: int, limit: int, total: dict[int, int], eligible: dict[int, int]) -> Visit:
    """Centroids by falling cosine, then number, until the probes or the candidates run out.

    Candidates are rows that pass the filter; the search stops when one more
    than ``limit`` turns up.  Whole lists are settled by their counts.
    """
    score = cosines(np.array([vector], np.float64), centroids.astype(np.float64))[0]
    order = np.lexsort((np.arange(len(score)), -score))[: min(probes, len(score))]
    whole, seen, scored = [], 0, 0
    for visited, c in enumerate(order.tolist(), 1):
        if scored + eligible.get(c, 0) > limit:
            return Visit(whole, c, limit - scored, visited, seen, limit, visited == len(order) and len(order) < len(score))
        whole.append(c)
        seen += total.get(c, 0)
        scored += eligible.get(c, 0)
    return Visit(whole, None, 0, len(order), seen, scored, len(order) < len(score))


def search(points: DataFrame, passes: Column | None, centroids: np.ndarray, totals: dict[int, int], qids: list[int], vectors: list[list[float]], k: int, probes: int, limit: int) -> tuple[DataFrame, dict[int, dict]]:
    """((qid, rank, cid, score), counters by qid) of an approximate search.

    points has (cid, vector, centroid, shard, payload); lists are in the order
    of (shard, cid).  Without a filter, ``totals`` (rows of each centroid)
    settle everything but the last list; a filter costs one more aggregate.
    Only lists cut by the candidate limit are numbered by a window.
    """
    spark = points.sparkSession
    eligible = totals
    if passes is not None:
        eligible = {r["centroid"]: r["n"] for r in points.where(passes).groupBy("centroid").agg(F.count("*").alias("n")).collect()}
    visits = {q: plan_visit(v, centroids, probes, limit, totals, eligible) for q, v in zip(qids, vectors)}
    ok = F.lit(True) if passes is None else passes
    if all(len(v.whole) == len(centroids) for v in visits.values()):
        # every list in whole is every point that passes
        from .search import top_k

        stats = {q: {"visited": v.visited, "discovered": v.discovered, "scored": v.scored, "probes": False, "limit": False} for q, v in visits.items()}
        return top_k(points.where(ok), qids, vectors, k), stats
    cut = sorted({v.partial for v in visits.values() if v.partial is not None})
    wanted = sorted({c for v in visits.values() for c in v.whole} | set(cut))
    base = points.where(F.col("centroid").isin(wanted)) if len(wanted) < len(centroids) else points
    stats = {q: {"visited": v.visited, "discovered": v.discovered, "scored": v.scored, "probes": v.probes_exhausted, "limit": v.partial is not None} for q, v in visits.items()}
    whole = base.where(ok).withColumn("n", F.lit(0).cast("long"))
    if cut:
        rows = Window.partitionBy("centroid").orderBy("shard", "cid")
        numbered = points.where(F.col("centroid").isin(cut)).withColumn("ok", ok)
        numbered = numbered.withColumn("place", F.row_number().over(rows)).withColumn("n", F.sum(F.col("ok").cast("long")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
        stops = {(v.partial, v.quota + 1) for v in visits.values() if v.partial is not None}
        wanted_stops = spark.createDataFrame(sorted(stops), "centroid int, n long")
        place = {(r["centroid"], r["n"]): r["place"] for r in numbered.where("ok").join(F.broadcast(wanted_stops), ["centroid", "n"]).select("centroid", "n", "place").collect()}
        for q, v in visits.items():
            if v.partial is not None:
                stats[q]["discovered"] += place[v.partial, v.quota + 1]
        kept = numbered.where("ok").select(*points.columns, "n")
        whole = base.where(ok & ~F.col("centroid").isin(cut)).withColumn("n", F.lit(0).cast("long")).unionByName(kept)
    # by centroid: queries that read it whole, and those that read its first rows
    readers: dict[int, list[tuple[int, int]]] = {}
    for place_, q in enumerate(qids):
        v = visits[q]
        for c in v.whole:
            readers.setdefault(c, []).append((place_, 1 << 62))
        if v.partial is not None:
            readers.setdefault(v.partial, []).append((place_, v.quota))
    if k <= 0 or not readers:
        return spark.createDataFrame([], "qid long, rank int, cid binary, score double"), stats
    shared = spark.sparkContext.broadcast((readers, np.array(vectors, np.float64), np.array(qids, np.int64)))

    def run(batches):
        from .search import _best

        readers, queries, ids = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cids, own = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
            x, n = matrix(batch.column(1), queries.shape[1]), batch.column(3).to_numpy()
            for c in np.unique(own).tolist():
                rows = np.flatnonzero(own == c)
                who = readers.get(c, [])
                if not who:
                    continue
                scores = cosines(x[rows], queries[[p for p, _ in who]])
                for j, (p, quota) in enumerate(who):
                    inside = n[rows] <= quota
                    s, i = scores[inside, j], cids[rows][inside]
                    if p in held:
                        s, i = np.concatenate([held[p][0], s]), np.concatenate([held[p][1], i])
                    keep = _best(s, i, k)
                    held[p] = s[keep], i[keep]
        for p, (s, i) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[p])), pa.array(i.tolist(), pa.binary()), pa.array(s)], names=["qid", "cid", "score"])

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = whole.select("cid", "vector", "centroid", "n").mapInArrow(run, "qid long, cid binary, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "cid", "score"), stats


def enough_probes(points: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, least: float = 0.95, sample: int = 256) -> int:
    """The fewest lists in which a sample of the queries finds this share of its exact best k.

    The sample is those of lowest hash; points and queries are as in search_join.
    """
    from .search import top_k_join

    asked = queries.select("qid", "vector").orderBy(F.xxhash64("qid"), "qid").limit(sample)
    exact = top_k_join(points, asked, k).select("qid", "cid")
    hits = exact.join(points.select("cid", "centroid"), "cid").join(asked, "qid").select("vector", "centroid").collect()  # at most sample * k rows
    if not hits:
        return len(centroids)
    score = cosines(np.array([r["vector"] for r in hits], np.float64), centroids.astype(np.float64))
    order = np.argsort(-score, axis=1, kind="stable")
    needed = np.sort((order == np.array([r["centroid"] for r in hits])[:, None]).argmax(axis=1) + 1)
    return int(needed[min(int(np.ceil(least * len(needed))), len(needed)) - 1])


def _bounds(x: np.ndarray, centroids: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """No point of a list (columns) has a higher cosine with a query (rows): its angle to the centroid less the list's reach, which is that of the farthest point."""
    near = np.arccos(np.clip(cosines(x, centroids), -1, 1))
    return np.cos(np.maximum(near - reach, 0)) + 1e-6  # more than the rounding of angles


def reaches(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The largest angle of each list's points to its centroid; a half turn where a norm is 0, since angles then tell nothing."""
    shared = points.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))

    @F.pandas_udf("double")
    def angle(vector: pd.Series, centroid: pd.Series) -> pd.Series:
        x, rows = np.array(vector.tolist(), np.float64).reshape(len(vector), -1), np.arange(len(vector))
        y = shared.value[centroid.to_numpy()]
        nx, ny = norms(x), norms(y)
        return pd.Series(np.where((nx == 0) | (ny == 0), np.pi, np.arccos(np.clip(cosine_rows(x, nx, y, ny, rows, rows), -1, 1))))

    out = np.zeros(len(centroids))
    for r in points.groupBy("centroid").agg(F.max(angle("vector", "centroid")).alias("most")).collect():  # at most MOST rows
        out[r["centroid"]] = r["most"]
    return out


def exact_join(points: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int, save, sample: int = 256) -> DataFrame:
    """search_join, and then the lists that may have a better point than those found: the exact best k.

    A list isn't read if the angle of the query to its centroid and the list's
    reach show that no point of it is among the best.  Where a sample of
    queries shows that most lists are read anyway, all are, in one pass.
    ``save`` writes a table and reads it back.
    """
    from .search import _ranked, listed_join, top_k

    count, lists = min(probes, len(centroids)), points.select("cid", "vector", F.col("centroid").alias("list"))
    if count == len(centroids) or k <= 0:
        return search_join(points, queries, centroids, k, count)
    reach, wide = reaches(points, centroids), centroids.astype(np.float64)
    asked = queries.select("qid", "vector").orderBy(F.xxhash64("qid"), "qid").limit(sample).collect()
    if not asked:
        return search_join(points, queries, centroids, k, count)
    vectors = [list(map(float, r["vector"])) for r in asked]
    least = {r["qid"]: r["score"] for r in top_k(points, list(range(len(asked))), vectors, k).where(F.col("rank") == k).select("qid", "score").collect()}
    needed = _bounds(np.array(vectors), wide, reach) >= np.array([least.get(i, -2.0) for i in range(len(asked))])[:, None]
    if needed.mean() > 0.5:
        return search_join(points, queries, centroids, k, len(centroids))
    shared = points.sparkSession.sparkContext.broadcast((wide, reach))

    @F.pandas_udf("array<int>")
    def rest(vector: pd.Series, least: pd.Series) -> pd.Series:
        wide, reach = shared.value
        x = np.array(vector.tolist(), np.float64).reshape(len(vector), -1)
        step, out = max(1, (8 << 20) // (8 * len(wide))), []
        for a in range(0, len(x), step):
            part = x[a : a + step]
            open_ = _bounds(part, wide, reach) >= least.to_numpy()[a : a + step, None]
            read = np.argsort(-cosines(part, wide), axis=1, kind="stable")[:, :count]
            np.put_along_axis(open_, read, False, axis=1)
            out += [np.flatnonzero(row).astype(np.int32) for row in open_]
        return pd.Series(out, dtype=object)

    found = save(search_join(points, queries, centroids, k, count))
    kth = found.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    more = queries.select("qid", "vector").join(kth, "qid", "left").withColumn("lists", rest("vector", F.coalesce("least", F.lit(-2.0)))).select("qid", "vector", "lists").where(F.size("lists") > 0)
    both = found.select("qid", "cid", "score").unionByName(listed_join(lists, more, k).select("qid", "cid", "score"))
    return _ranked(both, k)


def search_join(points: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int, block: int | None = None) -> DataFrame:
    """(qid, rank, cid, score) of an approximate search for a table of queries (qid: long, vector), of any size.

    points has (cid, vector, centroid).  Each query reads its ``probes``
    closest lists, which listed_join puts together in bins.
    """
    from .search import listed_join

    count = min(probes, len(centroids))
    if not count:
        return points.sparkSession.createDataFrame([], "qid long, rank int, cid binary, score double")
    asked = queries.select("qid", "vector")
    if count < len(centroids):
        shared = points.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))  # at most MOST rows

        @F.pandas_udf("array<int>")
        def lists(vector: pd.Series) -> pd.Series:
            x = np.array(vector.tolist(), np.float64).reshape(len(vector), -1)
            step = max(1, (8 << 20) // (8 * len(shared.value)))
            # stable, so ties go to the lowest number
            return pd.Series([row for a in range(0, len(x), step) for row in np.argsort(-cosines(x[a : a + step], shared.value), axis=1, kind="stable")[:, :count].astype(np.int32)], dtype=object)

        asked = asked.withColumn("lists", lists("vector"))
    return listed_join(points.select("cid", "vector", F.col("centroid").alias("list")), asked, k, block)
