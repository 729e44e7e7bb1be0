"""The older approximate search: sign signatures in several tables, probed by Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from ..errors import Invalid
from ..functions.vectors import cosine

DOMAIN = b"plumbline/lsh/projection\x00"


def projections(tables: int, bits: int, dimension: int, seed: int, domain: bytes = DOMAIN) -> np.ndarray:
    """Signs by table, bit and dimension, from SHA-256 of the domain and little-endian numbers."""
    number = lambda n: n.to_bytes(8, "little")
    signs = [hashlib.sha256(domain + number(seed) + number(t) + number(b) + number(d)).digest()[0] & 1 for t in range(tables) for b in range(bits) for d in range(dimension)]
    return np.array(signs, np.float64).reshape(tables, bits, dimension) * 2 - 1


def signatures(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Signature of each row in each table: a bit is set where the projection isn't negative."""
    out = np.zeros((len(x), len(signs)), np.int64)
    for t, table in enumerate(signs):
        for b, plane in enumerate(table):
            total = np.zeros(len(x))
            for d in range(x.shape[1]):
                total += x[:, d] * plane[d]
            out[:, t] |= (total >= 0).astype(np.int64) << b
    return out


def masks(bits: int, distance: int) -> Iterator[int]:
    """Masks of so many bits, in lexical order of the bits' numbers."""
    return (sum(1 << b for b in chosen) for chosen in combinations(range(bits), distance))


def probe_sequence(exact: list[int], bits: int, limit: int) -> list[tuple[int, int]]:
    """(table, signature) by distance, then table, then mask."""
    out: list[tuple[int, int]] = []
    for distance in range(bits + 1):
        for t, s in enumerate(exact):
            for m in masks(bits, distance):
                if len(out) == limit:
                    return out
                out.append((t, s ^ m))
    return out


def index(points: DataFrame, signs: np.ndarray) -> DataFrame:
    """(table, signature, cid_hash, cid): one row for each point and table."""
    shared = points.sparkSession.sparkContext.broadcast(signs)

    @F.pandas_udf(ArrayType(LongType()))
    def sign(vector: pd.Series) -> pd.Series:
        return pd.Series(signatures(np.array(vector.tolist(), np.float64).reshape(len(vector), -1), shared.value).tolist())

    return points.select("cid", F.sha2("cid", 256).alias("cid_hash"), F.posexplode(sign("vector")).alias("table", "signature"))


def search(points: DataFrame, buckets: DataFrame, passes: Column, vector: list[float], signs: np.ndarray, k: int, probes: int, limit: int) -> tuple[DataFrame, dict]:
    """((rank, cid, score), counters) for one query.

    Buckets are visited in the order of the probe sequence, each in the order
    of hashed ids; a point counts where it is met first, and the limit holds
    for discovered points, before the filter.  Scores are rounded to 32 bits
    before they rank, ties go by canonical id.
    """
    spark = points.sparkSession
    exact = signatures(np.array([vector], np.float64), signs)[0].tolist()
    sequence = probe_sequence(exact, signs.shape[1], probes)
    asked = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(sequence)], "probe int, table int, signature long")
    met = buckets.join(F.broadcast(asked), ["table", "signature"]).groupBy("cid").agg(F.min("probe").alias("probe"), F.first("cid_hash").alias("cid_hash"))
    # one more than the limit tells that it was reached, and where
    first = met.orderBy("probe", "cid_hash").limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy("probe", "cid_hash")))
    over = first.where(F.col("place") == limit + 1).select("probe").first()
    chosen = first.where(F.col("place") <= limit)
    target = F.array(*[F.lit(float(v)) for v in vector])
    passed = points.where(passes).join(chosen.select("cid"), "cid", "left_semi")
    scored = passed.select("cid", cosine(F.col("vector"), target).cast("float").alias("score"))
    discovered = chosen.count()
    visited = over["probe"] + 1 if over else len(sequence)
    stats = {"visited": visited, "discovered": discovered, "scored": passed.count(), "probes": visited == probes, "limit": over is not None}
    ranked = scored.orderBy(F.desc("score"), "cid").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "cid")))
    return ranked.select("rank", "cid", F.col("score").cast("double").alias("score")), stats


def search_join(points: DataFrame, buckets: DataFrame, passes: Column, queries: DataFrame, signs: np.ndarray, k: int, probes: int) -> DataFrame:
    """(qid, rank, cid, score) for a table of queries (qid: long, vector), of any size: search without a limit of points discovered.

    Each query reads the buckets of its probe sequence in one pass for all; a
    point that is met in several of them counts once.
    """
    from .search import LISTS, listed_join

    tables, bits, _ = signs.shape
    if tables << bits > LISTS:
        raise Invalid(f"a table of queries is for at most {LISTS} buckets")
    shared = points.sparkSession.sparkContext.broadcast(signs)

    @F.pandas_udf("array<int>")
    def lists(vector: pd.Series) -> pd.Series:
        exact = signatures(np.array(vector.tolist(), np.float64).reshape(len(vector), -1), shared.value)
        known: dict[tuple[int, ...], list[int]] = {}
        for e in map(tuple, exact.tolist()):
            if e not in known:
                known[e] = [t << bits | s for t, s in probe_sequence(list(e), bits, probes)]
        return pd.Series([known[e] for e in map(tuple, exact.tolist())], dtype=object)

    own = buckets.select("cid", (F.shiftleft("table", bits) + F.col("signature")).cast("int").alias("list"))
    listed = points.where(passes).select("cid", "vector").join(own, "cid")
    return listed_join(listed, queries.select("qid", "vector").withColumn("lists", lists("vector")), k, narrow=True, copies=tables)
