"""Operator 1: near-copies of embeddings by random hyperplanes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled
from .components import components
from .pairing import block_members, verified

THRESHOLD = 0.95
RECALL = 0.95
BLOCK = 1024
SEED = 10


def plan_tables(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables.

    One bit for each doubling of the rows keeps the number of strangers in a
    bucket constant; the tables then follow from the wanted recall of a pair
    at the threshold, which agrees in a bit with probability 1 - angle / pi.
    """
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    miss = 1 - agree**bits
    return bits, 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))


def hyperplanes(n: int, dimension: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, n))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows (id, v) with a finite vector that isn't empty or zero."""
    good = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)")
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(good)


def _keys(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(key, id): the bucket of each vector in each table; the numbers of the table and of the components are mixed into the key."""

    def run(batches):
        from .textops import mix

        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        salt = mix(np.arange(1, tables + 1, dtype=np.uint64))
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    planes = {**(planes if len(planes) < 4 else {}), d: hyperplanes(bits * tables, d, seed)}
                own = sizes == d
                x = batch.column(1).filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                sign = (x @ planes[d] >= 0).reshape(len(x), tables, bits)
                key = mix(mix((sign * weights).sum(axis=2, dtype=np.uint64) + salt[None, :]) ^ np.uint64(d))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[own], tables))], names=["key", "id"])

    return rows.select("id", "v").mapInArrow(settled(run), "key long, id long")


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length 1 as rows; shorter ones have zeros behind, which change no cosine among their like."""
    lists = pa.concat_arrays(column.chunks)
    sizes = pc.list_value_length(lists).to_numpy()
    x = np.zeros((len(sizes), int(sizes.max(initial=1))))
    x[np.arange(x.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    # by the largest component first, so that no square is lost or infinite
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_groups(rows: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, group_id, group_size, keep): every id with the least id of its group.

    Vectors whose cosine is at least ``threshold`` are linked, groups are the
    connected components.  Candidates agree in all signs of one of several
    tables of random hyperplanes; number and width of the tables follow from
    the number of rows and ``recall``, the least probability that a pair at
    the threshold is found.  Every candidate pair is verified by its cosine
    in double precision, whatever the size of its bucket.

    Vectors are compared with those of as many components.  Rows with a null
    id have no result; null, empty and zero vectors, and those with nulls or
    numbers that aren't finite, are groups of their own.  Equal vectors are
    always linked (by 128 bits of their hash).  Rows that repeat an id count
    as one, linked through any of its vectors.  Other columns are ignored.  No
    rows, no result.
    """
    source = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    ids = source.where("id IS NOT NULL").select("id").distinct()
    hashed = lambda df: df.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(7))})
    good = hashed(_usable(source))
    # equal vectors need no search: the least id stands for them
    keyed = good.select("id", "h1", "h2")
    least = scratch.save(keyed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")), "least")
    same = keyed.join(least.where("first < last"), ["h1", "h2"]).where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    # where an id is repeated, the hash tells which of its vectors is meant
    firsts = good.join(least.select(F.col("first").alias("id"), "h1", "h2"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    firsts = scratch.save(firsts.select("id", "v"), "firsts")
    bits, tables = plan_tables(firsts.count(), threshold, recall)
    entries = _keys(firsts, bits, tables, seed).distinct()
    members = block_members(scratch.save(entries, "keys"), block)
    near = verified(
        members.join(firsts.select("id", F.col("v").alias("vector")), "id").select("key", "i", "j", "id", "vector"),
        "vector",
        _units,
        lambda a, b: (a * b).sum(axis=1) >= threshold,
        lambda row, others: others @ row >= threshold,
    )
    found = scratch.save(components(near.union(same), scratch), "groups")
    every = ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))
    sizes = every.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return every.join(sizes, "group_id").select("id", "group_id", "group_size", (F.col("id") == F.col("group_id")).alias("keep"))
