"""Exact comparison inside hash buckets, whatever their size.

Two steps that both near-dedup operators share: buckets of equal membership
are kept once, and buckets are compared in pairs of bounded blocks, so a hot
bucket spreads over many tasks and every pair of it is still covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, group_starts

EDGES = "u long, v long"


def block_members(entries: DataFrame, block: int) -> DataFrame:
    """(key, i, j, id): the members of each bucket that holds two ids or more.

    entries has (key: long, id: long), without repeats.  Of buckets with the
    same members (seen by count and two hash sums) one is kept.  A bucket of
    more than ``block`` members is cut into blocks by a hash of the id, and
    appears once for each pair i <= j of its blocks.
    """
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id") % (1 << 31)).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")).where("n > 1")
    kept = buckets.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = entries.join(kept, "key")
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    spread = members.select("key", "id", own.alias("b"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"))
    return spread.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "id")


def forest(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly what all similar pairs of n rows connect.

    similar(i, others) compares row i with others.  A row that is connected
    already is not compared again, so a group of copies costs one pass.
    """
    left = np.arange(n)
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = similar(i, left)
            found = left[hit]
            if len(found):
                left = left[~hit]
                stack += found.tolist()
                for j in found.tolist():
                    yield i, j


def verified(members: DataFrame, payload: str, decode: Callable[[pa.ChunkedArray], np.ndarray], pairs: Callable, one: Callable) -> DataFrame:
    """Edges (u, v) between members whose payloads pass the test.

    members: (key, i, j, id, payload).  decode makes rows of numbers of the
    payload column; pairs(a, b) tests rows of a against rows of b one by one,
    one(row, others) tests a row against others.
    """

    def run(table):
        starts = group_starts(table, ["key", "i", "j"])
        ids, rows = table.column("id").to_numpy(), decode(table.column(payload))
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        us, vs = [], []
        if len(two):
            ok = pairs(rows[two], rows[two + 1])
            us.append(ids[two][ok])
            vs.append(ids[two + 1][ok])
        for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = rows[s : s + n]
            found = list(forest(n, lambda i, others: one(part[i], part[others])))
            if found:
                at = np.array(found)
                us.append(ids[s + at[:, 0]])
                vs.append(ids[s + at[:, 1]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return by_group(members, ["key", "i", "j"], run, EDGES)
