"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all v beside u.

    The least comes from an aggregate that combines before the shuffle and a
    join that AQE can split, so a node of millions of neighbours is no task's burden.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to its least neighbour (or itself)."""
    e = _with_least(_both(edges)).where("v > u")
    return e.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = _with_least(down)
    moved = e.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = e.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (u, v: long), component the least node.

    Repeated edges, either direction and loops are allowed; a node that has
    only loops has no row, rows with a null end are left out, and without
    edges the result is empty.  Every round is a saved table, and the rounds
    end when neither star changes the edges; about log2 of the longest path.
    """
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    now = scratch.save(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        after = scratch.save(small_star(large_star(now)), "stars")
        scratch.drop(now)
        now = after
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
