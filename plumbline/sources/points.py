"""Tables of points and how they come to be.

A table of points has cid (canonical id bytes), vector (array<float>) and
payload (canonical JSON text).  Stored tables add digest, shard and centroid.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType, StructField, StructType

from ..errors import Invalid
from ..functions.ids import digest, shard, string_cid, uint_cid
from ..model import Point, canonical_id, canonical_json, check_vector

SCHEMA = StructType([StructField("cid", BinaryType()), StructField("vector", ArrayType(FloatType())), StructField("payload", StringType())])


def from_points(spark: SparkSession, points: Iterable[Point], dimension: int) -> DataFrame:
    """A table of points given one by one, checked as they are read."""
    rows = [(bytearray(canonical_id(p.id)), check_vector(p.vector, dimension), canonical_json(p.payload)) for p in points]
    return spark.createDataFrame(rows, SCHEMA)


def from_table(table: DataFrame, id: str, vector: str, payload: Column | None = None, canonical: bool = False) -> DataFrame:
    """A table of points from columns: an id column of strings or whole numbers, an array, and JSON text.

    Payload text is made canonical, unless it is said to be so; rows that aren't points fail in check.
    """
    kind = dict(table.dtypes)[id]
    cid = string_cid(F.col(id)) if kind == "string" else uint_cid(F.col(id))
    text = F.lit("{}") if payload is None else payload if canonical else canonical_text(payload)
    return table.select(cid.alias("cid"), F.col(vector).cast("array<float>").alias("vector"), text.alias("payload"))


def canonical_text(c: Column) -> Column:
    """Canonical JSON text of a column of JSON texts; null where one isn't an object."""
    @F.pandas_udf(StringType())
    def canon(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return canonical_json(json.loads(t))
            except (ValueError, TypeError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return canon(c)


def check(points: DataFrame, dimension: int) -> int:
    """Number of points, after one aggregate has seen that all of them are valid and no id comes twice."""
    return check_and_place(points, dimension)[0]


def check_and_place(points: DataFrame, dimension: int) -> tuple[int, set[int]]:
    """The same, and the shards of the ids, of which there are few."""
    good = F.expr(f"cid IS NOT NULL AND payload IS NOT NULL AND vector IS NOT NULL AND size(vector) = {dimension} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    per_id = points.groupBy("cid").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    r = per_id.withColumn("shard", shard(digest(F.col("cid")))).agg(F.collect_set("shard").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if r["bad"]:
        raise Invalid(f"{r['bad']} points have no id, no payload object, or a vector that isn't of {dimension} finite components")
    if r["twice"]:
        raise Invalid(f"{r['twice']} ids come more than once in a batch")
    return int(r["n"]), set(r["shards"])


def with_place(points: DataFrame) -> DataFrame:
    """points with digest and shard."""
    return points.withColumn("digest", digest(F.col("cid"))).withColumn("shard", shard(F.col("digest")))


def query_points(points: DataFrame) -> DataFrame:
    """id_kind, id_str, id_uint beside the other columns: cid in a readable form."""
    text = F.col("cid").substr(3, 1 << 30)
    is_text = F.hex(F.substring("cid", 1, 1)) == "73"
    # two halves, since a signed long can't hold an unsigned one
    half = lambda a: F.conv(F.substring(F.hex("cid"), a, 8), 16, 10).cast("decimal(20,0)")
    number = (half(5) * F.lit(str(1 << 32)).cast("decimal(20,0)") + half(13)).cast("decimal(20,0)")
    return points.select(F.when(is_text, "s").otherwise("u").alias("id_kind"), F.when(is_text, F.decode(text, "UTF-8")).alias("id_str"), F.when(~is_text, number).alias("id_uint"), *points.columns)
