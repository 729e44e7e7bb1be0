"""Points from JSON Lines, and results to them."""

from __future__ import annotations

import json
import uuid
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Invalid
from ..model import canonical_id, canonical_json, check_vector, id_of

_PARSED = "cid binary, vector array<float>, payload string, error string"


def parse_line(line: str) -> tuple[bytes, list[float], str]:
    """(cid, vector, payload) of one line; Invalid says what is wrong."""
    try:
        value = json.loads(line)
    except ValueError as error:
        raise Invalid(f"not JSON: {error}") from None
    if not isinstance(value, dict) or "id" not in value or not isinstance(value.get("vector"), list):
        raise Invalid("a line is an object with id and vector")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value["vector"]):
        raise Invalid("a vector's components are numbers")
    return canonical_id(value["id"]), check_vector(value["vector"]), canonical_json(value.get("payload") or {})


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table of points and error (null for a good line); blank lines are passed over."""

    @F.pandas_udf(_PARSED)
    def parsed(lines: pd.Series) -> pd.DataFrame:
        def one(line):
            try:
                return (*parse_line(line), None)
            except (Invalid, ValueError) as error:
                return None, None, None, str(error)

        return pd.DataFrame([one(x) for x in lines], columns=["cid", "vector", "payload", "error"])

    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"[\r\t]", " ")) != "")
    return lines.select(parsed("value").alias("p")).select("p.*")


def preflight(parsed: DataFrame) -> tuple[int, int]:
    """(points, dimension) after one pass over all lines; nothing has been written if it fails."""
    r = parsed.agg(F.count("*").alias("n"), F.first("error", True).alias("error"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if r["error"]:
        raise Invalid(r["error"])
    if not r["n"]:
        raise Invalid("the input has no points")
    if r["a"] != r["b"]:
        raise Invalid(f"the input has vectors of {r['a']} and of {r['b']} components")
    return r["n"], r["a"]


def import_points(handle: Any, path: str, batch_size: int | None = None, expected_root: str | None = None, progress: Any = None) -> list:
    """Put a file's points into a collection: one commit, or one for each batch_size lines in their order.

    Each batch expects the root that the one before it left, so another
    writer between them ends the import.
    """
    spark = handle.store.database.spark
    parsed = read(spark, path)
    n, dimension = preflight(parsed)
    points = parsed.select("cid", "vector", "payload")
    if batch_size is not None and batch_size < 1:
        raise Invalid("a batch has at least one line")
    if expected_root is None and not handle.store.database.head(handle.name):
        from ..model import CollectionConfig

        handle.store.database.get_or_create_collection(handle.name, CollectionConfig(dimension))
    target, draft = handle.advanced(), None
    if batch_size is None or n <= batch_size:
        parts = [points]
    else:
        # a line's number: those before its partition, and its place in it
        marked = points.withColumn("at", F.monotonically_increasing_id())
        counts = marked.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        base, total = [], 0
        for r in counts:
            base.append((r["p"], total))
            total += r["n"]
        offsets = spark.createDataFrame(base, "p long, base long")
        numbered = marked.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("p")).withColumn("batch", F.floor((F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)) / batch_size))
        # parsed and numbered once, then each batch is a folder
        files = handle.store.database.files
        draft = f"drafts/{uuid.uuid4().hex}"
        numbered.select("cid", "vector", "payload", "batch").write.partitionBy("batch").parquet(files.path(draft))
        parts = [spark.read.schema(points.schema).parquet(files.path(f"{draft}/batch={i}")) for i in range(-(-n // batch_size))]
    results, root = [], expected_root
    try:
        for i, part in enumerate(parts):
            results.append(target.upsert_expect(part, root if root is not None else None))
            root = results[-1].root
            if progress:
                progress(i + 1, len(parts))
    finally:
        if draft:
            files.delete(draft)
    return results


def write(points: DataFrame, path: str) -> None:
    """Write a table of points as JSON Lines."""

    @F.pandas_udf("string")
    def line(cid: pd.Series, vector: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"id": id_of(bytes(c)), "vector": [float(x) for x in v], "payload": json.loads(p)}, ensure_ascii=False) for c, v, p in zip(cid, vector, payload)], dtype=object)

    points.select(line("cid", "vector", "payload").alias("value")).write.text(path)
