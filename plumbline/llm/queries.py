"""The subpackage's queries by name, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bpe, embeddings, encoding, minhash, mixing, passages, quality, rendering, rules, warc
from .common import Scratch, short_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(_table(spark, sf_dir, "embeddings"), Scratch(spark)).withColumnRenamed("id", "vec_id")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Scratch(spark), copy_column="copy")
    return mixed.select("doc_id", "source", "copy")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"), Scratch(spark))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), Scratch(spark))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), Scratch(spark))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(_table(spark, sf_dir, "documents"), Scratch(spark))


def bpe_decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 10 decodes, by itself, so that SQL can compare it."""
    return op10_bpe_encoding(spark, sf_dir).select("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_embedding_near_dedup,
        op2_minhash_near_dedup,
        op3_quality_classifier,
        op4_source_mixing,
        op5_html_extraction,
        op6_substring_dedup,
        op7_quality_rules,
        op8_token_counts,
        op9_warc,
        op10_bpe_encoding,
        bpe_decoded_text,
    )
    return {f.__name__: f for f in found}


_GROUPS = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
edges AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {embeddings.THRESHOLD}),
walk(u, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT walk.u, edges.w FROM walk JOIN edges ON walk.w = edges.u),
groups AS (SELECT u AS vec_id, min(w) AS group_id FROM walk GROUP BY u)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, vec_id = group_id AS keep FROM groups
"""

_WEIGHT = "CASE " + " ".join(f"WHEN s = '={k}' THEN {w:.17g}::DOUBLE" for k, w in mixing.WEIGHTS.items()) + f" ELSE {mixing.DEFAULT:.17g}::DOUBLE END"
_MIXED = f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce('=' || source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
sums AS (SELECT s, sum(coalesce(length(text), 0))::DOUBLE AS chars, {_WEIGHT} AS w FROM d GROUP BY s),
used AS (SELECT * FROM sums WHERE chars > 0 AND w > 0),
rates AS (
  SELECT s, floor(w / (SELECT sum(w) FROM used) * (SELECT sum(chars) FROM used) * 1.0::DOUBLE / chars * {mixing.UNIT}::DOUBLE)::HUGEINT AS each,
    ('0x' || substr(md5('{mixing.SEED}/' || s), 1, 8))::BIGINT::HUGEINT AS start
  FROM used),
ends AS (
  SELECT doc_id, source, each, start + each * row_number() OVER (PARTITION BY s ORDER BY place, doc_id NULLS FIRST, md5(text) NULLS FIRST) AS e
  FROM d JOIN rates USING (s)),
copies AS (SELECT doc_id, source, (e // {mixing.UNIT} - (e - each) // {mixing.UNIT})::BIGINT AS n FROM ends)
SELECT doc_id, source, unnest(range(n)) AS copy FROM copies WHERE n > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": _GROUPS,
        "op4_source_mixing": _MIXED,
        "bpe_decoded_text": "SELECT doc_id, text FROM documents",
        "op9_warc": "SELECT page_id, url, html FROM pages",
    }
