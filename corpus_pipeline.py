"""The corpus pipeline: five stages over documents, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import encoding, minhash, mixing, passages, quality
from plumbline.llm.common import Scratch
from plumbline.session import ship

#: The classifier and the encoder can't be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None

_before: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """A fresh scratch folder; those of earlier stages go, since their results are written by now."""
    ship(spark)
    while _before:
        _before.pop().release()
    _before.append(Scratch(spark))
    return _before[-1]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Rows stay whose text is null, empty or blank, and all rows if the labels
    lack a class or are empty; one at the threshold stays.  Repeated rows are
    judged alike, a null doc_id has no label but is judged.  Texts of any
    length are read whole.  Columns are those of docs, whatever others there
    are.  No documents, no rows.
    """
    _scratch(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, that of the least doc_id.

    Rows with a null doc_id or text stay, and so do texts without a word; rows
    equal in all columns become one.  Texts of any length are read whole.
    Columns are those of docs, whatever others there are.  No documents, no
    rows.
    """
    return minhash.drop_near_duplicates(docs, _scratch(spark))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur before.

    No row goes: one whose text is null, or too short for a passage, stays as
    it is, as does one with a null doc_id; a text that is all repeated may
    become empty.  The first occurrence is that of the least doc_id.  Rows
    that repeat a doc_id are one document if their texts are the same, and
    several if not.  Texts of any length are read whole.  n_chars is counted
    again where text has changed; columns are those of docs, whatever others
    there are.  No documents, no rows.
    """
    return passages.cut_passages(docs, _scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that gives each source its share of characters.

    A null source is one source of the default weight; a null or empty text
    has no characters but is copied as its source is; a source without
    characters has no copies.  Repeated rows are rows of their own, ties are
    in the order of the text's hash.  Columns are those of docs, whatever
    others there are.  No documents, no rows.
    """
    return mixing.mix_sources(docs, _scratch(spark))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, text) of each document, text decoded from token_ids.

    A null text has no ids, no count and no text; an empty one no tokens.
    Repeated rows each have a result, nulls elsewhere stay null.  Texts of any
    length are encoded whole.  Other columns are left out.  No documents, no
    rows.
    """
    encoded = encoding.encode_and_decode(docs, _scratch(spark), keep=["doc_id", "lang", "source"])
    n_tokens = F.when(F.col("token_ids").isNotNull(), F.size("token_ids"))
    return encoded.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "token_ids", "text")


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is in the shared folder until the session ends."""
    kept = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
