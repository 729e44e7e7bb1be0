"""Operator 2: near-copies of documents by MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import Scratch, settled, unique_name
from .components import components
from .pairing import block_members, verified

SHINGLE = 3
BANDS = 40
ROWS = 4
THRESHOLD = 0.45
BLOCK = 1024
SEED = 20


def _repeated(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(doc_id, least): ids that have several texts, and the least of their hashes; None if there are none."""
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    several = scratch.save(hashed.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most").drop("most"), "repeated")
    return None if several.isEmpty() else several


def _with_node(docs: DataFrame, several: DataFrame | None, name: str) -> DataFrame:
    """docs and the number that stands for each text: its doc_id, but a negative one for all but one text of an id that has several."""
    own = F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long"))
    if several is None:
        return docs.withColumn(name, own)
    key, least = unique_name(docs, "node_id"), unique_name(docs, "node_least")
    found = docs.join(several.select(F.col("doc_id").alias(key), F.col("least").alias(least)), docs["doc_id"].cast("long") == F.col(key), "left")
    other = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    return found.withColumn(name, F.when(F.xxhash64("text") > F.col(least), other).otherwise(own)).drop(key, least)


def _signatures(docs: DataFrame, shingle: int, n: int, seed: int) -> DataFrame:
    """(node, doc_id, sig): n minima of each text that has a word."""
    factors, addends = textops.permutations(n, seed)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in textops.blocks(texts):
                values, offsets = textops.shingles(textops.words(texts[a:b]), shingle)
                rows = textops.minima(values, offsets, factors, addends)
                if len(rows):
                    has = pa.array(np.diff(offsets) > 0)
                    sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a).filter(has) for k in (0, 1)), sig], names=["node", "doc_id", "sig"])

    return docs.mapInArrow(settled(run), "node long, doc_id long, sig binary")


def _band_keys(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id): one key for each band, made of its minima and its number."""

    def run(batches):
        salt = textops.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, rows)
            acc = np.repeat(salt[None, :], batch.num_rows, axis=0)
            for r in range(rows):
                acc = textops.mix(acc ^ sig[:, :, r].astype(np.uint64))
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(acc.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return signatures.select("node", "sig").mapInArrow(settled(run), "key long, id long")


def _groups(docs: DataFrame, several: DataFrame | None, scratch: Scratch, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(node, doc_id, group_id, keep) of texts that have near-copies; see near_groups."""
    n = bands * rows
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sigs = scratch.save(_signatures(_with_node(source, several, "node").select("node", "doc_id", "text"), shingle, n, seed), "signatures")
    # texts with equal signatures are copies: only the first goes through the bands
    keyed = sigs.select("node", F.xxhash64("sig").alias("h1"), F.xxhash64("sig", F.lit(7)).alias("h2"))
    firsts = keyed.groupBy("h1", "h2").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    same = keyed.join(firsts.where("first < last"), ["h1", "h2"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
    entries = _band_keys(sigs.join(firsts.select(F.col("first").alias("node")).distinct(), "node", "left_semi"), bands, rows).distinct()
    members = block_members(scratch.save(entries, "bands"), block)
    least = int(np.ceil(threshold * n))

    def decode(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, n)

    near = verified(
        members.join(sigs.select(F.col("node").alias("id"), "sig"), "id").select("key", "i", "j", "id", "sig"),
        "sig",
        decode,
        lambda a, b: (a == b).sum(axis=1) >= least,
        lambda row, others: (others == row).sum(axis=1) >= least,
    )
    found = components(near.union(same), scratch)
    if several is None:
        return found.select("node", F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep"))
    found = scratch.save(found.join(sigs.select("node", "doc_id").distinct(), "node"), "nodes")
    # the least doc_id names the group; of its texts the one of least number stays
    heads = found.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("head"))
    return found.join(heads, "component").select("node", "doc_id", F.col("head.doc_id").alias("group_id"), (F.col("node") == F.col("head.node")).alias("keep"))


def near_groups(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """(doc_id, group_id): each document that has near-copies, and the least doc_id of its group.

    A document is its set of runs of ``shingle`` words (see textops); the
    signature holds the minima of bands * rows universal hash functions.
    Documents that agree in a band are candidates, and are linked if their
    signatures agree in at least ``threshold`` of the minima (the estimate of
    the Jaccard similarity).  Groups are the connected components.  With 40
    bands of 4 rows, documents of similarity 0.5 are found with probability
    0.92, of 0.6 with 0.996.

    Rows with a null doc_id or text, and texts without a word, have no copies.
    A text of fewer words than a shingle is one shingle.  Rows that repeat a
    doc_id with the same text count as one document, with other texts as
    documents of their own, each with a row if it has copies.  Other columns
    are ignored, whatever their names.  No documents, no rows.
    """
    return _groups(docs, _repeated(docs, scratch), scratch, **parameters).select("doc_id", "group_id")


def near_duplicates(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """(doc_id, group_id, group_size, keep) for the documents of groups of two or more; keep marks the one of least doc_id.

    Parameters and edge cases: near_groups.
    """
    groups = scratch.save(_groups(docs, _repeated(docs, scratch), scratch, **parameters), "groups")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return groups.join(sizes, "group_id").select("doc_id", "group_id", "group_size", "keep")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """docs without all but one document of each group; the one of least doc_id stays.

    Of an id that has several texts only those go that have a copy elsewhere.
    Rows that are equal in all columns are also reduced to one.  Rows with a
    null doc_id or text stay.  Columns are those of docs.
    """
    several = _repeated(docs, scratch)
    name = unique_name(docs, "node")
    gone = _groups(docs, several, scratch, **parameters).where("NOT keep").select(F.col("node").alias(name))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = _with_node(docs, several, name).join(gone, name, "left_anti").select(docs.columns)
    # repeated ids are rare: only their rows are compared in whole
    twice = left.join(repeated, "doc_id", "left_semi").dropDuplicates()
    return left.join(repeated, "doc_id", "left_anti").unionByName(twice).select(docs.columns)
