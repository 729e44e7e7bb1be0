"""The stages of the pipeline, each against its operator or brute force on its own input."""

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .test_corpus_operators import SF, brute_mix, tokenizer


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        inputs.append(docs)
    return inputs


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, staged):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    docs, good, single, cut, mixed, encoded = staged
    assert all(x.columns == docs.columns for x in staged[:-1])
    quality, minhash = (importlib.import_module(f"plumbline.llm.{m}") for m in ("quality", "minhash"))
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert set(ids(good)) == keep and len(keep) < docs.count()
    from plumbline.llm.common import Scratch

    gone = {r.doc_id for r in minhash.near_duplicates(good, Scratch(spark)).where("NOT keep").collect()}
    assert gone and set(ids(single)) == keep - gone
    assert ids(cut) == ids(single)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (single, cut))
    assert any(len(after[i]) < len(before[i]) for i in before) and all(len(after[i]) <= len(before[i]) for i in before)
    mixing = importlib.import_module("plumbline.llm.mixing")
    rows = [(r.doc_id, r.text, r.source) for r in cut.collect()]
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == brute_mix(rows, mixing.WEIGHTS, mixing.DEFAULT, mixing.SEED)
    t = tokenizer()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in encoded.collect():
        assert r.token_ids == t.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.text == texts[r.doc_id]
    assert ids(encoded) == ids(mixed)


def test_run(spark, staged):
    key = lambda df: Counter((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(staged[-1])


def test_run_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0
