"""What was found of searches at larger sizes: each test fails with the code before."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.ids import uint_cid
from plumbline.functions.vectors import cosines
from plumbline.llm import encoding
from plumbline.model import canonical_id
from plumbline.operators import search
from plumbline.session import short_batches


@pytest.mark.parametrize("lists", [True, False])
def test_f9_f10_f14_rows_go_to_no_more_groups_in_a_larger_table(spark, monkeypatch, lists):
    copies = []
    own = search.grid
    monkeypatch.setattr(search, "grid", lambda *a: (copies.append(own(*a)), copies[-1])[1])
    for n in (20_000, 100_000):
        table = spark.range(n).select(F.col("id").alias("qid"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vector"))
        points = table.select(uint_cid(F.col("qid")).alias("cid"), "vector", (F.col("qid") % 50).cast("int").alias("list"))
        search.listed_join(points, table, 10) if lists else search.top_k_join(points.drop("list"), table, 10)  # plans only
    assert copies[0] == copies[1]
    # but a side of a group stays bounded, in rows of any length
    assert search.group_rows(spark.sql("SELECT array_repeat(1f, 4096) AS vector"))[1] * 4096 * 4 <= search.GROUP_BYTES


def _vectors(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def test_parts_of_a_group_and_their_lists(monkeypatch):
    monkeypatch.setattr(search, "WIDE", 64)
    monkeypatch.setattr(search, "PART", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 5)).astype(np.float32)
    x[30:40] = x[450:460]
    own = rng.integers(0, 9, 500)
    y = np.concatenate([x[:40], np.zeros((1, 5), np.float32)])
    open_ = [sorted(rng.choice(11, 3, replace=False).tolist()) for _ in y]
    exact = cosines(x.astype(float), y.astype(float))
    left = pa.table({"cid": pa.array([canonical_id(i) for i in range(500)], pa.binary()), "vector": _vectors(x), "list": pa.array(own, pa.int32())})
    right = pa.table({"qid": pa.array(np.arange(len(y))), "vector": _vectors(y)})
    every = [(q, canonical_id(int(i))) for q in range(len(y)) for i in np.lexsort((np.arange(500), -exact[:, q]))[:6]]
    found = search._blocked(left, right, 6)
    assert list(zip(found["qid"].to_pylist(), found["cid"].to_pylist())) == every
    some = [(q, canonical_id(int(i))) for q, o in enumerate(open_) for i in [i for i in np.lexsort((np.arange(500), -exact[:, q])) if own[i] in o][:6]]
    found = search._blocked(left, right.append_column("lists", pa.array(open_, pa.list_(pa.int32()))), 6)
    assert list(zip(found["qid"].to_pylist(), found["cid"].to_pylist())) == some


def test_f11_a_group_has_no_copies_in_64_bits():
    n = 60_000
    x = np.random.default_rng(1).standard_normal((n, 64)).astype(np.float32)
    left = pa.table({"cid": pa.array([canonical_id(i) for i in range(n)], pa.binary()), "vector": _vectors(x)})
    right = pa.table({"qid": pa.array(np.arange(300)), "vector": _vectors(x[:300])})
    tracemalloc.start()
    found = search._blocked(left, right, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["cid"].to_pylist() == [canonical_id(i) for i in range(300)]
    # a copy of units in 32 bits, the scores of one block, and little else
    assert most < x.nbytes + 8 * search.TILE + (8 << 20)


def test_f8_batches_of_long_rows_are_bounded_in_bytes(spark):
    short_batches(spark)
    rows = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) >= 60 << 20 and max(sizes) <= 18 << 20
    assert encoding.BUCKET <= 1 << 18
