"""Groups of a search: points are held, queries and what is found stream by, and marks of lists are bits.  Each test fails with the code before."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions.ids import uint_cid
from plumbline.functions.vectors import cosines
from plumbline.model import canonical_id
from plumbline.operators import ivf, search


def _vectors(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _batch(x, ids, asked):
    n = len(ids)
    cids = pa.nulls(n, pa.binary()) if asked else pa.array([canonical_id(i) for i in ids], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([asked] * n), pa.array(ids, pa.int64()) if asked else pa.nulls(n, pa.int64()), cids, _vectors(x[ids])], names=["asked", "qid", "cid", "vector"])


def test_f11_only_the_points_of_a_group_are_held():
    x = np.random.default_rng(4).standard_normal((3000, 8)).astype(np.float32)
    exact, read, seen = cosines(x[:2500].astype(float), x.astype(float)), [], []

    def batches():
        for a in range(0, 2500, 500):
            yield _batch(x, list(range(a, a + 500)), False)
        for a in range(0, 3000, 100):
            read.append(a)
            yield _batch(x, list(range(a, a + 100)), True)

    got = []
    for found in search.group_winners(batches(), 3):
        seen.append((read[-1], found.num_rows))
        got += zip(found["qid"].to_pylist(), found["cid"].to_pylist())
    # each batch of queries is answered before the next is read
    assert seen == [(a, 300) for a in range(0, 3000, 100)]
    assert got == [(q, canonical_id(int(i))) for q in range(3000) for i in np.argsort(-exact[:, q], kind="stable")[:3]]
    assert not list(search.group_winners(iter([_batch(x, [1, 2], True)]), 3)) and not list(search.group_winners(iter([_batch(x, [1, 2], False)]), 3))


def test_f14_marks_of_lists_take_a_bit_each(spark):
    rng = np.random.default_rng(6)
    counts = {c: 10 for c in range(0, 1000)} | {700: 95}
    lists, first, parts, bins = search._bins(counts, 40)
    assert parts.max() == 3
    asked = [np.sort(rng.choice(1003, 900, replace=False)).astype(np.int32) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), _vectors(np.ones((300, 2), np.float32)), pa.array(asked, pa.list_(pa.int32()))], names=["qid", "vector", "lists"])
    found = list(search.spread([batch], lists, first, parts))
    marks = sum(b.column(3).nbytes - 4 * (b.num_rows + 1) for b in found)
    assert marks <= 300 * bins < 300 * 900 * 4 / 12
    own: dict = {}
    for b in found:
        (bin_,) = set(b["bin"].to_pylist())
        numbers = lists[(first <= bin_) & (bin_ < first + parts)]
        for q, row in zip(b["qid"].to_pylist(), search._bits(b.column(3), numbers, (lists, first))):
            own.setdefault(q, []).append((bin_, numbers[row].tolist()))
    for q, o in enumerate(asked):
        assert len({b for b, _ in own[q]}) == len(own[q])
        assert sorted({c for _, row in own[q] for c in row}) == [c for c in o.tolist() if c < 1000]


def test_f10_f14_searches_of_lists_by_the_stream(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 6)).astype(np.float32)
    x[20:30] = x[800:810]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, vector array<float>").repartition(5)
    book = ivf.train(x, 32)
    points = ivf.assign(table.select(uint_cid(F.col("qid")).alias("cid"), "vector"), book)
    own = {r.qid: r.centroid for r in ivf.assign(table, book).collect()}
    read = np.argsort(-cosines(x.astype(float), book.astype(float)), axis=1, kind="stable")
    cos = cosines(x.astype(float), x.astype(float))
    for probes in (5, 32):
        plan = ivf.search_join(points, table, book, 10, probes, 60)
        assert "CoGroup" not in plan._jdf.queryExecution().executedPlan().toString()
        got: dict = {}
        for r in plan.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(bytes(r.cid))
        for q in range(900):
            seen = set(read[q, :probes].tolist())
            assert got[q] == [canonical_id(int(i)) for i in np.argsort(-cos[q], kind="stable") if own[int(i)] in seen][:10]
