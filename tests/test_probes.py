"""The number of lists follows from measured recall where the default isn't all of them."""

import dataclasses

import numpy as np

from plumbline.functions.ids import uint_cid
from plumbline.operators import ivf
from plumbline.plans import queries as core
from pyspark.sql import functions as F


class Few:
    """A snapshot of 64 lists whose default is to read 8."""

    def __init__(self, points, centroids):
        self.points, self.centroids = lambda: points, lambda: centroids
        self.config = dataclasses.make_dataclass("Config", ["index"])(dataclasses.make_dataclass("Index", ["default_probes"])(8))


def test_registered_query_reads_enough_lists(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((3000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, vector array<float>")
    centroids = ivf.train(x, 64)
    points = ivf.assign(table.select(uint_cid(F.col("qid")).alias("cid"), "vector"), centroids).cache()
    monkeypatch.setattr(core, "_snapshot", lambda spark, sf: Few(points, centroids))
    monkeypatch.setattr(core, "_queries", lambda spark, sf: table.where("qid < 600"))
    r = core.ivf_recall(spark, "").first()
    print("ivf recall", r.recall)
    assert r.recall >= 0.9 and ivf.enough_probes(points, table.where("qid < 600"), centroids, core.K) < 64
