"""Sign-hash tables of a snapshot, kept beside it: the index of the older format."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid
from ..model import Filter, check_vector
from ..operators import filters, lsh
from .snapshots import Snapshot

_STORED = "cid binary, cid_hash string, table int, signature long"


class OlderIndex:
    """Buckets of one snapshot's points by their signs in several tables of projections."""

    def __init__(self, snapshot: Snapshot, tables: int = 8, bits: int = 12, seed: int = 0):
        if tables < 1 or not 1 <= bits <= 62:
            raise Invalid("an index has at least one table, and 1 to 62 bits")
        self.snapshot = snapshot
        self.signs = lsh.projections(tables, bits, snapshot.config.dimension, seed)
        self._name = f"older/{snapshot.root}-{tables}-{bits}-{seed}"
        self._same = lambda other: OlderIndex(other, tables, bits, seed)

    def exists(self) -> bool:
        return self.snapshot.files.exists(f"{self._name}/_SUCCESS")

    def buckets(self) -> DataFrame:
        """(cid, cid_hash, table, signature): one row for each point and table; built if there is no such index yet."""
        if not self.exists():
            self._write(lsh.index(self.snapshot.points(), self.signs))
        return self.snapshot.spark.read.schema(_STORED).parquet(self.snapshot.files.path(self._name))

    def update(self, before: Snapshot) -> DataFrame:
        """The same, from the index of an earlier snapshot: only points that differ are hashed."""
        if not self.exists():
            change = before.diff_table(self.snapshot)
            kept = self._same(before).buckets().join(change.where("change != 'added'").select("cid"), "cid", "left_anti")
            fresh = self.snapshot.points().join(change.where("change != 'removed'").select("cid"), "cid", "left_semi")
            self._write(kept.unionByName(lsh.index(fresh, self.signs)))
        return self.buckets()

    def _write(self, rows: DataFrame) -> None:
        files, draft = self.snapshot.files, f"{self._name}.{uuid.uuid4().hex}.part"
        # by table and signature, so that a search skips what it doesn't probe
        out = rows.select("cid", "cid_hash", F.col("table").cast("int").alias("table"), "signature").repartitionByRange("table", "signature").sortWithinPartitions("table", "signature", "cid_hash")
        out.write.option("compression", "zstd").parquet(files.path(draft))
        if not files.rename(draft, self._name):
            files.delete(draft)

    def search(self, vector: Sequence[float], k: int, probes: int, limit: int, f: Filter | None = None) -> tuple[DataFrame, dict]:
        """((rank, cid, score), counters); the limit holds for points discovered, before the filter."""
        checked = check_vector(vector, self.snapshot.config.dimension)
        passes = filters.predicate(f) if f else F.lit(True)
        return lsh.search(self.snapshot.points(), self.buckets(), passes, checked, self.signs, k, probes, limit)

    def search_table(self, queries: DataFrame, k: int, probes: int, f: Filter | None = None) -> DataFrame:
        """(qid, rank, cid, score) for a table of queries (qid: long, vector) of any size, which stays on the executors; all points of the probed buckets count, as a limit is a matter of single queries."""
        passes = filters.predicate(f) if f else F.lit(True)
        return lsh.search_join(self.snapshot.points(), self.buckets(), passes, self.snapshot.checked(queries), self.signs, k, probes)
