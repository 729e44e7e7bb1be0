"""Scratch tables in the shared folder, and helpers for Arrow tasks.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` (a
folder that every executor reaches), so a lost executor costs a re-read and
never the result.  Only in local mode a temporary folder is used where that
setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import short_batches

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: str | None = None
_open: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of our own only if it is unset."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_fallback}"


class Scratch:
    """A folder of intermediate tables with one lifetime."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        short_batches(spark)
        self.path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        _open.append(self)

    @contextmanager
    def _shuffles_freed(self):
        """Writes inside let go of their shuffles at their end, since what is saved is never made again."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and read it back: its lineage ends here."""
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        with self._shuffles_freed():
            df.write.options(compression="zstd", **options).parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.scratch_path = at
        return back

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """The same, in buckets by key, so that a join on key with as many shuffle partitions doesn't move it."""
        table = f"plumbline_{name}_{uuid.uuid4().hex}"
        with self._shuffles_freed():
            df.write.bucketBy(buckets, key).option("path", f"{self.path}/{table}").option("compression", "zstd").format("parquet").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, df: DataFrame) -> None:
        """Delete one saved table that nothing will read again."""
        _delete(self.spark, df.scratch_path)

    def release(self) -> None:
        """Delete everything saved here."""
        if self in _open:
            _open.remove(self)
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _release_all() -> None:
    for scratch in list(_open):
        try:
            scratch.release()
        except Exception:  # the session has ended already
            return


def settled(run: Callable) -> Callable:
    """run, for mapInArrow, whose worker gives its free memory back at the end, since it may wait long for its next task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches sorted by integer keys so that no group is cut.

    Rows wait only while their group may go on, so memory holds one Arrow
    batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(n, bool)
        for c in cols:
            changes[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            changes[0] = any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(changes)
        if len(cuts) == 0:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, int(cuts[-1]))]
        table = pa.Table.from_batches([b for b in done if b.num_rows], schema=batch.schema)
        if table.num_rows:
            yield table
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over tables of whole groups of df, one shuffle, many groups a call."""

    def run(batches):
        for table in complete_groups(batches, keys):
            yield from fn(table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(settled(run), schema)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of a sorted table, and its number of rows at the end."""
    n = table.num_rows
    changes = np.zeros(n, bool)
    changes[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        changes[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changes), n)
