"""Make the package importable on executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once a SparkContext.

    Arrow functions refer to modules of the package; where it is not installed
    on the workers, the context's file server hands it out.
    """
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="plumbline-ship-")) / "plumbline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(to))
    context._plumbline_shipped = True


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 2000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have BATCH rows or BYTES, unless it has numbers of its own: rows are whole documents, vectors and blocks of texts here."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(BATCH))
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, str(BYTES))


_fallback: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder; in a local one of our own only in local mode where none is set."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        if _fallback is None:
            _fallback = tempfile.mkdtemp(prefix="plumbline-shared-")
        named = f"file://{_fallback}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, table: DataFrame) -> DataFrame:
    """table, written to the shared folder and read back: it is computed once."""
    at = shared_folder(spark, "table")
    table.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(table.schema).parquet(at)
