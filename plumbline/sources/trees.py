"""Text files of a folder, cut into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunked

SKIPPED = (".git", "target")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of all files below path (or the file there) that are UTF-8, without version control and build folders.

    Folders are passed over by their names below path; those above it don't
    count, nor does path's own name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    source = F.regexp_replace("path", r"^file:/*", "/")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    # what a file's address has before the root is of one length for all
    below = F.when(F.endswith(F.lit("/") if not root else F.col("path"), F.lit(root)), F.lit("")).otherwise(F.expr(f"substring(path, instr(path, {_quoted(root + '/')}) + {len(root)})"))
    inside = F.lit(True)
    for name in SKIPPED:
        inside = inside & ~below.contains(f"/{name}/") & ~below.endswith(f"/{name}")
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    return found.select(source.alias("source"), text.alias("text")).where(inside & F.col("text").isNotNull())


def document_chunks(spark: SparkSession, path: str, size: int = 2000) -> DataFrame:
    """(id, source, chunk, document) of all files below path."""
    return chunked(files(spark, path), size)
