"""Streams of points into a collection, one commit for each micro-batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(points: DataFrame, handle: Any, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of points (cid, vector, payload); of a batch's rows with one id the last survives only if ids are unique in it.

    A micro-batch that is tried again after a failure puts the same points in
    again, which leaves the root as it is.  Batches without rows write nothing.
    """

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            handle.upsert(batch.select("cid", "vector", "payload"))

    writer = points.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
