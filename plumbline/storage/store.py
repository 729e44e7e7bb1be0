"""The simple way in: collections that come to be with their first write."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import CollectionExists, CollectionNotFound, Invalid, StaleRoot
from ..model import CollectionConfig, DeleteSelector, Filter, GetRequest, Mutation, PointId, Query, QueryResult, Record, ScoredPoint, WriteResult, check_vector
from .database import Collection, Database

TRIES = 8


def open_store(spark: SparkSession, path: str) -> Store:
    return Store.open(spark, path)


class Store:
    def __init__(self, database: Database):
        self.database = database

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """Open the database at path, or make one there."""
        return cls(Database.init(spark, path))

    def collection(self, name: str) -> CollectionHandle:
        Database.validate_collection_name(name)
        return CollectionHandle(self, name)

    def list_collections(self) -> list[str]:
        return self.database.list_collections()

    def advanced(self) -> Database:
        return self.database

    def text_collection(self, name: str, embedder: Any):
        from .text import TextCollection

        return TextCollection(self.collection(name), embedder)


class CollectionHandle:
    """A collection by name; nothing is created before the first write."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def advanced(self) -> Collection:
        return self.store.database.collection(self.name)

    def _retried(self, write) -> WriteResult:
        for turn in range(TRIES):
            try:
                return write()
            except StaleRoot:
                if turn == TRIES - 1:
                    raise
                time.sleep(0.01 * 2**turn)
        raise AssertionError

    def upsert(self, points: Any, vector_space: str | None = None) -> WriteResult:
        """Put points in; the first write creates the collection with their dimension."""
        points = points if isinstance(points, DataFrame) else tuple(points)
        dimension = _dimension(points)

        def write() -> WriteResult:
            try:
                found = self.advanced()
            except CollectionNotFound:
                config = CollectionConfig(dimension, vector_space)
                try:
                    found = self.store.database.create_collection(self.name, config)
                except CollectionExists:
                    found = self.advanced()
            if vector_space is not None and found.snapshot().config.vector_space != vector_space:
                raise Invalid(f"{self.name} holds vectors of {found.snapshot().config.vector_space!r}, not {vector_space!r}")
            return found.upsert(points)

        return self._retried(write)

    def search(self, vector: Sequence[float], limit: int) -> list[ScoredPoint]:
        return self.query(Query.new(vector, limit).with_payload()).points

    def query(self, q: Query) -> QueryResult:
        return self.advanced().query(q)

    def query_batch(self, queries: Sequence[Query]) -> list[QueryResult]:
        return self.advanced().query_batch(queries)

    def get(self, request: GetRequest) -> list[Record]:
        return self.advanced().get(request)

    def get_ids(self, ids: Iterable[PointId]) -> list[Record]:
        return self.get(GetRequest(ids=tuple(ids), payload=True))

    def peek(self, limit: int) -> list[Record]:
        return self.get(GetRequest(limit=limit, payload=True))

    def delete_ids(self, ids: Iterable[PointId]) -> WriteResult:
        return self.delete(DeleteSelector(ids=tuple(ids)))

    def delete(self, selector: DeleteSelector) -> WriteResult:
        return self._retried(lambda: self.advanced().delete(selector))

    def apply(self, mutations: Iterable[Mutation]) -> WriteResult:
        steps = list(mutations)
        return self._retried(lambda: self.advanced().apply(steps))

    def count(self) -> int:
        return self.advanced().count()

    def count_where(self, f: Filter) -> int:
        return self.advanced().count(f)

    def root(self) -> str:
        return self.advanced().root()

    def restore(self, revision: str) -> WriteResult:
        return self._retried(lambda: self.advanced().restore(revision))


def _dimension(points: Any) -> int:
    """The one dimension of a first batch."""
    if isinstance(points, DataFrame):
        from pyspark.sql import functions as F

        r = points.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
        found = {r["a"], r["b"]} - {None}
    else:
        found = {len(check_vector(p.vector)) for p in points}
    if len(found) != 1:
        raise Invalid("an upsert has at least one point, and all have one dimension")
    return found.pop()
