"""A client of column lists: ids, embeddings, metadatas and documents go in and come out side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession

from .errors import Invalid
from .model import DeleteSelector, Filter, GetRequest, Point, PointId, Query
from .operators.filters import from_where, from_where_document
from .storage.store import CollectionHandle, Store
from .storage.text import RESERVED, HashingEmbedder, TextCollection


class PersistentClient:
    def __init__(self, path: str, spark: SparkSession | None = None, embedder: Any = None):
        self.store = Store.open(spark or SparkSession.builder.getOrCreate(), str(path))
        self.embedder = embedder

    def get_or_create_collection(self, name: str) -> ClientCollection:
        """A collection by name; it comes to be with its first write."""
        return ClientCollection(self, self.store.collection(name))

    def get_collection(self, name: str) -> ClientCollection:
        found = self.get_or_create_collection(name)
        found.count()
        return found

    def list_collections(self) -> list[str]:
        return self.store.list_collections()

    def delete_collection(self, name: str) -> None:
        self.store.database.delete_collection(name)

    def doctor(self) -> dict[str, Any]:
        return self.store.database.doctor()


class ClientCollection:
    def __init__(self, client: PersistentClient, handle: CollectionHandle):
        self.client, self.handle, self.name = client, handle, handle.name

    def upsert(self, *, ids: Sequence[PointId], embeddings: Sequence[Sequence[float]], metadatas: Sequence[Mapping[str, Any] | None] | None = None, documents: Sequence[str | None] | None = None) -> None:
        for name, values in (("embeddings", embeddings), ("metadatas", metadatas), ("documents", documents)):
            if values is not None and len(values) != len(ids):
                raise Invalid(f"ids and {name} have different lengths")
        points = []
        for i, id_ in enumerate(ids):
            payload = dict((metadatas[i] if metadatas is not None else None) or {})
            if documents is not None and documents[i] is not None:
                payload[RESERVED] = documents[i]
            points.append(Point(id_, tuple(embeddings[i]), payload))
        self.handle.upsert(points)

    def query(self, *, query_embeddings: Sequence[Sequence[float]] | None = None, query_texts: Sequence[str] | None = None, n_results: int = 10, where: Mapping[str, Any] | None = None, where_document: Mapping[str, Any] | None = None) -> dict[str, list[list[Any]]]:
        """Hits of each query, the nearest first; a distance is 1 - cosine.  All queries share one pass."""
        match (query_embeddings, query_texts):
            case (None, None):
                raise Invalid("a query has embeddings or texts")
            case (_, None) | (None, _):
                pass
            case _:
                raise Invalid("a query hasn't both embeddings and texts")
        if query_texts is not None:
            embedder = self.client.embedder or HashingEmbedder(self.handle.advanced().snapshot().config.dimension)
            query_embeddings = TextCollection(self.handle, embedder)._embed(list(query_texts))
        f = _both(where, where_document)
        found = self.handle.query_batch([Query(tuple(v), n_results, f, payload=True) for v in query_embeddings])
        column = lambda get: [[get(p) for p in r.points] for r in found]
        return {"ids": column(lambda p: p.id), "documents": column(lambda p: p.payload.get(RESERVED)), "metadatas": column(lambda p: _metadata(p.payload)), "distances": column(lambda p: 1.0 - p.score)}

    def get(self, *, ids: Sequence[PointId] | None = None, where: Mapping[str, Any] | None = None, limit: int | None = None, offset: int = 0) -> dict[str, list[Any]]:
        """Points in canonical order; an empty list of ids is no restriction."""
        found = self.handle.get(GetRequest(ids=tuple(ids) if ids else None, filter=_both(where, None), offset=offset, limit=limit, payload=True))
        return {"ids": [r.id for r in found], "documents": [r.payload.get(RESERVED) for r in found], "metadatas": [_metadata(r.payload) for r in found]}

    def count(self) -> int:
        return self.handle.count()

    def delete(self, *, ids: Sequence[PointId] | None = None, where: Mapping[str, Any] | None = None) -> None:
        if ids and where:
            raise Invalid("a deletion hasn't both ids and where")
        if ids:
            selector = DeleteSelector(ids=tuple(ids))
        elif where:
            selector = DeleteSelector(filter=from_where(where))
        else:
            raise Invalid("a deletion has ids or where")
        self.handle.delete(selector)


def _both(where, where_document) -> Filter | None:
    must = (*(from_where(where).must if where else ()), *(from_where_document(where_document).must if where_document else ()))
    return Filter(must=must) if must else None


def _metadata(payload: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in payload.items() if k != RESERVED}
