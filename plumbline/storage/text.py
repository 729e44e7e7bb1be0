"""Documents over points: texts that an embedder turns into vectors."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..errors import CollectionNotFound, Corrupt, EmbeddingError, Invalid
from ..model import DeleteSelector, Filter, Mutation, Point, PointId, Query, QueryParams, ScoredPoint, WriteResult, canonical_json
from ..sources.points import from_table

RESERVED = "document"


class Embedder(Protocol):
    """Turns texts into vectors, one each and in order; model_id says which vectors can be compared."""

    model_id: str

    def embed(self, texts: list[str]) -> list[Sequence[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words and word pairs, of unit length; needs no model."""

    def __init__(self, dimension: int = 64):
        if dimension < 1:
            raise Invalid("an embedding has at least one component")
        self.dimension, self.model_id = dimension, f"hashing-{dimension}"
        self._known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        """The word's hash, remembered as long as there is room."""
        h = self._known.get(word)
        if h is None:
            if len(self._known) >= 1 << 17:
                self._known.clear()
            h = self._known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        hashed = hashlib.blake2b
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            # words come again, most pairs do not
            pairs = b"".join([hashed(p, digest_size=8).digest() for p in map(str.encode, map(" ".join, zip(words, words[1:])))])
            h = np.concatenate([np.fromiter(map(self._hash, words), np.uint64, len(words)), np.frombuffer(pairs, "<u8")])
            place = (h >> np.uint64(1)) % np.uint64(self.dimension)
            out[i] = np.bincount(place.astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0), self.dimension)
            if not out[i].any():
                out[i, 0] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32).tolist() if len(texts) else []


@dataclass(frozen=True)
class Document:
    id: PointId
    text: str
    metadata: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def new(cls, id: PointId, text: str) -> Document:
        return cls(id, text)

    def with_metadata(self, metadata: dict[str, Any]) -> Document:
        return replace(self, metadata=dict(metadata))


@dataclass(frozen=True)
class TextQuery:
    text: str
    limit: int = 10
    filter: Filter | None = None
    params: QueryParams = field(default_factory=QueryParams)

    @classmethod
    def new(cls, text: str) -> TextQuery:
        return cls(text)

    def with_limit(self, limit: int) -> TextQuery:
        return replace(self, limit=limit)

    def with_filter(self, filter: Filter) -> TextQuery:
        return replace(self, filter=filter)

    def with_params(self, params: QueryParams) -> TextQuery:
        return replace(self, params=params)


@dataclass(frozen=True)
class DocumentHit:
    id: PointId
    score: float
    text: str
    metadata: dict[str, Any]


class TextCollection:
    """A collection whose vector space is the embedder's model."""

    def __init__(self, handle, embedder: Embedder):
        if not embedder.model_id:
            raise EmbeddingError("an embedder's model has a name")
        self.handle, self.embedder = handle, embedder
        try:
            self._same_space()
        except CollectionNotFound:
            pass

    def _same_space(self) -> None:
        space = self.handle.advanced().snapshot().config.vector_space
        if space != self.embedder.model_id:
            raise Invalid(f"{self.handle.name} holds vectors of {space!r}, not of {self.embedder.model_id!r}")

    def vectors(self):
        return self.handle

    def _embed(self, texts: list[str]) -> list[list[float]]:
        out = [list(map(float, v)) for v in self.embedder.embed(texts)]
        if len(out) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts were given, {len(out)} vectors came back")
        if any(not v or not np.isfinite(v).all() or not np.any(v) for v in out):
            raise EmbeddingError("an embedding is finite and isn't zero")
        return out

    def _points(self, documents: Iterable[Document]) -> tuple[Point, ...]:
        rows = list(documents)
        if not rows:
            raise Invalid("at least one document is needed")
        for d in rows:
            if RESERVED in d.metadata:
                raise Invalid(f"metadata has no key {RESERVED!r}: it holds the text")
        return tuple(Point(d.id, tuple(v), {**d.metadata, RESERVED: d.text}) for d, v in zip(rows, self._embed([d.text for d in rows])))

    def upsert_documents(self, documents: Iterable[Document]) -> WriteResult:
        return self.handle.upsert(self._points(documents), vector_space=self.embedder.model_id)

    def upsert_table(self, documents: DataFrame, id: str = "id", text: str = "text", metadata: str | None = None) -> WriteResult:
        """Documents from a table: texts are embedded in Arrow batches on the executors.

        metadata names a column of JSON text.  Rows without text, and metadata
        that isn't an object or has the text's key, fail the check of points.
        """
        @F.pandas_udf("string")
        def payloads(texts: pd.Series, metas: pd.Series) -> pd.Series:
            def one(t, m):
                try:
                    value = json.loads(m) if m is not None else {}
                    return None if t is None or RESERVED in value else canonical_json({**value, RESERVED: t})
                except (ValueError, TypeError):
                    return None

            return pd.Series([one(t, m) for t, m in zip(texts, metas)], dtype=object)

        given = F.col(metadata) if metadata else F.lit(None).cast("string")
        chosen = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), payloads(F.col(text), given).alias("payload"))
        own = embedded(chosen, "text", "vector", self.embedder)
        with self._drafted(from_table(own, "id", "vector", F.col("payload"), canonical=True)) as points:
            return self.handle.upsert(points, vector_space=self.embedder.model_id)

    @contextmanager
    def _drafted(self, points: DataFrame) -> Iterator[DataFrame]:
        """points, written once: their number, dimension and rows are asked for one after the other."""
        files = self.handle.store.database.files
        name = f"drafts/{uuid.uuid4().hex}"
        try:
            points.write.option("compression", "zstd").parquet(files.path(name))
            yield points.sparkSession.read.schema(points.schema).parquet(files.path(name))
        finally:
            files.delete(name)

    def sync_files(self, files: DataFrame, size: int) -> tuple[int, int, WriteResult | None]:
        """Make the chunks of files (source, text) what the collection has of them, as one commit; numbers of files and chunks, and the commit.

        Chunks that a file no longer has go, so all of an empty file's.  Files
        that aren't given are left alone.
        """
        from ..functions.chunks import chunked

        count = files.count()
        if not count:
            raise Invalid("there are no files to index")
        rows = chunked(files, size)
        own = embedded(rows.withColumn("payload", F.to_json(F.struct("source", "chunk", F.col("document").alias(RESERVED)))), "document", "vector", self.embedder)
        with self._drafted(from_table(own, "id", "vector", F.col("payload"))) as points:
            chunks = points.count()
            try:
                self._same_space()
                source = F.try_variant_get(F.parse_json("payload"), "$.source", "variant")
                named = F.when(F.schema_of_variant(source) == "STRING", F.try_variant_get(source, "$", "string"))
                old = self.handle.advanced().points().select("cid", named.alias("source"))
                stale = old.join(files.select("source").distinct(), "source", "left_semi").join(points.select("cid"), "cid", "left_anti").select("cid")
            except CollectionNotFound:
                return count, chunks, self.handle.upsert(points, vector_space=self.embedder.model_id) if chunks else None
            steps = [Mutation.delete_ids(stale)] + ([Mutation.upsert(points)] if chunks else [])
            return count, chunks, self.handle.apply(steps)

    def replace_documents(self, filter: Filter, documents: Iterable[Document]) -> WriteResult:
        """Delete what passes the filter and put documents in, as one commit."""
        self._same_space()
        return self.handle.apply([Mutation.delete_filter(filter), Mutation.upsert(self._points(documents))])

    def delete(self, selector: DeleteSelector) -> WriteResult:
        return self.handle.delete(selector)

    def search_text(self, text: str, limit: int) -> list[ScoredPoint]:
        self._same_space()
        return self.handle.search(self._embed([text])[0], limit)

    def query(self, q: TextQuery) -> list[DocumentHit]:
        return self.query_batch([q])[0]

    def query_batch(self, queries: Sequence[TextQuery]) -> list[list[DocumentHit]]:
        """Hits of all queries, with one call of the embedder."""
        self._same_space()
        vectors = self._embed([q.text for q in queries]) if queries else []
        asked = [Query(tuple(v), q.limit, q.filter, payload=True, vector_space=self.embedder.model_id, params=q.params) for q, v in zip(queries, vectors)]
        return [[_hit(p) for p in r.points] for r in self.handle.query_batch(asked)]


def _hit(p: ScoredPoint) -> DocumentHit:
    text = (p.payload or {}).get(RESERVED)
    if not isinstance(text, str):
        raise Corrupt(f"point {p.id!r} has no document")
    return DocumentHit(p.id, p.score, text, {k: v for k, v in p.payload.items() if k != RESERVED})


def embedded(documents: DataFrame, text: str, column: str, embedder: Embedder) -> DataFrame:
    """documents and a column of vectors of text, null where it is null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        rows = [t for t in texts if t is not None]
        vectors = embedder.embed(rows) if rows else []
        if len(vectors) != len(rows):
            raise ValueError(f"{len(rows)} texts were given, {len(vectors)} vectors came back")
        if any(not len(v) or not np.isfinite(v).all() or not np.any(v) for v in vectors):
            raise ValueError("an embedding is finite and isn't zero")
        turn = iter(vectors)
        return pd.Series([None if t is None else [float(x) for x in next(turn)] for t in texts], dtype=object)

    return documents.withColumn(column, embed(text))
