"""Versioned vector search and corpus processing on Spark."""

from .model import CollectionConfig, Condition, DeleteSelector, Filter, GetRequest, IndexConfig, Mutation, Point, Query, QueryParams, Range
from .storage.database import Collection, Database
from .storage.snapshots import Snapshot, SnapshotEngine
from .storage.store import CollectionHandle, Store, open_store
from .storage.text import Document, HashingEmbedder, TextCollection, TextQuery

__all__ = [
    "Collection", "CollectionConfig", "CollectionHandle", "Condition", "Database", "DeleteSelector", "Document", "Filter", "GetRequest", "HashingEmbedder", "IndexConfig",
    "Mutation", "Point", "Query", "QueryParams", "Range", "Snapshot", "SnapshotEngine", "Store", "TextCollection", "TextQuery", "open_store",
]
