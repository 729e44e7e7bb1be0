"""Requests and results: plain values that say what to compute."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any, Union

from .errors import Invalid

U64 = (1 << 64) - 1
PointId = Union[str, int]


def canonical_id(value: PointId) -> bytes:
    """Bytes that identify an id and give its order: all strings, then all integers.

    Strings and integers are separate: "1" and 1 are different ids.
    """
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        raise Invalid(f"an id is a string or an unsigned integer, not {value!r}")
    if isinstance(value, str):
        return b"s\x00" + value.encode("utf-8")
    if not 0 <= value <= U64:
        raise Invalid(f"an integer id has 64 bits without a sign, {value} doesn't")
    return b"u\x00" + value.to_bytes(8, "big")


def id_of(cid: bytes) -> PointId:
    """The id that canonical_id made the bytes of."""
    kind, rest = cid[:2], bytes(cid[2:])
    return rest.decode("utf-8") if kind == b"s\x00" else int.from_bytes(rest, "big")


def canonical_json(value: Mapping[str, Any]) -> str:
    """Compact JSON with sorted keys; numbers that aren't finite are refused."""
    if not isinstance(value, Mapping):
        raise Invalid("a payload is a JSON object")
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError as error:
        raise Invalid(f"payload: {error}") from None


def check_vector(vector: Iterable[float], dimension: int | None = None) -> list[float]:
    """The vector as floats, if it is finite, not empty and of the dimension."""
    out = [float(x) for x in vector]
    if not out:
        raise Invalid("a vector has at least one component")
    if not all(math.isfinite(x) and abs(x) <= 3.4028234663852886e38 for x in out):
        raise Invalid("a vector's components are finite 32-bit numbers")
    if dimension is not None and len(out) != dimension:
        raise Invalid(f"expected dimension {dimension}, found {len(out)}")
    return out


@dataclass(frozen=True)
class Point:
    id: PointId
    vector: tuple[float, ...]
    payload: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def new(cls, id: PointId, vector: Iterable[float]) -> Point:
        return cls(id, tuple(vector))

    def with_payload(self, payload: Mapping[str, Any]) -> Point:
        return replace(self, payload=dict(payload))

    with_metadata = with_payload


@dataclass(frozen=True)
class IndexConfig:
    full_scan_threshold: int = 1000
    default_probes: int = 96
    default_candidate_limit: int = 10_000
    tables: int = 12
    signature_bits: int = 12
    seed: int = 1


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int
    vector_space: str | None = None
    index: IndexConfig = field(default_factory=IndexConfig)

    @classmethod
    def new(cls, dimension: int) -> CollectionConfig:
        return cls(dimension)

    def with_vector_space(self, name: str) -> CollectionConfig:
        return replace(self, vector_space=name)

    def with_index(self, index: IndexConfig) -> CollectionConfig:
        return replace(self, index=index)

    def check(self) -> None:
        if not 1 <= self.dimension <= (1 << 32) - 1:
            raise Invalid("a dimension is at least 1 and has 32 bits")
        if self.vector_space is not None and not self.vector_space:
            raise Invalid("a vector space has a name")
        if min(self.index.default_probes, self.index.default_candidate_limit) < 1:
            raise Invalid("default probes and candidates are at least 1")


@dataclass(frozen=True)
class Range:
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Condition:
    """One test of a point; kind is one of the class methods' names."""

    kind: str
    key: str | None = None
    value: Any = None
    range_: Range | None = None

    @classmethod
    def matches(cls, key: str, value: Any) -> Condition:
        return cls("field", key, (value,))

    @classmethod
    def range(cls, key: str, bounds: Range) -> Condition:
        return cls("field", key, None, bounds)

    @classmethod
    def matches_in_range(cls, key: str, value: Any, bounds: Range) -> Condition:
        return cls("field", key, (value,), bounds)

    @classmethod
    def has_id(cls, ids: Iterable[PointId]) -> Condition:
        return cls("has_id", None, tuple(ids))

    @classmethod
    def exists(cls, key: str) -> Condition:
        return cls("exists", key)

    @classmethod
    def is_in(cls, key: str, values: Iterable[Any]) -> Condition:
        return cls("is_in", key, tuple(values))

    @classmethod
    def not_in(cls, key: str, values: Iterable[Any]) -> Condition:
        return cls("not_in", key, tuple(values))

    @classmethod
    def contains(cls, key: str, value: Any) -> Condition:
        return cls("contains", key, value)

    @classmethod
    def document_contains(cls, value: str) -> Condition:
        return cls("document_contains", None, value)

    @classmethod
    def document_regex(cls, value: str) -> Condition:
        return cls("document_regex", None, value)

    @classmethod
    def nested(cls, inner: Filter) -> Condition:
        return cls("nested", None, inner)


@dataclass(frozen=True)
class Filter:
    """All of must, none of must_not, and one of should if there is any."""

    must: tuple[Condition, ...] = ()
    should: tuple[Condition, ...] = ()
    must_not: tuple[Condition, ...] = ()

    @classmethod
    def all_of(cls, conditions: Iterable[Condition]) -> Filter:
        return cls(must=tuple(conditions))

    @classmethod
    def from_json(cls, value: Mapping[str, Any]) -> Filter:
        """The filter that a JSON object says; unknown keys are refused rather than ignored."""
        if not isinstance(value, Mapping):
            raise Invalid("a filter is an object")
        if unknown := set(value) - {"must", "should", "must_not"}:
            raise Invalid(f"a filter has no {sorted(unknown)}")
        parts = {}
        for name in ("must", "should", "must_not"):
            given = value.get(name, [])
            if not isinstance(given, list):
                raise Invalid(f"{name} is a list of conditions")
            parts[name] = tuple(_condition(c) for c in given)
        return cls(**parts)


def _condition(c: Any) -> Condition:
    if not isinstance(c, Mapping):
        raise Invalid("a condition is an object")
    names = frozenset(c)
    if names == {"has_field"}:
        return Condition.exists(c["has_field"])
    if names == {"key", "any"}:
        return Condition.is_in(c["key"], c["any"])
    if names == {"key", "none"}:
        return Condition.not_in(c["key"], c["none"])
    if names == {"key", "contains"}:
        return Condition.contains(c["key"], c["contains"])
    if names == {"document_contains"}:
        return Condition.document_contains(c["document_contains"])
    if names == {"document_regex"}:
        return Condition.document_regex(c["document_regex"])
    if names == {"has_id"}:
        return Condition.has_id(c["has_id"])
    if "key" in names and names <= {"key", "match", "range"}:
        bounds = None
        if (r := c.get("range")) is not None:
            if not isinstance(r, Mapping) or set(r) - {"gt", "gte", "lt", "lte"}:
                raise Invalid("a range has gt, gte, lt and lte")
            bounds = Range(**r)
        if (m := c.get("match")) is not None and (not isinstance(m, Mapping) or set(m) != {"value"}):
            raise Invalid("a match has a value")
        return Condition("field", c["key"], None if m is None else (m["value"],), bounds)
    if names and names <= {"must", "should", "must_not"}:
        return Condition.nested(Filter.from_json(c))
    raise Invalid(f"no condition has the keys {sorted(names)}")


@dataclass(frozen=True)
class QueryParams:
    exact: bool | None = None  # None: exact up to the collection's threshold
    probes: int = 0  # 0: the default
    candidate_limit: int = 0


@dataclass(frozen=True)
class Query:
    vector: tuple[float, ...]
    limit: int = 10
    filter: Filter | None = None
    payload: bool = False
    vectors: bool = False
    vector_space: str | None = None
    params: QueryParams = field(default_factory=QueryParams)

    @classmethod
    def new(cls, vector: Iterable[float], limit: int = 10) -> Query:
        return cls(tuple(vector), limit)

    @classmethod
    def exact(cls, vector: Iterable[float], limit: int = 10) -> Query:
        return cls(tuple(vector), limit, params=QueryParams(exact=True))

    @classmethod
    def approximate(cls, vector: Iterable[float], limit: int = 10) -> Query:
        return cls(tuple(vector), limit, params=QueryParams(exact=False))

    def with_filter(self, filter: Filter) -> Query:
        return replace(self, filter=filter)

    def with_payload(self) -> Query:
        return replace(self, payload=True)

    def with_vector(self) -> Query:
        return replace(self, vectors=True)

    def in_vector_space(self, name: str) -> Query:
        return replace(self, vector_space=name)

    def with_params(self, params: QueryParams) -> Query:
        return replace(self, params=params)


@dataclass(frozen=True)
class ScoredPoint:
    id: PointId
    score: float
    payload: dict | None = None
    vector: list[float] | None = None


@dataclass(frozen=True)
class QueryStats:
    mode: str
    collection_points: int
    partitions_visited: int
    candidates_discovered: int
    vectors_scored: int
    probe_limit_exhausted: bool
    candidate_limit_exhausted: bool


@dataclass(frozen=True)
class QueryResult:
    root: str
    points: list[ScoredPoint]
    stats: QueryStats


@dataclass(frozen=True)
class GetRequest:
    ids: tuple[PointId, ...] | None = None
    filter: Filter | None = None
    offset: int = 0
    limit: int | None = None
    payload: bool = False
    vectors: bool = False


@dataclass(frozen=True)
class Record:
    id: PointId
    payload: dict | None = None
    vector: list[float] | None = None


@dataclass(frozen=True)
class DeleteSelector:
    """Points of the ids or that pass the filter; at least one is given."""

    ids: tuple[PointId, ...] | None = None
    filter: Filter | None = None


@dataclass(frozen=True)
class Mutation:
    """One step of a batch: kind upsert (value: points or a table of them), delete_ids or delete_filter."""

    kind: str
    value: Any

    @classmethod
    def upsert(cls, points: Any) -> Mutation:
        return cls("upsert", (points,) if isinstance(points, Point) else points)

    @classmethod
    def delete_ids(cls, ids: Any) -> Mutation:
        """ids one by one, or a table with a column cid of their canonical bytes."""
        return cls("delete_ids", ids if hasattr(ids, "schema") else tuple(ids))

    @classmethod
    def delete_filter(cls, filter: Filter) -> Mutation:
        return cls("delete_filter", filter)


@dataclass(frozen=True)
class WriteResult:
    commit: str | None
    root: str
    affected: int


@dataclass(frozen=True)
class HistoryEntry:
    commit: str
    root: str
    parent: str | None
    message: str
    seconds: int


@dataclass(frozen=True)
class DiffResult:
    left: str
    right: str
    added: list[PointId]
    removed: list[PointId]
    changed: list[PointId]
    config_changed: bool
    index_changed: bool
    shared_bytes: int
    left_bytes: int
    right_bytes: int
    shared_objects: int
    left_objects: int
    right_objects: int


@dataclass(frozen=True)
class ValidationReport:
    root: str
    full: bool
    point_count: int
    checked_centroids: int
    valid: bool = True
