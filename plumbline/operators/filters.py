"""Filters as boolean columns.

Two-valued: a leaf on a missing path is false, so its negation is true.
Nothing is cast: numbers compare with numbers as doubles, and all other
scalars only with their own kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid
from ..functions.patterns import check_pattern, java_pattern
from ..model import Condition, Filter, Range, canonical_id

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"

def check(f: Filter) -> None:
    """Refuse a filter that can't mean anything, before any plan is made."""
    for c in (*f.must, *f.should, *f.must_not):
        if c.kind in ("exists", "is_in", "not_in", "contains", "field"):
            if not isinstance(c.key, str) or not all(c.key.split(".")):
                raise Invalid(f"a path's steps have names, {c.key!r} doesn't")
        if c.kind in ("is_in", "not_in"):
            if not c.value:
                raise Invalid("a list of values has at least one")
            for v in c.value:
                _scalar(v)
        elif c.kind == "contains":
            _scalar(c.value)
        elif c.kind == "field":
            if c.value is None and c.range_ is None:
                raise Invalid("a field's condition has a value or a range")
            if c.value is not None:
                _scalar(c.value[0])
            for bound in (c.range_.gt, c.range_.gte, c.range_.lt, c.range_.lte) if c.range_ else ():
                if bound is not None and (isinstance(bound, bool) or not isinstance(bound, (int, float)) or math.isnan(bound)):
                    raise Invalid("bounds are numbers")
        elif c.kind == "document_contains":
            if not c.value:
                raise Invalid("a substring has at least one character")
        elif c.kind == "document_regex":
            check_pattern(c.value)
        elif c.kind == "has_id":
            if not c.value:
                raise Invalid("a list of ids has at least one")
            for i in c.value:
                canonical_id(i)
        elif c.kind == "nested":
            check(c.value)
        elif c.kind != "exists":
            raise Invalid(f"no condition is called {c.kind!r}")


def _scalar(v: Any) -> None:
    if isinstance(v, (list, tuple, dict)):
        raise Invalid("only scalars are compared")
    if isinstance(v, float) and not math.isfinite(v):
        raise Invalid("only finite numbers are compared")


def _json_path(key: str) -> str:
    return "$" + "".join('["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]' for s in key.split("."))


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _double(x: Column) -> Column:
    """The number, or null if x isn't one."""
    return F.when(_kind(x).rlike(_NUMBER), F.try_variant_get(x, "$", "double"))


def _equal(x: Column, v: Any) -> Column:
    if v is None:
        return F.is_variant_null(x)
    if isinstance(v, bool):
        return (_kind(x) == "BOOLEAN") & (F.when(_kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")) == F.lit(v))
    if isinstance(v, (int, float)):
        return _double(x) == F.lit(float(v))
    if isinstance(v, str):
        return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")) == F.lit(v)
    raise Invalid(f"{v!r} isn't a scalar")


def _any(parts: Iterable[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | _false(p)
    return out


def _in_range(x: Column, r: Range) -> Column:
    number = _double(x)
    out = number.isNotNull()
    for bound, test in ((r.gt, number.__gt__), (r.gte, number.__ge__), (r.lt, number.__lt__), (r.lte, number.__le__)):
        if bound is not None:
            out = out & test(F.lit(float(bound)))
    return out


def _condition(c: Condition, v: Column, cid: Column) -> Column:
    if c.kind == "nested":
        return compile_filter(c.value, v, cid)
    if c.kind == "has_id":
        return _any([cid.isin([bytearray(canonical_id(i)) for i in c.value])])
    if c.kind in ("document_contains", "document_regex"):
        document = F.variant_get(v, '$["document"]', "variant")
        text = F.when(_kind(document) == "STRING", F.try_variant_get(document, "$", "string"))
        return _false(text.contains(F.lit(c.value)) if c.kind == "document_contains" else text.rlike(java_pattern(c.value)))
    x = F.try_variant_get(v, _json_path(c.key), "variant")
    if c.kind == "exists":
        return x.isNotNull()
    if c.kind == "is_in":
        return _any(_equal(x, w) for w in c.value)
    if c.kind == "not_in":
        return x.isNotNull() & ~_any(_equal(x, w) for w in c.value)
    if c.kind == "contains":
        members = F.when(_kind(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))
        return _false(F.exists(members, lambda e: _false(_equal(e, c.value))))
    out = F.lit(True)
    if c.value is not None:
        out = out & _false(_equal(x, c.value[0]))
    if c.range_ is not None:
        out = out & _false(_in_range(x, c.range_))
    return out


def compile_filter(f: Filter, v: Column, cid: Column) -> Column:
    """A boolean, never null, of a VARIANT payload and the canonical id."""
    out = F.lit(True)
    for c in f.must:
        out = out & _condition(c, v, cid)
    for c in f.must_not:
        out = out & ~_condition(c, v, cid)
    if f.should:
        any_ = F.lit(False)
        for c in f.should:
            any_ = any_ | _condition(c, v, cid)
        out = out & any_
    return out


def predicate(f: Filter | None) -> Column:
    """The filter as a column of a table of points (payload: JSON text, cid: binary)."""
    if f is None:
        return F.lit(True)
    check(f)
    return compile_filter(f, F.parse_json("payload"), F.col("cid"))


_BOUNDS = {"$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}


def from_where(where: Mapping[str, Any]) -> Filter:
    """A ``where`` object of operators: $and, $or, $eq, $in, $nin, $contains, bounds, and bare values.

    Branches of $or are nested whole, and all operators of a key hold.
    """
    if not isinstance(where, Mapping) or not where:
        raise Invalid("where is an object with at least one key")
    must: list[Condition] = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise Invalid(f"{key} has a list of at least one object")
            inner = tuple(Condition.nested(from_where(w)) for w in value)
            must.append(Condition.nested(Filter(must=inner) if key == "$and" else Filter(should=inner)))
        elif key.startswith("$"):
            raise Invalid(f"no operator is called {key}")
        elif isinstance(value, Mapping):
            bounds = {}
            for name, operand in value.items():
                if name == "$eq":
                    must.append(Condition.matches(key, operand))
                elif name == "$ne":
                    must.append(Condition.nested(Filter(must_not=(Condition.matches(key, operand),))))
                elif name in ("$in", "$nin"):
                    must.append((Condition.is_in if name == "$in" else Condition.not_in)(key, operand))
                elif name == "$contains":
                    must.append(Condition.contains(key, operand))
                elif name in _BOUNDS:
                    bounds[_BOUNDS[name]] = operand
                else:
                    raise Invalid(f"no operator is called {name}")
            if bounds:
                must.append(Condition.range(key, Range(**bounds)))
            if not value:
                raise Invalid(f"{key} has no operator")
        else:
            must.append(Condition.matches(key, value))
    return Filter(must=tuple(must))


def from_where_document(where: Mapping[str, Any]) -> Filter:
    """A ``where_document`` object: $contains or $regex, with $and and $or."""
    must: list[Condition] = []
    for key, value in where.items():
        if key == "$contains":
            must.append(Condition.document_contains(value))
        elif key == "$regex":
            must.append(Condition.document_regex(value))
        elif key in ("$and", "$or"):
            inner = tuple(Condition.nested(from_where_document(w)) for w in value)
            must.append(Condition.nested(Filter(must=inner) if key == "$and" else Filter(should=inner)))
        else:
            raise Invalid(f"no operator is called {key}")
    if not must:
        raise Invalid("where_document has at least one operator")
    return Filter(must=tuple(must))
