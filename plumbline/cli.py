"""The command line: python -m plumbline.cli --db PATH COMMAND ..., JSON in and out."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import Invalid, VectorStoreError
from .model import CollectionConfig, DeleteSelector, Filter, GetRequest, IndexConfig, Point, Query, QueryParams
from .sources import jsonl, trees
from .storage.database import Database
from .storage.store import Store
from .storage.text import HashingEmbedder, TextCollection, TextQuery

COMMANDS = ("init", "collection", "upsert", "get", "delete", "count", "search", "query", "index", "history", "restore", "push", "pull", "diff", "validate", "doctor", "completions")


def parse_id(text: str) -> str | int:
    """An id as JSON if it is a string or a whole number there, else the text itself."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return value if isinstance(value, (str, int)) and not isinstance(value, bool) else text


def parse_vector(text: str) -> list[float]:
    """A file's vector, a JSON array, or numbers between commas."""
    if os.path.exists(text):
        with open(text) as f:
            text = f.read()
    try:
        value = json.loads(text)
    except ValueError:
        try:
            return [float(x) for x in text.split(",")]
        except ValueError:
            raise Invalid(f"{text!r} isn't a vector") from None
    if isinstance(value, dict):
        value = value.get("vector")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = [value]
    if not isinstance(value, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
        raise Invalid("a vector is an array of numbers")
    return value


def parse_json(text: str) -> Any:
    """JSON from standard input (-), a file, or the text itself."""
    if text == "-":
        text = sys.stdin.read()
    elif os.path.exists(text):
        with open(text) as f:
            text = f.read()
    try:
        return json.loads(text)
    except ValueError as error:
        raise Invalid(f"not JSON: {error}") from None


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    top.add_argument("--db", default=".plumbline")
    top.add_argument("--format", choices=("json", "pretty", "jsonl"), default="json")
    subs = top.add_subparsers(dest="command", required=True)

    def command(name: str, *words: str, **kw):
        p = subs.add_parser(name, **kw)
        for w in words:
            p.add_argument(w)
        return p

    command("init", "path").add_argument("--bare", action="store_true")
    inner = command("collection").add_subparsers(dest="action", required=True)
    p = inner.add_parser("create")
    p.add_argument("name")
    p.add_argument("--dimension", type=int, required=True)
    p.add_argument("--distance", choices=("cosine",), default="cosine")
    p.add_argument("--vector-space")
    for flag, default in (("full-scan-threshold", 1000), ("default-probes", 96), ("default-candidate-limit", 10_000)):
        p.add_argument(f"--{flag}", type=int, default=default)
    inner.add_parser("list")
    p = inner.add_parser("info")
    p.add_argument("name")
    p.add_argument("--at")
    inner.add_parser("delete").add_argument("name")
    p = command("upsert", "collection")
    p.add_argument("input", nargs="?")
    for flag in ("--id", "--vector", "--payload", "--expect-root"):
        p.add_argument(flag)
    p.add_argument("--batch-size", type=int)
    p.add_argument("--progress", action="store_true")
    p = command("get", "collection")
    p.add_argument("--ids", nargs="+")
    p.add_argument("--filter")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--with-payload", action="store_true")
    p.add_argument("--with-vector", action="store_true")
    p.add_argument("--at")
    p = command("delete", "collection")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--ids", nargs="+")
    one.add_argument("--filter")
    p.add_argument("--expect-root")
    p = command("count", "collection")
    p.add_argument("--filter")
    p.add_argument("--at")
    p = command("search", "collection", aliases=["query"])
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--vector")
    one.add_argument("--text")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--filter")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--exact", action="store_true")
    one.add_argument("--approximate", action="store_true")
    p.add_argument("--probes", type=int, default=0)
    p.add_argument("--candidate-limit", type=int, default=0)
    p.add_argument("--with-payload", action="store_true")
    p.add_argument("--with-vector", action="store_true")
    p.add_argument("--expected-vector-space")
    p.add_argument("--at")
    p = command("index", "collection")
    p.add_argument("paths", nargs="+")
    p.add_argument("--chunk-chars", type=int, default=2000)
    p.add_argument("--dimension", type=int, default=64)
    command("history", "collection").add_argument("--limit", type=int, default=20)
    command("restore", "collection", "revision")
    command("push", "collection", "remote")
    command("pull", "collection", "remote")
    command("diff", "collection", "left", "right")
    p = command("validate", "collection")
    p.add_argument("--at")
    p.add_argument("--full", action="store_true")
    command("doctor")
    command("completions").add_argument("shell", choices=("bash",), nargs="?", default="bash")
    return top


def _hits(points, a) -> list[dict]:
    return [{"id": p.id, "score": p.score} | ({"payload": p.payload} if a.with_payload else {}) | ({"vector": p.vector} if a.with_vector else {}) for p in points]


def run(a: argparse.Namespace, spark: SparkSession) -> Any:
    """What a parsed command answers."""
    filter_ = Filter.from_json(parse_json(a.filter)) if getattr(a, "filter", None) else None
    if a.command == "init":
        return {"repository": a.path, "bare": a.bare, "collections": Database.init(spark, a.path).list_collections()}
    if a.command == "upsert":
        handle = Store.open(spark, a.db).collection(a.collection)
        if (a.id is None) != (a.vector is None) or (a.input is None) == (a.id is None):
            raise Invalid("an upsert has either a file or an id with a vector")
        if a.id is not None:
            payload = parse_json(a.payload) if a.payload else {}
            point = Point(parse_id(a.id), tuple(parse_vector(a.vector)), payload)
            if a.expect_root:
                return asdict(handle.advanced().upsert_expect([point], a.expect_root))
            return asdict(handle.upsert([point]))
        path = a.input
        if path == "-":
            import tempfile

            with tempfile.NamedTemporaryFile("w", suffix=".jsonl", delete=False) as f:
                f.write(sys.stdin.read())
            path = f.name
        said = (lambda i, n: print(f"batch {i} of {n}", file=sys.stderr)) if a.progress else None
        try:
            done = jsonl.import_points(handle, path, a.batch_size, a.expect_root, said)
        finally:
            if a.input == "-":
                os.unlink(path)
        return asdict(done[-1]) | {"affected": sum(r.affected for r in done), "batches": len(done)}
    if a.command == "index":
        texts = Store.open(spark, a.db).text_collection(a.collection, HashingEmbedder(a.dimension))
        files = reduce(DataFrame.union, (trees.files(spark, p) for p in a.paths)).dropDuplicates(["source"])
        n, chunks, _ = texts.sync_files(files, a.chunk_chars)
        return {"collection": a.collection, "files": n, "chunks": chunks, "root": texts.vectors().root()}
    if a.command == "pull":
        return {"collection": a.collection, "received": Database.init(spark, a.db).pull(a.collection, a.remote)}
    database = Database.open(spark, a.db)
    if a.command == "collection":
        if a.action == "create":
            index = IndexConfig(a.full_scan_threshold, a.default_probes, a.default_candidate_limit)
            return database.create_collection(a.name, CollectionConfig(a.dimension, a.vector_space, index)).info()
        if a.action == "list":
            return {"collections": database.list_collections()}
        if a.action == "delete":
            return {"deleted": a.name, "root": database.delete_collection(a.name)}
        found = database.collection(a.name)
        return (found.at(a.at) if a.at else found).info()
    if a.command == "doctor":
        return database.doctor()
    if a.command == "push":
        return {"collection": a.collection, "sent": database.push(a.collection, a.remote)}
    found = database.collection(a.collection)
    if getattr(a, "at", None):
        found = found.at(a.at)
    if a.command == "get":
        rows = found.get(GetRequest(tuple(map(parse_id, a.ids)) if a.ids else None, filter_, a.offset, a.limit, a.with_payload, a.with_vector))
        return {"root": found.root(), "points": [{"id": r.id} | ({"payload": r.payload} if a.with_payload else {}) | ({"vector": r.vector} if a.with_vector else {}) for r in rows]}
    if a.command == "delete":
        return asdict(found.delete_expect(DeleteSelector(tuple(map(parse_id, a.ids)) if a.ids else None, filter_), a.expect_root))
    if a.command == "count":
        return {"root": found.root(), "count": found.count(filter_)}
    if a.command in ("search", "query"):
        params = QueryParams(True if a.exact else False if a.approximate else None, a.probes, a.candidate_limit)
        if a.text is not None:
            if a.at or a.with_vector or a.expected_vector_space:
                raise Invalid("a search by text has no --at, --with-vector or --expected-vector-space")
            handle = Store(database).collection(a.collection)
            texts = TextCollection(handle, HashingEmbedder(found.snapshot().config.dimension))
            return {"root": found.root(), "points": [asdict(h) for h in texts.query(TextQuery(a.text, a.limit, filter_, params))]}
        r = found.query(Query(tuple(parse_vector(a.vector)), a.limit, filter_, a.with_payload, a.with_vector, a.expected_vector_space, params))
        return {"root": r.root, "points": _hits(r.points, a), "stats": asdict(r.stats)}
    if a.command == "history":
        return {"history": [asdict(e) for e in found.history(a.limit)]}
    if a.command == "restore":
        return asdict(found.restore(a.revision))
    if a.command == "diff":
        return asdict(found.diff(a.left, a.right))
    return asdict(found.validate(a.full))


_LISTS = ("points", "history", "collections", "added")


def rendered(value: Any, form: str) -> str:
    if form == "pretty":
        return json.dumps(value, indent=2, ensure_ascii=False)
    if form == "jsonl":
        main = next((value[k] for k in _LISTS if isinstance(value.get(k), list)), [value])
        return "\n".join(json.dumps(x, ensure_ascii=False) for x in main)
    return json.dumps(value, ensure_ascii=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "completions":
        print(f"complete -W '{' '.join(COMMANDS)}' plumbline")
        return 0
    try:
        print(rendered(run(a, spark or SparkSession.builder.appName("plumbline").getOrCreate()), a.format))
        return 0
    except VectorStoreError as error:
        print(f"plumbline: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
