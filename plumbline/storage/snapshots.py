"""Immutable snapshots: Parquet segments by shard, and a manifest whose hash is the root.

A shard's identity is its number of rows and an order-free sum of row
hashes, so a root depends on config and points alone, not on history, order
or partitions.  A new snapshot writes the shards that changed and lists the
files of all others again.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from ..functions.ids import SHARD_BITS
from ..model import CollectionConfig, DiffResult, Filter, GetRequest, IndexConfig, Mutation, Point, Query, QueryResult, QueryStats, Record, ScoredPoint, ValidationReport, canonical_id, check_vector, id_of
from ..operators import filters, ivf, search
from ..session import ship
from ..sources import points as tables
from .files import Files, canonical

FORMAT = 2
FILE_ROWS = 1 << 20  # rows of a shard's file, about
COLUMNS = ["cid", "vector", "payload", "digest", "shard", "centroid"]
_STORED = "cid binary, vector array<float>, payload string, digest string, centroid int, shard int"


def _row_hash() -> Column:
    """SHA-256 of a row: id, vector and payload, each with its length."""
    vector = F.concat_ws(",", F.transform("vector", lambda x: x.cast("double").cast("string")))
    # -0.0 and 0.0 are equal, as vectors compare
    vector = F.regexp_replace(vector, r"-0\.0(?![0-9])", "0.0")
    return F.sha2(F.concat_ws("\x1f", F.hex("cid"), vector, F.octet_length("payload").cast("string"), "payload"), 256)


def sums(points: DataFrame) -> tuple[dict[int, tuple[int, list[str]]], dict[int, int]]:
    """By shard: rows and four sums of 60-bit parts of row hashes; by list: rows.  One pass, combined before the shuffle.

    The driver gets a row for each shard and list that occur together, at most
    64 times ivf.MOST of them.
    """
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(x) for i, x in enumerate("abcd")]
    shards: dict[int, tuple[int, list[int]]] = {}
    lists: dict[int, int] = {}
    for r in points.select("shard", "centroid", _row_hash().alias("h")).groupBy("shard", "centroid").agg(F.count("*").alias("n"), *parts).collect():
        n, own = shards.get(r["shard"], (0, [0, 0, 0, 0]))
        shards[r["shard"]] = n + r["n"], [x + int(r[k]) for x, k in zip(own, "abcd")]
        lists[r["centroid"]] = lists.get(r["centroid"], 0) + r["n"]
    return {s: (n, list(map(str, own))) for s, (n, own) in shards.items()}, lists


def _config_json(config: CollectionConfig) -> dict:
    return asdict(config)


def config_of(value: dict) -> CollectionConfig:
    return CollectionConfig(value["dimension"], value["vector_space"], IndexConfig(**value["index"]))


class Snapshot:
    """One state of a collection, read only."""

    def __init__(self, engine: SnapshotEngine, root: str, manifest: dict):
        self.engine, self.root, self.manifest = engine, root, manifest
        self.spark, self.files = engine.spark, engine.files
        self.config = config_of(manifest["config"])
        self._centroids: np.ndarray | None = None

    # tables

    def _table(self, shards: Sequence[int] | None = None) -> DataFrame:
        """Stored rows of some shards or all; only their files are listed."""
        chosen = {int(s): v for s, v in self.manifest["shards"].items() if shards is None or int(s) in shards}
        by_segment: dict[str, list[int]] = {}
        for s, v in chosen.items():
            by_segment.setdefault(v["segment"], []).append(s)
        out = self.spark.createDataFrame([], _STORED).limit(0) if not by_segment else None  # a plan without rows, that joins fall away with
        for segment, own in sorted(by_segment.items()):
            base = self.files.path(f"segments/{segment}")
            part = self.spark.read.schema(_STORED).option("basePath", base).parquet(*(f"{base}/shard={s}" for s in sorted(own)))
            out = part if out is None else out.unionByName(part)
        return out.select(COLUMNS)

    def points(self) -> DataFrame:
        """All points (cid, vector, payload, digest, shard, centroid)."""
        return self._table()

    def centroids(self) -> np.ndarray:
        """The codebook, in order."""
        if self._centroids is None:
            book = self.manifest["index"]["codebook"]
            rows = self.spark.read.parquet(self.files.path(f"codebooks/{book}")).orderBy("centroid").collect() if book else []
            self._centroids = np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), self.config.dimension)
        return self._centroids

    # reading

    @property
    def count_all(self) -> int:
        return self.manifest["count"]

    def info(self) -> dict[str, Any]:
        return {"root": self.root, "format_version": FORMAT, "point_count": self.count_all, "config": self.manifest["config"], "centroids": self.manifest["index"]["centroids"]}

    def _selected(self, ids: Iterable | None, f: Filter | None) -> DataFrame:
        if ids is None:
            return self._table().where(filters.predicate(f)) if f else self._table()
        cids = sorted({canonical_id(i) for i in ids})
        own = {hashlib.sha256(c).digest()[0] >> 8 - SHARD_BITS for c in cids}
        wanted = self.spark.createDataFrame([(bytearray(c),) for c in cids], "cid binary")
        found = self._table(sorted(own)).join(F.broadcast(wanted), "cid", "left_semi")
        return found.where(filters.predicate(f)) if f else found

    def get_table(self, request: GetRequest) -> DataFrame:
        """Points of the ids that pass the filter, in canonical order, from offset, at most limit."""
        if request.offset < 0 or (request.limit is not None and request.limit < 0):
            raise Invalid("offset and limit aren't negative")
        columns = ["cid", *(["payload"] if request.payload else []), *(["vector"] if request.vectors else [])]
        found = self._selected(request.ids, request.filter).select(columns).orderBy("cid")
        if request.offset:
            found = found.offset(request.offset)
        return found if request.limit is None else found.limit(request.limit)

    def get(self, request: GetRequest) -> list[Record]:
        rows = self.get_table(request).collect()
        return [Record(id_of(r["cid"]), json.loads(r["payload"]) if request.payload else None, list(r["vector"]) if request.vectors else None) for r in rows]

    def count(self, f: Filter | None = None) -> int:
        """From the manifest without a filter, else by a scan."""
        return self.count_all if f is None else self._table().where(filters.predicate(f)).count()

    def _check_query(self, q: Query) -> list[float]:
        if q.limit < 0 or q.params.probes < 0 or q.params.candidate_limit < 0:
            raise Invalid("limits aren't negative")
        if q.vector_space is not None and q.vector_space != self.config.vector_space:
            raise Invalid(f"the collection's vector space is {self.config.vector_space!r}")
        if q.filter:
            filters.check(q.filter)
        return check_vector(q.vector, self.config.dimension)

    def mode(self, q: Query) -> str:
        exact = q.params.exact if q.params.exact is not None else self.count_all <= self.config.index.full_scan_threshold
        return "exact" if exact else "approximate"

    def query(self, q: Query) -> QueryResult:
        return self.query_batch([q])[0]

    def query_batch(self, queries: Sequence[Query]) -> list[QueryResult]:
        """Results in the order of the queries; those that differ only in vector and limit share one pass."""
        vectors = [self._check_query(q) for q in queries]
        groups: dict[Any, list[int]] = {}
        for i, q in enumerate(queries):
            groups.setdefault((self.mode(q), repr(q.filter), q.params), []).append(i)
        out: list[QueryResult | None] = [None] * len(queries)
        for (mode, _, _), own in groups.items():
            first = queries[own[0]]
            found, stats = self._ranked([vectors[i] for i in own], max(queries[i].limit for i in own), first.filter, mode, first.params)
            payload, with_vector = any(queries[i].payload for i in own), any(queries[i].vectors for i in own)
            extra = [c for c, on in (("payload", payload), ("vector", with_vector)) if on]
            rows = found.collect()
            details = {}
            if extra and rows:  # payloads and vectors of winners only
                winners = self.spark.createDataFrame([(bytearray(c),) for c in sorted({bytes(r["cid"]) for r in rows})], "cid binary")
                shards = sorted({hashlib.sha256(bytes(r["cid"])).digest()[0] >> 8 - SHARD_BITS for r in rows})
                details = {bytes(r["cid"]): r for r in self._table(shards).join(F.broadcast(winners), "cid", "left_semi").select("cid", *extra).collect()}
            by: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
                by.setdefault(r["qid"], []).append(r)
            for place, i in enumerate(own):
                q = queries[i]
                points = []
                for r in by.get(place, [])[: q.limit]:
                    more = details.get(bytes(r["cid"]))
                    points.append(ScoredPoint(id_of(r["cid"]), float(np.float32(r["score"])), json.loads(more["payload"]) if q.payload else None, list(more["vector"]) if q.vectors else None))
                out[i] = QueryResult(self.root, points, stats[place])
        return out

    def _ranked(self, vectors: list[list[float]], k: int, f: Filter | None, mode: str, params) -> tuple[DataFrame, list[QueryStats]]:
        qids, n = list(range(len(vectors))), self.count_all
        table = self._table()
        passes = filters.predicate(f) if f else None
        if mode == "exact":
            kept = table if passes is None else table.where(passes)
            scored = n if passes is None else kept.count()
            return search.top_k(kept, qids, vectors, k), [QueryStats("exact", n, 0, n, scored, False, False)] * len(vectors)
        centroids = self.centroids()
        # all lists are open to a filtered query unless it says otherwise
        probes = params.probes or (len(centroids) if f else self.config.index.default_probes)
        # and so are all of their candidates
        limit = params.candidate_limit or (n if f and not params.probes else self.config.index.default_candidate_limit)
        totals = {int(c): m for c, m in self.manifest["index"]["rows"].items()}
        found, by = ivf.search(table, passes, centroids, totals, qids, vectors, k, probes, limit)
        return found, [QueryStats("approximate", n, by[q]["visited"], by[q]["discovered"], by[q]["scored"], by[q]["probes"], by[q]["limit"]) for q in qids]

    def checked(self, queries: DataFrame) -> DataFrame:
        """(qid, vector) of a table of queries, after one pass has seen that all vectors are valid."""
        rows = queries.select("qid", "vector")
        good = F.expr(f"vector IS NOT NULL AND size(vector) = {self.config.dimension} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
        if bad := rows.where(~F.coalesce(good, F.lit(False))).count():
            raise Invalid(f"{bad} queries have no vector of {self.config.dimension} finite components")
        return rows

    def query_table(self, queries: DataFrame, k: int, f: Filter | None = None, exact: bool = True, probes: int = 0) -> DataFrame:
        """(qid, rank, cid, score) for a table of queries (qid: long, vector) of any size, which stays on the executors.

        An approximate search reads whole lists: those that are closest, all
        of them with a filter unless ``probes`` says otherwise.  A candidate
        limit is a matter of single queries.
        """
        rows = self.checked(queries)
        points = self._table() if f is None else self._table().where(filters.predicate(f))
        if exact:
            return search.top_k_join(points, rows, k)
        centroids = self.centroids()
        return ivf.search_join(points, rows, centroids, k, probes or (len(centroids) if f else self.config.index.default_probes))

    # comparing and checking

    def diff_table(self, other: Snapshot) -> DataFrame:
        """(cid, change) of points that other added, removed or changed; shards that are equal aren't read."""
        mine, theirs = self.manifest["shards"], other.manifest["shards"]
        own = sorted(int(s) for s in mine.keys() | theirs.keys() if mine.get(s, {}).get("hash") != theirs.get(s, {}).get("hash"))
        # rows are compared by their hashes, so that no payload is shuffled
        a = self._table(own).select("cid", _row_hash().alias("a"))
        b = other._table(own).select("cid", _row_hash().alias("b"))
        both = a.join(b, "cid", "full_outer")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        return both.select("cid", change.alias("change")).where("change IS NOT NULL")

    def diff(self, other: Snapshot) -> DiffResult:
        found: dict[str, list] = {"added": [], "removed": [], "changed": []}
        for r in self.diff_table(other).orderBy("cid").collect():
            found[r["change"]].append(id_of(r["cid"]))
        a, b = self.objects(), other.objects()
        shared = a.keys() & b.keys()
        size = lambda d, keys: sum(d[k] for k in keys)
        return DiffResult(self.root, other.root, found["added"], found["removed"], found["changed"], self.manifest["config"] != other.manifest["config"], self.manifest["index"] != other.manifest["index"], size(a, shared), size(a, a.keys() - shared), size(b, b.keys() - shared), len(shared), len(a) - len(shared), len(b) - len(shared))

    def folders(self) -> list[str]:
        """Folders of data that the manifest names."""
        out = [f"segments/{v['segment']}/shard={s}" for s, v in self.manifest["shards"].items()]
        if self.manifest["index"]["codebook"]:
            out.append(f"codebooks/{self.manifest['index']['codebook']}")
        return sorted(out)

    def objects(self) -> dict[str, int]:
        """Bytes of each data file."""
        return {f: n for folder in self.folders() for f, n in self.files.sizes(folder).items()}

    def validate(self, full: bool = False) -> ValidationReport:
        """Recount and rehash every shard; with full, train and assign again too."""
        if hashlib.sha256(canonical(identity(self.manifest))).hexdigest() != self.root:
            raise Corrupt("the manifest doesn't have its root's hash")
        try:
            table = self._table()
            total = tables.check(table.select("cid", "vector", "payload"), self.config.dimension)
            found, lists = sums(tables.with_place(table))
            actual = {str(s): v for s, v in found.items()}
        except Invalid as error:
            raise Corrupt(str(error)) from None
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error) or "FAILED_READ_FILE" in str(error):
                raise Corrupt("a data file is missing or can't be read") from error
            raise
        expected = {s: (v["count"], v["hash"]) for s, v in self.manifest["shards"].items()}
        if total != self.count_all or actual != expected:
            raise Corrupt("stored points don't match the manifest")
        rows = {str(c): n for c, n in lists.items()}
        if rows != self.manifest["index"]["rows"]:
            raise Corrupt("lists of the index don't match the manifest")
        if full:
            n = ivf.centroid_count(self.count_all)
            mark, sample = self.engine._sample(tables.with_place(table.drop("digest", "shard")), n, self.config.dimension)
            book = ivf.train(sample, n)
            if mark != self.manifest["index"]["sample"] or not np.array_equal(book, self.centroids()):
                raise Corrupt("the codebook doesn't come from these points")
            if ivf.assign(table, book, "again").where("again != centroid").limit(1).count():
                raise Corrupt("points aren't in the lists of their centroids")
        return ValidationReport(self.root, full, total, len(self.centroids()) if full else 0)

    def materialize(self, target: str) -> None:
        """Write the snapshot by itself to a folder that doesn't exist, by way of a draft."""
        parent, _, name = target.rstrip("/").rpartition("/")
        home = Files(self.spark, parent or "/")
        if home.exists(name):
            raise Invalid(f"{target} exists")
        draft = f"{name}.{uuid.uuid4().hex}.part"
        out = Files(self.spark, f"{home.root}/{draft}")
        for folder in self.folders():
            self.files.copy(folder, out)
        out.create("root.json", canonical(self.manifest))
        if not home.rename(draft, name):
            home.delete(draft)
            raise Invalid(f"{target} exists")

    def apply(self, mutations: Iterable[Mutation]) -> Snapshot:
        return self.engine.apply(self.root, mutations)

    @staticmethod
    def open_directory(spark: SparkSession, path: str) -> Snapshot:
        """A materialized snapshot, read where it lies."""
        engine = SnapshotEngine(spark, path)
        manifest = engine.files.read_json("root.json")
        if manifest is None:
            raise Invalid(f"no snapshot at {path}")
        root = hashlib.sha256(canonical(identity(manifest))).hexdigest()
        return Snapshot(engine, root, manifest)


def identity(manifest: dict) -> dict:
    """What a root is the hash of: everything but where files lie."""
    return {
        "format": manifest["format"],
        "config": manifest["config"],
        "count": manifest["count"],
        "shards": {s: [v["count"], v["hash"]] for s, v in manifest["shards"].items()},
        "index": {k: manifest["index"][k] for k in ("centroids", "sample", "rows")},
    }


class SnapshotEngine:
    """Builds and opens snapshots in one folder, without names or history."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.files = spark, Files(spark, path)
        self._opened: dict[str, Snapshot] = {}

    @classmethod
    def init(cls, spark: SparkSession, path: str) -> SnapshotEngine:
        engine = cls(spark, path)
        engine.files.create("format.json", canonical({"format": FORMAT}))
        return engine

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SnapshotEngine:
        engine = cls(spark, path)
        if (found := engine.files.read_json("format.json")) is None:
            raise Invalid(f"no database at {path}")
        if found != {"format": FORMAT}:
            raise Corrupt(f"format {found}")
        return engine

    @classmethod
    def ephemeral(cls, spark: SparkSession) -> SnapshotEngine:
        """In a temporary folder that goes with the engine, for one machine."""
        folder = tempfile.TemporaryDirectory(prefix="plumbline-")
        engine = cls.init(spark, folder.name)
        engine._folder = folder
        return engine

    def _points(self, points: Any, dimension: int) -> DataFrame:
        table = points.select("cid", "vector", "payload") if isinstance(points, DataFrame) else tables.from_points(self.spark, points, dimension)
        return table

    def build(self, config: CollectionConfig, points: Any = ()) -> Snapshot:
        """A snapshot of points, given one by one or as a table of points; ids come once."""
        config.check()
        table = self._points(points, config.dimension)
        count = tables.check(table, config.dimension)
        return self._write(config, tables.with_place(table), count, None, None)

    def _sample(self, placed: DataFrame, centroids: int, dimension: int) -> tuple[str, np.ndarray]:
        """The training vectors, at most ivf.SAMPLE, and a hash of them, their ids and the number of centroids."""
        rows = ivf.training_sample(placed).collect()
        vectors = np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), dimension)
        # -0.0 equals 0.0, so adding 0 makes their bytes equal
        ids = b"".join(len(r["cid"]).to_bytes(8, "big") + bytes(r["cid"]) for r in rows)
        return hashlib.sha256(ids + (vectors + np.float32(0)).tobytes() + centroids.to_bytes(8, "big")).hexdigest(), vectors

    def _write(self, config: CollectionConfig, placed: DataFrame, count: int, before: Snapshot | None, touched: set[int] | None) -> Snapshot:
        """Write the shards of placed that changed.  placed: cid, vector, payload, digest, shard (and centroid, null where not known)."""
        centroids = ivf.centroid_count(count)
        old = before.manifest["index"] if before else None
        mark, sample = self._sample(placed, centroids, config.dimension)
        stable = old is not None and old["sample"] == mark and old["centroids"] == centroids
        book = before.centroids() if stable else ivf.train(sample, centroids)
        write = touched if stable and touched is not None else None
        if stable and "centroid" in placed.columns:
            known = placed.where("centroid IS NOT NULL")
            fresh = ivf.assign(placed.where("centroid IS NULL").drop("centroid"), book)
            assigned = known.unionByName(fresh)
        else:
            assigned = ivf.assign(placed.drop("centroid"), book)
        if write is not None:
            assigned = assigned.where(F.col("shard").isin(sorted(write))) if write else assigned.where("false")
        segment = uuid.uuid4().hex
        # sorted by list, so that row groups of other lists are skipped
        # a shard is one file until its rows are many
        files = -(-count // (FILE_ROWS << SHARD_BITS))
        out = assigned.select(COLUMNS)
        out = out.repartition("shard") if files < 2 else out.repartition(files << SHARD_BITS, "shard", F.pmod(F.xxhash64("cid"), F.lit(files)))
        out = out.sortWithinPartitions("shard", "centroid", "cid")
        out.write.option("compression", "zstd").partitionBy("shard").parquet(self.files.path(f"segments/{segment}"))
        written = self.spark.read.schema(_STORED).parquet(self.files.path(f"segments/{segment}"))
        found, lists = sums(written)
        shards = {str(s): {"count": n, "hash": own, "segment": segment} for s, (n, own) in found.items()}
        if write is not None:
            kept = {s: v for s, v in before.manifest["shards"].items() if int(s) not in write}
            shards |= kept
            if kept:  # their rows of each list, which no one has counted
                rest = before._table([int(s) for s in kept]).groupBy("centroid").agg(F.count("*").alias("n")).collect()
                for r in rest:
                    lists[r["centroid"]] = lists.get(r["centroid"], 0) + r["n"]
        name = None
        if len(book):
            name = hashlib.sha256((book + np.float32(0)).tobytes()).hexdigest()
            if not self.files.exists(f"codebooks/{name}/_SUCCESS"):
                self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "centroid int, vector array<float>").coalesce(1).write.mode("overwrite").parquet(self.files.path(f"codebooks/{name}"))
        manifest = {"format": FORMAT, "config": _config_json(config), "count": count, "shards": shards, "index": {"centroids": centroids, "sample": mark, "codebook": name, "rows": {str(c): n for c, n in lists.items()}}}
        root = hashlib.sha256(canonical(identity(manifest))).hexdigest()
        if not self.files.create(f"roots/{root}.json", canonical(manifest)):
            # the same state was written before: its files serve, ours go
            self.files.delete(f"segments/{segment}")
            self._opened.pop(root, None)
            return self.open_snapshot(root)
        return Snapshot(self, root, manifest)

    def open_snapshot(self, root: str) -> Snapshot:
        if root not in self._opened:
            manifest = self.files.read_json(f"roots/{root}.json")
            if manifest is None:
                raise Invalid(f"no snapshot has the root {root}")
            self._opened[root] = Snapshot(self, root, manifest)
        return self._opened[root]

    def apply(self, previous: str, mutations: Iterable[Mutation]) -> Snapshot:
        """The snapshot after an ordered batch; each step sees what those before it left.

        Points that end as they were are no change, and without a change the
        root stays.  Without a filter among the steps only the shards of the
        ids in the batch are read.
        """
        drafts: list[str] = []
        try:
            return self._apply(self.open_snapshot(previous), list(mutations), drafts)
        finally:
            for name in drafts:
                self.files.delete(name)

    def _apply(self, before: Snapshot, steps: list[Mutation], drafts: list[str]) -> Snapshot:
        config = before.config
        upserts, shards, everything = [], set(), False
        folded: list[tuple[str, Any]] = []
        shard_of = lambda c: hashlib.sha256(c).digest()[0] >> 8 - SHARD_BITS
        for m in steps:
            if m.kind == "upsert":
                table = self._points(m.value, config.dimension)
                if isinstance(m.value, DataFrame):
                    # what may be dear to compute is read several times
                    drafts.append(f"drafts/{uuid.uuid4().hex}")
                    table.write.option("compression", "zstd").parquet(self.files.path(drafts[-1]))
                    table = self.spark.read.schema(table.schema).parquet(self.files.path(drafts[-1]))
                upserts.append(table)
                folded.append(("upsert", tables.with_place(table)))
            elif m.kind == "delete_ids" and isinstance(m.value, DataFrame):
                table = tables.with_place(m.value.select("cid").where("cid IS NOT NULL").distinct())
                shards |= {r["shard"] for r in table.select("shard").distinct().collect()}
                folded.append(("delete_table", table))
            elif m.kind == "delete_ids":
                cids = [canonical_id(i) for i in m.value]
                if not cids:
                    raise Invalid("a list of ids has at least one")
                shards |= {shard_of(c) for c in cids}
                folded.append(("delete", self.spark.createDataFrame([(bytearray(c),) for c in sorted(set(cids))], "cid binary")))
            elif m.kind == "delete_filter":
                everything = True
                folded.append(("filter", filters.predicate(m.value)))
            else:
                raise Invalid(f"no mutation is called {m.kind!r}")
        if upserts:
            every = upserts[0]
            for t in upserts[1:]:
                every = every.union(t)
            shards |= tables.check_and_place(every, config.dimension)[1]
        start = before._table() if everything else before._table(sorted(shards))
        state = start.withColumn("kept", F.lit(True))
        for kind, value in folded:
            if kind == "upsert":
                put = value.withColumn("centroid", F.lit(None).cast("int")).withColumn("kept", F.lit(False))
                state = state.join(value.select("cid"), "cid", "left_anti").unionByName(put)
            elif kind == "delete_table":
                state = state.join(value.select("cid"), "cid", "left_anti")
            elif kind == "delete":
                state = state.join(F.broadcast(value), "cid", "left_anti")
            else:
                state = state.where(~value)

        def draft(table: DataFrame) -> DataFrame:
            drafts.append(f"drafts/{uuid.uuid4().hex}")
            table.write.option("compression", "zstd").parquet(self.files.path(drafts[-1]))
            return self.spark.read.schema(table.schema).parquet(self.files.path(drafts[-1]))

        if before.count_all:
            # rows that stay are as they were: only those put in are compared, by their hashes
            state = draft(state)
            now = state.select("cid", "kept", F.col("shard").alias("s"), F.when(~F.col("kept"), _row_hash()).alias("h"))
            was = start.select("cid", F.col("shard").alias("sa"), F.col("centroid").alias("ca"), _row_hash().alias("ha") if upserts else F.lit("").alias("ha"))
            # an upsert of what is there already keeps its list
            marks = draft(now.join(was, "cid", "full_outer").where(~F.coalesce("kept", F.lit(False))).select("cid", F.coalesce("s", "sa").alias("s"), F.col("sa").isNull().alias("added"), F.col("s").isNull().alias("removed"), F.coalesce(F.col("h") == F.col("ha"), F.lit(False)).alias("same"), "ca"))
            change = marks.where("NOT same").groupBy("s").agg(F.count_if("added").alias("added"), F.count_if("removed").alias("removed")).collect()
            put = state.where("NOT kept").drop("centroid").join(marks.where("NOT removed").select("cid", F.when(F.col("same"), F.col("ca")).alias("centroid")), "cid")
            kept = state.where("kept").unionByName(put).select(COLUMNS)
        else:
            # the upserts' drafts are read again, there is nothing to compare them with
            change = state.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("added"), F.lit(0).alias("removed")).collect()
            kept = state.select(COLUMNS)
        touched = {r["s"] for r in change}
        if not touched:
            return before
        count = before.count_all + sum(r["added"] - r["removed"] for r in change)
        if not everything:
            others = [int(s) for s in before.manifest["shards"] if int(s) not in shards]
            kept = kept.unionByName(before._table(others))
        return self._write(config, kept, count, before, touched)

    def import_directory(self, path: str) -> Snapshot:
        """Take in a materialized snapshot after checking all of it; the root is the same."""
        source = Snapshot.open_directory(self.spark, path)
        source.validate(full=True)
        for folder in source.folders():
            source.files.copy(folder, self.files)
        self.files.create(f"roots/{source.root}.json", canonical(source.manifest))
        return self.open_snapshot(source.root)

    def build_directory(self, path: str, config: CollectionConfig, points: Any = ()) -> Snapshot:
        self.build(config, points).materialize(path)
        return Snapshot.open_directory(self.spark, path)

    def query(self, root: str, q: Query) -> QueryResult:
        return self.open_snapshot(root).query(q)

    def get(self, root: str, request: GetRequest) -> list[Record]:
        return self.open_snapshot(root).get(request)

    def count(self, root: str, f: Filter | None = None) -> int:
        return self.open_snapshot(root).count(f)

    def validate(self, root: str, full: bool = False) -> ValidationReport:
        return self.open_snapshot(root).validate(full)
