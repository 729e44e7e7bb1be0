"""Registered queries of collections, their history, batches, counters and texts, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Invalid
from ..functions.chunks import chunked
from ..model import CollectionConfig, Condition, DeleteSelector, Filter, GetRequest, Mutation, Query, QueryParams
from ..operators import filters, lsh
from ..session import shared_folder
from ..sources import jsonl
from ..sources.points import from_table
from ..storage.database import Collection, Database
from ..storage.older import OlderIndex
from ..storage.snapshots import Snapshot, SnapshotEngine
from ..storage.store import Store
from ..storage.text import Document, HashingEmbedder
from . import queries as core
from .queries import K, _documents, _hits, _ORIGINAL, _queries, _register, _snapshot, _state, _STATE, _table, _top_sql, _uint, points

_LABEL = lambda *labels: Filter(must=(Condition.is_in("label", list(labels)),))


def _collection(spark: SparkSession, sf: str) -> Collection:
    """A collection of all embeddings."""
    made = Database.init(spark, shared_folder(spark, "database")).create_collection("points", CollectionConfig(64))
    made.upsert(points(spark, sf))
    return made


# searches, their budgets and counters


def _asked(spark: SparkSession, sf: str) -> list[tuple[int, tuple[float, ...]]]:
    """The query set of single searches: rows whose id is a multiple of 50."""
    return [(r["qid"], tuple(r["vector"])) for r in _queries(spark, sf).where("qid % 50 = 0").orderBy("qid").collect()]


def _searched(s: Snapshot, asked: list, f: Filter | None, params: QueryParams) -> list:
    return s.query_batch([Query(v, K, f, payload=True, params=params) for _, v in asked])


@_register(f"""
SELECT qid, rank, h.vec_id AS id, round(score, 6) AS score, e.label::BIGINT AS label FROM ({_top_sql("q.vec_id % 50 = 0 AND p.label <> 7", "score::FLOAT::DOUBLE")}) h JOIN embeddings e USING (vec_id)""")
def store_query(spark, sf):
    """Single searches in one batch, with payloads and scores of 32 bits."""
    asked = _asked(spark, sf)
    found = _searched(_snapshot(spark, sf), asked, Filter(must_not=(Condition.matches("label", 7),)), QueryParams(True))
    rows = [(q, i + 1, p.id, round(p.score, 6), p.payload["label"]) for (q, _), r in zip(asked, found) for i, p in enumerate(r.points)]
    return spark.createDataFrame(rows, "qid long, rank long, id long, score double, label long")


_STATS = "qid long, mode string, points long, discovered long, scored long, probes_exhausted boolean, limit_exhausted boolean"


def _stats(spark: SparkSession, asked: list, found: list) -> DataFrame:
    rows = [(q, s.mode, s.collection_points, s.candidates_discovered, s.vectors_scored, s.probe_limit_exhausted, s.candidate_limit_exhausted) for (q, _), s in zip(asked, (r.stats for r in found))]
    return spark.createDataFrame(rows, _STATS)


@_register("""
SELECT vec_id AS qid, 'exact' AS mode, (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM embeddings) AS discovered,
  (SELECT count(*) FROM embeddings WHERE label IN (1, 2)) AS scored, false AS probes_exhausted, false AS limit_exhausted FROM embeddings WHERE vec_id % 50 = 0""")
def exact_stats(spark, sf):
    asked = _asked(spark, sf)
    return _stats(spark, asked, _searched(_snapshot(spark, sf), asked, _LABEL(1, 2), QueryParams(True)))


@_register("""
SELECT vec_id AS qid, 'approximate' AS mode, (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM embeddings) AS discovered,
  (SELECT count(*) FROM embeddings WHERE label IN (1, 2)) AS scored, false AS probes_exhausted, false AS limit_exhausted FROM embeddings WHERE vec_id % 50 = 0""")
def approximate_stats(spark, sf):
    """With a filter all lists are read, so all of the eligible are scored."""
    asked = _asked(spark, sf)
    return _stats(spark, asked, _searched(_snapshot(spark, sf), asked, _LABEL(1, 2), QueryParams(False)))


@_register("""
SELECT vec_id AS qid, 'approximate' AS mode, (SELECT count(*) FROM embeddings) AS points, least(20, n) AS scored, n > 20 AS limit_exhausted
FROM embeddings, (SELECT count(*) AS n FROM embeddings WHERE label = 4) WHERE vec_id % 50 = 0""")
def candidate_limit(spark, sf):
    asked = _asked(spark, sf)
    found = _stats(spark, asked, _searched(_snapshot(spark, sf), asked, _LABEL(4), QueryParams(False, 0, 20)))
    return found.select("qid", "mode", "points", "scored", "limit_exhausted")


@_register(_top_sql("p.label IN (1, 2)"))
def query_table_filtered(spark, sf):
    """A table of queries against a snapshot; nothing but the codebook is on the driver."""
    found = _snapshot(spark, sf).query_table(_queries(spark, sf), K, _LABEL(1, 2), exact=False)
    return _hits(found)


@_register("SELECT greatest(1, count(*))::BIGINT AS queries, true AS in_budget, true AS own_first FROM embeddings WHERE vec_id % 50 = 0")
def probe_budget(spark, sf):
    """Searches of four lists: at most so many are visited, and each point finds itself first."""
    asked = _asked(spark, sf)
    found = _searched(_snapshot(spark, sf), asked, None, QueryParams(False, 4))
    inside = all(r.stats.partitions_visited <= 4 and r.stats.probe_limit_exhausted for r in found)
    return spark.createDataFrame([(len(found), inside, all(r.points[0].id == q for (q, _), r in zip(asked, found)))], "queries long, in_budget boolean, own_first boolean")


# writing and history


@_register(f"SELECT * FROM ({_ORIGINAL}) WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE label = 6 OR vec_id IN (1, 2, 3))")
def delete_selector(spark, sf):
    c = _collection(spark, sf)
    c.delete(DeleteSelector(ids=(1, 2, 3, 10**15), filter=_LABEL(6)))
    return _state(c.snapshot())


@_register("SELECT (SELECT count(*) FROM embeddings WHERE label = 6 OR vec_id IN (1, 2, 3)) AS deleted, (SELECT count(*) FROM embeddings) AS put")
def affected_counts(spark, sf):
    c = Store.open(spark, shared_folder(spark, "database")).collection("first.write")
    put = c.upsert(points(spark, sf))
    gone = c.delete(DeleteSelector(ids=(1, 2, 3, 10**15), filter=_LABEL(6)))
    return spark.createDataFrame([(gone.affected, put.affected)], "deleted long, put long")


@_register(_ORIGINAL)
def restore(spark, sf):
    c = _collection(spark, sf)
    before = c.root()
    c.apply(core._batch(spark, sf))
    c.restore(before)
    return _state(c.snapshot())


@_register("""
SELECT * FROM (VALUES (0::BIGINT, true, (SELECT count(*) FROM embeddings)), (1, false, (SELECT count(*) FILTER (label <> 3) + count(*) FILTER (label = 2) FROM embeddings)), (2, true, (SELECT count(*) FROM embeddings)), (3, false, 0)) t(back, is_first, points)""")
def history(spark, sf):
    """Roots from the newest back to the empty collection: those of an upsert, a batch and a restoration."""
    c = _collection(spark, sf)
    before = c.root()
    c.apply(core._batch(spark, sf))
    c.restore("HEAD~1")
    rows = [(i, e.root == before, c.at(e.commit).count()) for i, e in enumerate(c.history(10))]
    return spark.createDataFrame(rows, "back long, is_first boolean, points long")


@_register(_STATE)
def time_travel_by_commit(spark, sf):
    c = _collection(spark, sf)
    done = c.apply(core._batch(spark, sf))
    c.restore("HEAD~1")
    return _state(c.at(done.commit).snapshot())


@_register("SELECT true AS same_root, 0::BIGINT AS affected")
def net_no_op(spark, sf):
    """An upsert of what is there, and a deletion that an upsert undoes, leave the root."""
    c = _collection(spark, sf)
    before = c.root()
    again = from_table(_table(spark, sf, "embeddings").where("label = 3"), "vec_id", "embedding", F.to_json(F.struct("label", (F.col("vec_id") % 1000).alias("selectivity_bucket"))))
    done = c.apply([Mutation.delete_filter(_LABEL(3)), Mutation.upsert(again)])
    return spark.createDataFrame([(done.root == before, done.affected)], "same_root boolean, affected long")


@_register("SELECT true AS refused, (SELECT count(*) FROM embeddings) AS points")
def duplicate_ids(spark, sf):
    """A batch with an id that comes twice is refused whole."""
    c = _collection(spark, sf)
    twice = points(spark, sf)
    try:
        c.upsert(twice.unionByName(twice.where(F.lit(True))))
        refused = False
    except Invalid:
        refused = True
    return spark.createDataFrame([(refused, c.count())], "refused boolean, points long")


@_register("""
WITH s AS (SELECT (('0x' || substr(sha256(unhex('7500') || unhex(printf('%016x', vec_id))), 1, 2))::INT >> 2)::INT AS shard, label FROM embeddings),
t AS (SELECT shard, bool_or(label = 4) AS touched, bool_and(label = 4) AS gone FROM s GROUP BY shard)
SELECT count(*) FILTER (NOT touched) AS shared, count(*) FILTER (touched) AS only_left, count(*) FILTER (touched AND NOT gone) AS only_right FROM t""")
def sharing(spark, sf):
    """Shards that two states have in common, and those of one only."""
    first = _snapshot(spark, sf)
    second = first.apply([Mutation.delete_filter(_LABEL(4))])
    a, b = first.manifest["shards"], second.manifest["shards"]
    same = {s for s in a if b.get(s, {}).get("hash") == a[s]["hash"]}
    return spark.createDataFrame([(len(same), len(a) - len(same), len(b) - len(same))], "shared long, only_left long, only_right long")


@_register("SELECT count(*) AS points, true AS same_root, true AS valid FROM embeddings")
def materialize_import(spark, sf):
    s = _snapshot(spark, sf)
    at = shared_folder(spark, "materialized")
    s.materialize(at)
    other = SnapshotEngine.init(spark, shared_folder(spark, "snapshots"))
    taken = other.import_directory(at)
    return spark.createDataFrame([(taken.count(), taken.root == s.root, taken.validate().point_count == taken.count())], "points long, same_root boolean, valid boolean")


@_register(_STATE)
def push_pull(spark, sf):
    """What another database has after a push, a change there, and a pull back."""
    c = _collection(spark, sf)
    remote = shared_folder(spark, "remote")
    c.database.push("points", remote)
    Database.open(spark, remote).collection("points").apply(core._batch(spark, sf))
    c.database.pull("points", remote)
    return _state(c.snapshot())


@_register("SELECT (SELECT count(*) FROM embeddings) AS points, true AS same_root, least(4, (SELECT count(*) FROM embeddings)) AS batches")
def import_batches(spark, sf):
    """A file put in by batches of a quarter has the root of one commit."""
    at = shared_folder(spark, "jsonl")
    jsonl.write(points(spark, sf), at)
    store = Store.open(spark, shared_folder(spark, "database"))
    n = _table(spark, sf, "embeddings").count()
    done = jsonl.import_points(store.collection("parts"), at, -(-n // 4))
    jsonl.import_points(store.collection("whole"), at)
    return spark.createDataFrame([(store.collection("parts").count(), store.collection("parts").root() == store.collection("whole").root(), len(done))], "points long, same_root boolean, batches long")


@_register("SELECT 'points' AS name, count(*) AS points, true AS healthy FROM embeddings UNION ALL SELECT 'second', count(*), true FROM embeddings WHERE label = 1")
def doctor(spark, sf):
    c = _collection(spark, sf)
    c.database.create_collection("second", CollectionConfig(64)).upsert(points(spark, sf).where(filters.predicate(_LABEL(1))))
    c.database.create_collection("gone", CollectionConfig(64))
    c.database.delete_collection("gone")
    found = c.database.doctor()
    return spark.createDataFrame([(x["name"], x["point_count"], found["healthy"]) for x in found["collections"]], "name string, points long, healthy boolean")


@_register("SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE label IN (2, 3) ORDER BY vec_id LIMIT 20 OFFSET 5")
def get_filtered(spark, sf):
    rows = _snapshot(spark, sf).get(GetRequest(filter=_LABEL(2, 3), offset=5, limit=20, payload=True))
    return spark.createDataFrame([(r.id, r.payload["label"]) for r in rows], "id long, label long")


@_register("SELECT label::INT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean FROM embeddings GROUP BY label")
def aggregate_points(spark, sf):
    label = F.get_json_object("payload", "$.label").cast("int")
    return _snapshot(spark, sf).points().groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("vector")[0].cast("double")), 6).alias("mean"))


# filters of the client, and the dialect of regular expressions

for _name, _where, _sql in (
    ("and_bounds", {"$and": [{"k": {"$gte": 10, "$lt": 60}}, {"k": {"$ne": 20}}]}, "k >= 10 AND k < 60 AND k <> 20"),
    ("nin", {"k": {"$nin": [1, 2, 3]}}, "k NOT IN (1, 2, 3)"),
    ("eq_or_gt", {"$or": [{"k": 5}, {"k": {"$eq": 6}}, {"k": {"$gt": 95}}]}, "k = 5 OR k = 6 OR k > 95"),
):
    _register(f"SELECT event_id FROM (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events) WHERE {_sql}", f"where_{_name}")(core._events(filters.from_where(_where)))
for _name, _where, _sql in (
    ("tags", {"tags": {"$contains": "src1"}}, "source = 'src1'"),
    ("lang_ne", {"meta.lang": {"$ne": "en"}}, "lang IS DISTINCT FROM 'en'"),
):
    _register(f"SELECT doc_id FROM documents WHERE {_sql}", f"where_{_name}")(_documents(filters.from_where(_where)))
for _name, _where, _sql in (
    ("document_contains", {"$contains": "the "}, "contains(text, 'the ')"),
    ("document_regex", {"$regex": r"^\p{Lu}\p{Ll}+ (?P<word>[[:alpha:]]+) "}, r"regexp_matches(text, '^\p{Lu}\p{Ll}+ ([[:alpha:]]+) ')"),
    ("document_all", {"$and": [{"$contains": " a"}, {"$regex": r"\+\d\b|[0-9]{4}$"}]}, r"contains(text, ' a') AND regexp_matches(text, '\+\d\b|[0-9]{4}$')"),
    ("document_any", {"$or": [{"$contains": "|"}, {"$regex": r"(?i)WWW\.[a-z&&[^x]]+"}]}, r"contains(text, '|') OR regexp_matches(text, '(?i)WWW\.[a-wyz]+')"),
):
    _register(f"SELECT doc_id FROM documents WHERE {_sql}", f"where_{_name}")(_documents(filters.from_where_document(_where)))


# texts

_SIZE = 2000
_CHUNKS = rf"""
WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS source, list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
u AS (SELECT source, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
w AS MATERIALIZED (SELECT *, sum(length(word) + 1) OVER (PARTITION BY source ORDER BY i) AS upto FROM u),
s AS (
  SELECT source, 0 AS chunk, 1::BIGINT AS start, 0::HUGEINT AS base FROM w WHERE i = 1
  UNION ALL
  SELECT s.source, s.chunk + 1, min(w.i), arg_min(w.upto - length(w.word) - 1, w.i)
  FROM s JOIN w ON w.source = s.source AND w.i > s.start AND w.upto - s.base - 1 > {_SIZE} GROUP BY s.source, s.chunk),
c AS (SELECT w.*, s.chunk FROM w ASOF JOIN s ON w.source = s.source AND w.i >= s.start)
SELECT printf('%s#%06d', source, chunk) AS id, source, chunk::INT AS chunk, string_agg(word, ' ' ORDER BY i) AS document FROM c GROUP BY source, chunk"""


@_register(_CHUNKS)
def document_chunks(spark, sf):
    return chunked(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"), _SIZE)


@_register(f"SELECT id, source, chunk, document FROM ({_CHUNKS}) WHERE NOT (source::BIGINT % 3 = 0 AND chunk > 0) AND source::BIGINT % 5 <> 0")
def source_sync(spark, sf):
    """All documents as files; then those of every third id shrink to their first chunk, and those of every fifth become empty."""
    files = _table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("source"), "text")
    texts = Store.open(spark, shared_folder(spark, "database")).text_collection("texts", HashingEmbedder(8))
    texts.sync_files(files, _SIZE)
    first = chunked(files, _SIZE).where("chunk = 0").select("source", F.col("document").alias("first"))
    third, fifth = (F.col("source").cast("long") % n == 0 for n in (3, 5))
    changed = files.where(third | fifth).join(first, "source", "left").select("source", F.when(fifth, "").otherwise(F.coalesce("first", F.lit(""))).alias("text"))
    texts.sync_files(changed, _SIZE)
    left = texts.vectors().advanced().points()
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return left.select(F.format_string("%s#%06d", get("source"), get("chunk").cast("int")).alias("id"), get("source").alias("source"), get("chunk").cast("int").alias("chunk"), get("document").alias("document"))


@_register("SELECT doc_id AS id, 'old' AS kind FROM documents WHERE text IS NOT NULL AND lang <> 'de' UNION ALL SELECT -1, 'new'")
def replace_documents(spark, sf):
    """Documents in a table, of which those of one language give way to a single new one."""
    docs = _table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    texts = Store.open(spark, shared_folder(spark, "database")).text_collection("texts", HashingEmbedder(8))
    texts.upsert_table(docs.select("doc_id", "text", F.to_json(F.struct("lang", F.lit("old").alias("kind"))).alias("meta")), "doc_id", "text", "meta")
    texts.replace_documents(Filter(must=(Condition.matches("lang", "de"),)), [Document("new", "one text", {"kind": "new"})])
    own = texts.vectors().advanced().points()
    is_text = F.hex(F.substring("cid", 1, 1)) == "73"
    return own.select(F.when(is_text, F.lit(-1).cast("long")).otherwise(_uint()).alias("id"), F.get_json_object("payload", "$.kind").alias("kind"))


# the older index

_TABLES, _BITS = 2, 4


@_register(_top_sql("q.vec_id % 50 = 0 AND p.label <> 7", "score::FLOAT::DOUBLE").replace("ORDER BY score DESC", "ORDER BY score::FLOAT DESC"))
def older_search(spark, sf):
    """Searches of all buckets of the older index, which rank by scores of 32 bits."""
    asked = _queries(spark, sf).where("qid % 50 = 0")
    other = Filter(must_not=(Condition.matches("label", 7),))
    return _hits(OlderIndex(_snapshot(spark, sf), _TABLES, _BITS).search_table(asked, K, _TABLES << _BITS, other))


@_register("""
SELECT count(*) FILTER (label <> 3) + count(*) FILTER (label = 2) AS points, 2 * (count(*) FILTER (label <> 3) + count(*) FILTER (label = 2)) AS entries, 0::BIGINT AS differ FROM embeddings""")
def older_index_update(spark, sf):
    """An index carried on from an earlier snapshot's is that of a new build."""
    first = _snapshot(spark, sf)
    second = first.apply(core._batch(spark, sf))
    updated = OlderIndex(second, _TABLES, _BITS)
    rows = updated.update(first)
    anew = lsh.index(second.points(), updated.signs).select("cid", "table", "signature")
    own = rows.select("cid", "table", "signature")
    differ = own.exceptAll(anew).count() + anew.exceptAll(own).count()
    return spark.createDataFrame([(second.count_all, rows.count(), differ)], "points long, entries long, differ long")
