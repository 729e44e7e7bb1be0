"""The store, its history and its texts, on the small fixtures of FIXTURES.md."""

import json
import threading

import pytest

from plumbline import CollectionConfig, Condition, DeleteSelector, Document, Filter, GetRequest, HashingEmbedder, Mutation, Point, Query, QueryParams, SnapshotEngine, TextQuery, open_store
from plumbline.errors import CollectionExists, CollectionNotFound, Corrupt, EmbeddingError, Invalid, ReadOnly, StaleRoot
from plumbline.storage.database import Database


def compass():
    return [Point("east", (1.0, 0.0), {"label": "East"}), Point("north", (0.0, 1.0), {"label": "North"})]


def kind(value):
    return Filter(must=(Condition.matches("kind", value),))


def test_open_write_search_reopen_delete(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    places = store.collection("places")
    with pytest.raises(CollectionNotFound):
        places.count()
    assert places.upsert(compass()).affected == 2
    hits = places.search([0.9, 0.1], 1)
    assert [h.id for h in hits] == ["east"] and hits[0].payload == {"label": "East"}
    again = open_store(spark, str(tmp_path / "db")).collection("places")
    assert again.count() == 2
    assert [r.id for r in again.peek(5)] == ["east", "north"]
    assert [r.id for r in again.get_ids(["north", "absent"])] == ["north"]
    assert again.delete_ids(["north", "absent"]).affected == 1
    assert again.count() == 1
    assert store.list_collections() == ["places"]


def test_batches_history_restore_and_views(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    c = store.collection("c")
    first = c.upsert([Point("a", (1.0, 0.0), {"kind": "keep"}), Point("b", (0.0, 1.0), {"kind": "remove"})])
    second = c.apply([Mutation.delete_filter(kind("remove")), Mutation.upsert([Point("a", (0.9, 0.1), {"kind": "changed"})])])
    assert second.affected == 2
    inner = c.advanced()
    diff = inner.diff(first.root, second.root)
    assert (diff.added, diff.removed, diff.changed) == ([], ["b"], ["a"])
    past = inner.at(first.commit)
    assert past.count() == 2 and past.info()["read_only"]
    with pytest.raises(ReadOnly):
        past.upsert(compass())
    assert inner.at("HEAD~1").root() == first.root
    restored = c.restore(first.root)
    assert restored.root == first.root and restored.affected == 2
    assert [h.root for h in inner.history(10)][:3] == [first.root, second.root, first.root] and len(inner.history(10)) == 4
    # the same points by another way have the same root
    clean = inner.database.engine.build(CollectionConfig(2), [Point("a", (0.9, 0.1), {"kind": "changed"})])
    assert clean.root == second.root
    with pytest.raises(StaleRoot):
        inner.upsert_expect(compass(), second.root)
    # no change leaves the root, and is a commit still
    same = c.upsert([Point("a", (1.0, -0.0), {"kind": "keep"})])
    assert same.root == first.root and same.commit != restored.commit
    inner.validate(full=True)


def test_refusals(spark, tmp_path):
    database = Database.init(spark, str(tmp_path / "db"))
    for name in ("", ".a", "a.", "a..b", "a/b", "x" * 129):
        with pytest.raises(Invalid):
            database.create_collection(name, CollectionConfig(2))
    c = database.create_collection("c", CollectionConfig(2))
    with pytest.raises(CollectionExists):
        database.create_collection("c", CollectionConfig(2))
    with pytest.raises(Invalid):
        database.get_or_create_collection("c", CollectionConfig(3))
    for points in ([], [Point("a", (1.0,))], [Point("a", (1.0, float("nan")))], [Point("a", (1.0, 0.0)), Point("a", (0.0, 1.0))], [Point(-1, (1.0, 0.0))], [Point(True, (1.0, 0.0))]):
        with pytest.raises(Invalid):
            c.upsert(points)
    with pytest.raises(Invalid):
        c.delete(DeleteSelector())
    with pytest.raises(Invalid):
        c.query(Query.new((1.0, 0.0, 0.0)))
    assert c.query(Query.new((1.0, 0.0))).points == []
    root = database.delete_collection("c")
    assert database.list_collections() == [] and database.engine.open_snapshot(root).count() == 0
    database.create_collection("c", CollectionConfig(3))
    assert database.collection("c").info()["config"]["dimension"] == 3


def test_typed_ids_and_ties(spark, tmp_path):
    engine = SnapshotEngine.ephemeral(spark)
    s = engine.build(CollectionConfig(2), [Point(7, (1.0, 0.0)), Point("b", (1.0, 0.0)), Point("a", (1.0, 0.0)), Point(8, (0.0, 0.0)), Point(2**64 - 1, (0.0, 1.0)), Point("7", (-1.0, 0.0))])
    r = s.query(Query.exact((1.0, 0.0), 10))
    assert [(p.id, p.score) for p in r.points] == [("a", 1.0), ("b", 1.0), (7, 1.0), (8, 0.0), (2**64 - 1, 0.0), ("7", -1.0)]
    assert s.query(Query.exact((1.0, 0.0), 0)).stats.vectors_scored == 6
    assert [x.id for x in s.get(GetRequest(offset=1, limit=3))] == ["a", "b", 7]
    again = engine.open_snapshot(s.root)
    assert [x.id for x in again.get(GetRequest(ids=("7", 7)))] == ["7", 7]


def test_approximate_budgets(spark):
    engine = SnapshotEngine.ephemeral(spark)
    points = [Point(i, (float(i + 1), float(i % 7 - 3)), {"topic": "even" if i % 2 == 0 else "odd"}) for i in range(100)]
    s = engine.build(CollectionConfig(2), points)
    f = Filter(must=(Condition.matches("topic", "even"),))
    near = s.query(Query((1.0, 0.2), 20, f, params=QueryParams(False, 8, 75)))
    exact = s.query(Query((1.0, 0.2), 20, f, params=QueryParams(True)))
    assert [p.id for p in near.points] == [p.id for p in exact.points]
    assert near.stats.vectors_scored == 50 and not near.stats.candidate_limit_exhausted
    few = s.query(Query((1.0, 0.2), 5, params=QueryParams(False, 1, 10)))
    assert few.stats.vectors_scored <= 10 and few.stats.partitions_visited == 1


def test_materialize_import_and_corruption(spark, tmp_path):
    engine = SnapshotEngine.init(spark, str(tmp_path / "a"))
    s = engine.build(CollectionConfig(2), compass())
    s.materialize(str(tmp_path / "copy"))
    with pytest.raises(Invalid):
        s.materialize(str(tmp_path / "copy"))
    other = SnapshotEngine.init(spark, str(tmp_path / "b"))
    assert other.import_directory(str(tmp_path / "copy")).root == s.root
    manifest = json.loads((tmp_path / "copy/root.json").read_bytes())
    manifest["count"] = 3
    (tmp_path / "copy/root.json").write_text(json.dumps(manifest))
    with pytest.raises(Corrupt):
        other.import_directory(str(tmp_path / "copy"))


def test_push_pull(spark, tmp_path):
    a = Database.init(spark, str(tmp_path / "a"))
    c = a.create_collection("c", CollectionConfig(2))
    c.upsert(compass())
    assert a.push("c", str(tmp_path / "b")) == 2 and a.push("c", str(tmp_path / "b")) == 0
    b = Database.open(spark, str(tmp_path / "b"))
    assert b.collection("c").root() == c.root() and b.collection("c").count() == 2
    b.collection("c").delete(DeleteSelector(ids=("east",)))
    assert a.pull("c", str(tmp_path / "b")) == 1 and a.collection("c").count() == 1
    a.collection("c").upsert([Point("x", (1.0, 1.0))])
    b.collection("c").upsert([Point("y", (1.0, 1.0))])
    with pytest.raises(Invalid):
        a.push("c", str(tmp_path / "b"))
    assert a.doctor()["healthy"]


def test_two_writers(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    errors = []

    def write(i):
        try:
            store.collection("c").upsert([Point(i, (1.0, float(i)))])
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.collection("c").count() == 2


class Stub:
    model_id = "stub"

    def embed(self, texts):
        return [[0.0, 1.0] if "north" in t else [1.0, 0.0] for t in texts]


def test_texts(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    texts = store.text_collection("t", Stub())
    texts.upsert_documents([Document("east-guide", "go east", {"kind": "guide"}), Document("north-guide", "go north", {"kind": "guide"}), Document("north-note", "north star", {"kind": "note"})])
    a, b = texts.query_batch([TextQuery("north", 2), TextQuery("east", 1, kind("guide"))])
    assert [h.id for h in a] == ["north-guide", "north-note"] and b[0].id == "east-guide" and b[0].metadata == {"kind": "guide"}
    texts.replace_documents(kind("guide"), [Document("new", "more north")])
    assert [r.id for r in texts.vectors().peek(9)] == ["new", "north-note"]
    with pytest.raises(Invalid):
        texts.upsert_documents([Document("x", "y", {"document": "z"})])
    with pytest.raises(Invalid):
        store.text_collection("t", HashingEmbedder(2))

    class Zero(Stub):
        def embed(self, texts):
            return [[0.0, 0.0]]

    with pytest.raises(EmbeddingError):
        store.text_collection("new", Zero()).upsert_documents([Document("a", "b")])
    assert store.list_collections() == ["t"]
    table = spark.createDataFrame([("p", 'q "uoted"\nline', '{"kind":"x"}'), ("r", "north", None)], "id string, text string, meta string")
    store.text_collection("tables", Stub()).upsert_table(table, "id", "text", "meta")
    hit = store.text_collection("tables", Stub()).query(TextQuery("south", 1))[0]
    assert (hit.id, hit.text, hit.metadata) == ("p", 'q "uoted"\nline', {"kind": "x"})
