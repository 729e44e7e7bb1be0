"""Filters, files, the client, the command line and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import Condition, Filter, Range, open_store
from plumbline.cli import main, parse_id, parse_vector
from plumbline.client import PersistentClient
from plumbline.errors import Invalid
from plumbline.functions.chunks import chunks
from plumbline.functions.ids import string_cid, uint_cid
from plumbline.model import canonical_id
from plumbline.operators import filters, ivf, lsh, search
from plumbline.sources import jsonl, trees
from plumbline.streaming.imports import upsert_stream

PAYLOADS = ['{"x":5}', '{"x":5.0}', '{"x":"5"}', '{"x":true}', '{"x":null}', '{"x":[1,"a",null]}', '{"x":{"y":1}}', "{}", '{"x":"other"}', '{"x":9007199254740993}', '{"x":-0.5,"document":"Hello world"}']


def python_filter(f: Filter, p: dict) -> bool:
    missing = object()

    def at(key):
        for step in key.split("."):
            if not isinstance(p_ := here[0], dict) or step not in p_:
                return missing
            here[0] = p_[step]
        return here[0]

    def equal(a, b):
        if isinstance(a, bool) or isinstance(b, bool):
            return isinstance(a, bool) and isinstance(b, bool) and a == b
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return float(a) == float(b)
        return type(a) is type(b) and not isinstance(a, (list, dict)) and a == b

    def one(c):
        if c.kind == "nested":
            return python_filter(c.value, p)
        if c.kind == "document_contains":
            return isinstance(p.get("document"), str) and c.value in p["document"]
        here[0] = p
        v = at(c.key)
        if v is missing:
            return False
        if c.kind == "exists":
            return True
        if c.kind == "is_in":
            return any(equal(v, w) for w in c.value)
        if c.kind == "not_in":
            return not any(equal(v, w) for w in c.value)
        if c.kind == "contains":
            return isinstance(v, list) and any(equal(w, c.value) for w in v)
        ok = c.value is None or equal(v, c.value[0])
        if c.range_:
            r = c.range_
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            ok = ok and number and (r.gt is None or v > r.gt) and (r.gte is None or v >= r.gte) and (r.lt is None or v < r.lt) and (r.lte is None or v <= r.lte)
        return ok

    here = [p]
    return all(map(one, f.must)) and not any(map(one, f.must_not)) and (not f.should or any(map(one, f.should)))


def test_filters_against_python(spark):
    leaves = [Condition.exists("x"), Condition.exists("x.y"), *(Condition.matches("x", v) for v in (5, 5.0, "5", True, None, "other", 9007199254740993)), Condition.is_in("x", [5, "other"]), Condition.not_in("x", [5, None]), Condition.contains("x", "a"), Condition.contains("x", None), Condition.range("x", Range(gte=0, lt=6)), Condition.range("x", Range()), Condition.document_contains("world")]
    tests = [Filter(must=(c,)) for c in leaves] + [Filter(must_not=(c,)) for c in leaves] + [Filter(should=(leaves[2], leaves[4])), Filter(must=(Condition.nested(Filter(should=(leaves[7], leaves[12]))),))]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "i int, payload string").withColumn("cid", uint_cid(F.col("i")))
    rows = table.select("i", *(filters.predicate(f).alias(f"f{k}") for k, f in enumerate(tests))).collect()
    for r in rows:
        for k, f in enumerate(tests):
            assert r[f"f{k}"] == python_filter(f, json.loads(PAYLOADS[r["i"]])), (f, PAYLOADS[r["i"]])


def test_filters_refused():
    bad = [{"key": "a..b", "match": {"value": 1}}, {"key": "a", "any": []}, {"key": "a", "match": {"value": [1]}}, {"document_contains": ""}, {"document_regex": "("}, {"document_regex": "(?=a)"}, {"has_id": []}, {"key": "a"}, {"typo": 1}]
    for c in bad:
        with pytest.raises(Invalid):
            filters.check(Filter.from_json({"must": [c]}))
    f = filters.from_where({"$or": [{"a": 1, "b": {"$gt": 2, "$lte": 3}}, {"c": {"$in": [4]}}]})
    assert [python_filter(f, p) for p in ({"a": 1, "b": 3}, {"a": 1, "b": 2}, {"c": 4}, {})] == [True, False, True, False]


def test_ids(spark):
    ids = ["", "a", "é\0", 0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    texts = spark.createDataFrame([(x,) for x in ids[:3]], "x string").select(string_cid(F.col("x")).alias("c"))
    numbers = spark.createDataFrame([(str(x),) for x in ids[3:]], "x string").select(uint_cid(F.col("x").cast("decimal(20,0)")).alias("c"))
    assert {bytes(r.c) for r in texts.union(numbers).collect()} == {canonical_id(x) for x in ids}


def test_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 6)).astype(np.float32), rng.standard_normal((40, 6)).astype(np.float32)
    x[7] = x[9]
    x[11] = 0
    table = spark.createDataFrame([(bytearray(canonical_id(i)), v.tolist()) for i, v in enumerate(x)], "cid binary, vector array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "qid long, vector array<float>")
    a, b = x.astype(float), y.astype(float)
    norm = np.linalg.norm(a, axis=1)
    cos = (b @ a.T) / np.where(norm == 0, 1, norm) / np.linalg.norm(b, axis=1)[:, None]
    best = {q: [(canonical_id(int(i))) for i in np.lexsort((np.arange(300), -np.round(cos[q], 12)))[:5]] for q in range(40)}
    book = ivf.train(x, 8)
    placed = ivf.assign(table, book)
    for found in (search.top_k_join(table, asked, 5, 64), search.top_k(table, list(range(40)), b.tolist(), 5), ivf.search_join(placed, asked, book, 5, 8, 7)):
        got: dict = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(bytes(r.cid))
        assert got == best
    none = table.where("false")
    assert search.top_k_join(none, asked, 5).count() == 0 and search.top_k_join(table, asked.where("false"), 5).count() == 0
    assert [ivf.centroid_count(n) for n in (0, 1, 100, 500, 2000, 9120, 9121, 10**9)] == [0, 1, 8, 16, 32, 64, 128, 4096]


def test_older_search(spark):
    signs = lsh.projections(3, 6, 4, 1)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 4)).astype(np.float32)
    table = spark.createDataFrame([(bytearray(canonical_id(i)), v.tolist()) for i, v in enumerate(x)], "cid binary, vector array<float>")
    found, stats = lsh.search(table, lsh.index(table, signs), F.lit(True), x[3].tolist(), signs, 5, 10**6, 1000)
    assert bytes(found.orderBy("rank").first().cid) == canonical_id(3)
    assert stats["discovered"] == stats["scored"] == 80
    assert lsh.probe_sequence([0, 4], 4, 6) == [(0, 0), (1, 4), (0, 1), (0, 2), (0, 4), (0, 8)]


def greedy(text, size):
    out, now = [], ""
    for w in text.split():
        if now and len(now) + 1 + len(w) > size:
            out.append(now)
            now = ""
        now = f"{now} {w}" if now else w
    return out + [now] if now else out


def test_chunks(spark, tmp_path):
    texts = ["", "  ", "one", "a bb ccc dddd", "word " * 50, "x" * 30 + " y", "nbsp is space\nand lines"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks(F.col("t"), 8).alias("c")).collect()
    assert all(r.c == greedy(r.t, 8) for r in rows)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.txt").write_text("alpha beta")
    (tmp_path / "a/bad.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x").write_text("hidden")
    assert [(r.id, r.document) for r in trees.document_chunks(spark, str(tmp_path), 5).orderBy("id").collect()] == [(f"{tmp_path}/a/one.txt#00000{i}", w) for i, w in enumerate(("alpha", "beta"))]


def test_import(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("".join(json.dumps({"id": i if i % 2 else f"s{i}", "vector": [1.0, float(i)], "payload": {"n": i}}) + "\n\n" for i in range(7)))
    handle = open_store(spark, str(tmp_path / "db")).collection("c")
    assert len(jsonl.import_points(handle, str(path), 3)) == 3 and handle.count() == 7
    one = open_store(spark, str(tmp_path / "db")).collection("d")
    assert len(jsonl.import_points(one, str(path))) == 1 and one.root() == handle.root()
    path.write_text('{"id":"a","vector":[1,0]}\nnot-json\n')
    with pytest.raises(Invalid):
        jsonl.import_points(open_store(spark, str(tmp_path / "db")).collection("e"), str(path))
    assert open_store(spark, str(tmp_path / "db")).list_collections() == ["c", "d"]


def test_client(spark, tmp_path):
    c = PersistentClient(str(tmp_path / "db"), spark).get_or_create_collection("c")
    c.upsert(ids=["east", "north", 3], embeddings=[[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], metadatas=[{"k": 1}, None, {"k": 3}], documents=["East", "North", None])
    r = c.query(query_embeddings=[[1.0, 0.0], [0.0, 1.0]], n_results=2)
    assert r["ids"] == [["east", 3], ["north", 3]] and r["documents"][0] == ["East", None] and abs(r["distances"][0][0]) < 1e-6
    assert c.query(query_embeddings=[[1.0, 0.0]], where={"k": {"$gte": 2}}, where_document=None)["ids"] == [[3]]
    assert c.query(query_embeddings=[[1.0, 0.0]], where_document={"$contains": "ort"})["ids"] == [["north"]]
    assert c.get(where={"k": {"$in": [1, 3]}})["ids"] == ["east", 3]
    c.delete(ids=["east"])
    assert c.count() == 2
    with pytest.raises(Invalid):
        c.delete()
    with pytest.raises(Invalid):
        c.query()


def test_command_line(spark, tmp_path, capsys):
    db = str(tmp_path / "db")

    def run(*words, code=0):
        assert main(["--db", db, *words], spark) == code
        out = capsys.readouterr().out
        return json.loads(out) if out.strip() else None

    run("count", "docs", code=1)
    assert not (tmp_path / "db").exists()
    first = run("upsert", "docs", "--id", "a", "--vector", "1,0", "--payload", '{"n":1}')
    run("upsert", "docs", "--id", "7", "--vector", "[0,1]")
    assert run("count", "docs")["count"] == 2
    assert [p["id"] for p in run("search", "docs", "--vector", "0,1", "--with-payload")["points"]] == [7, "a"]
    assert run("get", "docs", "--filter", '{"must":[{"has_field":"n"}]}', "--with-vector")["points"] == [{"id": "a", "vector": [1.0, 0.0]}]
    assert run("count", "docs", "--at", first["root"])["count"] == 1
    assert run("restore", "docs", first["root"])["root"] == first["root"]
    assert len(run("history", "docs")["history"]) == 4
    assert run("validate", "docs", "--full")["valid"] and run("doctor")["healthy"]
    assert run("collection", "list") == {"collections": ["docs"]}
    (tmp_path / "f.txt").write_text("the river runs north\nand the hill is green")
    assert run("index", "texts", str(tmp_path / "f.txt"), "--chunk-chars", "22")["chunks"] == 2
    assert "river" in run("search", "texts", "--text", "river north", "--limit", "1")["points"][0]["text"]
    assert (parse_id("7"), parse_id('"7"'), parse_id("abc")) == (7, "7", "abc") and parse_vector("1, 2") == [1.0, 2.0]


def test_stream(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    (tmp_path / "in").mkdir()
    points = spark.createDataFrame([(bytearray(canonical_id(i)), [1.0, float(i)], "{}") for i in range(5)], "cid binary, vector array<float>, payload string")
    points.write.mode("overwrite").parquet(str(tmp_path / "in"))
    upsert_stream(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), store.collection("c"), str(tmp_path / "mark")).awaitTermination()
    assert store.collection("c").count() == 5
