"""Regular expressions, source sync, file trees, drafts, tables of queries and large shards."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import CollectionConfig, Condition, Filter, HashingEmbedder, Mutation, Point, SnapshotEngine, open_store
from plumbline.errors import Invalid
from plumbline.functions.patterns import check_pattern, java_pattern
from plumbline.model import canonical_id
from plumbline.operators import search
from plumbline.sources import trees
from plumbline.storage import snapshots
from plumbline.storage.files import Files
from plumbline.storage.text import embedded

TEXTS = ["", "a", "abc", "ABC", "C++", "a\\1", "x-y", "tab\there", "line\nend", "ends\n", "éa", "Ωmega", "1234-56", "a]b", "a[b", "foo_bar", "  ", "aaa", "{2}", "a.b", "naïve café", "日本", "^$", "a#b", "Zebra crossing"]
PATTERNS = [r"\p{L}+", r"C\++", r"\\1", "(?P<x>a)b", "(?P<n_1>a)", "[[:alpha:]]$", "^[^[:digit:]]+$", r"^\w+$", "a.c", "(?s)line.end", "line.end", "(?i)abc", "(?i:A)bc", "^a|b$", "(?m)^end", "(?m)line$", "ends$", r"ends\z", r"\bfoo", r"[\]a]b", r"\x{3A9}", r"\d{4}-\d{2,}", "a{2,3}", "(?:a|b)+c", r"\.b", r"[a-c&-]$", r"\pL\PL", r"\p{Greek}", "[^a-z]", "a*?b", "(?:a{2})+", r"\Q", "(", "[a", "*a", "(?=a)", r"\1", "a{3,2}"]


def test_patterns_against_another_engine(spark):
    """RE2 reads nearly the same dialect; \\w, \\d, \\s and \\b know ASCII only there, so such patterns meet only texts without other letters."""
    con = duckdb.connect()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for p in PATTERNS:
        try:
            wanted = [con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS]
        except duckdb.Error:
            wanted = None
        if p == r"\Q":  # quoting is known to RE2 alone
            wanted = None
        if wanted is None:
            with pytest.raises(Invalid):
                check_pattern(p)
            continue
        got = [r.m for r in table.select("i", F.col("t").rlike(check_pattern(p)).alias("m")).orderBy("i").collect()]
        plain = any(x in p for x in (r"\w", r"\d", r"\b"))
        assert [g for g, t in zip(got, TEXTS) if not plain or t.isascii()] == [w for w, t in zip(wanted, TEXTS) if not plain or t.isascii()], p


def test_patterns_beyond_it(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cases = {
        "[a-z--[aeiou]]": lambda t: any(c in "bcdfghjklmnpqrstvwxyz" for c in t),
        "^[a-c&&b-z]+$": lambda t: bool(t) and set(t) <= set("bc"),
        "a**$": lambda t: True,
        "(?x) a b # a comment (\n c": lambda t: "abc" in t,
        r"\u{e9}|日": lambda t: "é" in t or "日" in t,
        r"[[:^alpha:]&&[:ascii:]]": lambda t: any(c.isascii() and not c.isalpha() for c in t),
        "[]a]b": lambda t: "]b" in t or "ab" in t,
        "[#a] ?b": lambda t: any(x in t for x in ("#b", "ab", "# b", "a b")),
        r"^\p{Lu}\p{Lowercase_Letter}+ ": lambda t: t.startswith("Zebra "),
    }
    for p, test in cases.items():
        got = [r.m for r in table.select("i", F.col("t").rlike(check_pattern(p)).alias("m")).orderBy("i").collect()]
        assert got == [test(t) for t in TEXTS], p
    for p in ("(?<=a)b", "(?!a)", r"\k<x>", "(?>a)", "a)", "[a--]", "[z-a]", r"\p{Nonsense}", r"\x{110000}", "(?q)a", "(?P<1>a)", "(" * 300, None):
        with pytest.raises(Invalid):
            check_pattern(p)
    assert java_pattern("") == "(?dU)"


def test_source_sync(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    texts = store.text_collection("t", HashingEmbedder(8))
    make = lambda **files: spark.createDataFrame(list(files.items()), "source string, text string")
    n, chunks, _ = texts.sync_files(make(a="one two three", b="four five", empty=""), 5)
    assert (n, chunks) == (3, 5) and texts.vectors().count() == 5
    # a file that shrinks leaves no chunk behind, an emptied one none at all, others stay
    n, chunks, done = texts.sync_files(make(a="one", b=""), 5)
    assert (n, chunks) == (2, 1) and done.affected == 4
    assert [r.id for r in texts.vectors().peek(9)] == ["a#000000"]
    same = texts.sync_files(make(a="one"), 5)[2]
    assert same.root == done.root and same.affected == 0
    texts.sync_files(make(c="six"), 5)
    assert [r.id for r in texts.vectors().peek(9)] == ["a#000000", "c#000000"]
    with pytest.raises(Invalid):
        texts.sync_files(make(a="x").where("false"), 5)
    nothing = store.text_collection("n", HashingEmbedder(8))
    assert nothing.sync_files(make(a=""), 5) == (1, 0, None) and "n" not in store.list_collections()


def test_trees_below_folders_that_are_passed_over(spark, tmp_path):
    root = tmp_path / "target" / "it's .git" / "src"
    for name in ("a.txt", "target/b.txt", "deep/.git/c.txt", "deep/targets/d.txt", "deep/target"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        if not (root / name).is_dir():
            (root / name).write_text(name)
    found = {r.source: r.text for r in trees.files(spark, str(root)).collect()}
    assert found == {f"{root}/{n}": n for n in ("a.txt", "deep/targets/d.txt")}
    assert [r.text for r in trees.files(spark, str(root / "a.txt")).collect()] == ["a.txt"]


def test_files_by_way_of_drafts(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/far")
    files.local = None  # as on a disk that isn't mounted
    assert files.create("log/1.json", b"{}") and not files.create("log/1.json", b"[]")
    assert files.read("log/1.json") == b"{}" and files.names("log") == ["1.json"]
    # a writer that dies leaves a draft, which is no entry
    (tmp_path / "far/log/2.json.0123.tmp").write_bytes(b"")
    assert files.names("log") == ["1.json"] and files.create("log/2.json", b"1") and files.names("log") == ["1.json", "2.json"]
    assert not [n for n in os.listdir(tmp_path / "far/log") if n.endswith(".tmp") and "0123" not in n]


def test_tables_of_queries(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 5)).astype(np.float32)
    s = SnapshotEngine.ephemeral(spark).build(CollectionConfig(5), [Point(i, tuple(map(float, v)), {"even": i % 2 == 0}) for i, v in enumerate(x)])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:30])], "qid long, vector array<float>")
    even = Filter(must=(Condition.matches("even", True),))
    for f in (None, even):
        rows = [i for i in range(120) if f is None or i % 2 == 0]
        a = x[rows].astype(float)
        cos = (x[:30].astype(float) @ a.T) / np.linalg.norm(a, axis=1)
        best = {q: [canonical_id(rows[i]) for i in np.argsort(-cos[q], kind="stable")[:4]] for q in range(30)}
        for exact in (True, False):
            got: dict = {}
            for r in s.query_table(asked, 4, f, exact, probes=0 if f else 99).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append(bytes(r.cid))
            assert got == best
    with pytest.raises(Invalid):
        s.query_table(asked.withColumn("vector", F.slice("vector", 1, 4)), 4)


def test_winners_with_rounding_and_ties():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((30, 7)), 5, axis=0)
    x[::2] *= 3.0  # the same cosine up to rounding
    x[7] = 0
    cids = np.array([canonical_id(i) for i in rng.permutation(150).tolist()], object)
    y = np.concatenate([x[::10], rng.standard_normal((9, 7)), np.zeros((1, 7))])
    from plumbline.functions.vectors import cosines

    exact = cosines(x, y)
    for k in (1, 6, 149, 150, 400):
        q, r, s = search.winners(cids, x, y, k)
        wanted = [(j, i, exact[i, j]) for j in range(len(y)) for i in sorted(range(150), key=lambda i: (-exact[i, j], cids[i]))[:k]]
        assert list(zip(q.tolist(), r.tolist(), s.tolist())) == wanted
    from plumbline.functions.vectors import closest

    assert closest(x, y).tolist() == cosines(x, y).argmax(axis=1).tolist() and closest(x[:0], y).tolist() == []
    i, j = search.grid(2000, 2000, 8, 16384)
    assert i * j >= 8 and search.grid(10**6, 10, 8, 16384)[0] == 62 and search.grid(0, 0, 8, 4) == (1, 1)


def test_shards_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 1)
    engine = SnapshotEngine.ephemeral(spark)
    points = [Point(i, (1.0, float(i))) for i in range(300)]
    s = engine.build(CollectionConfig(2), points)
    assert max(len(engine.files.sizes(f)) for f in s.folders()) > 1
    monkeypatch.undo()
    assert engine.build(CollectionConfig(2), points).root == s.root and s.validate(full=True).valid
    t = s.apply([Mutation.delete_ids([1, 2])])
    gone = spark.createDataFrame([(bytearray(canonical_id(i)),) for i in (1, 2, 2, 10**9)], "cid binary")
    assert s.apply([Mutation.delete_ids(gone)]).root == t.root and t.count() == 298
    assert not engine.files.names("drafts")


def test_embedders_of_tables_are_checked(spark):
    class Zero:
        model_id = "zero"

        def embed(self, texts):
            return [[0.0, 0.0] for _ in texts]

    with pytest.raises(Exception, match="finite and isn't zero"):
        embedded(spark.createDataFrame([("a",)], "t string"), "t", "v", Zero()).collect()
