"""The corpus operators against brute force, known tokenizers, round trips and held-out labels."""

import base64
import gzip
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, components, embeddings, encoding, minhash, mixing, passages, quality, rendering, rules, textops, warc
from plumbline.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["key", "id", "i", "j", "sig", "part", "n", "u", "v", "span", "copy", "token", "mix_end", "cut_id", "encode_part", "quality_score", "group_id", "KEEP"]


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(2000)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def scratch(spark):
    s = Scratch(spark)
    yield s
    s.release()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def crowded(docs):
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def sets(rows):
    by = defaultdict(set)
    for node, c in rows:
        by[c].add(node)
    return sorted(map(sorted, by.values()))


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark, scratch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7), (7, 7)]
    wanted = union_find({x for e in edges for x in e if e[0] != e[1]}, edges)
    found = components.components(spark.createDataFrame([*edges, (None, 3)], "u long, v long"), scratch).collect()
    assert {r.node: r.component for r in found} == wanted and len(found) == len(wanted)
    assert components.components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_embeddings(spark, scratch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((250, 16))
    for i in range(0, 100, 2):
        x[i + 1] = x[i] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.4])
    x[200:230] = x[200]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    edges = [(i, j) for i in range(250) for j in range(i) if cos[i, j] >= 0.95]
    wanted = union_find(range(250), edges)
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0]), (None, [1.0] * 16), (905, [None] * 16)]
    odd += [(910 + i, [1.0, 2.0, 3.0 + i * 1e-3]) for i in range(3)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist())] + odd, "vec_id long, embedding array<double>")
    found = embeddings.near_groups(crowded(rows), scratch).collect()
    got = {r.id: r.group_id for r in found}
    assert len(got) == len(found) == 259 and all(got[i] == i for i in range(900, 906))
    # vectors of another length are compared with their like
    assert {got[i] for i in range(910, 913)} == {910}
    linked = [got[a] == got[b] for a, b in edges]
    assert sum(linked) >= 0.95 * len(linked)
    # nothing is linked that brute force doesn't link
    assert all(wanted[i] == wanted[got[i]] for i in range(250))
    assert embeddings.near_groups(rows.where("false"), scratch).count() == 0


def shingle_set(t, k=3):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash(spark, scratch):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(40)]
    for t in texts[:25]:
        for cut in (0, 0.03, 0.08):
            texts.append(" ".join(w if rng.random() >= cut else "changed" for w in t.split()))
    texts += ["", "   ...  ", "one", "one", "two words", "two words"] + [prose(rng, 30_000)] * 2
    rows = list(enumerate(texts)) + [(3, texts[3]), (2000, None), (None, texts[0])]
    docs = crowded(table(spark, rows))
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs, scratch, block=16).collect()}
    s = [shingle_set(t) for t in texts]
    pairs = [(i, j, len(s[i] & s[j]) / len(s[i] | s[j])) for i in range(len(texts)) for j in range(i) if s[i] | s[j] and texts[i].strip(" .") and texts[j].strip(" .")]
    near = [got.get(i) is not None and got.get(i) == got.get(j) for i, j, k in pairs if k >= 0.6]
    assert len(near) > 50 and sum(near) >= 0.97 * len(near)
    linked = union_find(range(len(texts)), [(i, j) for i, j, k in pairs if k >= 0.3])
    assert all(linked[i] == linked[g] for i, g in got.items())
    left = minhash.drop_near_duplicates(docs, scratch)
    assert left.columns == docs.columns
    kept = Counter(r.doc_id for r in left.select("doc_id").collect())
    assert kept[2000] == kept[None] == 1 and max(kept.values()) == 1
    assert set(kept) == {i for i, _ in rows} - {i for i, g in got.items() if i != g}
    assert minhash.near_duplicates(docs.where("false"), scratch).count() == 0
    assert minhash.drop_near_duplicates(docs.where("false"), scratch).count() == 0


def test_minhash_of_ids_with_several_texts(spark, scratch):
    """Of an id's texts only those go that have a copy elsewhere, and two near-copies of one id don't both stay."""
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (8, c), (9, d), (9, d + " end"), (9, d + " end"), (10, b), (None, a), (11, None), (11, "")]
    docs = crowded(table(spark, rows))
    found = minhash.near_duplicates(docs, scratch).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in found) == [(3, 3, 2), (7, 3, 2), (7, 7, 2), (9, 9, 2), (9, 9, 2), (10, 7, 2)]
    assert sorted(r.doc_id for r in found if r.keep) == [3, 7, 9]
    left = minhash.drop_near_duplicates(docs, scratch).select("doc_id", "text").collect()
    kept = Counter((r.doc_id, r.text) for r in left)
    nine = [k for k in kept if k[0] == 9]
    assert len(nine) == 1 and kept[nine[0]] == 1
    assert kept - Counter(nine) == Counter([(3, a), (7, b), (8, c), (None, a), (11, None), (11, "")])


def test_shingles_by_hand():
    w = textops.words(["A b, c-d", "", "東京 x", "a b c d"])
    assert np.diff(w.first).tolist() == [4, 0, 3, 4]
    assert w.hash[:4].tolist() == w.hash[7:].tolist()
    values, offsets = textops.shingles(w, 3)
    assert np.diff(offsets).tolist() == [2, 0, 1, 2] and values[:2].tolist() == values[3:].tolist()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    judged = quality.classify(docs, learn).join(labels.join(learn, "doc_id", "left_anti"), "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == bool(r.quality) for r in judged) >= 0.93 * len(judged)
    good = [r.keep for r in judged if r.quality]
    assert sum(good) >= 0.97 * len(good) and len(judged) > 100
    odd = crowded(table(spark, [(1, None), (2, ""), (3, "  "), (None, "the end"), (4, "x" * 300_000), (5, "a"), (5, "a")]))
    got = {(r.doc_id, r.score is None, r.keep) for r in quality.classify(odd, learn).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True)} <= got
    # no class or no rows: nothing is rejected
    assert quality.keep_good(odd, labels.where("quality = 1")).count() == 7 and quality.keep_good(odd, labels.where("false")).columns == odd.columns
    assert quality.classify(odd.where("false"), labels).count() == 0


def test_quality_against_plain_python(spark):
    """Features, log-count ratios, descent and scores, computed again one row at a time."""
    import re

    rng = random.Random(30)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice((good, bad)[i % 2] if rng.random() < 0.4 else good + bad) for _ in range(rng.randrange(5, 40))) + rng.choice([" .", "!! ??", " a a a", ""])) for i in range(120)]
    # ids with two labels have the least of them, others count for nothing
    labels = [(i, 1 - i % 2) for i in range(80)] + [(3, 1), (4, 7), (None, 1), (900, 0), (5, None)]
    docs = table(spark, rows + [(200, None), (201, "")])
    bits, size = 9, 1 << 9
    hashed = lambda tokens: [int(textops.tokens([x]).hash[0]) for x in tokens]

    def features(text):
        h = hashed(re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]+", text))
        out = {x >> 1 & size - 1 for x in h} | {int(textops.fold(np.array(x, np.uint64), 2)[0]) & size - 1 for x in zip(h, h[1:])}
        return sorted(out | ({0} if any(a == b == c for a, b, c in zip(h, h[1:], h[2:])) else set()))

    y = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and i < 120:
            y[i] = min(q, y.get(i, 1))
    learn = sorted(y)
    sets = {i: features(t) for i, t in rows}
    p, q = ([1.0 + sum(f in sets[i] for i in learn if y[i] == c) for f in range(size)] for c in (1, 0))
    ratio = [math.log(a / sum(p)) - math.log(b / sum(q)) for a, b in zip(p, q)]
    unit = {i: {f: ratio[f] / (math.sqrt(sum(ratio[g] ** 2 for g in x)) or 1.0) for f in x} for i, x in sets.items()}
    n = {c: sum(v == c for v in y.values()) for c in (0, 1)}
    weights, bias, alpha = [0.0] * size, 0.0, dict.fromkeys(learn, 0.0)
    order = np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for k in order.permutation(len(learn)).tolist():
            i = learn[k]
            s = 1 if y[i] else -1
            slope = s * (sum(weights[f] * v for f, v in unit[i].items()) + bias) - 1
            square = sum(v * v for v in unit[i].values()) + 1
            new = min(max(alpha[i] - slope / square, 0.0), len(learn) / (2 * n[y[i]]) * quality.COST)
            step, alpha[i] = (new - alpha[i]) * s, new
            for f, v in unit[i].items():
                weights[f] += step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    found = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), bits=bits).collect()}
    assert len(found) == 122 and found[200].score is None and found[200].keep and found[201].keep
    for i, x in unit.items():
        wanted = sum(weights[f] * v for f, v in x.items()) + bias
        assert abs(found[i].score - wanted) < 1e-6 and found[i].keep == (found[i].score >= quality.THRESHOLD)


def test_quality_at_the_threshold_and_in_ties(spark):
    """A score that is just the threshold is kept; equal texts have equal scores; of a tied sample the same rows are taken each time."""
    rows = [(i, f"fine words {'ok' if i % 2 else 'bad junk'} {i % 5}") for i in range(60)] + [(7, "fine words ok 2")] * 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    docs = table(spark, rows)
    scores = quality.classify(docs, labels, sample=30).collect()
    by = defaultdict(set)
    for r, t in ((r, dict(rows)[r.doc_id]) for r in scores):
        by[t].add(r.score)
    assert all(len(s) == 1 for s in by.values()) and len(scores) == 62
    again = quality.classify(docs.repartition(5), labels.repartition(3), sample=30).collect()
    assert {(r.doc_id, r.score) for r in scores} == {(r.doc_id, r.score) for r in again}
    least = min(r.score for r in scores)
    assert all(r.keep for r in quality.classify(docs, labels, threshold=least, sample=30).collect())
    assert quality.keep_good(docs, labels, threshold=least, sample=30).count() == 62


def test_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    y = np.where([x.min() < 4 for x in rows], 1.0, -1.0)
    ratios = quality.log_count_ratios(rows, y, 30, 1.0)
    w, b = quality.dual_coordinate_descent(rows, ratios, y, 1.0, 400, 1)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    dense = np.zeros((60, 31))
    for i, x in enumerate(rows):
        dense[i, x] = ratios[x] / np.sqrt((ratios[x] ** 2).sum())
    dense[:, 30] = 1

    def objective(v):
        return (v @ v) / 2 + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()

    mine = np.append(w, b)
    best = objective(mine)
    assert all(objective(mine + rng.standard_normal(31) * 0.02) > best - 1e-3 for _ in range(300))


def brute_mix(rows, weights, default, seed):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        by["" if r[2] is None else f"={r[2]}"].append(r)
    chars = {s: sum(len(r[1] or "") for r in v) for s, v in by.items()}
    weight = {s: max(0.0, weights.get(s[1:], default) if s else default) for s in by}
    used = [s for s in by if chars[s] and weight[s]]
    out = Counter()
    for s in used:
        each = math.floor(weight[s] / sum(weight[x] for x in used) * sum(chars[x] for x in used) / chars[s] * 2**32)
        at = int(md5(f"{seed}/{s}")[:8], 16)
        for r in sorted(by[s], key=lambda r: (md5("" if r[0] is None else str(r[0])), r[0] is not None, r[0] or 0, r[1] is not None, md5(r[1] or ""))):
            n = (at + each >> 32) - (at >> 32)
            at += each
            out[r] += n
    return +out


def test_mixing(spark, scratch):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, "x" * rng.randrange(0, 400), rng.choice(["src0", "src0", "src1", "src2", "other", "", None])) for i in range(600)]
    rows += rows[:20] + [(9999, None, "src0"), (9998, None, "empty"), (9997, "", "empty"), (9996, "y" * 100_000, "src1")]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    mixed = mixing.mix_sources(docs, scratch)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == brute_mix(rows, mixing.WEIGHTS, mixing.DEFAULT, mixing.SEED)
    assert mixing.mix_sources(docs.where("false"), scratch).count() == 0
    assert mixing.mix_sources(docs, scratch, {"src0": 0, "src1": -1}, 0.0).count() == 0


def test_mixing_of_a_tiny_source(spark, scratch):
    """Rows whose running sum of copies is far beyond a long, and thousands of copies of a row."""
    rows = [(i, "x", "src0") for i in range(20)] + [(100 + i, "y" * 100_000, "other") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute_mix(rows, {"src0": 1.0}, 1.0, mixing.SEED)
    assert max(want.values()) > 10_000
    got = mixing.mix_sources(docs, scratch, {"src0": 1.0}, copy_column="copy")
    assert Counter({(r.doc_id, r.text, r.source): r.n for r in got.groupBy("doc_id", "text", "source").agg(F.countDistinct("copy").alias("n")).collect()}) == want
    assert got.agg(F.max("copy")).first()[0] == max(want.values()) - 1
    rows = [(i, "x", "src0") for i in range(3000)] + [(10**6, "y" * 3_000_000, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    counted = mixing.mix_sources(docs, scratch, {"src0": 8.0}, 1.0, seed=3).groupBy("doc_id").count()
    want = {k[0]: n for k, n in brute_mix(rows, {"src0": 8.0}, 1.0, 3).items()}
    assert {r.doc_id: r["count"] for r in counted.collect()} == want


PAGES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
    ("<ol start=3><li>x</li><li value=9>y</li></ol>", "3. x\n9. y"),
    ("<table><tr><th>Name<th>N<tr><td>Ann<td>10<tr><td>Bartholomew<td>2</table>", "Name         N\nAnn          10\nBartholomew  2"),
    ("<p hidden>no</p><p style='display: none'>no</p><script>no()</script><p>yes", "yes"),
    ("<style>.x{display:none}</style><p class='a x'>no</p><b>yes</b>", "yes"),
    ("<details><summary>seen</summary>hidden</details>", "seen"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a &amp; b &lt;c&gt; &nbsp;d", "a & b <c>  d"),
    ("<head><title>t</title></head><body>x", "x"),
    ("<!-- no --> 1 < 2 <b>and</b>  3", "1 < 2 and 3"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("", ""),
    (None, None),
    ("<p", "<p"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<pre>a\n\n\n\nb</pre>c", "a\n\n\n\nb\n\nc"),
    ("<table><tr><td><pre>a\n\n\nb</pre><td>c</table>", "a  c\n\n\nb"),
    (f"<table><tr><td>{'w' * 80}<td>x<tr><td>a<td>y</table>", f"{'w' * 80}\n{' ' * 62}x\na{' ' * 61}y"),
    (f"<table><tr><td>a<td><td>b<tr><td>aa<td><td>{'v' * 90}<td>c</table>", f"a   b\naa  {'v' * 90}\n{' ' * 66}c"),
    ("<ol start=00000000000000000012><li>x<li value=12345678901>y</ol>", "12. x\n1000000000. y"),
    ("<style>@media print {.a{color:red} .n, nav {display:none}} .x,.y{display:none} .y{display:block}</style><nav>a</nav><p class=x>no<p class=y>b", "a\n\nb"),
    ("<style>p{display:none} #k{display:block} @media screen{.s{visibility:hidden}} @import url(a); .t{display:none}</style><p>no<p id=k>a<div class=s>no</div><div class=t>no</div><p style='display:block'>b", "a\n\nb"),
    ("<dialog>no</dialog>a<style>x{" , "a"),
    ("a <b title='>' <i x=\">\"", "a <b title='>' <i x=\">\""),
]


def tree(rng, depth=0):
    """A random page as nested lists: (tag, children), words, or a line break."""
    kinds = ["word"] * 4 + ["br", "span", "hidden"] + (["div", "p", "h2", "ul", "pre"] if depth < 4 else [])
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.choice(kinds)
        if kind == "word":
            out.append(f"w{rng.randrange(99)}")
        elif kind == "ul":
            out.append(("ul", [("li", [f"i{rng.randrange(9)}", ("span", tree(rng, 9))]) for _ in range(rng.randrange(1, 4))]))
        elif kind == "pre":
            out.append(("pre", "  x" + "\n" * rng.randrange(1, 5) + "y"))
        elif kind in ("p", "h2", "span", "hidden"):
            out.append((kind, tree(rng, 9)))
        else:
            out.append((kind, [] if kind == "br" else tree(rng, depth + 1)))
    return out


def markup(rng, nodes):
    """HTML of a tree; ends that are implied are left out now and then."""
    out = ""
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            out += f"{rng.choice([' ', '  ', chr(10)])}{node} "
            continue
        tag, inside = node
        after = nodes[k + 1] if k + 1 < len(nodes) else None
        if tag == "br":
            out += "<br>"
        elif tag == "pre":
            out += f"<pre>{inside}</pre>"
        elif tag == "hidden":
            out += rng.choice(["<span hidden>{}</span>", "<b style='display:none'>{}</b>", "<i class=gone>{}</i>"]).format(markup(rng, inside))
        else:
            implied = tag == "li" or tag == "p" and isinstance(after, tuple) and after[0] in ("p", "div", "h2", "ul", "pre")
            out += f"<{tag}>{markup(rng, inside)}" + ("" if implied and rng.random() < 0.5 else f"</{tag}>")
    return out


def laid_out(nodes):
    """The text of a tree, from the tree itself: items are words, forced line ends, and block edges with their margins."""
    items = []

    def walk(nodes):
        for node in nodes:
            if isinstance(node, str):
                items.append(("word", node))
            elif node[0] == "br":
                items.append(("br", None))
            elif node[0] == "pre":
                items.extend([("edge", 1), ("pre", node[1]), ("edge", 1)])
            elif node[0] == "span":
                walk(node[1])
            elif node[0] != "hidden":
                margin = 0 if node[0] in ("div", "li") else 1
                items.append(("item" if node[0] == "li" else "edge", margin))
                walk(node[1])
                items.append(("last" if node[0] == "li" else "edge", margin))

    walk(nodes)
    lines, line, margin, bullet, inside = [], [], 0, False, False

    def put(text):
        nonlocal margin, bullet
        if margin and lines:
            lines.append("")
        margin = 0
        lines.append((("- " if bullet else "  " if inside else "") + text).rstrip())
        bullet = False

    for kind, value in items:
        if kind == "word":
            line.append(value)
            continue
        if kind == "br" or line:
            put(" ".join(line))
            line = []
        if kind == "pre":
            for x in value.split("\n"):
                put(x if x else "\0")
        elif kind != "br":
            margin = max(margin, value)
            if kind == "item":
                bullet, inside = True, True
            elif kind == "last":
                bullet, inside = False, False
    if line:
        put(" ".join(line))
    out = []
    for x in lines:
        if x or not out or out[-1]:
            out.append(x)
    return "\n".join("" if x == "\0" else x for x in out).strip("\n")


def test_rendering_of_random_trees():
    rng = random.Random(21)
    for _ in range(3000):
        nodes = tree(rng)
        page = "<style>.gone{display:none}</style>" + markup(rng, nodes)
        assert rendering.render(page) == laid_out(nodes), page


def test_rendering_takes_time_as_the_page_is_long():
    import time

    began = time.monotonic()
    for page in ("<a " * 350_000, "<! " * 350_000, "<title>" + "</title " * 130_000, "<style>" + "x " * 500_000, "<a " * 350_000 + 'x=">"', "<p>" * 300_000 + "end", "&amp; " * 200_000):
        rendering.render(page)
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("page,text", PAGES)
def test_rendering(page, text):
    assert (None if page is None else rendering.render(page)) == text


def test_extract(spark):
    rows = [(i if i else None, f"u{i}" if i % 2 else None, p) for i, (p, _) in enumerate(PAGES)] + [(3, "u3", PAGES[3][0])] * 2
    pages = crowded(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = Counter((a, b, None if p is None else rendering.render(p)) for a, b, p in rows)
    assert Counter(map(tuple, rendering.extract(pages).collect())) == want
    assert rendering.extract(pages.where("false")).count() == 0


def test_passages(spark, scratch):
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (55, 60, 90, 200)]
    texts = [prose(rng, 150) for _ in range(40)]
    homes = defaultdict(list)
    for k, p in enumerate(shared):
        for i in rng.sample(range(40), 6):
            words = texts[i].split()
            at = rng.randrange(len(words))
            texts[i] = " ".join(words[:at]) + ("\n" if at % 2 else " ") + p + " " + " ".join(words[at:])
            homes[k].append(i)
    texts += [texts[0], "", "short text", f"{shared[0]} {prose(rng, 30)} {shared[0]}", prose(rng, 40_000)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (500, None), (None, texts[1])]
    docs = crowded(table(spark, rows))
    found = passages.repeated_passages(docs, scratch).collect()
    spans = defaultdict(list)
    for r in found:
        assert 0 <= r.start_char < r.end_char <= len(texts[r.doc_id]) and r.first_doc <= r.doc_id
        spans[r.doc_id].append((r.start_char, r.end_char))
    for k, own in homes.items():
        for i in own:
            a = texts[i].find(shared[k])
            if a >= 0:  # another passage may be inside by now
                inside = np.zeros(len(texts[i]), bool)
                for s, e in spans[i]:
                    inside[s:e] = True
                assert inside[a : a + len(shared[k])].mean() > 0.4, (k, i)
    clean = set(range(40)) - {i for own in homes.values() for i in own} - {0}
    assert not clean & set(spans)
    rest = passages.cut_passages(docs, scratch).collect()
    cut = {r.doc_id: r for r in rest}
    assert len(rest) == len(rows) and cut[500].text is None and cut.pop(None).text == texts[1]
    assert all(cut[i].text == texts[i] for i in clean)
    for i, r in cut.items():
        if r.text is not None and i != 500:
            gone = sorted((x.start_char, x.end_char) for x in passages_of(found, i))
            assert len(r.text) == r.n_chars and (gone or r.text == texts[i])
            assert r.text == without(texts[i], gone)
    assert passages.repeated_passages(docs.where("false"), scratch).count() == 0 and passages.cut_passages(docs.where("false"), scratch).columns == docs.columns


def passages_of(found, i):
    return [r for r in found if r.doc_id == i and r.removed]


def without(text, gone):
    out, at = "", 0
    for s, e in gone:
        out += text[at:s]
        at = e
    return out + text[at:]


def test_rules(spark, scratch):
    rng = random.Random(4)
    # more words than have a bin of their own, all differently common but for pairs of the same number
    words = {k: [f"{k}{i}" for i in range(60) for _ in range(60 - i // 2 * 2)] for k in ("en", "de")}
    rows = [(i, prose(rng, 120, words[k]), k) for i, k in enumerate(["en", "de"] * 40)]
    rows += [(500, "$$$ %%% " * 100, "en"), (501, "$", "en"), (502, None, "en"), (503, "", "de"), (None, "x y z", None), (504, prose(rng, 20_000, words["de"]), "de"), (0, *rows[0][1:])]
    rows += [(600 + i, prose(rng, 80, words["en"]), f"rare{i}") for i in range(4)] + [(700, None, "never")]
    rows += [(800 + i, t, "tie") for i, t in enumerate(["a b c d e f " * 12] * 2)]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hashed = lambda word: int(textops.words([word]).hash.view(np.int64)[0])
    split = lambda t: Counter("".join(c if c.isalnum() else " " for c in t.lower()).split())

    def distance(p, q):
        p, q = ({x: n / max(1, sum(c.values())) for x, n in c.items()} for c in (p, q))
        m = {x: (p.get(x, 0) + q.get(x, 0)) / 2 for x in {*p, *q}}
        return math.sqrt(max(0, sum(v * math.log2(v / m[x]) / 2 for d in (p, q) for x, v in d.items() if v)))

    for common, languages in ((rules.COMMON, rules.LANGUAGES), (rules.COMMON, 2), (3, 1)):
        got = rules.judge(docs, scratch, common=common, languages=languages).collect()
        refs = {}
        for k in {r[2] or "" for r in rows}:
            own = [t for _, t, lang in rows if t is not None and (lang or "") == k]
            counts = sum(map(split, own), Counter())
            top = set(sorted(counts, key=lambda x: (-counts[x], hashed(x)))[:common])
            refs[k] = sum((Counter(map(rules.char_class, t)) for t in own), Counter()), counts, top
        texts = {(r[0], r[2]): r[1] for r in rows}
        assert Counter((r.doc_id, r.lang) for r in got) == Counter((i, k) for i, _, k in rows)
        seen, compared = {}, 0
        for r in got:
            t = texts[r.doc_id, r.lang]
            seen[r.doc_id] = r.keep
            if not t:
                assert r.char_distance is None and r.word_distance is None and r.keep
                continue
            chars, counts, top = refs[r.lang or ""]
            assert abs(r.char_distance - distance(Counter(map(rules.char_class, t)), chars)) < 1e-6
            binned = lambda c: Counter({w: n for w, n in c.items() if w in top}) + Counter({None: sum(n for w, n in c.items() if w not in top)})
            own = split(t)
            if own:
                compared += 1
                assert abs(r.word_distance - distance(binned(own), binned(counts))) < 1e-6
            else:
                assert r.word_distance is None
            over = r.char_distance > rules.CHAR_LIMIT and len(t) >= rules.MIN_CHARS or bool(own) and r.word_distance > rules.WORD_LIMIT and sum(own.values()) >= rules.MIN_WORDS
            assert r.keep == (not over)
        assert compared > 80 and not seen[500] and seen[501] and seen[None]
    assert rules.judge(docs.where("false"), scratch).count() == 0


NASTY = ["", " ", "   lead", "trail   ", "a'b'll it's", "naïve café", "日本語テキスト", "🙂🙃 emoji", "x" * 5000, "ab" * 3000, "\n\n\t x \r\n", "<|endoftext|>", "12345 67", "the " * 400, "aaaaaaa" * 9, "́combining", "!!!???...", "\x00\x01"]


def tokenizer():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_against_a_known_tokenizer(spark, scratch):
    t = tokenizer()
    rng = random.Random(6)
    texts = NASTY + ["".join(rng.choice("ab cdeXYZ01 .,é漢") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (900, None), (None, "a b")]
    docs = crowded(table(spark, rows))
    want = {i: None if x is None else t.encode_ordinary(x) for i, x in rows}
    counted = bpe.count_tokens(docs).collect()
    assert len(counted) == len(rows) and all(r.n_tokens == (None if want[r.doc_id] is None else len(want[r.doc_id])) for r in counted)
    got = encoding.encode(docs, scratch)
    assert got.columns == [*docs.columns, "token_ids"]
    got = got.select("doc_id", "token_ids").collect()
    assert len(got) == len(rows) and all(r.token_ids == want[r.doc_id] for r in got)
    back = Counter((r.doc_id, r.text) for r in encoding.round_trip(docs, Scratch(spark)).collect())
    assert back == Counter(rows)
    assert encoding.round_trip(docs.where("false"), Scratch(spark)).count() == 0 and bpe.count_tokens(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(1, [10**7, None, -1, 64]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in encoding.decode(odd).collect()} == {1: t.decode([64]), 2: None, 3: ""}


def test_whole_table_of_tokens(spark):
    t = tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encoding.round_trip(docs, Scratch(spark)).collect():
        assert r.text == texts[r.doc_id] and r.token_ids == t.encode_ordinary(r.text)


def test_encoding_in_other_splits(spark, scratch, monkeypatch):
    """Blocks are those that were saved, however the documents are split when they are read again."""
    t = tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(encoding, "BLOCK", 50_000)
    monkeypatch.setattr(encoding, "BUCKET", 3_000)
    monkeypatch.setattr(encoding, "LONG", 2_000)
    monkeypatch.setattr(encoding, "EMIT", 1_000)
    spark.conf.set("spark.sql.files.minPartitionNum", "9")
    try:
        encoded = encoding.encode(docs, scratch)
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        rows = encoding.decode(encoded.withColumnRenamed("text", "before"), to="after", keep_ids=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(rows) == docs.count() and all(r.before == r.after and r.token_ids == t.encode_ordinary(r.before) for r in rows)


def test_one_word_everywhere(spark, scratch):
    """A third of all words the same, one text of a million words, only nulls in a block, and a column of lists."""
    t = tokenizer()
    rows = [(i, [i], "the the the rare%d" % i if i % 3 else None, {"a": i}) for i in range(300)] + [(1000, None, "the " * 1_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tags array<int>, text string, more map<string,int>")
    found = {r.doc_id: r for r in encoding.encode(docs, scratch, keep=["doc_id", "tags", "more"]).collect()}
    assert len(found) == len(rows)
    assert all((found[i].tags, found[i].more) == (tags, more) and found[i].token_ids == (None if text is None else t.encode_ordinary(text)) for i, tags, text, more in rows)
    nothing = encoding.encode(docs.where("text IS NULL"), scratch, keep=[]).collect()
    assert len(nothing) == 100 and all(r.token_ids is None for r in nothing)


def record(block, extra=""):
    return f"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 5\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    trap = record(b"HTTP/1.1 200 OK\r\n\r\ninner").decode()
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", rng.choice(["", trap, trap * 3, "WARC/1.0\r\n\r\n", "é" * rng.randrange(3000), "\r\n\r\nplain"])) for i in range(120)]
    rows += [(None, "http://none", "a"), (500, None, "b"), (501, "http://null", None), rows[3], rows[3], (502, "http://long", trap * 4000)]
    pages = crowded(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for size in (700, 5000, warc.RANGE):
        scratch = Scratch(spark)
        assert Counter(map(tuple, warc.round_trip(pages.repartition(3), scratch, size).collect())) == Counter(rows)
        scratch.release()
    assert warc.round_trip(pages.where("false"), Scratch(spark)).count() == 0
    body = b"HTTP/1.1 200 OK\r\n\r\n" + record(b"HTTP/1.1 200 OK\r\n\r\ninner")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(body)) for _ in range(20)))
    (tmp_path / "broken.warc").write_bytes(record(body) + b"junk" + record(body))
    (tmp_path / "none.warc").write_bytes(b"no record here" + record(body))
    got = Counter(r.file.rpartition("/")[2] for r in warc.read(spark, f"file://{tmp_path}", Scratch(spark), 100).collect())
    assert got == {"a.warc.gz": 20, "broken.warc": 1}
