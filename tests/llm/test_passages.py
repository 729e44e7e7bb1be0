"""Repeated passages against brute force over paragraphs and words."""

import random

import numpy as np

from plumbline.llm import passages, textops
from plumbline.llm.common import Scratch

from .test_corpus_operators import SCHEMA, crowded, prose, table, union_find


def edited(rng, text, every):
    """text with one word in each run of ``every`` replaced."""
    words = text.split()
    for a in range(0, len(words), every):
        words[rng.randrange(a, min(a + every, len(words)))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_edited_passages_are_found(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(300):
        p = prose(rng, 60)
        texts += [f"{prose(rng, 40)} {x} {prose(rng, 40)}" for x in (p, edited(rng, p, 20))]
    w, at, text = passages._paragraphs(texts, passages.LENGTH, passages.WINDOW)
    runs = textops.fold(w.hash, passages.SHINGLE)
    sets = [set(runs[a : a + passages.LENGTH - passages.SHINGLE + 1].tolist()) for a in at.tolist()]
    by_doc = {}
    for i, d in enumerate(text.tolist()):
        by_doc.setdefault(d, []).append(i)
    # only the two copies of a passage share words in order
    pairs = [(i, j) for d in range(0, len(texts), 2) for i in by_doc.get(d, []) for j in by_doc.get(d + 1, []) if sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= passages.THRESHOLD]
    assert len(pairs) > 300
    cluster = {(r.doc_id, r.s): r.cluster for r in passages.occurrences(table(spark, list(enumerate(texts))), Scratch(spark)).collect()}
    place = lambda i: (int(text[i]), int(w.start[at[i]]))
    found = sum(place(i) in cluster and cluster[place(i)] == cluster.get(place(j)) for i, j in pairs)
    print("recall", found / len(pairs), len(pairs))
    assert found / len(pairs) >= 0.9


def test_loops_are_found(spark):
    rng = random.Random(13)
    texts, loops = [], []
    for k in range(80):
        loop = " ".join([f"loop{k}x{j}" for j in range(k % 4 + 1)] * (200 // (k % 4 + 1)))
        loops += [loop] * 2
        texts += [f"{prose(rng, 50)} {loop} {prose(rng, 50)}" for _ in range(2)]
    spans = {}
    for r in passages.repeated_passages(table(spark, list(enumerate(texts))), Scratch(spark)).collect():
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    shares = []
    for i, (t, loop) in enumerate(zip(texts, loops)):
        a = t.find(loop)
        inside = np.zeros(len(t), bool)
        for s, e in spans.get(i, []):
            inside[s:e] = True
        shares.append(inside[a : a + len(loop)].mean())
    print("loops", np.mean(shares), min(shares))
    assert min(shares) > 0.7
    w, at, text = passages._paragraphs(["a " * 100, "a " * 24, "a", "", "0 1 " * 5000], passages.LENGTH, passages.WINDOW)
    assert len(at) and (at + passages.LENGTH <= w.first[text + 1]).all() and (np.diff(at) >= passages.LENGTH).all() and {0, 1, 4} >= set(text.tolist()) >= {0, 4}


def test_passages_are_cut_to_their_ends(spark):
    rng = random.Random(14)
    texts, own = [], []
    for n in (51, 60, 90, 200) * 20:
        p = prose(rng, n)
        texts += [f"{prose(rng, 40)} {p} {prose(rng, 40)}" for _ in range(2)]
        own += [p] * 2
    spans = {}
    for r in passages.repeated_passages(table(spark, list(enumerate(texts))), Scratch(spark)).collect():
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    inside = beside = 0
    shares = []
    for i, (t, p) in enumerate(zip(texts, own)):
        a, covered = t.find(p), np.zeros(len(t), bool)
        for s, e in spans.get(i, []):
            covered[s:e] = True
        shares.append(covered[a : a + len(p)].mean())
        beside += covered[:a].sum() + covered[a + len(p) :].sum()
        inside += covered.sum()
    print("coverage", np.mean(shares), min(shares), beside, inside)
    assert min(shares) > 0.95 and beside < 0.02 * inside


def test_bands_have_their_recall():
    assert passages.recall(passages.THRESHOLD) >= 0.95
    rng = np.random.default_rng(1)
    found = many = 0
    for _ in range(300):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 24)]
        other = list(words)
        other[rng.integers(3, 21)] = "changed"
        w = textops.words([" ".join(words), " ".join(other)])
        keys = passages.band_keys(w, np.array([0, 24]), 24, 3, passages.BANDS, passages.ROWS, passages.SEED)
        a, b = ({tuple(x[i : i + 3]) for i in range(22)} for x in (words, other))
        assert len(a & b) / len(a | b) >= passages.THRESHOLD
        found += (keys[0] == keys[1]).any()
        many += 1
    assert found >= 0.95 * many


def test_every_window_has_a_start():
    rng = random.Random(15)
    texts = [prose(rng, n) for n in (0, 1, 23, 24, 25, 40, 50, 51, 52, 80, 400)] + ["a " * n for n in (24, 51, 60, 200)] + ["a b " * 90, "x " * 60 + prose(rng, 60) + " x" * 70, " ".join(f"{prose(rng, 3)} same same" for _ in range(80))]
    w, at, text = passages._paragraphs(texts, passages.LENGTH, passages.WINDOW)
    for i in range(len(texts)):
        valid = max(0, w.first[i + 1] - w.first[i] - passages.LENGTH + 1)
        own = (at[text == i] - w.first[i]).tolist()
        assert bool(own) == (valid > 0) and all(0 <= a < valid for a in own)
        assert all(any(s <= a < s + passages.WINDOW for a in own) for s in range(valid - passages.WINDOW + 1)), texts[i]
    # the same passage is cut alike, whatever is around it
    p = prose(rng, 51)
    w, at, text = passages._paragraphs([f"{prose(rng, a)} {p} {prose(rng, b)}" for a, b in ((0, 90), (70, 0), (33, 44), (5, 200))], passages.LENGTH, passages.WINDOW)
    starts = [{int(x) - int(w.first[i]) - lead for x in at[text == i]} for i, lead in enumerate((0, 70, 33, 5))]
    assert set.intersection(*starts) & set(range(28))


def test_clusters_against_all_pairs(spark):
    """Clusters of paragraphs and those that all pairs make by the exact similarity of their words."""
    rng = random.Random(16)
    texts = []
    for _ in range(40):
        p = prose(rng, 70)
        texts += [f"{prose(rng, 20)} {p} {prose(rng, 20)}", f"{prose(rng, 30)} {edited(rng, p, 23)} {prose(rng, 9)}", p if rng.random() < 0.5 else prose(rng, 60)]
    loop = "la li lu " * 30
    texts += [loop, f"{prose(rng, 10)} {loop}", f"{texts[0]} {texts[0]}"]
    w, at, text = passages._paragraphs(texts, passages.LENGTH, passages.WINDOW)
    places = [(int(text[i]), int(w.start[at[i]]), int(w.end[at[i] + passages.LENGTH - 1])) for i in range(len(at))]
    words = [tuple(texts[d][s:e].lower().split()) for d, s, e in places]
    sets = [{x[i : i + 3] for i in range(len(x) - 2)} for x in words]
    first = {}
    for p, x in sorted(zip(places, words)):
        first.setdefault(x, p)

    def beside(x, y):
        (d, s, e), (d2, s2, e2) = first[x], first[y]
        return d == d2 and s < e2 and s2 < e

    near = [(i, j) for i in range(len(at)) for j in range(i) if words[i] == words[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= passages.THRESHOLD and not beside(words[i], words[j])]
    wanted = union_find(range(len(at)), near)
    found = {(r.doc_id, r.s): r for r in passages.occurrences(table(spark, list(enumerate(texts))), Scratch(spark), block=8).collect()}
    number = {p[:2]: i for i, p in enumerate(places)}
    by = {}
    for k, r in found.items():
        by.setdefault(r.cluster, []).append(number[k])
    assert all(len({wanted[i] for i in own}) == 1 for own in by.values())
    cluster = {number[k]: r.cluster for k, r in found.items()}
    hit = [i in cluster and cluster[i] == cluster.get(j) for i, j in near]
    assert len(near) > 100 and sum(hit) >= 0.95 * len(hit)
    assert all(i in cluster and cluster[i] == cluster.get(j) for i, j in near if words[i] == words[j])
    for own in by.values():
        # all but the first are removed
        assert [not found[places[i][:2]].removed for i in sorted(own, key=lambda i: places[i])] == [True] + [False] * (len(own) - 1)


def test_forests_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 2, 3, 7, 40, 1, 120]
    starts = np.append(0, np.cumsum(sizes))
    value = rng.integers(0, 60, starts[-1])
    close = lambda i, j: np.abs(value[i] - value[j]) <= 1
    group = np.repeat(np.arange(len(sizes)), sizes)
    edges = [(i, j) for i in range(starts[-1]) for j in range(i) if group[i] == group[j] and close(i, j)]
    u, v = passages.forests(starts, close)
    assert union_find(range(starts[-1]), edges) == union_find(range(starts[-1]), list(zip(u.tolist(), v.tolist()))) and len(u) < starts[-1]
    assert (group[u] == group[v]).all() and close(u, v).all()
    assert len(passages.forests(np.array([0]), close)[0]) == 0


def test_rows_that_share_an_id_and_words_of_any_length(spark):
    rng = random.Random(17)
    shared, other = prose(rng, 80), "OTHER " + prose(rng, 120)
    long = f"{prose(rng, 15)} {'x' * 1_200_000} {prose(rng, 40)}"
    rows = [(1, f"{prose(rng, 40)} {shared}"), (2, f"{shared} {prose(rng, 40)}"), (2, other), (2, f"{shared} {prose(rng, 40)}"[:0] or None), (3, f"{prose(rng, 30)} {long}"), (4, f"{long} {prose(rng, 30)}"), (None, shared), (5, "")]
    docs = crowded(table(spark, rows))
    left = passages.cut_passages(docs, Scratch(spark)).select("doc_id", "text", "n_chars").collect()
    assert len(left) == len(rows)
    texts = {}
    for r in left:
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.text is None or len(r.text) == r.n_chars
    assert other in texts[2] and None in texts[2] and texts[None] == [shared] and texts[5] == [""]
    assert all(shared not in (t or "") for t in texts[2]) and texts[1] == [rows[0][1]]
    # the passage goes whole, with its long word
    assert texts[3] == [rows[4][1]] and len(texts[4][0]) < 400


def test_one_paragraph_in_very_many_versions(spark):
    """A hot key: hundreds of different near-copies of a paragraph share it, over many blocks."""
    rng = random.Random(18)
    words = prose(rng, 60).split()
    texts = []
    for i in range(900):
        own = list(words)
        own[rng.randrange(5, 55)] = f"version{i}"
        texts.append(" ".join(own))
    rows = passages.occurrences(table(spark, list(enumerate(texts))), Scratch(spark), block=32).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.cluster)
    assert len(by) == 900 and max(map(len, by.values())) <= 6
    counts = {}
    for own in by.values():
        for c in own:
            counts[c] = counts.get(c, 0) + 1
    assert max(counts.values()) > 720


def test_no_documents_and_no_passages(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "src0", 5)], SCHEMA)
    assert passages.repeated_passages(docs, Scratch(spark)).count() == 0
    assert [r.text for r in passages.cut_passages(docs, Scratch(spark)).collect()] == ["a b c"]


def test_keys_that_are_too_many_to_broadcast(spark, monkeypatch):
    rng = random.Random(19)
    p = prose(rng, 60)
    docs = table(spark, list(enumerate([f"{prose(rng, 20)} {x} {prose(rng, 20)}" for x in (p, edited(rng, p, 23), p, prose(rng, 60))])))
    found = []
    for few in (passages.FEW, -1):
        monkeypatch.setattr(passages, "FEW", few)
        found.append(sorted(map(tuple, passages.occurrences(docs, Scratch(spark)).select("cluster", "doc_id", "s", "e", "removed").collect())))
    assert found[0] and found[0] == found[1]
