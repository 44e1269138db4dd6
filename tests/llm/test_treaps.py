"""Inverted treaps against plain scoring, on small tables with ties, nulls, repeats, long texts and odd characters."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id long, term string, score long"
ITEMS = "item_id long, text string, doc string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, k):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n, total = len(found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, words in found:
            tf, m = Counter(words), 75 + 25 * len(words) * n // total
            score = sum(w[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score:
                scored.append((-score, 2**63 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def tables(seed, n=300):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(40)] + ["É", "日本", "a"]
    share = 1 / np.arange(1, len(names) + 1)
    prose = lambda m: " ".join(rng.choice(names, m, p=share / share.sum()))
    texts = [prose(int(rng.integers(1, 40))) for _ in range(n)]
    texts += [texts[3]] * 30 + [None, "", " .,- ", "W1 w1_W1;w1", "x\x7fy é É \x00a", prose(5000), texts[5]]
    ids = [*rng.permutation(n).tolist(), *range(n, n + 30), *range(1000, 1006), 5]
    ids[7] = ids[8] = None
    items = [(0, prose(12)), (1, "w0"), (2, "W0 w0, w0 nowhere"), (3, None), (4, ""), (5, "nowhere"), (None, prose(4)), (1, "w0"), (6, "日本é w39-w39 É"), (7, prose(2000))]
    return items, list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("k", [1, 20])
def test_search_is_plain_scoring(spark, monkeypatch, k):
    monkeypatch.setattr(treaps, "SHARD_DOCS", 17)
    monkeypatch.setattr(treaps, "UNIT_WORDS", 2000)
    monkeypatch.setattr(treaps, "BLOCK", 3)
    items, docs = tables(1)
    # columns of the other table's names do no harm
    d = spark.createDataFrame([(i, t, 1, "t", 2) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = sorted([tuple(r) for r in treaps.search(q, d, k).collect()], key=repr)
    assert got == plain(items, docs, k)


def test_search_of_nothing(spark):
    items, docs = tables(2, 12)
    d, q = spark.createDataFrame([(i, t, 1, "t", 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert treaps.search(q.limit(0), d).collect() == treaps.search(q, d.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, 1, "", 1), (2, " - ", 1, "", 1)], DOCS)
    assert treaps.search(q, blank).collect() == []


def unit(seed, n=4000):
    rng = np.random.default_rng(seed)
    parts = []
    for share in (0.6, 0.3, 0.02, 0.01):
        rows = np.flatnonzero(rng.random(n) < share)
        p = np.zeros(len(rows), treaps.POSTING)
        p["doc"], p["row"], p["n"], p["tf"] = n - rows // 2, rows, 50 + rows % 300, rng.integers(1, 6, len(rows))
        parts.append(p)
    return treaps.Treaps(parts, n, 200 * n), parts


def test_treaps_are_search_trees_and_heaps():
    t, _ = unit(3)

    def walk(v, lo, hi):
        if v < 0:
            return 0
        assert lo < t.place[v] < hi
        for child in (t.left[v], t.right[v]):
            assert child < 0 or t.impact[child] <= t.impact[v]
        return 1 + walk(t.left[v], lo, t.place[v]) + walk(t.right[v], t.place[v], hi)

    assert sum(walk(r, -1, len(t.docs)) for r in t.roots) == len(t.place)


def test_traversal_prunes():
    t, parts = unit(4)
    weights = np.array([10, 300, 4000, 5000])
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    scores, docs = t.best(np.arange(4), weights, 10, none)
    score = np.zeros(len(t.docs), np.int64)
    for k in range(4):
        of = np.flatnonzero(t.key >> 32 == k)
        score[t.place[of]] += weights[k] * t.impact[of]
    order = np.lexsort((t.docs, -score))[:10]
    assert scores.tolist() == score[order].tolist() and docs.tolist() == t.docs[order].tolist()
    # most documents lie in ranges that are left out whole
    assert t.scored < len(t.docs) / 5
    before = t.scored
    # with ten other documents known beforehand
    assert t.best(np.arange(4), weights, 10, (scores, docs - 10**6))[0].tolist() == sorted([*scores, *scores], reverse=True)[:10]
    assert t.scored - before < before


def test_treap_of_equal_impacts_is_not_deep():
    p = np.zeros(20_000, treaps.POSTING)
    p["doc"] = p["row"] = np.arange(20_000)
    p["n"], p["tf"] = 10, 1
    t = treaps.Treaps([p], 20_000, 200_000)
    level, depth = [t.roots[0]], 0
    while level:
        level, depth = [c for v in level for c in (t.left[v], t.right[v]) if c >= 0], depth + 1
    assert depth < 60
