"""Fast similarity sketching: sketches by their definition, and near-duplicates against all pairs."""

import numpy as np
import pytest

from quernstone.llm import sketches

SCHEMA = "doc_id long, text string, uid long, n string, bands string"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def all_pairs(docs):
    """component and set size of each row."""
    found = [sets(t) for _, t in docs]
    root = list(range(len(docs)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[of(i)] = of(j)
    key = lambda i: 2**63 - 1 if docs[i][0] is None else docs[i][0]
    least = {}
    for i in range(len(docs)):
        least[of(i)] = min(least.get(of(i), 2**63 - 1), key(i))
    return sorted([(docs[i][0], len(found[i]), None if least[of(i)] == 2**63 - 1 else least[of(i)], key(i) == least[of(i)]) for i in range(len(docs))], key=repr)


def corpus(seed):
    rng = np.random.default_rng(seed)
    names = np.array([f"w{i}" for i in range(60)])
    prose = lambda m: list(rng.choice(names, m))
    texts = []
    for _ in range(25):
        base = prose(int(rng.integers(2, 120)))
        texts.append(base)
        for _ in range(int(rng.integers(0, 9))):
            # copies with some words changed: on both sides of the bound
            new = list(texts[-1])
            for at in rng.integers(0, len(new), int(rng.integers(0, 1 + len(new) // 12))):
                new[at] = names[rng.integers(60)]
            texts.append(new)
    texts = [" ".join(t) for t in texts]
    texts += [None, "", " \n\x0b", "one", "One", "one two", "ONE\ttwo ", "two one", "é é", "É é", "x\x1cy z", "x\x1cy z", " ".join(prose(20_000))]
    # one word of a set of five differs: 4 / 6, one of a set of nine: exactly 8 / 10 where a last word is another
    texts += ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f", "a b c d e g"]
    ids = rng.permutation(len(texts)).tolist()
    ids[2] = ids[3] = None
    ids[10] = ids[11]
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed, fragment", [(1, 256), (2, 1)])
def test_near_duplicates_are_all_pairs(spark, seed, fragment):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "n", "b") for i, t in docs], SCHEMA).repartition(3)
    got = sketches.near_duplicates(df, fragment=fragment)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == all_pairs(docs)
    assert sketches.near_duplicates(df.limit(0)).collect() == []


def test_bound_is_sharp(spark):
    # 8 of 10 shingles are shared: linked; 7 of 9 are not
    docs = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "p q r s t u v w x"), (4, "p q r s t u v w y")]
    got = {r.doc_id: r.component_id for r in sketches.near_duplicates(spark.createDataFrame([(*d, 1, "", "") for d in docs], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("n", [1, 2, 7, 40, 500, 5000])
def test_sketch_by_rounds(n):
    elements = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    size, u = sketches.SIZE, np.uint64
    want = [None] * size
    for i in range(2 * size):
        if None not in want:
            break
        hashed = sketches._mixed(elements + np.array([i + 1], u) * sketches._A)
        bins = sketches._mixed(hashed + sketches._B) % u(size) if i < size else np.full(n, i % size, u)
        for h, b in zip(hashed.tolist(), bins.tolist(), strict=True):
            v = i << 55 | h >> 9
            # a coordinate that an earlier round filled stays
            if want[b] is None or want[b] >> 55 == i and v < want[b]:
                want[b] = v
    assert sketches.sketch(elements).tolist() == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = pool[:250], pool[50:]  # 200 of 300
        errors.append((sketches.sketch(a) == sketches.sketch(b)).mean() - 2 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.3 * (2 / 9 / sketches.SIZE) ** 0.5


def test_recall_of_bands():
    rng = np.random.default_rng(6)
    for n in (9, 18, 180):
        for _ in range(200):
            k = n // 9
            # n - k of n + k: a similarity of 0.8
            pool = rng.integers(0, 2**63, n + k).astype(np.uint64)
            a, b = (sketches.sketch(x).astype(np.uint8) for x in (pool[:n], pool[k:]))
            assert (a == b).reshape(-1, sketches.ROWS).all(1).any() and (a == b).sum() >= sketches.ENOUGH


def test_strays_meet_every_other_cluster(spark):
    # two buckets: one of three clusters, one of a single cluster; one set has another sketch
    rows = [(1, 10, i, 0 if i < 30 else i % 2 + 1) for i in range(40)] + [(2, 10, i, 0) for i in range(30)]
    # the same sets meet in a later band, too, and are no pairs there
    buckets = spark.createDataFrame([(k, 10 * k + r[0], *r[1:]) for r in rows for k in (0, 3)], "k int, band long, n long, node long, root long")
    nodes = spark.createDataFrame([(i, bytes([7 * (i == 33)]) * sketches.SIZE) for i in range(40)], "node long, sketch binary")
    root = {node: r for band, _, node, r in rows if band == 1}
    for fragment in (1, 3, 256):
        got = [tuple(r) for r in sketches.across(buckets, nodes, fragment).collect()]
        assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40) if root[a] != root[b] and 33 not in (a, b)]


def test_neighbours(spark):
    # five alike in a bucket, of which the last is too large, and one that is unlike the others
    rows = [(1, n, i, bytes([i == 2]) * sketches.SIZE) for i, n in enumerate([10, 10, 10, 11, 11, 20])] + [(2, 20, 5, bytes(sketches.SIZE)), (2, 21, 6, bytes(sketches.SIZE))]
    got = sketches.neighbours(spark.createDataFrame(rows, "band long, n long, node long, sketch binary").repartition(3))
    assert sorted(map(tuple, got.coalesce(1).collect())) in ([(0, 1), (3, 4), (5, 6)], [(0, 1), (5, 6)], [(3, 4), (5, 6)])


def test_sets_just_under_the_bound_are_no_candidates(spark):
    # 60 near copies of one text, each with 16 of 180 elements of its own: a similarity of about 0.7, which sketches alone let through
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 180).astype(np.uint64)
    sets_of = []
    for _ in range(60):
        new = base.copy()
        new[rng.choice(180, 16, replace=False)] = rng.integers(0, 2**63, 16).astype(np.uint64)
        sets_of.append(np.unique(new))
    sets_of.append(np.concatenate([sets_of[7][:-1], base[:1] + np.uint64(1)]))  # but for one element a copy
    coordinates = [sketches.sketch(s).astype(np.uint8) for s in sets_of]
    linked = {(i, j) for i in range(61) for j in range(i + 1, 61) if 9 * len(np.intersect1d(sets_of[i], sets_of[j])) >= 4 * (len(sets_of[i]) + len(sets_of[j]))}
    passed = sum(bool(sketches._alike(coordinates[i], coordinates[j])) for i in range(61) for j in range(i + 1, 61))
    nodes = spark.createDataFrame([(i, c.tobytes() + sketches.parities(s).tobytes()) for i, (c, s) in enumerate(zip(coordinates, sets_of, strict=True))], "node long, sketch binary")
    rows = [(k, int.from_bytes(bytes([k, *c[5 * k : 5 * k + 5].tolist()])), len(s), i, i) for i, (c, s) in enumerate(zip(coordinates, sets_of, strict=True)) for k in range(48)]
    got = {tuple(r) for r in sketches.across(spark.createDataFrame(rows, "k int, band long, n long, node long, root long"), nodes).collect()}
    assert (7, 60) in linked and linked <= got and passed > 1000 and len(got) < len(linked) + 100


@pytest.mark.parametrize("n", [1, 9, 180, 5000])
def test_parities_are_a_lower_bound(n):
    rng = np.random.default_rng(n)
    for k in (0, 1, n // 9, n // 4, n):
        pool = rng.integers(0, 2**63, n + k).astype(np.uint64)
        x, y = (sketches.parities(s).view(np.uint64) for s in (pool[:n], pool[k:]))
        assert np.bitwise_count(x ^ y).sum() <= 2 * k
        assert sketches._near(np.int64(2 * n), x, y) or 18 * k > 2 * n
