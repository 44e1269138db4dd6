"""The pipeline: its contract, and its stages against brute force on a small corpus."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from quernstone.llm import near, simhash

WORDS = [("word" if i % 3 else "wort") + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    notice = "This notice stands below many of the documents of this collection and says that " + prose(77, 45)
    rows = []
    for i in range(60):
        text = "\n".join(prose(1000 + 10 * i + k, 40) for k in range(3))
        rows.append((i, f"{text}\n{notice}" if i % 3 == 0 else text, "en", f"s{i % 4}", 0))
    rows += [(100 + i, rows[5][1], "en", "s1", 0) for i in range(5)]  # copies
    rows += [(200, "too short", "en", "s1", 0), (201, None, "en", None, 0), (202, prose(5, 12) * 9, "en", "s2", 0)]
    rows += [(300 + i, " ".join(f"{w}$$$" for w in prose(i, 120).split()), "en", "s3", 0) for i in range(12)]  # junk
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return str(d), {r[0]: r for r in rows}, notice


def test_stages(spark, folder, tmp_path):
    d, rows, notice = folder
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_level_bpe"]
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        assert name == "byte_level_bpe" or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r.asDict() for r in docs.collect()])
    quality, lines, near, mixed, coded = seen
    ids = lambda part: {r["doc_id"] for r in part}
    assert ids(quality) == {i for i in rows if i < 200}  # short, null, repeating and junk documents go; no clean one does
    with_notice = [r["doc_id"] for r in lines if notice in r["text"]]
    assert with_notice == [0] and ids(lines) == set(range(60))  # the copies' lines all belong to document 5
    assert all(r["text"] == rows[r["doc_id"]][1] for r in lines if r["doc_id"] % 3)
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in lines}
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in ids(near) for b in ids(near) if a < b)
    assert ids(near) == set(range(60))
    assert ids(mixed) <= ids(near) and len(mixed) <= 3 * len(near)
    texts = {r["doc_id"]: r["text"] for r in near}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in coded) == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed)


def test_near_dedup_keeps_one(spark, folder):
    d, rows, _ = folder
    docs = spark.createDataFrame([rows[5], *(rows[100 + i] for i in range(5)), rows[7], rows[201], (None, "a null id", "en", "s", 0), rows[7]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in P.near_dedup(spark, docs, d).collect()) == [(False, 5), (False, 7), (False, 201), (True, 0)]


def test_run(spark, folder):
    got = P.run(spark, folder[0])
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns) and got.count() > 0


def test_stages_lose_no_row(spark, folder):
    """Null ids, equal ids with different texts, repeated rows and a lone label: nothing goes that has no copy elsewhere."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [prose(400 + i, 40) for i in range(6)]
    rows = [(None, texts[0], "en", "s", 1), (None, texts[1], "en", None, 1), (7, texts[2], "en", "s", 1), (7, texts[3], "en", "s", 1), (8, texts[4], "en", "s", 1), (8, texts[4], "fr", "s", 2), (9, texts[5], None, "s", None)]
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    assert sorted(map(str, (tuple(r) for r in P.near_dedup(spark, docs, folder[0]).collect()))) == sorted(str(r) for r in rows if r[2] != "fr")
    assert {r.text for r in P.line_dedup(spark, docs, folder[0]).collect()} == set(texts)
    assert {tuple(r) for r in P.mixing_sources(spark, docs, folder[0]).collect()} <= set(rows)
    assert {tuple(r) for r in P.quality_rules(spark, docs, folder[0]).collect()} <= set(rows)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_against_brute_force(spark, folder):
    rng = np.random.default_rng(3)
    texts = [prose(9000 + i, int(rng.integers(3, 160))) for i in range(60)] + ["", None, " ", "a b", "A  b"]
    for i in range(90):  # copies of copies with edited words: chains, and pairs on either side of the rule
        words = (texts[int(rng.integers(0, len(texts)))] or "x").split() or ["x"]
        for _ in range(int(rng.integers(1, 4))):
            words[int(rng.integers(0, len(words)))] = WORDS[int(rng.integers(0, 300))]
        texts.append(" ".join(words))
    base = prose(77, 150).split()
    for i in range(60):  # a large group around one text
        texts.append(" ".join([*base[: 2 * i], WORDS[i], *base[2 * i + 1 :]]))
    passage = prose(78, 40)
    texts += [f"{prose(7000 + i, 60)} {passage}" for i in range(50)]  # a common passage in texts that differ

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def up(x):
        return x if root[x] == x else up(root[x])

    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((up(a), up(b)))
                root[y] = x
    want = [i for i in range(len(texts)) if up(i) == i]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert len(want) < 200 and sorted(r.doc_id for r in P.near_dedup(spark, docs, folder[0]).collect()) == want
    for wide in (2, 8):  # large runs are paired in two passes
        got = near.near_duplicates(docs, wide=wide)
        assert {r.key: r.component for r in got.collect()} == {i: up(i) for i in range(len(texts))}


def test_near_dedup_counts_every_shingle():
    """Hashes of texts' shingles, made for many texts at once, meet as the shingles do."""
    odd = ["", " ", "a b", "A  b", "\ta\nb ", "ab", "a", "b a", "a b c d e", "A b\x0bC d e", "é b c d e", "É b c d e", "x" * 3000, "x" * 3001, "a b c d e f", "a b c d e a b c d e a b c d e"]

    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    made = [set(x.tolist()) for x in near.shingles(pa.array(odd))]
    alone = [set(near.shingles(pa.array(["zz", t, "q"], pa.large_string()))[1].tolist()) for t in odd]
    assert made == alone and all(len(a & b) == len(grams(x) & grams(y)) for a, x in zip(made, odd, strict=True) for b, y in zip(made, odd, strict=True))
    assert near.shingles(pa.array([], pa.string())) == []


def test_common_shingles_cost_no_more_with_their_number(spark):
    """As many as there may be of a large table took milliseconds a text."""
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(2000)], "doc_id long, text string").repartition(1).cache()
    docs.count()

    def took(common):
        began = time.time()
        assert near.prefixes(docs, common=common).count() > 0
        return time.time() - began

    none = np.empty(0, np.int64)
    took(none)
    assert took(np.sort(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, near.COMMON))) < 3 * took(none) + 1
