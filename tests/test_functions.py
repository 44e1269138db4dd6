"""Small fixtures worked out by hand."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import assemble, dedup, extract, gates, generate, numbering, packing, retrieval, scoring
from quernstone.plans.predicate import Predicate, condition, real, recompute, whole
from quernstone.sources import sinks, tables


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="공급위치 A1 84㎡") == ["공급위치", "a1", "84", "공급", "급위", "위치"]


def test_numbers(spark):
    assert one(spark, X.numbers(F.col("t")), t="1,234원 5.5%") == ["1,234", "5.5"]


def test_space(spark):
    assert one(spark, X.squeezed(F.col("t")), t="a b　c\td") == "abcd"


def test_bucket(spark):
    import hashlib

    for text in ("", "a", "수원", "x" * 100):
        assert one(spark, X.bucket(F.col("t")), t=text) == int(hashlib.md5(text.encode()).hexdigest(), 16) % 100


def test_cloze(spark):
    assert one(spark, X.cloze(F.col("t"), F.lit("84")), t="the area is 84 square") == "the area is ____"
    assert one(spark, X.cloze(F.col("t"), F.lit("99")), t="no such value") is None


def test_grounded_empty_term(spark):
    assert one(spark, X.grounded(F.col("t"), F.lit(" ")), t="text") is False


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "red apple pie"), (1, "green apple"), (2, "blue sky and red sky")], "d long, t string")
    ask = spark.createDataFrame([(0, "red sky"), (1, "apple"), (2, "zzz")], "q long, t string")
    got = {(r.query, r.doc): r.score for r in retrieval.bm25(ask, docs, "q", "t", "d", "t").collect()}
    assert got == pytest.approx({(0, 0): 0.492150, (0, 2): 1.590851, (1, 0): 0.492150, (1, 1): 0.573175}, abs=1e-6)


def test_fusion(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "query long, doc long, rank long")
    b = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 0, 3)], "query long, doc long, rank long")
    got = {r.doc: r.score for r in retrieval.fused([a, b]).collect()}
    assert got == pytest.approx({0: 0.032266, 1: 0.032522, 2: 0.032002}, abs=1e-6)


def test_chunks(spark):
    text = "\n".join(["aaaa", "bbb", "c" * 12, "", "d"])
    assert one(spark, retrieval.chunks(F.col("t"), 10), t=text) == ["aaaa\nbbb", "c" * 12, "d"]


def test_bands(spark):
    df = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40)], "i long, n long").withColumn("g", F.lit(0))
    rows = packing.running(df, ["g"], ["i"], "n").orderBy("i")
    got = [r.b for r in rows.select(packing.band(F.col("cum") - F.col("n"), F.col("n"), F.lit(100)).alias("b")).collect()]
    assert got == ["early", "early", "middle", "late"]


@pytest.mark.parametrize("k,n,low,high", [(8, 10, 0.490157, 0.943319), (0, 10, 0, 0.277540), (10, 10, 0.722460, 1)])
def test_wilson(spark, k, n, low, high):
    a, b = scoring.wilson(F.lit(k / n), F.lit(float(n)))
    assert one(spark, F.struct(a.alias("a"), b.alias("b"))) == pytest.approx((low, high), abs=1e-6)


def test_views(spark):
    assert [one(spark, whole(F.col("t")), t=t) for t in ("12,345 ", "3.7", "x")] == [12345, None, None]
    assert [one(spark, real(F.col("t")), t=t) for t in ("12,345 ", "3.7", "x")] == [12345.0, 3.7, None]


def test_predicate(spark):
    rows = spark.createDataFrame([("x", "5", 1), ("y", "5", 2), ("z", "84", 3), ("w", "85", 4), (None, "n/a", 5)], "name string, v string, ord long")
    tables, views = {"t": rows}, {"v": real(F.col("v"))}
    value = lambda p: recompute(tables, p, ["ord"], views=views).first().value
    assert value(Predicate("t", {"v": {"min": 84, "max": 85}})) == 1
    assert value(Predicate("t", {"v": {"max": 80}}, "argmax", "v", "name")) == "x"
    assert value(Predicate("t", {"name": ""})) == 1
    assert value(Predicate("t", {"name": "none"}, "sum", "v")) is None
    assert value(Predicate("t", {}, "median", "v", round=0)) == 44  # 44.5, half to even
    assert str(Predicate("t", {"v": {"min": 1, "max": 2}}, "avg", "v")) == "t[v=1..2].avg(v)"
    assert rows.filter(condition(rows, {"v": {"min": 0}}, views)).count() == 4


def test_predicate_on_strings(spark):
    rows = spark.createDataFrame([("a", "2.5", 1), ("b", "4", 2), ("c", "NaN", 3), ("d", "1,200", 4), ("e", "junk", 5), ("f", None, 6)], "name string, v string, ord long")
    value = lambda *p, **k: recompute({"t": rows}, Predicate("t", *p, **k), ["ord"]).first().value
    assert value({"v": {"min": 0, "max": 10}}) == 2 and value({"v": {"min": 0}}) == 3  # not a number is in no range
    assert value({"v": {"max": 10}}, "avg", "v") == 3 and value({"v": {"max": 10}}, "avg", "v", round=2) == 3.25
    assert value({"v": {"max": 10}}, "median", "v") == 3
    assert value({"name": "none"}, "argmax", "v", "name") is None and value({"name": "none"}, "median", "v") is None
    assert value({"v": {"max": 5000}}, "argmax", "v", "name") == "d"


def test_running_over_ranges(spark):
    rows = [(i % 2 if i % 5 else None, i, i * 3 % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(5)
    want, sums = {}, {}
    for g, i, n in rows:
        want[i] = sums[g] = sums.get(g, 0) + n
    assert {r.i: r.cum for r in numbering.running(df, ["g"], ["i"], "n").collect()} == want


def test_next_fit(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([4, 4, 4, 12, 1, 9, 1])] + [("h", 0, 99)], "g string, i long, n long")
    got = {(r.g, r.i): r.part for r in numbering.next_fit(df, "g", "i", "n", 10).collect()}
    assert [got["g", i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4] and got["h", 0] == 0


@pytest.mark.parametrize("kind", ["random", "zeros", "ones", "huge", "many groups"])
def test_next_fit_over_many_partitions(spark, kind):
    """A group's parts hang on one another over all ranges; nothing but the order decides them."""
    rng = random.Random(kind)
    draw = {"random": lambda: rng.randint(0, 9), "zeros": lambda: rng.choice([0, 0, 0, 11, 5]), "ones": lambda: 1, "huge": lambda: rng.choice([25, 3, 0, 10]), "many groups": lambda: rng.randint(0, 6)}[kind]
    groups = 40 if kind == "many groups" else 1
    rows = [(i % groups if i % 7 else None, i, draw() if i % 31 else None) for i in range(900)]
    want, state = {}, {}
    for g, i, n in rows:
        held, part = state.get(g, (0, 0))
        if held and held + (n or 0) > 10:
            held, part = 0, part + 1
        state[g], want[i] = (held + (n or 0), part), part
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {r.i: r.part for r in numbering.next_fit(df, "g", "i", "n", 10).collect()} == want
        assert numbering.next_fit(df.filter("false"), "g", "i", "n", 10).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_range_tells_what_comes_of_anything_held():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 5, 12]) for _ in range(rng.randint(1, 30))]
        entries = numbering._chains(np.array(sizes), 10)
        for start in range(16):
            held, parts = start, 0
            for n in sizes:
                if held and held + n > 10:
                    held, parts = 0, parts + 1
                held += n
            met = entries[0] if not start else [e for e in entries[1:] if start > e[0]][-1]
            assert (parts, held) == (met[1], start + sum(sizes) if met[2] < 0 else met[2])


@pytest.mark.parametrize("gram, window", [(2, 2), (3, 4), (8, 16)])
def test_containing(spark, gram, window):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    texts = ["abc abd", "xabcx", "", None, "ab", "abc abd", "日本語の文", long, "aaaaaaaaaaaa", long[:1500]]
    docs = spark.createDataFrame([*enumerate(texts), (None, "ab"), (0, "ab"), (0, "ab")], "d long, t string").repartition(2)
    terms = [(0, "ab"), (1, "abc"), (2, ""), (3, None), (4, "c a"), (5, "ab"), (5, "ab"), (6, "zz"), (None, "本語"), (8, long), (9, long[1400:1600]), (10, long[700:760]), (11, long[701:760] + "?"), (12, "aaaa"), (13, "a" * 13)]
    asked = spark.createDataFrame(terms, "q long, t string")
    rows = [*enumerate(texts), (None, "ab"), (0, "ab"), (0, "ab")]
    want = sorted(((q, d) for q, t in terms if t for d, x in rows if x and t in x), key=repr)
    assert sorted(map(tuple, retrieval.containing(asked, docs, "q", "t", "d", "t", gram, window).collect()), key=repr) == want
    assert retrieval.containing(asked.limit(0), docs, "q", "t", "d", "t").collect() == retrieval.containing(asked, docs.limit(0), "q", "t", "d", "t").collect() == []


def test_block_max_is_bm25(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(30)]
    share = 1 / np.arange(1, 31)
    prose = lambda n: " ".join(rng.choice(names, n, p=share / share.sum()))
    texts = [prose(int(rng.integers(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:50]), (900, None), (901, "")], "d long, t string").repartition(3)
    asked = spark.createDataFrame([(i, prose(6)) for i in range(8)] + [(8, "w29"), (9, "zzz"), (10, None), (11, "")], "q long, t string")
    full = retrieval.bm25(asked, docs, "q", "t", "d", "t")
    for k, unit in ((1, 1000), (7, 50), (600, 100)):
        want = sorted(map(tuple, retrieval.ranked(full, k).collect()))
        assert sorted(map(tuple, retrieval.ranked(retrieval.bm25_top(asked, docs, "q", "t", "d", "t", k, unit=unit), k).collect())) == want
    assert retrieval.bm25_top(asked, docs.limit(0), "q", "t", "d", "t", 3).collect() == retrieval.bm25_top(asked.limit(0), docs, "q", "t", "d", "t", 3).collect() == []


def test_block_max_skips_blocks():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(20_000), 6)
    # a document's terms come from one of twenty languages
    term = (doc % 20) * 100 + np.minimum(rng.zipf(1.5, len(doc)), 100) - 1
    pairs = np.unique(doc * 10_000 + term)
    doc, term = pairs // 10_000, pairs % 10_000
    part = np.log(20_000 / np.bincount(term)[term]) * rng.uniform(0.3, 1, len(doc))
    index = retrieval.BlockMax(doc, term, part)
    for terms in ([300, 301, 340], [500, 511], [700, 1201, 1222]):
        at, score = index.best(terms, 5)
        full = np.bincount(doc[np.isin(term, terms)], part[np.isin(term, terms)], 20_000)
        assert sorted(score)[-5:] == pytest.approx(np.sort(full)[-5:].tolist()) and np.allclose(full[index.docs[at]], score)
    assert index.scored < 3 * 20_000 / 20


def test_retrievers(spark):
    ranking = spark.createDataFrame([(0, d, r, d % 2) for r, d in enumerate([4, 2, 0, 1], 1)], "query long, doc long, rank long, page long")
    pick = lambda *a: {r.doc for r in retrieval.retrieve(*a).collect()}
    assert pick("bm25", {"bm25": ranking}, 2) == {4, 2} and pick("bm25", {"bm25": ranking}, 3, "page", 1) == {4, 1}
    with pytest.raises(ValueError):
        retrieval.retrieve("none", {}, 1)


def test_responses(spark):
    xml = "<r><resultCode>{}</resultCode><item><a>1</a></item></r>"
    assert one(spark, tables.xml_items(F.col("t"), "a string"), t=xml.format("00"))[0].a == "1"
    assert one(spark, tables.json_items(F.col("t"), "struct<a: int>"), t='{"total": 1, "list": [{"a": 1}]}')[0].a == 1
    for bad in (tables.xml_items(F.lit(xml.format("99")), "a string"), tables.json_items(F.lit('{"ERROR_CODE": "7", "data": []}'), "struct<a: int>")):
        with pytest.raises(Exception, match="code (99|7)"):
            spark.range(1).select(bad).collect()


def test_paragraph_pages(spark):
    assert one(spark, extract.paragraph_pages(F.col("t"), 5), t=" aaa \n\nbbb\ncc") == ["aaa\nbbb", "cc"]
    assert one(spark, extract.paragraph_pages(F.col("t"), 5), t=" \n") == [" \n"]


def test_unescaped(spark):
    assert one(spark, X.unescaped(F.col("t")), t="&amp;lt; &#233; &#xE9; &eacute; &nope;") == "&lt; é é é &nope;"


def test_signature(spark):
    text = '서울특별시 강남구 「공고 1」 "a b" (p.12)  2024년 3월 1,234.5개'
    assert one(spark, dedup.signature(F.col("t"), F.lit("f")), t=text) == 'f|<시도> <시군구> 「T」 "A" (p.N) <날짜> <수>개'


def test_providers(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i long, t string")
    assert {r.prediction for r in assemble.generated(df, "i", "t", lambda: 1 / 0, mock=True).collect()} == {"mock answer"}
    assert {r.i: r.prediction for r in assemble.generated(df, "i", "t", lambda: str.upper).collect()} == {1: "AB", 2: ""}
    with pytest.raises(ValueError):
        list(assemble.all_pages(lambda after, n: ([{"id": 1}], True)))


def test_nested_caps(spark):
    rows = spark.createDataFrame([(i, "g", p, t) for i, (p, t) in enumerate([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)])], "i long, g string, p string, t long")
    # the second row is refused by t and so leaves p's cap to the third
    got = generate.nested_caps(rows, "g", ["i"], {"p": 2, "t": 1}).collect()
    assert sorted(r.i for r in got) == [0, 2]


def test_nested_caps_equal_the_loop(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("gh"), rng.choice("abcd"), rng.choice([1, 2, None])) for i in range(400)]
    caps, used, want = {"g": 9, "p": 3, "t": 4}, {}, []
    for i, g, p, t in rows:
        keys = [(g, "g", g), (g, "p", p), (g, "t", t)]
        if all(used.get(k, 0) < caps[k[1]] for k in keys):
            want.append(i)
            for k in keys:
                used[k] = used.get(k, 0) + 1
    df = spark.createDataFrame(rows, "i long, g string, p string, t long").repartition(3)
    assert sorted(r.i for r in generate.nested_caps(df, "g", ["i"], caps).collect()) == want


def test_attached(spark):
    places = spark.createDataFrame([("a", 8, 1, "early"), ("b", 32, 1, "early"), ("c", 32, 1, "late"), ("d", 128, 1, "late"), ("d", 128, 2, "early"), ("b", 32, 2, "late")], "bundle string, tier int, page long, band string")
    rows = [(1, "e", [1]), (2, "l", [1]), (3, "m", [2, 1]), (4, "m", [1, 9]), (5, "x", [1]), (6, "l", [7]), (7, None, [2]), (8, "e", []), (9, "m", None)]
    items = spark.createDataFrame(rows, "item long, family string, pages array<long>")
    got = {r.item: (r.bundle, r.tier, r.position) for r in packing.attached(items, places, "item", "family", "pages", {"e": "early", "l": "late", "m": "all"}).collect()}
    nothing = (None, None, None)
    assert got == {1: ("a", 8, "early"), 2: ("d", 128, "late"), 3: ("d", 128, "multi"), 4: nothing, 5: ("c", 32, "late"), 6: nothing, 7: ("d", 128, "early"), 8: nothing, 9: nothing}


def test_subset_by_listed_ids(spark):
    lines = spark.createDataFrame([(x,) for x in ["1", " 2 ", '{"id": 3}', '{"id": "4", "p": {}}', "{broken", '{"no": 5}', "", None, "1"]], "value string")
    ids = scoring.listed_ids(lines)
    assert sorted(r.id for r in ids.collect()) == ["1", "2", "3", "4", "{broken"]
    gold, preds = spark.range(1, 7).toDF("k"), spark.createDataFrame([("2",), ("4",), ("6",)], "k string")
    kept = lambda *x: sorted(r.k for r in scoring.subset(gold, "k", *x).collect())
    assert (kept(ids), kept(None, preds), kept(ids, preds), kept()) == ([1, 2, 3, 4], [2, 4, 6], [2, 4], [1, 2, 3, 4, 5, 6])


def test_scanned_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("fine\nclick onclick here\nonclick")
    (tmp_path / "deep" / "b.txt").write_text("serviceKey=1")
    got = sorted((r.file.rpartition("/")[2], r.term) for r in gates.scanned_files(spark, str(tmp_path), ["onclick", "serviceKey", "none"]).collect())
    assert got == [("a.md", "onclick"), ("b.txt", "serviceKey")]


def test_facts(spark):
    df = spark.createDataFrame([(1, "ab 12 cd 345")], "i long, t string")
    assert [(r.ord, r.value, r.start, r.snippet) for r in extract.facts(df, "i", "t", "[0-9]+", 3).collect()] == [(0, "12", 3, "ab 12 cd"), (1, "345", 9, "cd 345")]


def test_jaccard_copies(spark):
    df = spark.createDataFrame([(1, "x", "a b c d"), (2, "x", "d c b a"), (3, "x", "a b c e"), (4, "y", "a b c d")], "i long, f string, t string")
    assert {r.id for r in dedup.with_later_match(df, "i", "f", F.split("t", " "), 0.92).collect()} == {1}
    assert {r.id for r in dedup.with_later_match(df, "i", "f", F.split("t", " "), 0.6).collect()} == {1, 2}


def test_inside():
    assert sinks.inside("/data/out/x", "/data/out") == "/data/out/x"
    for bad in ("/etc/passwd", "/data/out/../x"):
        with pytest.raises(ValueError):
            sinks.inside(bad, "/data/out")


def test_references_without_a_semicolon_stay(spark):
    """As the SQL has it."""
    assert one(spark, X.unescaped(F.col("t")), t="a&amp b &copy; c&copy &notit; &eacute;") == "a&amp b © c&copy &notit; é"
    assert one(spark, X.clean_title(F.col("t")), t="ver&amp &nbsp;") == "ver&amp"


@pytest.fixture
def many_documents(spark, tmp_path):
    """10,050 documents of different texts in two languages, and some copies."""
    k = F.col("id")
    docs = spark.range(10100).select(k.alias("doc_id"), F.concat(F.lit("line of "), F.translate((k % 10050).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["a2_union_keep_first", "n2_clusters"])
def test_numbers_of_five_digits_agree_with_sql(spark, many_documents, name):
    import duckdb

    from quernstone import catalog

    got = catalog.queries()[name](spark, many_documents)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{many_documents}/documents.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_parities_never_differ_oftener_than_members(spark):
    """A lossless filter, and one that tells unlike sets apart."""
    rng = random.Random(3)
    member = lambda: rng.getrandbits(64) - 2**63
    pairs = []
    for n, other in [(1, 1), (30, 2), (200, 12), (200, 200), (0, 3), (5, 0)]:
        both = [member() for _ in range(n)]
        pairs.append((both + [member() for _ in range(other)], both + [member() for _ in range(other // 2)]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    unlike = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(dedup.parities(F.col("a")), dedup.parities(F.col("b")), strict=True)), F.lit(0))
    got = [r[0] for r in df.select(unlike).collect()]
    true = [len(set(a) ^ set(b)) for a, b in pairs]
    assert all(g <= t and (t - g) % 2 == 0 for g, t in zip(got, true, strict=True)) and got[3] > 60


def test_jaccard_links_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = rng.sample(words, 60) if i % 4 == 0 else [w for w in base if rng.random() > 0.03]
        rows.append((i, "f" if i % 8 < 4 else None, " ".join(base)))
    sets = [(i, f, set(t.split())) for i, f, t in rows]
    want = {i for i, f, a in sets for j, g, b in sets if f == g and i < j and len(a & b) >= 0.92 * len(a | b)}
    df = spark.createDataFrame(rows, "i long, f string, t string")
    assert {r.id for r in dedup.with_later_match(df, "i", "f", F.split("t", " "), 0.92).collect()} == want and len(want) > 20


@pytest.mark.parametrize("block", [7, 8192])
def test_nearest_holds_the_best_and_odd_vectors(spark, block):
    """All pairs, equal scores, vectors of other lengths, null and not finite."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(200)]
    rows += [(200, rows[3][1]), (201, None), (202, [1.0, 2.0]), (203, [float("nan"), *[1.0] * 7]), (204, [None, *[1.0] * 7]), (205, [float("inf"), *[1.0] * 7])]
    docs = spark.createDataFrame(rows, "doc long, v array<float>")
    queries = docs.filter("doc % 10 = 0 OR doc > 200").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    every = queries.join(docs, F.col("query") != F.col("doc")).select("query", "doc", F.round(retrieval.dot(F.col("q"), F.col("v")), 6).alias("score"))
    told = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    assert told(retrieval.similarities(queries, docs, block)) == told(every)
    found = retrieval.nearest(queries, docs, 5, block)
    assert told(retrieval.ranked(found, 5)) == told(retrieval.ranked(every, 5))
    assert "BroadcastNestedLoopJoin" not in retrieval.nearest(queries.filter("query < 200"), docs.filter("doc < 200"), 5)._jdf.queryExecution().executedPlan().toString()


def test_marks_come_in_bounded_batches():
    """Whatever the number and length of the texts of a batch."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in [0, 5, 22, 23, 24, *[400] * 200]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    out = list(retrieval._marks(8, 16, [5], most=1000)([batch]))
    whole = pa.Table.from_batches(retrieval._marks(8, 16, [5], most=10**9)([batch]))
    assert len(out) > 10 and max(b.num_rows for b in out) < 1000 + 1000 and pa.Table.from_batches(out).equals(whole)
    grams = lambda raw, n: [hash_of(raw[i : i + n]) for i in range(len(raw) - n + 1)]

    def hash_of(g):
        h = len(g)
        for x in g:
            h = (h ^ x) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return h

    for doc, text in enumerate(texts[:8]):
        raw = text.encode()
        g = grams(raw, 8)
        want = set(grams(raw, 5)) | {min(g[i : i + 16]) for i in range(len(g) - 15)}
        assert {h % 2**64 for d, h in zip(*(whole[c].to_pylist() for c in ("doc", "h")), strict=True) if d == doc} == want


def test_all_scores_come_by_units(spark):
    """No aggregate of pairs, whose memory would grow with the documents; scores are those of the formula."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) if i % 13 else None) for i in range(90)]
    asked = [(i, " ".join(rng.choice("abcdefghz") for _ in range(3))) for i in range(7)]
    found = retrieval.bm25(spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(docs, "i long, t string"), "q", "t", "i", "t")
    bags = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    df = {w: sum(w in bag for bag in bags.values()) for w in "abcdefghz"}
    idf = lambda w: np.log((len(bags) - df[w] + 0.5) / (df[w] + 0.5) + 1)
    want = {(q, i): sum(idf(w) * bag.count(w) * 2.5 / (bag.count(w) + 1.5 * (0.25 + 0.75 * len(bag) / mean)) for w in set(t.split())) for q, t in asked for i, bag in bags.items()}
    want = {at: x for at, x in want.items() if x > 0}
    got = {(r.query, r.doc): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[at] - want[at]) < 2e-6 for at in want)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_stated_terms_leave_texts_where_they_are(spark, monkeypatch):
    """Terms and marks of a stated set are broadcast up to a set number; more are shuffled, and give the same."""
    from quernstone.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} a passage that is looked for {i % 3} and more words") for i in range(60)] + [(None, None), (None, "word1 a passage that is looked for 1 and")], "doc long, text string")
    asked = spark.createDataFrame([(1, "a passage that is looked for 1 and"), (2, "word3 other2"), (3, None), (4, "word"), (5, "d3")], "q long, text string")
    made = {}
    for few in (1 << 17, 0):
        monkeypatch.setattr(R, "FEW", few)
        plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
        made[few] = plain(R.containing(asked, docs, "q", "text", "doc", "text")), plain(R.bm25_top(asked, docs.filter("doc IS NOT NULL"), "q", "text", "doc", "text", 4))
    assert made[0] == made[1 << 17] and {q for q, _ in made[0][0]} == {1, 2, 4, 5}
    monkeypatch.setattr(R, "FEW", 10)
    hinted = lambda n: "Hint" in R.narrow(spark.range(n))._jdf.queryExecution().logical().toString()
    assert hinted(10) and not hinted(11)


def test_sets_alike_share_a_part_and_others_hardly_do():
    """No pair is lost whatever its sizes, and sets of the same few words do not meet: words alone, which many sets share, gave their square."""
    rng = random.Random(6)
    member = lambda: rng.getrandbits(64) - 2**63
    few = [member() for _ in range(400)]

    def keys(sets, least):
        arrays = [pa.array(range(len(sets))), pa.array([7] * len(sets)), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))]
        rows = [r for b in dedup._keys([pa.RecordBatch.from_arrays(arrays, names=["k", "f", "w"])], least) for r in b.to_pylist()]
        held = [set() for _ in sets]
        own = [set() for _ in sets]
        for r in rows:
            held[r["k"]].add(r["key"])
            if r["own"]:
                own[r["k"]].add(r["key"])
        return held, own

    for least in (0.92, 0.6):
        sets = []
        for _ in range(150):
            a = {member() for _ in range(rng.randint(1, 300))}
            drop = set(rng.sample(sorted(a), int(len(a) * (1 - least) / 2)))
            sets += [a, (a - drop) | {member() for _ in range(rng.randint(0, len(drop)))}]
        held, own = keys(sets, least)
        alike = [(i, i + 1) for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= least * len(sets[i] | sets[i + 1])]
        assert len(alike) > 60 and all(own[i] & held[j] or held[i] & own[j] for i, j in alike)
    held, _ = keys([set(rng.sample(few, 60)) for _ in range(1000)], 0.92)
    counts = Counter(x for h in held for x in h)
    assert sum(n - 1 for n in counts.values()) < 100


def test_null_words_match_nothing(spark):
    rows = [(1, "f", None), (2, "f", None), (3, "f", "a b"), (None, "f", "a b"), (4, "f", "a b"), (5, "g", ""), (6, "g", "")]
    df = spark.createDataFrame(rows, "i long, f string, t string")
    assert [r.id for r in dedup.with_later_match(df, "i", "f", F.split("t", " "), 0.92).orderBy("id").collect()] == [3, 5]


def test_a_large_group_gives_few_pairs(spark):
    """All but the last of 300 sets alike have a later one; what each looks at does not grow with the group."""
    base = [f"w{i}" for i in range(120)]
    df = spark.createDataFrame([(i, "f", " ".join([*base, f"own{i}"])) for i in range(300)], "i long, f string, t string")
    assert sorted(r.id for r in dedup.with_later_match(df, "i", "f", F.split("t", " "), 0.92).collect()) == list(range(299))
    key, k, own, open_ = np.zeros(1000, np.int64), np.arange(1000), np.ones(1000, bool), np.ones(1000, bool)
    assert sum(b.num_rows for b in dedup._mates((key, k, own, open_), dedup.NEXT)) < 1000 * dedup.NEXT
    open_[:997] = False
    assert sum(b.num_rows for b in dedup._mates((key, k, own, open_), None)) == 3
