"""Queries of retrieval (R1 to R20): benchmark passages against documents, and embeddings against one another."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import SPACE, WORD, quotes
from ..registry import query
from ..sources.tables import spread, table
from . import retrieval as R

TOK = f"regexp_extract_all(lower(text), '{WORD}')"
POST = f"t AS (SELECT doc_id, {TOK} AS w FROM documents), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL)"
BM = f"""{POST}, n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY 1, 2),
z AS (SELECT * FROM s UNION ALL SELECT b.item_id, f.doc_id, 0 FROM benchmark b, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20) f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item_id = b.item_id AND s.doc_id = f.doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM z)"""
DENSE = """v AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM v)"""
GOLD = "g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def scores(spark, d):
    return R.bm25(table(spark, d, "benchmark"), spread(table(spark, d, "documents").select("doc_id", "text")), "item_id", "text", "doc_id", "text")


def top(spark, d, k=5):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = R.bm25_top(asked, spread(docs.select("doc_id", "text")), "item_id", "text", "doc_id", "text", k)
    return R.ranked(R.with_zeros(found, asked, docs, "item_id", "doc_id", k), k)


def gold(spark, d):
    """Documents that hold a passage."""
    return R.containing(table(spark, d, "benchmark"), spread(table(spark, d, "documents").select("doc_id", "text")), "item_id", "text", "doc_id", "text")


def vectors(spark, d):
    """The asked vectors, every 50th, and all."""
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def dense(spark, d, k=10):
    """Exact neighbours of the asked vectors (every 50th) by dot product."""
    return R.ranked(R.nearest(*vectors(spark, d), k), k)


@query("r1_pages", "SELECT doc_id, i - 1 AS page_no, length(p) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10) || 'The ')) AS p, generate_subscripts(string_split(text, chr(10) || 'The '), 1) AS i FROM documents) WHERE regexp_replace(p, '\\s+', '', 'g') <> ''")
def r1(spark, d):
    pages = R.split_pages(table(spark, d, "documents"), "\nThe ")
    return pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.length("page_text").cast("long").alias("n"))


@query("r2_chunks", r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
f(doc_id, a, i, chunk, held) AS (SELECT doc_id, a, 1, 0, length(a[1]) FROM l UNION ALL
SELECT doc_id, a, i + 1, CASE WHEN held + length(a[i + 1]) + 1 > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN held + length(a[i + 1]) + 1 > 400 THEN length(a[i + 1]) ELSE held + length(a[i + 1]) + 1 END FROM f WHERE i < len(a)),
c AS (SELECT doc_id, chunk, regexp_replace(string_agg(a[i], chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS t FROM f GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, max(length(t)) AS longest, sum(length(t)) AS total FROM c WHERE t <> '' GROUP BY 1""")
def r2(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", R.chunks(F.col("text"), 400).alias("c"))
    return docs.select("doc_id", F.explode("c").alias("t")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("t")).cast("long").alias("longest"), F.sum(F.length("t")).cast("long").alias("total"))


@query("r3_index", f"WITH {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1")
def r3(spark, d):
    return R.postings(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("r4_idf", f"WITH {POST} SELECT term, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p GROUP BY 1")
def r4(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    df = R.postings(docs, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n", docs.agg(F.count(F.lit(1))).scalar())
    return df.select("term", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query("r5_bm25_scores", f"WITH {BM} SELECT item_id AS query, doc_id AS doc, score FROM s")
def r5(spark, d):
    return scores(spark, d)


@query("r6_bm25_top", f"WITH {BM} SELECT item_id AS query, doc_id AS doc, rank FROM r WHERE rank <= 5")
def r6(spark, d):
    return top(spark, d).select("query", "doc", "rank")


@query("r6_zero_scores", f"""
WITH {POST}, n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'zzzz' ELSE split_part(text, ' ', 1) END AS text FROM benchmark), q AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM b),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY 1, 2),
a AS (SELECT item_id, doc_id, coalesce(score, 0) AS score FROM (SELECT item_id, doc_id FROM b, documents) LEFT JOIN s USING (item_id, doc_id))
SELECT item_id AS query, doc_id AS doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 25""")
def r6_zero(spark, d):
    """Queries of one word: few documents have it, and those without fill the ranking up."""
    asked = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "zzzz").otherwise(F.split_part("text", F.lit(" "), F.lit(1))).alias("text"))
    docs = table(spark, d, "documents")
    found = R.bm25_top(asked, spread(docs.select("doc_id", "text")), "item_id", "text", "doc_id", "text", 25)
    return R.ranked(R.with_zeros(found, asked, docs, "item_id", "doc_id", 25), 25).select("query", "doc", "score", "rank")


@query("r7_similarity", f"WITH {DENSE} SELECT q AS query, d AS doc, score FROM v")
def r7(spark, d):
    return R.similarities(*vectors(spark, d))


@query("r8_dense_top", f"WITH {DENSE} SELECT q AS query, d AS doc, rank FROM dr WHERE rank <= 10")
def r8(spark, d):
    return dense(spark, d).select("query", "doc", "rank")


@query("r9_embeddings")
def r9(spark, d):
    """Embeddings by a local model of hashed words; a hosted one is another `provider`."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return R.embedded(docs, "doc_id", "text", R.hashed_words)


@query("r10_fusion", f"""
WITH {DENSE}, l AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) AS lr FROM dr WHERE rank <= 10),
u AS (SELECT q, d, rank AS k FROM l UNION ALL SELECT q, d, lr FROM l)
SELECT q AS query, d AS doc, round(sum(1.0::DOUBLE / (60 + k)), 9) AS score FROM u GROUP BY 1, 2""")
def r10(spark, d):
    by_score = dense(spark, d)
    by_id = by_score.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc")).cast("long"))
    return R.fused([by_score, by_id])


@query("r11_diverse", f"""
WITH {DENSE}, l AS (SELECT q, d, dr.rank, label FROM dr JOIN embeddings ON vec_id = d WHERE dr.rank <= 10),
c AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY rank) AS n FROM l)
SELECT q AS query, d AS doc, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM c WHERE n <= 1""")
def r11(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    return R.diverse(dense(spark, d).join(labels, "doc"), "label", 1).select("query", "doc", "rank")


@query("r12_oracle", f"WITH {GOLD} SELECT item_id AS query, doc_id AS doc FROM g")
def r12(spark, d):
    return gold(spark, d)


@query("r13_reading_order", f"WITH {BM} SELECT item_id AS query, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM r WHERE rank <= 5 GROUP BY 1")
def r13(spark, d):
    return top(spark, d).groupBy("query").agg(F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("docs"))


_DISPATCH = f"""{BM}, {GOLD}, dv AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.vec_id <> b.vec_id),
de AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dv),
hs AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM de WHERE rank <= 20) GROUP BY 1, 2),
hy AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hs),
u AS (SELECT 'bm25' AS retriever, item_id, doc_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT 'dense', item_id, doc_id, rank FROM de WHERE rank <= 20 UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM hy),
dd AS (SELECT *, row_number() OVER (PARTITION BY retriever, item_id, source ORDER BY rank) AS nth FROM u JOIN documents USING (doc_id)),
pk AS (SELECT retriever, item_id, doc_id, row_number() OVER (PARTITION BY retriever, item_id ORDER BY rank) AS place FROM dd WHERE nth <= 1)"""


@query("r13_dispatch", f"""WITH {_DISPATCH} SELECT retriever, item_id AS query, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs
FROM (SELECT retriever, item_id, doc_id FROM pk WHERE place <= 5 UNION ALL SELECT 'oracle', item_id, doc_id FROM g) GROUP BY 1, 2""")
def r13_dispatch(spark, d):
    """Each retriever's picks in reading order, one of a source at most; vectors of the same id stand for the embeddings of passages and documents."""
    e = table(spark, d, "embeddings")
    asked = e.join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    rows = e.join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    rankings = {"bm25": top(spark, d, 20).join(sources, "doc"), "dense": R.ranked(R.nearest(asked, rows, 20), 20).join(sources, "doc"), "oracle": gold(spark, d), "pages": sources}
    picks = [R.retrieve(name, rankings, 5, "source", 1).withColumn("retriever", F.lit(name)) for name in ("bm25", "dense", "hybrid", "oracle")]
    every = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])
    return every.groupBy("retriever", "query").agg(F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("docs"))


@query("r14_slice", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 2000 ORDER BY doc_id LIMIT 25")
def r14(spark, d):
    return table(spark, d, "documents").filter("lang = 'en' AND n_chars BETWEEN 500 AND 2000").select("doc_id", "lang").orderBy("doc_id").limit(25)


@query("r15_no_quote", f"WITH {GOLD} SELECT b.item_id, count(*) AS n_gold FROM benchmark b JOIN g ON g.item_id = b.item_id WHERE len(list_filter(list_transform(regexp_extract_all(b.text, '[\"''‘’“”]([^\"''‘’“”]+)[\"''‘’“”]', 1), lambda s: regexp_replace(s, '{SPACE}+', '', 'g')), lambda s: length(s) >= 5)) = 0 GROUP BY 1")
def r15(spark, d):
    """Passages with a source document that quote nothing of five characters or more from it."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    g = gold(spark, d).groupBy(F.col("query").alias("item_id")).agg(F.count(F.lit(1)).alias("n_gold"))
    return b.join(g, "item_id").filter(F.size(quotes(F.col("text"))) == 0).select("item_id", "n_gold")


_ASKED = f"""i AS (SELECT l.doc_id, CASE l.doc_id % 3 WHEN 0 THEN 'Who said "' || substr(d.text, 3, 18) || '"?' WHEN 1 THEN 'Who said "never in any text"?' ELSE 'Who?' END AS question, CASE WHEN l.doc_id % 2 = 0 THEN 'user' WHEN l.doc_id % 5 = 0 THEN 'analyst' ELSE 'cloze' END AS style, d.text, l.doc_id % 11 = 0 AS gone, l.doc_id % 7 <> 0 AS has FROM (SELECT DISTINCT doc_id FROM labels) l JOIN documents d ON d.doc_id = l.doc_id)"""


def asked_items(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id")
    k = F.col("doc_id")
    question = F.when(k % 3 == 0, F.concat(F.lit('Who said "'), F.substring("text", 3, 18), F.lit('"?'))).when(k % 3 == 1, 'Who said "never in any text"?').otherwise("Who?")
    style = F.when(k % 2 == 0, "user").when(k % 5 == 0, "analyst").otherwise("cloze")
    items = docs.select(k, question.alias("question"), F.array(k).alias("pages"), k.alias("bundle"), style.alias("style"))
    bundles = docs.filter(k % 11 != 0).select(k.alias("bundle"), "text", F.when(k % 7 != 0, F.array(k)).otherwise(F.array().cast("array<long>")).alias("have"))
    return R.non_quote_slice(items, bundles, "doc_id", "question", "pages", "bundle", "text", "have", "style", ["user", "analyst"], 120)


@query("r15_non_quote_slice", f"""WITH {_ASKED} SELECT doc_id, style FROM i WHERE style <> 'cloze' AND NOT gone AND has AND len(list_filter(list_transform(regexp_extract_all(question, '[\"''‘’“”]([^\"''‘’“”]+)[\"''‘’“”]', 1), lambda s: regexp_replace(s, '{SPACE}+', '', 'g')), lambda s: length(s) >= 5 AND contains(regexp_replace(i.text, '{SPACE}+', '', 'g'), s))) = 0 ORDER BY doc_id LIMIT 120""")
def r15_slice(spark, d):
    """Questions of two styles about documents, some of which quote theirs."""
    return asked_items(spark, d)[0].select("doc_id", "style")


@query("r15_missing_bundles", f"WITH {_ASKED} SELECT doc_id AS bundle, count(*) AS n_items FROM i WHERE style <> 'cloze' AND gone GROUP BY 1")
def r15_missing(spark, d):
    return asked_items(spark, d)[1]


_RANKS = f"WITH {BM}, {GOLD}, h AS (SELECT b.item_id, min(r.rank) AS best FROM benchmark b JOIN g ON g.item_id = b.item_id LEFT JOIN r ON r.item_id = g.item_id AND r.doc_id = g.doc_id AND r.rank <= 10 GROUP BY 1)"


def best_ranks(spark, d):
    g = gold(spark, d)
    return g.join(top(spark, d, 10), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("best"))


@query("r16_gold_rank", f"{_RANKS} SELECT item_id AS query, best FROM h")
def r16(spark, d):
    return best_ranks(spark, d)


_TOKENS = f"{_RANKS}, l AS (SELECT r.item_id, r.rank, d.source, length(d.text) // 2 AS tok FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 10)"


def diagnosed(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("page"), F.floor(F.length("text") / 2).alias("tokens"))
    return R.diagnosed(top(spark, d, 10), gold(spark, d), pages, [1, 3, 5, 10])


@query("r17_hits_at_k", f"{_TOKENS}, e AS (SELECT h.item_id, best, k, (SELECT coalesce(sum(tok), 0) FROM l WHERE l.item_id = h.item_id AND l.rank <= k) AS tok FROM h, (VALUES (1), (3), (5), (10)) v(k)) SELECT k, count(*) AS n, round(avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(tok), 6) AS mean_tokens FROM e GROUP BY 1")
def r17(spark, d):
    return diagnosed(spark, d)[0]


@query("r17_diagnostics", f"""{_TOKENS}, u AS (SELECT h.item_id, (SELECT count(*) - count(DISTINCT source) FROM l WHERE l.item_id = h.item_id AND l.rank <= 5) AS dup FROM h),
o AS (SELECT best, row_number() OVER (ORDER BY best) - 1 AS i, count(*) OVER () AS c FROM h WHERE best IS NOT NULL)
SELECT (SELECT count(*) FROM h) AS n, (SELECT count(*) FROM o) AS found, (SELECT round(avg(dup), 6) FROM u) AS mean_dup5, (SELECT min(best) FROM o) AS rank_min, (SELECT best FROM o WHERE i = c // 2) AS rank_median, (SELECT max(best) FROM o) AS rank_max""")
def r17_diagnostics(spark, d):
    return diagnosed(spark, d)[1]


@query("r18_confusion", f"{_RANKS} SELECT best <= 1 AS retrieved, item_id % 3 = 0 AS right_answer, count(*) AS n FROM h WHERE best IS NOT NULL GROUP BY 1, 2")
def r18(spark, d):
    return best_ranks(spark, d).filter("best IS NOT NULL").groupBy((F.col("best") <= 1).alias("retrieved"), (F.col("query") % 3 == 0).alias("right_answer")).agg(F.count(F.lit(1)).alias("n"))


@query("r19_unique_pages", f"WITH {BM} SELECT item_id AS query, string_agg(source, ',' ORDER BY k) AS sources FROM (SELECT item_id, source, min(rank) AS k FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1, 2) GROUP BY 1")
def r19(spark, d):
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    listed = top(spark, d).join(sources, "doc").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("l"))
    return listed.select("query", F.array_join(F.array_distinct(F.transform("l", lambda x: x["source"])), ",").alias("sources"))


@query("r20_recall_cuts", f"""
WITH {BM}, {GOLD}, x AS (SELECT g.item_id, count(r.doc_id) / count(*)::DOUBLE AS rec, 1.0 / count(*) AS w, CASE WHEN g.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, 'task' || g.item_id % 3 AS task, CASE WHEN count(*) > 2 THEN 'large' ELSE 'small' END AS tier FROM g LEFT JOIN r ON r.item_id = g.item_id AND r.doc_id = g.doc_id AND r.rank <= 5 GROUP BY g.item_id)
SELECT cut, value, count(*) AS n, round(avg(rec), 6) AS recall, round(avg(CASE WHEN rec > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(sum(w * rec) / sum(w), 6) AS weighted
FROM (SELECT *, 'ALL' AS cut, 'ALL' AS value FROM x UNION ALL SELECT *, 'split', split FROM x UNION ALL SELECT *, 'task', task FROM x UNION ALL SELECT *, 'tier', tier FROM x) GROUP BY 1, 2""")
def r20(spark, d):
    found = top(spark, d).groupBy("query").agg(F.collect_list("doc").alias("found"))
    rows = gold(spark, d).groupBy("query").agg(F.collect_set("doc").alias("gold")).join(found, "query", "left")
    rec = F.coalesce(R.recall(F.col("found"), F.col("gold")), F.lit(0.0))
    rows = rows.select(rec.alias("rec"), (F.lit(1.0) / F.size("gold")).alias("w"), F.when(F.col("query") % 2 == 0, "even").otherwise("odd").alias("split"), F.concat(F.lit("task"), F.col("query") % 3).alias("task"), F.when(F.size("gold") > 2, "large").otherwise("small").alias("tier"))
    hit = F.when(F.col("rec") > 0, 1.0).otherwise(0.0)
    return R.multi_cut(rows, ["split", "task", "tier"], [F.count(F.lit(1)).alias("n"), F.round(F.avg("rec"), 6).alias("recall"), F.round(F.avg(hit), 6).alias("hit"), F.round(F.sum(F.col("w") * F.col("rec")) / F.sum("w"), 6).alias("weighted")])
