"""Queries of splits and samples (L1 to L12): sources as entities, documents as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from . import splits as L

SPLIT = "CASE doc_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' WHEN 2 THEN 'hidden' ELSE 'train' END"


def items(spark, d):
    k = F.col("doc_id") % 5
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.when(k == 0, "dev").when(k == 1, "test").when(k == 2, "hidden").otherwise("train").alias("split"))


@query("l1_split", f"SELECT split, count(*) AS n FROM (SELECT {SPLIT} AS split FROM documents) WHERE split IN ('dev', 'test') GROUP BY 1")
def l1(spark, d):
    return items(spark, d).filter(F.col("split").isin("dev", "test")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("l2_masked", f"SELECT doc_id, CASE WHEN {SPLIT} = 'hidden' THEN '[hidden]' ELSE source END AS source, CASE WHEN {SPLIT} <> 'hidden' THEN n_chars END AS n_chars FROM documents")
def l2(spark, d):
    return L.masked(items(spark, d), F.col("split") == "hidden", "source", ["n_chars"]).select("doc_id", "source", "n_chars")


@query("l3_entities", "SELECT doc_id, CASE WHEN source < 'src' || (doc_id % 7) THEN source || ',src' || (doc_id % 7) WHEN source = 'src' || (doc_id % 7) THEN source ELSE 'src' || (doc_id % 7) || ',' || source END AS entities FROM documents")
def l3(spark, d):
    page = F.format_string("src%d-p%03d", F.col("doc_id") % 7, F.col("doc_id") % 1000)
    return items(spark, d).select("doc_id", F.array_join(L.entities(F.array("source"), F.array(page)), ",").alias("entities"))


_SPLIT = "s AS (SELECT source, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'test' WHEN doc_id % 17 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents)"


def leaky(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.when(k % 13 == 0, "test").when(k % 17 == 0, "dev").otherwise("train").alias("split"))


@query("l4_leak_eval", f"WITH {_SPLIT} SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s WHERE split IN ('dev', 'test') GROUP BY 1 HAVING count(DISTINCT split) > 1")
def l4_leaking(spark, d):
    return L.leaked(leaky(spark, d), "source", "split", ["dev", "test"]).select("source", F.array_join("splits", ",").alias("splits"))


@query("l5_leak_first_seen", f"WITH {_SPLIT} SELECT source, arg_min(split, doc_id) AS first_split FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def l5_moved(spark, d):
    return L.moved(leaky(spark, d), "source", "split", "doc_id")


@query("l6_unanimous", "SELECT conv_id, CASE WHEN count(DISTINCT s) = 0 THEN 'dev' WHEN count(DISTINCT s) = 1 THEN min(s) END AS split FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'test' ELSE 'train' END WHEN conv_id % 3 = 1 THEN 'test' END AS s FROM conversations) GROUP BY 1")
def l6(spark, d):
    s = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("turn") % 2 == 0, "test").otherwise("train")).when(F.col("conv_id") % 3 == 1, "test")
    return L.unanimous(table(spark, d, "conversations").select("conv_id", s.alias("s")), "conv_id", "s")


@query("l7_policy", "SELECT n_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'test' ELSE 'train' END AS split, CASE WHEN n_name < 'F' THEN 'early' ELSE 'late' END AS tag FROM nation JOIN region ON n_regionkey = r_regionkey")
def l7(spark, d):
    policy = spark.createDataFrame([("ASIA", "test"), ("EUROPE", "test")], "r_name string, split string")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(policy, "r_name", "left")
    return n.select("n_name", F.coalesce("split", F.lit("train")).alias("split"), F.when(F.col("n_name") < "F", "early").otherwise("late").alias("tag"))


QUOTA = "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, n, CAST(least(n, greatest(4, 60 // (2 * (SELECT count(*) FROM c)), round_even(60.0::DOUBLE * n / (SELECT sum(n) FROM c), 0))) AS BIGINT) AS quota FROM c)"


@query("l8_stratified", f"WITH {QUOTA} SELECT doc_id, lang FROM (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('s1' || doc_id), doc_id) AS draw FROM documents JOIN q USING (lang)) WHERE draw <= quota")
def l8(spark, d):
    docs = items(spark, d)
    rows = docs.join(L.quotas(docs, "lang", 60).select("lang", "quota"), "lang")
    return L.capped(rows, ["lang"], F.col("quota"), "s1", "doc_id").select("doc_id", "lang")


@query("l8_quotas", f"WITH {QUOTA} SELECT lang, n, quota FROM q")
def l8_quotas(spark, d):
    return L.quotas(items(spark, d), "lang", 60)


@query("l8_clustered_draw", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT greatest(4, 60 // (2 * count(*))) AS least FROM c),
q AS (SELECT lang, least, CAST(least(n, greatest(least, round_even(60.0::DOUBLE * n / (SELECT sum(n) FROM c), 0))) AS BIGINT) AS quota FROM c, f),
o AS (SELECT doc_id, d.lang, quota, least, row_number() OVER (PARTITION BY d.lang, source ORDER BY md5('d1' || doc_id), doc_id) > 1 AS late FROM documents d JOIN q ON q.lang = d.lang),
h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY late, md5('d1' || doc_id), doc_id) AS h FROM o), p AS (SELECT * FROM h WHERE h <= quota),
r AS (SELECT *, row_number() OVER (ORDER BY h <= least, h DESC, lang) AS k FROM p)
SELECT doc_id, lang FROM r WHERE h <= least OR k > (SELECT greatest(0, count(*) - 60) FROM p)""")
def l8_clustered(spark, d):
    return L.drawn(items(spark, d).select("doc_id", "lang", "source"), "lang", "source", 60, "d1", "doc_id").select("doc_id", "lang")


@query("l9_tier_caps", "SELECT doc_id, tier FROM (SELECT doc_id, tier, row_number() OVER (PARTITION BY tier ORDER BY md5('s2' || doc_id), doc_id) AS draw FROM (SELECT doc_id, CASE WHEN n_chars < 1000 THEN '1k' WHEN n_chars < 4000 THEN '4k' ELSE '16k' END AS tier FROM documents)) WHERE draw <= 15")
def l9(spark, d):
    tier = F.when(F.col("n_chars") < 1000, "1k").when(F.col("n_chars") < 4000, "4k").otherwise("16k")
    return L.capped(items(spark, d).withColumn("tier", tier), ["tier"], 15, "s2", "doc_id").select("doc_id", "tier")


_DRAW = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {0} ORDER BY md5('{1}' || doc_id), doc_id) AS draw FROM documents) WHERE draw <= {2}"


@query("l10_review_sample", f"""
WITH a AS ({_DRAW.format('lang', 'r0', 10)} UNION {_DRAW.format('source', 'r1', 2)}),
e AS (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND doc_id NOT IN (SELECT doc_id FROM a) AND (SELECT count(*) FROM a JOIN documents USING (doc_id) WHERE lang IN ('de', 'fr')) < 45 ORDER BY md5('re' || doc_id), doc_id LIMIT 45),
b AS (SELECT * FROM a UNION ALL SELECT * FROM e), t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('rt' || doc_id), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b))
SELECT doc_id FROM b UNION ALL SELECT doc_id FROM t WHERE k <= 150 - (SELECT count(*) FROM b)""")
def l10(spark, d):
    return L.review_sample(items(spark, d), "doc_id", {"lang": 10, "source": 2}, ("lang", ["de", "fr"], 45), 150, "r")


_BLIND = """j AS (SELECT l.doc_id, quality = 1 AS ok, lang, CASE WHEN n_chars >= 4000 THEN 'long' ELSE 'short' END AS tier, md5('b1' || l.doc_id) AS o FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
h AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, ok ORDER BY o, doc_id) AS k FROM j WHERE lang IN ('de', 'es')) WHERE k <= 3),
t AS (SELECT doc_id FROM j WHERE tier = 'long' AND doc_id NOT IN (SELECT doc_id FROM h) ORDER BY o, doc_id LIMIT 8), ht AS (SELECT * FROM h UNION ALL SELECT * FROM t),
w AS (SELECT doc_id, row_number() OVER (ORDER BY o, doc_id) AS k FROM j WHERE NOT ok AND doc_id NOT IN (SELECT doc_id FROM ht)), x AS (SELECT * FROM ht UNION ALL SELECT doc_id FROM w WHERE k <= greatest(0, (40 - (SELECT count(*) FROM ht)) // 2)),
y AS (SELECT doc_id, row_number() OVER (ORDER BY o, doc_id) AS k FROM j WHERE ok AND doc_id NOT IN (SELECT doc_id FROM x)), z AS (SELECT * FROM x UNION ALL SELECT doc_id FROM y WHERE k <= 40 - (SELECT count(*) FROM x))"""


def blind(spark, d):
    rows = table(spark, d, "labels").join(items(spark, d).select("doc_id", "lang", F.when(F.col("n_chars") >= 4000, "long").otherwise("short").alias("tier")), "doc_id")
    return L.blind_sample(rows.select("doc_id", "lang", "tier", (F.col("quality") == 1).alias("verdict")), "doc_id", ("lang", ["de", "es"], 3), ("tier", "long", 8), "verdict", 40, "b1")


@query("l11_blind_sample", f"WITH {_BLIND} SELECT doc_id, lang, tier, row_number() OVER (ORDER BY md5('b1s' || doc_id), doc_id) AS row FROM z JOIN j USING (doc_id)")
def l11(spark, d):
    return blind(spark, d)[0]


@query("l11_key_file", f"WITH {_BLIND} SELECT doc_id, ok AS verdict FROM z JOIN j USING (doc_id)")
def l11_key(spark, d):
    return blind(spark, d)[1]


@query("l12_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def l12(spark, d):
    return items(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
