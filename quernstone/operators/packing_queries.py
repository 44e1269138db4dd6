"""Queries of context packing (D1 to D18): documents by source stand for components, n_chars div 2 for tokens."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import token_length
from ..registry import query
from ..sources.tables import table
from . import packing as K
from .numbering import next_fit

C = "c AS (SELECT doc_id, source, lang, CAST(length(text) // 2 AS BIGINT) AS tok FROM documents)"
RUN = f"WITH {C}, r AS (SELECT *, sum(tok) OVER (PARTITION BY source ORDER BY doc_id) AS cum, sum(tok) OVER (PARTITION BY source ORDER BY doc_id DESC) AS back, sum(tok) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM c)"


def parts(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", token_length(F.col("text")).alias("tok"))


def banded(spark, d):
    totals = parts(spark, d).groupBy("source").agg(F.sum("tok").alias("total"))
    rows = K.running(parts(spark, d), ["source"], ["doc_id"], "tok").join(totals, "source")
    return rows.withColumn("band", K.band(F.col("cum") - F.col("tok"), F.col("tok"), F.col("total")))


BANDS = RUN + ", b AS (SELECT *, CASE WHEN (cum - tok + tok / 2) / total < 0.34 THEN 'early' WHEN (cum - tok + tok / 2) / total < 0.67 THEN 'middle' ELSE 'late' END AS band FROM r)"


@query("d1_components", "SELECT 'document' AS kind, doc_id AS id, '## ' || source || chr(10) || substr(text, 1, 30) AS header, CAST(length(text) // 2 AS BIGINT) AS tok FROM documents UNION ALL SELECT 'passage', item_id, '## benchmark' || chr(10) || substr(text, 1, 30), CAST(length(text) // 2 AS BIGINT) FROM benchmark")
def d1(spark, d):
    one = lambda df, kind, key, title: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat(F.lit("## "), title, F.lit("\n"), F.substring("text", 1, 30)).alias("header"), token_length(F.col("text")).alias("tok"))
    return one(table(spark, d, "documents"), "document", "doc_id", F.col("source")).unionByName(one(table(spark, d, "benchmark"), "passage", "item_id", F.lit("benchmark")))


@query("d1_row_blocks", "SELECT o_orderstatus, b AS block, '## ' || o_orderstatus || ' ' || b || chr(10) || string_agg(o_orderkey || ',' || o_custkey, chr(10) ORDER BY o_orderkey) AS component, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 60 AS b FROM orders) GROUP BY 1, 2")
def d1_rows(spark, d):
    """The third kind of component: blocks of rows, with a header line."""
    rows = K.blocks(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"), ["o_orderstatus"], ["o_orderkey"], 60)
    made = rows.groupBy("o_orderstatus", "block").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat_ws(",", x["o_orderkey"], x["o_custkey"])), "\n")
    return made.select("o_orderstatus", "block", F.concat(F.lit("## "), "o_orderstatus", F.lit(" "), F.col("block").cast("string"), F.lit("\n"), lines).alias("component"), F.size("r").cast("long").alias("n"))


@query("d2_blocks", "SELECT o_orderstatus, b AS block, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 60 AS b FROM orders) GROUP BY 1, 2")
def d2(spark, d):
    rows = K.blocks(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 60)
    return rows.groupBy("o_orderstatus", "block").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), " ").alias("ids"))


@query("d3_table_component", "SELECT r_name, 'begin' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) || 'end' AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def d3(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.concat(F.lit("begin\n"), F.array_join(F.array_sort(F.collect_list("n_name")), "\n"), F.lit("\nend")).alias("body"))


@query("d4_prefix", RUN + " SELECT doc_id, source, CAST(cum AS BIGINT) AS cum FROM r WHERE cum <= 9000")
def d4(spark, d):
    return K.prefix_pack(parts(spark, d), ["source"], ["doc_id"], "tok", 9000).select("doc_id", "source", "cum")


@query("d5_suffix", RUN + " SELECT doc_id, source FROM r WHERE back <= 4000")
def d5(spark, d):
    return K.prefix_pack(parts(spark, d), ["source"], [F.desc("doc_id")], "tok", 4000).select("doc_id", "source")


@query("d6_prefill", RUN + " SELECT doc_id, source FROM r WHERE cum - tok < 9000")
def d6(spark, d):
    return K.prefill(parts(spark, d), ["source"], ["doc_id"], "tok", 9000).select("doc_id", "source")


@query("d7_cyclic", RUN + " SELECT doc_id, source, cycle, CAST(cycle * total + cum - tok AS BIGINT) AS start FROM r, range(0, 200) t(cycle) WHERE rn <= 5 AND cycle * total + cum - tok < 60000".replace("rn <= 5 AND ", ""))
def d7(spark, d):
    return K.cyclic(parts(spark, d), ["source"], ["doc_id"], "tok", 60000).select("doc_id", "source", "cycle", F.col("offset").alias("start"))


@query("d8_greedy_reset", """
WITH RECURSIVE l AS (SELECT source, list(length(text) ORDER BY doc_id) AS a, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1),
f(source, a, ids, i, part, held) AS (SELECT source, a, ids, 1, 0, a[1] FROM l UNION ALL
SELECT source, a, ids, i + 1, CASE WHEN held + a[i + 1] > 20000 THEN part + 1 ELSE part END, CASE WHEN held + a[i + 1] > 20000 THEN a[i + 1] ELSE held + a[i + 1] END FROM f WHERE i < len(a))
SELECT source, ids[i] AS doc_id, CAST(part AS BIGINT) AS part FROM f""")
def d8(spark, d):
    """Next-fit of a source's sizes (not its texts) in order."""
    sizes = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return next_fit(sizes, "source", "doc_id", "n", 20000).select("source", "doc_id", "part")


@query("d9_bands", BANDS + " SELECT doc_id, source, band FROM b")
def d9(spark, d):
    return banded(spark, d).select("doc_id", "source", "band")


@query("d10_offsets", RUN + " SELECT doc_id, CAST(cum - tok AS BIGINT) AS start, CAST(cum AS BIGINT) AS stop FROM r")
def d10(spark, d):
    return K.running(parts(spark, d), ["source"], ["doc_id"], "tok").select("doc_id", (F.col("cum") - F.col("tok")).alias("start"), F.col("cum").alias("stop"))


@query("d11_round_robin", RUN + " SELECT doc_id, source, rn AS turn FROM r WHERE rn <= 3")
def d11(spark, d):
    return K.interleaved(parts(spark, d), "source", ["doc_id"]).filter("turn <= 3").select("doc_id", "source", "turn").orderBy("turn", "source")


@query("d12_manifest", f"WITH {C} SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n_components, CAST(sum(tok) AS BIGINT) AS tokens FROM c GROUP BY 1")
def d12(spark, d):
    return parts(spark, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count(F.lit(1)).alias("n_components"), F.sum("tok").alias("tokens"))


@query("d13_inverted", BANDS + " SELECT doc_id, string_agg(source || ':' || band, ',') AS places FROM b GROUP BY 1")
def d13(spark, d):
    """From the manifest's rows; no bundle is gathered."""
    return banded(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "band"))), ",").alias("places"))


#: Bundles: a source's documents up to a tier's budget; the tiers of each document.
TIERS = RUN + ", t AS (SELECT doc_id, source, tier, row_number() OVER (PARTITION BY doc_id ORDER BY tier) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC) AS down, count(*) OVER (PARTITION BY doc_id) AS n FROM r, (VALUES (4000), (8000), (16000), (32000)) v(tier) WHERE cum <= tier)"


def tiered(spark, d):
    rows = K.running(parts(spark, d), ["source"], ["doc_id"], "tok")
    return rows.withColumn("tier", F.explode(F.array(*map(F.lit, (4000, 8000, 16000, 32000))))).filter(F.col("cum") <= F.col("tier")).select("doc_id", "source", "tier")


@query("d14_smallest_largest", TIERS + " SELECT doc_id, min(tier) AS smallest, max(tier) AS largest FROM t GROUP BY 1")
def d14(spark, d):
    return tiered(spark, d).groupBy("doc_id").agg(F.min("tier").alias("smallest"), F.max("tier").alias("largest"))


@query("d15_contains_all", BANDS + """, p AS (SELECT source, list(DISTINCT lang) AS langs, CAST(sum(tok) AS BIGINT) AS tokens FROM b GROUP BY 1)
SELECT source, tokens FROM p WHERE list_contains(langs, 'en') AND list_contains(langs, 'de')""")
def d15(spark, d):
    have = parts(spark, d).groupBy("source").agg(F.collect_set("lang").alias("langs"), F.sum("tok").alias("tokens"))
    return have.filter(K.covers(F.array(F.lit("en"), F.lit("de")), F.col("langs"))).select("source", "tokens")


@query("d15_largest_bundle", TIERS + """, n AS (SELECT source, min(doc_id) AS a, max(doc_id) AS z FROM r WHERE rn <= 3 GROUP BY 1), m AS (SELECT n.source, tier, count(DISTINCT doc_id) AS met, count(DISTINCT CASE WHEN doc_id IN (a, z) THEN doc_id END) AS hit, CASE WHEN a = z THEN 1 ELSE 2 END AS need FROM n JOIN t ON t.source = n.source GROUP BY 1, 2, a, z)
SELECT source, max(tier) AS tier FROM m WHERE hit = need GROUP BY 1""")
def d15_largest(spark, d):
    """The largest of a source's bundles that holds both its first and its third document."""
    first = K.running(parts(spark, d).withColumn("one", F.lit(1)), ["source"], ["doc_id"], "one", "rn").filter("rn <= 3")
    needs = first.groupBy("source").agg(F.array(F.min("doc_id"), F.max("doc_id")).alias("needed"))
    bundles = tiered(spark, d).groupBy(F.col("source").alias("bundle"), "tier").agg(F.collect_list("doc_id").alias("have"))
    return K.largest_covering(needs, bundles, "source", "needed", "have", [F.desc("tier"), "bundle"]).select("source", "tier")


@query("d17_stale_references", TIERS + " SELECT l.doc_id, max(tier) AS tier FROM labels l LEFT JOIN t ON t.doc_id = l.doc_id AND t.tier <> 8000 GROUP BY 1")
def d17_stale(spark, d):
    """References to bundles that are not there any more are dropped; the item stays, without one if need be."""
    there = tiered(spark, d).filter("tier <> 8000").select("doc_id", "tier")
    wanted = table(spark, d, "labels").select("doc_id").distinct().join(tiered(spark, d).select("doc_id", F.col("tier").alias("asked")), "doc_id", "left")
    kept = wanted.join(there.select("doc_id", F.col("tier").alias("asked"), "tier"), ["doc_id", "asked"], "left")
    return kept.groupBy("doc_id").agg(F.max("tier").alias("tier"))


@query("d16_middle", TIERS + " SELECT doc_id, tier FROM t WHERE up = n // 2 + 1")
def d16(spark, d):
    w = Window.partitionBy("doc_id")
    rows = tiered(spark, d).withColumns({"up": F.row_number().over(w.orderBy("tier")), "n": F.count(F.lit(1)).over(w)})
    return rows.filter(F.col("up") == F.floor(F.col("n") / 2) + 1).select("doc_id", "tier")


@query("d17_dispatch", TIERS + """
SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN a.tier WHEN d.lang = 'de' THEN z.tier END AS tier FROM documents d LEFT JOIN (SELECT * FROM t WHERE up = 1) a ON a.doc_id = d.doc_id LEFT JOIN (SELECT * FROM t WHERE down = 1) z ON z.doc_id = d.doc_id""")
def d17(spark, d):
    ends = tiered(spark, d).groupBy("doc_id").agg(F.min("tier").alias("a"), F.max("tier").alias("z"))
    docs = table(spark, d, "documents").select("doc_id", "lang").join(ends, "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("lang") == "en", F.col("a")).when(F.col("lang") == "de", F.col("z")).alias("tier"))


@query("d17_attach", TIERS + BANDS[len(RUN):] + """, f AS (SELECT source, min(doc_id) AS f FROM r GROUP BY 1), o AS (SELECT t.doc_id, t.source, min(tier) AS a, max(tier) AS z, max(CASE WHEN up = n // 2 + 1 THEN tier END) AS m FROM t GROUP BY 1, 2),
p AS (SELECT d.doc_id, d.source, CASE d.lang WHEN 'en' THEN CASE WHEN band = 'early' THEN a END WHEN 'de' THEN CASE WHEN band = 'late' THEN z END WHEN 'fr' THEN z ELSE m END AS tier, CASE d.lang WHEN 'en' THEN 'early' WHEN 'de' THEN 'late' WHEN 'fr' THEN 'multi' ELSE band END AS position FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN tier IS NOT NULL THEN source END AS bundle, tier, CASE WHEN tier IS NOT NULL THEN position END AS position FROM p""")
def d17_attach(spark, d):
    """Documents as items and pages, bundles by source and tier; an item of the third family needs its source's first document as well."""
    where = tiered(spark, d).join(banded(spark, d).select("doc_id", "band"), "doc_id").select(F.col("source").alias("bundle"), "tier", F.col("doc_id").alias("page"), "band")
    first = parts(spark, d).groupBy("source").agg(F.min("doc_id").alias("first"))
    items = parts(spark, d).join(first, "source").select("doc_id", "lang", F.when(F.col("lang") == "fr", F.array("doc_id", "first")).otherwise(F.array("doc_id")).alias("pages"))
    return K.attached(items, where, "doc_id", "lang", "pages", {"en": "early", "de": "late", "fr": "all"})


@query("d18_coverage", BANDS + " SELECT band, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS bundles FROM b GROUP BY 1")
def d18(spark, d):
    return banded(spark, d).groupBy("band").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("bundles"))
