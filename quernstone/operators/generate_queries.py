"""Queries of question generation (G1 to G12): lines of orders as cells, documents as announcements."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..registry import query
from ..sources.sinks import rendered
from ..sources.tables import table
from . import generate as G
from .numbering import running


@query("g1_unique_pairs", "SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def g1(spark, d):
    return G.unique_in(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("g2_quantity_cells", "SELECT p_partkey FROM part WHERE p_size % 10 <> 0 AND length(p_size || 'mm ' || p_name) <= 14 AND contains(p_name, ' ') AND (p_size % 2 = 0 OR regexp_matches(p_type, 'LARGE|SMALL'))")
def g2(spark, d):
    """Sizes of parts as cells: the unit stands in some cells and in some headers."""
    p = table(spark, d, "part")
    cell = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "mm ").otherwise("   "), F.col("p_name"))
    sure = F.when(F.col("p_size") % 10 == 0, 0.5).otherwise(1.0)
    rows = p.select("p_partkey", "p_name", cell.alias("cell"), "p_type", sure.alias("sure"))
    return G.quantity_cells(rows, F.col("cell"), F.col("p_type"), F.col("sure"), F.contains("p_name", F.lit(" ")), ["mm", "LARGE", "SMALL"], longest=14).select("p_partkey")


@query("g3_nested_caps", """
WITH RECURSIVE l AS (SELECT p_brand, list(p_type ORDER BY p_partkey) AS t, list(p_size ORDER BY p_partkey) AS s, list(p_partkey ORDER BY p_partkey) AS k FROM part GROUP BY 1),
f(p_brand, t, s, k, i, kt, ks, ok) AS (SELECT p_brand, t, s, k, 0, CAST([] AS VARCHAR[]), CAST([] AS INTEGER[]), false FROM l UNION ALL
SELECT p_brand, t, s, k, i + 1, CASE WHEN go THEN list_append(kt, t[i + 1]) ELSE kt END, CASE WHEN go THEN list_append(ks, s[i + 1]) ELSE ks END, go
FROM (SELECT *, len(kt) < 12 AND len(list_filter(kt, lambda x: x = t[i + 1])) < 3 AND len(list_filter(ks, lambda x: x = s[i + 1])) < 2 AS go FROM f WHERE i < len(t)))
SELECT k[i] AS p_partkey, p_brand, t[i] AS p_type, s[i] AS p_size FROM f WHERE ok""")
def g3(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return G.nested_caps(rows, "p_brand", ["p_partkey"], {"p_brand": 12, "p_type": 3, "p_size": 2})


@query("g3_single_cap", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 2")
def g3_one(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return G.nested_caps(rows, "p_brand", ["p_partkey"], {"p_type": 2}).select("p_partkey")


@query("g4_eligibility", "SELECT doc_id FROM documents WHERE (contains(text, 'License') OR contains(text, 'reserved')) AND NOT regexp_matches(text, '[0-9]{16}')")
def g4(spark, d):
    return table(spark, d, "documents").filter(G.eligible(F.col("text"), ["License", "reserved"], "[0-9]{16}")).select("doc_id")


@query("g5_schedule", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'filled' END, CASE WHEN o_orderpriority <> '' THEN o_orderpriority END) AS header, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '-(01|02)-')")
def g5(spark, d):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").withColumn("date", date)
    cells = G.schedule_cells(rows, F.col("date"), "-(01|02)-", [F.when(F.col("o_orderstatus") == "F", "filled").otherwise(" "), F.col("o_orderpriority")])
    return cells.select("o_orderkey", "header", "date")


@query("g6_unique_facts", "SELECT source, n_chars FROM documents GROUP BY 1, 2 HAVING count(*) = 1")
def g6(spark, d):
    return G.unique_in(table(spark, d, "documents").select("source", "n_chars"), "source", "n_chars")


@query("g7_early_late", """
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents), m AS (SELECT *, max(page) OVER (PARTITION BY source) AS last FROM p),
e AS (SELECT *, CASE WHEN page <= 6 THEN 'early' WHEN page >= greatest(8, floor(last * 0.58::DOUBLE)) THEN 'late' END AS place FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source, place ORDER BY doc_id) AS nth FROM e WHERE place IS NOT NULL)
SELECT doc_id, place FROM r WHERE nth <= CASE place WHEN 'early' THEN 4 ELSE 3 END""")
def g7(spark, d):
    pages = running(table(spark, d, "documents").select("doc_id", "source", F.lit(1).alias("one")), ["source"], ["doc_id"], "one", "page")
    return G.ends(pages, "source", "page", ["doc_id"], caps=(4, 3)).select("doc_id", "place")


@query("g8_comparisons", """
WITH r AS (SELECT n_name, c_custkey, c_acctbal, lead(c_custkey) OVER w AS other, row_number() OVER w AS nth FROM customer JOIN nation ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey))
SELECT n_name, array_to_string(list_sort([CAST(c_custkey AS VARCHAR), CAST(other AS VARCHAR)]), '|') AS pair, c_custkey AS winner FROM r WHERE other IS NOT NULL AND nth <= 5""")
def g8(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_acctbal")
    return G.compared(c, "n_name", "c_custkey", "c_acctbal", 5)


@query("g8_region_pairs", """
WITH c AS (SELECT r_name, n_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
p AS (SELECT a.r_name, a.n_name AS a, b.n_name AS b, CASE WHEN a.n > b.n THEN a.n_name WHEN a.n < b.n THEN b.n_name END AS winner, row_number() OVER (PARTITION BY a.r_name ORDER BY a.n_name, b.n_name) AS k FROM c a JOIN c b ON a.r_name = b.r_name AND a.n_name < b.n_name)
SELECT r_name, a, b, winner FROM p WHERE k <= 7""")
def g8_regions(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = n.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("n"))
    return G.all_pairs(counts, "r_name", "n_name", "n", 7)


@query("g8_providers", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT a.source AS a, b.source AS b, CASE WHEN a.n > b.n THEN a.source WHEN a.n < b.n THEN b.source END AS winner, row_number() OVER (ORDER BY a.source, b.source) AS k FROM c a JOIN c b ON a.source < b.source)
SELECT a, b, winner FROM p WHERE k <= 40""")
def g8_providers(spark, d):
    """Providers are the one group here."""
    counts = table(spark, d, "documents").groupBy(F.lit("all").alias("g"), "source").agg(F.count(F.lit(1)).alias("n"))
    return G.all_pairs(counts, "g", "source", "n", 40).drop("g")


@query("g9_absence_pairs", "SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders")
def g9(spark, d):
    o = table(spark, d, "orders")
    return G.absent_pairs(o.select("o_custkey").distinct(), o.select("o_orderpriority"), o.select("o_custkey", "o_orderpriority"))


@query("g10_max_ordinal", "SELECT conv_id, 'how many turns has conversation ' || conv_id || '?' AS question, max(turn) + 1 AS answer FROM conversations GROUP BY 1")
def g10_max(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("answer"))
    return c.select("conv_id", F.format_string("how many turns has conversation %d?", "conv_id").alias("question"), "answer")


@query("g10_cloze", r"""
SELECT doc_id, 'fill in: ' || regexp_replace(l, '[0-9]+', '____') AS question, regexp_extract(l, '[0-9]+') AS answer FROM (SELECT doc_id, regexp_extract(text, '(?m)^.*[0-9].*$') AS l FROM documents) WHERE l <> ''""")
def g10_cloze(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(?m)^.*[0-9].*$", 0).alias("l")).filter("l <> ''")
    first = F.regexp_extract("l", "[0-9]+", 0)
    at = F.instr(F.col("l"), first)
    blank = F.concat(F.substring("l", F.lit(1), at - 1), F.lit("____"), F.substring("l", at + F.length(first), F.length("l")))
    return rows.select("doc_id", F.concat(F.lit("fill in: "), blank).alias("question"), first.alias("answer"))


@query("g10_titles", "SELECT min(page_id) AS page_id, t AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) WHERE t <> '' GROUP BY t HAVING count(*) = 1")
def g10_titles(spark, d):
    """Pages that their title names."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).filter("title <> ''")
    return G.unique_in(rows, "title").select("page_id", "title")


@query("g10_formats", "SELECT r_name, format, count(n_nationkey) AS answer FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('txt'), ('markdown'), ('csv'), ('json')) v(format) GROUP BY 1, 2")
def g10_formats(spark, d):
    """The same slice in four formats: the answer, counted in the rendering, is the same."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = rendered(n, "r_name", ["n_nationkey"], ["n_nationkey", "n_name"])
    return made.select("r_name", "format", F.size(F.split("rendered", "\n")).cast("long").alias("answer"))


@query("g10_negative_controls", "SELECT o_custkey, 'which order of priority ' || p || ' has customer ' || o_custkey || '?' AS question, 'cannot be determined' AS answer FROM (SELECT o_custkey, o_orderpriority AS p FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders)")
def g10_negative(spark, d):
    """Questions on what is not there."""
    gone = g9(spark, d)
    return gone.select("o_custkey", F.format_string("which order of priority %s has customer %d?", "o_orderpriority", "o_custkey").alias("question"), F.lit("cannot be determined").alias("answer"))


@query("g10_metadata_pairs", """
WITH c AS (SELECT lang, min(doc_id) AS first FROM documents GROUP BY 1) SELECT a.lang AS a, b.lang AS b, CASE WHEN a.first < b.first THEN b.lang ELSE a.lang END AS winner FROM c a JOIN c b ON a.lang < b.lang""")
def g10_metadata(spark, d):
    """Which of two languages comes later in the collection."""
    firsts = table(spark, d, "documents").groupBy(F.lit("all").alias("g"), "lang").agg(F.min("doc_id").alias("first"))
    return G.all_pairs(firsts, "g", "lang", "first", 1000).drop("g")


@query("g10_top_two", "SELECT o_orderpriority, 'which is greater: ' || a || ' or ' || b || '?' AS question, a AS answer FROM (SELECT o_orderpriority, max(o_orderkey) FILTER (r = 1) AS a, max(o_orderkey) FILTER (r = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2 GROUP BY 1)")
def g10(spark, d):
    nth = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    two = table(spark, d, "orders").withColumn("r", nth).filter("r <= 2").groupBy("o_orderpriority").agg(F.max(F.when(F.col("r") == 1, F.col("o_orderkey"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("o_orderkey"))).alias("b"))
    return two.select("o_orderpriority", F.format_string("which is greater: %d or %d?", "a", "b").alias("question"), F.col("a").alias("answer"))


@query("g11_keep_first", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def g11(spark, d):
    return G.keep_first(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])


@query("g12_verified", "SELECT c.conv_id FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) k ON k.conv_id = c.conv_id WHERE c.turn = k.n - 1 AND c.role = 'assistant'")
def g12(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"))
    return G.verified(c, (F.col("role") == "assistant") & (F.col("last") == F.col("n") - 1)).select("conv_id")
