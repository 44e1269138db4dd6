"""Queries of extraction (X1 to X15) on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NUMBER, WORD, tokens
from ..registry import query
from ..sources.source_queries import scratch
from ..sources.tables import spread, table
from . import extract as X


@query("x1_numeric_facts", f"SELECT doc_id, i - 1 AS ord, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMBER}')) AS v, generate_subscripts(regexp_extract_all(text, '{NUMBER}'), 1) AS i FROM documents)")
def x1(spark, d):
    return X.facts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", NUMBER).select("doc_id", "ord", "value")


@query("x1_snippets", f"SELECT doc_id, length(string_split_regex(text, '{NUMBER}')[1]) AS start, regexp_extract(text, '{NUMBER}') AS value FROM documents WHERE regexp_matches(text, '{NUMBER}')")
def x1_snippets(spark, d):
    return X.facts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", NUMBER).filter("ord = 0").select("doc_id", "start", "value")


_KINDS = {"mail": r"[a-z.0-9]+@[a-z0-9]+\.example\.com", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"}


@query("x2_multi_pattern", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in _KINDS.items()))
def x2(spark, d):
    return X.mined(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", _KINDS)


@query("x3_units", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), l AS (SELECT *, regexp_extract(body, '^[A-Za-z]+', 0) AS k FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS nth FROM l) SELECT doc_id, i - 1 AS pos, CASE WHEN nth > 1 THEN k || '#' || nth ELSE k END AS label FROM n")
def x3(spark, d):
    return X.units(table(spark, d, "documents"), "doc_id", "text", "\n", "^[A-Za-z]+").select("doc_id", F.col("pos").cast("long").alias("pos"), "label")


@query("x4_marker_counts", "SELECT doc_id, len(regexp_extract_all(text, '[.] ')) AS stops, len(regexp_extract_all(text, '[|]')) AS bars, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[#*$%&]'))), '') AS signs FROM documents")
def x4(spark, d):
    signs = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[#*$%&]"), F.lit(0)))), "")
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[.] ")).cast("long").alias("stops"), F.regexp_count("text", F.lit("[|]")).cast("long").alias("bars"), signs.alias("signs"))


@query("x5_enumeration", "SELECT page_id, i AS no, content FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) AS content, generate_subscripts(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1), 1) AS i, len(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) AS n FROM pages) WHERE n >= 3 AND length(content) <= 400")
def x5(spark, d):
    items = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", items.alias("l")).filter(F.size("l") >= 3).select("page_id", F.posexplode("l").alias("pos", "content"))
    return rows.filter(F.length("content") <= 400).select("page_id", (F.col("pos") + 1).cast("long").alias("no"), "content")


@query("x6_links", "SELECT page_id, href, arg_max(label, i) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) AS i FROM pages) GROUP BY 1, 2")
def x6(spark, d):
    each = table(spark, d, "pages").select("page_id", F.posexplode(X.links(F.col("html"))).alias("pos", "x"))
    return each.groupBy("page_id", F.col("x.href").alias("href")).agg(F.max_by("x.label", "pos").alias("label"))


@query("x7_link_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(html|/)$') AND NOT regexp_matches(url, '/(de|fr)/')")
def x7(spark, d):
    return table(spark, d, "pages").filter(F.col("url").rlike("(html|/)$") & ~F.col("url").rlike("/(de|fr)/")).select("page_id", "url")


@query("x8_cells", """
WITH g AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(x, '|'), lambda c: trim(c))) AS g FROM documents),
d AS (SELECT doc_id, g, len(list_filter(flatten(g), lambda c: c <> '')) / len(flatten(g))::DOUBLE AS density FROM g WHERE len(g) >= 2 AND len(g[1]) >= 2),
r AS (SELECT doc_id, density, g[1] AS head, unnest(g) AS row, generate_subscripts(g, 1) - 1 AS row_index FROM d),
c AS (SELECT doc_id, density, head, row[1] AS row_header, row_index, unnest(row) AS cell_text, generate_subscripts(row, 1) - 1 AS col_index FROM r WHERE row_index > 0)
SELECT doc_id, row_index, col_index, row_header, head[col_index + 1] AS col_header, cell_text, round(least(density, CASE WHEN length(cell_text) = 0 THEN 0.2 WHEN length(cell_text) <= 40 THEN 1.0 ELSE 0.7 END), 4) AS confidence FROM c WHERE col_index > 0""")
def x8(spark, d):
    grid = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.transform(F.split(x, "[|]"), lambda c: F.trim(c)))
    return X.cells(table(spark, d, "documents"), "doc_id", grid)


@query("x9_alignment", f"WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents), s AS (SELECT item_id AS l, doc_id AS r, len(list_intersect(b.w, t.w)) / len(b.w)::DOUBLE AS share FROM b, t) SELECT l, r, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY share DESC, r) AS k FROM s WHERE share >= 0.5) WHERE k = 1")
def x9(spark, d):
    pages = spread(table(spark, d, "documents").select("doc_id", "text"))
    return X.aligned(table(spark, d, "benchmark"), pages, "item_id", "doc_id", tokens(F.col("text")), tokens(F.col("text")))


@query("x10_pseudo_pages", "SELECT doc_id, i AS page_no, length(substr(text, i * 2600 + 1, 2600)) AS n FROM documents, range(0, 1000) t(i) WHERE i * 2600 < length(text)")
def x10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(X.pseudo_pages(F.col("text"), 2600)).alias("page_no", "p"))
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.length("p").cast("long").alias("n"))


@query("x10_paragraph_pages", r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS a, text FROM documents),
f(doc_id, a, i, page, size) AS (SELECT doc_id, a, 1, 0, length(a[1]) FROM l WHERE len(a) > 0 UNION ALL SELECT doc_id, a, i + 1, CASE WHEN size >= 600 THEN page + 1 ELSE page END, CASE WHEN size >= 600 THEN length(a[i + 1]) ELSE size + length(a[i + 1]) END FROM f WHERE i < len(a))
SELECT doc_id, page AS page_no, CAST(sum(length(a[i])) + count(*) - 1 AS BIGINT) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, length(text) FROM l WHERE len(a) = 0""")
def x10_paragraphs(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.paragraph_pages(F.col("text"), 600)).alias("page_no", "p"))
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.length("p").cast("long").alias("n"))


@query("x11_lead_marker", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE turn <= 6 AND contains(text, 'the') GROUP BY 1")
def x11(spark, d):
    return table(spark, d, "conversations").filter((F.col("turn") <= 6) & F.contains("text", F.lit("the"))).groupBy("conv_id").agg(F.min_by("turn", "turn").alias("turn"))


@query("x12_keyword_scores", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) + len(regexp_extract_all(text, 'and')) AS BIGINT) AS score FROM documents ORDER BY 2 DESC, 1 LIMIT 12")
def x12(spark, d):
    return table(spark, d, "documents").select("doc_id", X.scored(F.col("text"), ["the", "and"]).alias("score")).orderBy(F.desc("score"), "doc_id").limit(12)


@query("x13_ring_pairs", "WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT a.item_id AS a, b.item_id AS b FROM o a, o b WHERE b.i = (a.i + 1) % a.n OR b.i = (a.i + 3) % a.n")
def x13(spark, d):
    return X.ring_pairs(table(spark, d, "benchmark"), "item_id", [1, 3])


@query("x13_all_pairs", "SELECT a.item_id AS a, b.item_id AS b FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id")
def x13_all(spark, d):
    return X.all_pairs(table(spark, d, "benchmark"), "item_id")


_FACTS = {"documents": "doc_id", "orders": "o_orderkey", "events": "event_id"}


@query("x14_static_facts", " UNION ALL ".join(f"SELECT '{t}' AS name, '{k}' AS key, count(*) AS rows, count(DISTINCT {k}) = count(*) AS is_key FROM {t}" for t, k in _FACTS.items()))
def x14(spark, d):
    """Facts about the sources themselves: literals (name, key) beside what is counted."""
    each = [table(spark, d, t).agg(F.lit(t).alias("name"), F.lit(k).alias("key"), F.count(F.lit(1)).alias("rows"), (F.countDistinct(k) == F.count(F.lit(1))).alias("is_key")) for t, k in _FACTS.items()]
    return each[0].union(each[1]).union(each[2])


def _authored(spark, d):
    """A folder with a file a language: arrays of documents, but one file is broken and one holds no array."""
    path = scratch(spark)
    rows = table(spark, d, "documents").groupBy("lang").agg(F.to_json(F.collect_list(F.struct("doc_id", "n_chars"))).alias("value"))
    value = F.when(F.col("lang") == "de", F.substring("value", 1, 30)).when(F.col("lang") == "fr", F.concat(F.lit('{"items": '), "value", F.lit("}"))).otherwise(F.col("value"))
    rows.select("lang", value.alias("value")).write.partitionBy("lang").text(path)
    return path + "/*"


@query("x15_merge_arrays", "SELECT doc_id, n_chars FROM documents WHERE lang NOT IN ('de', 'fr')")
def x15(spark, d):
    return X.merged_arrays(spark, _authored(spark, d), "struct<doc_id: bigint, n_chars: bigint>")[0].select("doc_id", "n_chars")


@query("x15_bad_files", "SELECT CASE lang WHEN 'de' THEN 'no JSON' ELSE 'not a list' END AS reason, count(DISTINCT lang) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1")
def x15_bad(spark, d):
    return X.merged_arrays(spark, _authored(spark, d), "struct<doc_id: bigint, n_chars: bigint>")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
