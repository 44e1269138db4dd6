"""Queries of the text functions (T1 to T31) on documents, pages and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.retrieval import containing
from ..registry import query
from ..sources.tables import spread, table
from . import text as X

SP = X.SPACE
DOCS = "documents"


def _each(name, sql, make, source="documents", key="doc_id"):
    def run(spark, d):
        t = spread(table(spark, d, source)) if source in ("documents", "pages") else table(spark, d, source)
        return t.select(key, *[v.alias(k) for k, v in make(F).items()])

    query(name, sql)(run)


_each("t1_strip_space", f"SELECT doc_id, regexp_replace(text, '{SP}+', '', 'g') AS t FROM documents", lambda F: {"t": X.squeezed(F.col("text"))})
_each("t2_collapse", f"SELECT doc_id, trim(regexp_replace(text, '{SP}+', ' ', 'g')) AS t FROM documents", lambda F: {"t": X.collapsed(F.col("text"))})
_each("t3_numbers", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{X.NUMBER}'), '|') AS n FROM documents", lambda F: {"n": F.array_join(X.numbers(F.col("text")), "|")})
_each("t4_tokens", f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{X.WORD}'), ' ') AS t FROM documents", lambda F: {"t": F.array_join(X.tokens(F.col("text")), " ")})
_each("t5_token_set", f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '{X.WORD}'))) AS BIGINT) AS n FROM documents", lambda F: {"n": F.size(X.token_set(F.col("text"))).cast("long")})
_each("t6_page_text", f"SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{SP}+$', '')), chr(10)), '^\\n+|\\n+$', '', 'g') AS t FROM documents", lambda F: {"t": X.page_text(F.col("text"))})
_UN = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_each("t7_strip_tags", "SELECT page_id, trim(regexp_replace(" + _UN.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')") + f", '{SP}+', ' ', 'g')) AS t FROM pages", lambda F: {"t": X.stripped_tags(F.col("html"))}, "pages", "page_id")
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_each("t8_clean_title", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _UN.format(_TITLE) + f""", '(?i)on[a-z]+="[^"]*"', ' ', 'g'), '<[^>]*>?', ' ', 'g'), '["'';]+\\s*$', ''), '{SP}+', ' ', 'g')) AS t FROM pages""", lambda F: {"t": X.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))}, "pages", "page_id")
_each("t9_slug", r"SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^0-9a-z\x{AC00}-\x{D7A3}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS t FROM documents", lambda F: {"t": X.slug(F.col("text"))})
_each("t10_snippet", f"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SP}+', ' ', 'g')), 1, 120) AS t FROM pages", lambda F: {"t": X.snippet(F.col("html"), 120)}, "pages", "page_id")
_each("t11_numeric_value", f"SELECT doc_id, try_cast(replace(regexp_extract(text, '{X.NUMBER}'), ',', '') AS DOUBLE) AS v, nullif(regexp_extract(text, '%|mm|kg|st'), '') AS u FROM documents", lambda F: {"v": X.numeric_value(F.col("text")), "u": X.unit(F.col("text"), ["%", "mm", "kg", "st"])})
_each("t12_header_unit", "SELECT p_partkey, nullif(regexp_extract(p_type, 'BRASS|STEEL|COPPER|TIN|NICKEL'), '') AS u FROM part", lambda F: {"u": X.unit(F.col("p_type"), ["BRASS", "STEEL", "COPPER", "TIN", "NICKEL"])}, "part", "p_partkey")
_each("t15_markers", "SELECT doc_id, contains(text, 'License') OR contains(text, 'reserved') OR contains(text, 'Copyright') AS m FROM documents", lambda F: {"m": X.marked(F.col("text"), ["License", "reserved", "Copyright"])})
_FOLD = "SELECT doc_id, list_reduce(list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(md5(CAST(doc_id AS VARCHAR)), i, 1)) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % {}) AS b FROM documents"
_each("t21_percent_bucket", _FOLD.format(100), lambda F: {"b": X.bucket(F.col("doc_id").cast("string"))})
_each("t22_rotation", _FOLD.format(7), lambda F: {"b": X.bucket(F.col("doc_id").cast("string"), 7)})
_each("t26_token_length", "SELECT doc_id, CAST(length(text) // 2 AS BIGINT) AS n FROM documents", lambda F: {"n": X.token_length(F.col("text"))})
_each("t27_first_of", """SELECT doc_id, CASE WHEN least(a, b, c) = 1000000000 THEN NULL WHEN a <= b AND a <= c THEN 'the' WHEN b <= c THEN 'der' ELSE 'les' END AS w FROM (SELECT doc_id, coalesce(nullif(instr(text, 'the'), 0), 1000000000) AS a, coalesce(nullif(instr(text, 'der'), 0), 1000000000) AS b, coalesce(nullif(instr(text, 'les'), 0), 1000000000) AS c FROM documents)""", lambda F: {"w": X.first_of(F.col("text"), ["the", "der", "les"])})
_each("t28_classify", "SELECT doc_id, CASE WHEN contains(text, 'MIT License') THEN 'mit' WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, 'token') THEN 'secret' ELSE 'plain' END AS k FROM documents", lambda F: {"k": X.classified(F.col("text"), [("MIT License", "mit"), ("License", "licence"), ("token", "secret")], "plain")})
_each("t30_id_parse", "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages", lambda F: {"host": F.regexp_extract("url", "://([^/?#]+)", 1), "number": F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long")}, "pages", "page_id")


@query("t13_grounding", f"""
SELECT item_id, count(*) FILTER (contains(regexp_replace(d.text, '{SP}+', '', 'g'), regexp_replace(b.text, '{SP}+', '', 'g'))) AS n FROM benchmark b, documents d GROUP BY 1""")
def t13(spark, d):
    """Terms, a stated set, in all documents."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.squeezed(F.col("text")).alias("t"))
    terms = table(spark, d, "benchmark").select("item_id", X.squeezed(F.col("text")).alias("term"))
    hits = containing(terms, docs, "item_id", "term", "doc_id", "t").groupBy(F.col("query").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return terms.select("item_id").join(hits, "item_id", "left").na.fill(0, ["n"])


@query("t14_absent", f"""
SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(regexp_replace(d.text, '{SP}+', '', 'g'), regexp_replace(b.text, '{SP}+', '', 'g')))""")
def t14(spark, d):
    return t13(spark, d).filter("n = 0").select("item_id")


_each("t16_cloze", None, lambda F: {"c": X.cloze(X.collapsed(F.col("text")), F.regexp_extract("text", X.NUMBER, 0))})
_each("t17_trim_term", """
SELECT item_id, CASE WHEN length(text) <= 26 THEN text WHEN contains(cut, ' ') AND pos > 10 THEN substr(cut, 1, pos - 1) ELSE cut END AS t
FROM (SELECT item_id, text, substr(text, 1, 26) AS cut, length(substr(text, 1, 26)) - instr(reverse(substr(text, 1, 26)), ' ') + 1 AS pos FROM benchmark)""", lambda F: {"t": X.trimmed_term(F.col("text"))}, "benchmark", "item_id")
_each("t18_keyed_substitution", "SELECT doc_id, CASE WHEN contains(text, 'token') AND length(text) > 100 THEN 'redacted' WHEN contains(text, 'License') AND length(text) > 100 THEN 'licensed' ELSE source END AS t FROM documents", lambda F: {"t": X.keyed(F.col("source"), F.col("text"), 100, {"token": "redacted", "License": "licensed"})})
_STYLES = {"user": ("rewritten", "", [("the ", "a "), (" of ", " in ")]), "system": ("marked", "note: ", [])}
_each("t19_template_rewrite", "SELECT conv_id, turn, CASE role WHEN 'user' THEN replace(replace(text, 'the ', 'a '), ' of ', ' in ') WHEN 'system' THEN 'note: ' || text ELSE text END AS t, CASE role WHEN 'user' THEN 'rewritten' WHEN 'system' THEN 'marked' ELSE 'kept' END AS style FROM conversations", lambda F: {"turn": F.col("turn"), "t": X.rewritten(F.col("text"), F.col("role"), _STYLES)[0], "style": X.rewritten(F.col("text"), F.col("role"), _STYLES)[1]}, "conversations", "conv_id")
_CLOZE = r"^(.*?)\s*____\s*(.*)$"
_MADE = r"(CASE item_id % 4 WHEN 0 THEN '(see ' || split_part(text, ' ', 1) || ' ____ ' || split_part(text, ' ', 2) || ', (part' WHEN 1 THEN split_part(text, ' ', 1) || ' ____ ' WHEN 2 THEN 'no blank' ELSE split_part(text, ' ', 2) || ' (a) ____; ' || split_part(text, ' ', 3) || '.' END)"
_BAL = r"trim(regexp_replace(regexp_replace(regexp_extract(c, '^(.*?)\s*____\s*(.*)$', {}), '\s*\([^()]*$', ''), '^[^()]*\)\s*', ''), ' .,;:')"
_each("t20_cloze_question", f"SELECT item_id, CASE WHEN a <> '' AND b <> '' THEN 'what comes between ' || a || ' and ' || b || '?' WHEN a <> '' THEN 'what comes after ' || a || '?' END AS q FROM (SELECT item_id, {_BAL.format(1)} AS a, {_BAL.format(2)} AS b FROM (SELECT item_id, {_MADE} AS c FROM benchmark))", lambda F: {"q": X.cloze_question(_made(F), _CLOZE, 1, 2)}, "benchmark", "item_id")


def _made(F):
    k, word = F.col("item_id") % 4, lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    first = F.when(k == 0, F.concat(F.lit("(see "), word(1), F.lit(" ____ "), word(2), F.lit(", (part"))).when(k == 1, F.concat(word(1), F.lit(" ____ "))).when(k == 2, "no blank")
    return first.otherwise(F.concat(word(2), F.lit(" (a) ____; "), word(3), F.lit(".")))


@query("t26_tokens")
def t26_tokens(spark, d):
    """Tokens by a real tokeniser; its files are a parameter."""
    import public_tokenizers

    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", X.token_counts(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).alias("n"))


_each("t23_code", "SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) AS letters FROM customer", lambda F: {"letters": X.code(F.col("c_name"))}, "customer", "c_custkey")
_each("t24_disposition", "SELECT page_id, 'page ' || page_id || '.html' AS name FROM pages", lambda F: {"name": X.disposition_name(F.concat(F.lit("attachment; filename*=UTF-8''page%20"), F.col("page_id").cast("string"), F.lit(".html")))}, "pages", "page_id")
_each("t25_magic_bytes", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' ELSE 'bin' END AS k FROM documents", lambda F: {"k": X.sniffed(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("255044462D"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.lit("text").cast("binary")))})
_each("t29_cascade", "SELECT doc_id, coalesce(nullif(regexp_extract(text, 'Under the ([A-Za-z]+)', 1), ''), nullif(regexp_extract(text, '([A-Z]+) License', 1), ''), lang) AS k FROM documents", lambda F: {"k": X.cascaded(F.regexp_extract("text", "Under the ([A-Za-z]+)", 1), F.regexp_extract("text", "([A-Z]+) License", 1), F.col("lang"))})
_each("t31_quotes", "SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(text, '[\"''‘’“”]([^\"''‘’“”]+)[\"''‘’“”]', 1), lambda s: regexp_replace(s, '" + SP + "+', '', 'g')), lambda s: length(s) >= 5)) AS BIGINT) AS n FROM documents", lambda F: {"n": F.size(X.quotes(F.col("text"))).cast("long")})
