"""Queries of validation gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, squeezed
from ..registry import query
from ..sources.tables import table
from . import gates as V

_ERR = "concat_ws(',', CASE WHEN o_custkey IS NULL THEN 'customer' END, CASE WHEN o_totalprice <= 50000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END)"


def checked(spark, d):
    return V.report(table(spark, d, "orders"), {"customer": F.col("o_custkey").isNotNull(), "price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("v1_required_fields", f"SELECT o_orderkey, {_ERR} AS errors FROM orders")
def v1(spark, d):
    return checked(spark, d).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("v2_references", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')")
def v2(spark, d):
    known = table(spark, d, "documents").filter("lang <> 'fr'")
    return V.dangling(table(spark, d, "labels"), "doc_id", known, "doc_id").select("doc_id")


@query("v2_references_of_two", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def v2_two(spark, d):
    known = V.known_ids((table(spark, d, "nation").filter("n_nationkey < 9"), "n_nationkey"), (table(spark, d, "supplier").filter("s_acctbal > 5000"), "s_suppkey"))
    return V.dangling(table(spark, d, "events"), "user_id", known, "id").select("event_id")


@query("v3_id_existence", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY 1")
def v3(spark, d):
    known = table(spark, d, "supplier").filter("s_acctbal > 0")
    return V.dangling(table(spark, d, "lineitem"), "l_suppkey", known, "s_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("v4_ids_in_match_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def v4(spark, d):
    match = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return V.dangling(table(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_orderkey", match, "l_orderkey").select("o_orderkey")


@query("v5_enums", "SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN role = 'system' AND turn > 0 THEN 'place' END) AS errors FROM conversations")
def v5(spark, d):
    rules = {"role": F.col("role").isin("user", "assistant"), "place": (F.col("role") != "system") | (F.col("turn") == 0)}
    return V.report(table(spark, d, "conversations"), rules).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query("v6_grounding", f"SELECT c.conv_id, bool_or(contains(regexp_replace(c.text, '{SPACE}+', '', 'g'), regexp_replace(substr(f.text, 1, 12), '{SPACE}+', '', 'g'))) AS grounded FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 1 WHERE c.turn = 0 OR c.turn = 1 GROUP BY 1")
def v6(spark, d):
    c = table(spark, d, "conversations")
    term = c.filter("turn = 1").select("conv_id", squeezed(F.substring("text", 1, 12)).alias("term"))
    rows = c.filter("turn <= 1").join(term, "conv_id")
    return rows.groupBy("conv_id").agg(F.bool_or(F.contains(squeezed(F.col("text")), F.col("term"))).alias("grounded"))


@query("v7_family_rules", "SELECT conv_id, count(DISTINCT role) >= 2 AND max(turn) >= 1 AS sane FROM conversations GROUP BY 1")
def v7(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(((F.countDistinct("role") >= 2) & (F.max("turn") >= 1)).alias("sane"))


@query("v8_report", f"SELECT o_orderpriority, CASE WHEN {_ERR} = '' THEN 'ok' ELSE 'fail' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def v8(spark, d):
    return checked(spark, d).groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


@query("v9_forbidden_keys", """
SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['gold'] WHEN 1 THEN ['a.gold', 'a.list.answer'] WHEN 2 THEN ['a.list.answer'] ELSE [] END) AS path FROM events WHERE event_id % 4 < 3 AND value > 20""")
def v9(spark, d):
    """Properties of events, with keys at several depths, in objects and lists; some texts are no JSON."""
    k = F.col("event_id") % 4
    deep = F.when(k == 0, F.concat(F.lit('{"gold": '), "props", F.lit("}"))).when(k == 1, F.concat(F.lit('{"a": {"gold": "x", "list": [{"answer": 1}, {"answer": '), "props", F.lit("}]}}")))
    deep = deep.when(k == 2, F.concat(F.lit('{"text": "gold", "a": {"list": [1, {"answer": null}]}, "b": '), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"gold": '), "props"))
    return V.forbidden_in_json(table(spark, d, "events").filter("value > 20").select("event_id", deep.alias("j")), "event_id", "j", {"gold", "answer"})


@query("v9_forbidden_fields", "SELECT column_name AS field FROM (DESCRIBE documents) WHERE column_name IN ('text', 'html', 'raw', 'lang')")
def v9_fields(spark, d):
    return spark.createDataFrame([(k,) for k in V.forbidden_keys(table(spark, d, "documents"), {"text", "html", "raw", "lang"})], "field string")


@query("v10_forbidden_terms", "SELECT doc_id, term FROM documents, (VALUES ('License'), ('token'), ('@mail')) v(term) WHERE contains(text, term)")
def v10(spark, d):
    return V.scanned(table(spark, d, "documents"), "doc_id", "text", ["License", "token", "@mail"])


@query("v11_secret_values", "SELECT doc_id, regexp_extract(text, 'token = \"([0-9a-f]{40})\"', 1) AS secret FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"')")
def v11(spark, d):
    pattern = 'token = "([0-9a-f]{40})"'
    return table(spark, d, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).alias("secret"))


_SECRETS = {"token": 'token = "([0-9a-f]{40})"', "access": "(AKIA[A-Z0-9]{12,})", "card": "([0-9]{16})"}


@query("v11_secret_kinds", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) AS secret FROM documents" for k, p in _SECRETS.items()))
def v11_kinds(spark, d):
    return V.secret_values(table(spark, d, "documents"), "doc_id", "text", _SECRETS)


@query("v12_thresholds", """
SELECT rule, value, value BETWEEN lo AND hi AS ok FROM (SELECT 'rows' AS rule, count(*)::DOUBLE AS value, 100 AS lo, 1e12 AS hi FROM documents UNION ALL SELECT 'sources', count(DISTINCT source)::DOUBLE, 5, 1e9 FROM documents UNION ALL SELECT 'longest', max(length(text))::DOUBLE, 0, 5000 FROM documents)""")
def v12(spark, d):
    return V.thresholds(table(spark, d, "documents"), {"rows": (F.count(F.lit(1)), 100, 1e12), "sources": (F.countDistinct("source"), 5, 1e9), "longest": (F.max(F.length("text")), 0, 5000)})


@query("v13_dominance", "SELECT entity, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM (SELECT source AS entity FROM documents UNION ALL SELECT lang FROM documents) GROUP BY 1")
def v13(spark, d):
    return V.dominance(table(spark, d, "documents").select(F.array("source", "lang", "source").alias("e")), "e")


@query("v14_diversity", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents WHERE n_chars > 1000")
def v14(spark, d):
    return table(spark, d, "documents").filter("n_chars > 1000").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("v15_invariance", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 0")
def v15(spark, d):
    old = table(spark, d, "orders").dropDuplicates(["o_orderkey"])
    new = old.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 15 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return V.changed(old, new, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


@query("v16_style_shares", "SELECT round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 6) AS asked, round(avg(CASE WHEN length(text) < 100 THEN 1.0 ELSE 0.0 END), 6) AS short FROM conversations")
def v16(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return table(spark, d, "conversations").agg(share(F.contains("text", F.lit("?"))).alias("asked"), share(F.length("text") < 100).alias("short"))


@query("v17_steps", "SELECT 'scan' AS step, 'done: ' || (SELECT count(*) FROM lineitem) AS outcome UNION ALL SELECT 'count', 'done: ' || (SELECT count(DISTINCT l_orderkey) FROM lineitem) UNION ALL SELECT 'gate', 'failed: ' || (SELECT count(*) FROM lineitem WHERE l_quantity > 49) || ' rows above'")
def v17(spark, d):
    """A gate that fails stops what comes after."""
    lines = table(spark, d, "lineitem")

    def gate():
        if n := lines.filter("l_quantity > 49").count():
            raise ValueError(f"{n} rows above")

    return spark.createDataFrame(V.run_steps([("scan", lines.count), ("count", lambda: lines.select("l_orderkey").distinct().count()), ("gate", gate), ("never", lines.count)]), "step string, outcome string")


@query("v17_missing", "SELECT table_name AS step, 'missing' AS outcome FROM (VALUES ('answers'), ('bundles')) v(table_name) WHERE (SELECT count(*) FROM region) > 0")
def v17_missing(spark, d):
    """Preconditions are asked for before any step runs."""
    there = {"region": table(spark, d, "region").count() > 0, "answers": False, "bundles": False}
    return spark.createDataFrame(V.run_steps([("scan", lambda: 1 / 0)], there), "step string, outcome string")
