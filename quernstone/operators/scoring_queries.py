"""Queries of scoring (M1 to M13): labels and benchmark as gold, shifted or cut answers as predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NUMBER, SPACE, WORD
from ..registry import query
from ..sources.tables import table
from . import scoring as M
from .retrieval import multi_cut

_SQ = f"regexp_replace(lower({{}}), '{SPACE.replace('{', '{{').replace('}', '}}')}+', '', 'g')"
#: Predictions: the gold itself, a part of it, another text, or nothing, by item.
PRED = "CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 5, 40) WHEN 2 THEN 'something else entirely 12' ELSE '' END"
PAIRS = f"p AS (SELECT item_id, text AS gold, {PRED} AS pred, CASE item_id % 3 WHEN 0 THEN 'abstain' WHEN 1 THEN 'number' ELSE 'text' END AS metric FROM benchmark)"


def pairs(spark, d):
    k = F.col("item_id") % 4
    pred = F.when(k == 0, F.col("text")).when(k == 1, F.substring("text", 5, 40)).when(k == 2, "something else entirely 12").otherwise("")
    m = F.col("item_id") % 3
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"), pred.alias("pred"), F.when(m == 0, "abstain").when(m == 1, "number").otherwise("text").alias("metric"))


P_, G_ = _SQ.format("pred"), _SQ.format("gold")


@query("m1_legacy_score", f"WITH {PAIRS} SELECT item_id, CASE WHEN {P_} = '' THEN false WHEN metric = 'abstain' THEN contains(pred, 'else') WHEN metric = 'number' THEN contains(replace(pred, ',', ''), '12') ELSE contains({P_}, {G_}) OR contains({G_}, {P_}) END AS ok FROM p")
def m1(spark, d):
    return pairs(spark, d).select("item_id", M.legacy_correct(F.col("metric"), F.col("pred"), F.col("gold"), F.array(F.lit("12")), ["else"]).alias("ok"))


FIVE = f"""{PAIRS}, q AS (SELECT *, {P_} AS ps, {G_} AS gs, list_transform(regexp_extract_all(gold, '{NUMBER}'), lambda x: replace(x, ',', '')) AS nums,
list_distinct(regexp_extract_all(lower(gold), '{WORD}')) AS gt, list_distinct(regexp_extract_all(lower(pred), '{WORD}')) AS pt FROM p),
m AS (SELECT *, len(nums) > 0 AND len(list_filter(nums, lambda x: NOT contains(replace(pred, ',', ''), x))) = 0 AS num, ps <> '' AND ps = gs AS em, ps <> '' AND (contains(ps, gs) OR contains(gs, ps)) AS has, coalesce(len(list_intersect(gt, pt)) / nullif(len(gt), 0)::DOUBLE, 0) AS rec FROM q)"""


@query("m2_five_metrics", f"WITH {FIVE} SELECT item_id, num, em, has AS contains, rec >= 0.6 AS recall, has OR rec >= 0.6 OR num AS soft FROM m")
def m2(spark, d):
    return pairs(spark, d).select("item_id", *[c.alias(k) for k, c in M.metrics(F.col("pred"), F.col("gold")).items()])


@query("m3_token_recall", f"WITH {FIVE} SELECT item_id, round(rec, 6) AS recall FROM m")
def m3(spark, d):
    return pairs(spark, d).select("item_id", F.round(M.token_recall(F.col("pred"), F.col("gold")), 6).alias("recall"))


@query("m4_left_join", "SELECT l.doc_id, coalesce(p.pred, '') AS prediction FROM labels l LEFT JOIN (SELECT doc_id, arg_max(CAST(quality AS VARCHAR), toxic * 10 + quality) AS pred FROM labels WHERE doc_id % 2 = 0 GROUP BY 1) p ON l.doc_id = p.doc_id")
def m4(spark, d):
    labels = table(spark, d, "labels")
    preds = labels.filter("doc_id % 2 = 0").select("doc_id", F.col("quality").cast("string").alias("prediction"), (F.col("toxic") * 10 + F.col("quality")).alias("ord"))
    return M.answered(labels.select("doc_id"), preds, "doc_id", "ord")


@query("m5_subset", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def m5(spark, d):
    ids = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").select("doc_id", "quality").join(ids, "doc_id", "left_semi")


@query("m5_listed_subset", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')) AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 700)")
def m5_listed(spark, d):
    """Gold rows by the lines of an ids file, half of them bare ids and half JSON with blanks around, and by predictions."""
    docs = table(spark, d, "documents")
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("x").alias("text"))))
    ids = M.listed_ids(docs.filter("lang IN ('en', 'de')").select(line.alias("value")))
    return M.subset(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", ids, docs.filter("n_chars > 700").select("doc_id"))


GRADED = "g AS (SELECT l.doc_id, lang, source, (quality = 1) = (n_chars > 500) AS ok, CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE 1.0::DOUBLE / (1 + l.doc_id % 3) END AS w FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def graded(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return rows.select("doc_id", "lang", "source", ((F.col("quality") == 1) == (F.col("n_chars") > 500)).alias("ok"), F.when(F.col("doc_id") % 5 != 0, F.lit(1.0) / (1 + F.col("doc_id") % 3)).alias("w"))


@query("m6_multi_cut", f"WITH {GRADED} SELECT cut, value, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS acc, round(sum(CAST(ok AS INT) * coalesce(w, 1)) / sum(coalesce(w, 1)), 6) AS weighted FROM (SELECT *, 'ALL' AS cut, 'ALL' AS value FROM g UNION ALL SELECT *, 'lang', lang FROM g UNION ALL SELECT *, 'source', source FROM g) GROUP BY 1, 2")
def m6(spark, d):
    return multi_cut(graded(spark, d), ["lang", "source"], [F.count(F.lit(1)).alias("n"), F.round(M.accuracy(F.col("ok")), 6).alias("acc"), F.round(M.accuracy(F.col("ok"), F.col("w")), 6).alias("weighted")])


@query("m6_grouping_sets", f"WITH {GRADED} SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n FROM g GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def m6_sets(spark, d):
    sets = graded(spark, d).groupingSets([[], ["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n")


@query("m7_wilson", f"WITH {GRADED}, a AS (SELECT source, count(*)::DOUBLE AS n, avg(CAST(ok AS INT)) AS p FROM g GROUP BY 1) SELECT source, round(greatest(0, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS high FROM a")
def m7(spark, d):
    rows = graded(spark, d).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), M.accuracy(F.col("ok")).alias("p"))
    low, high = M.wilson(F.col("p"), F.col("n"))
    return rows.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("m8_judge_pivot", f"WITH {GRADED} SELECT source, round(avg(CAST(ok AS INT)) FILTER (lang = 'de'), 6) AS de, round(avg(CAST(ok AS INT)) FILTER (lang = 'en'), 6) AS en, round(avg(CAST(ok AS INT)) FILTER (lang = 'es'), 6) AS es, round(avg(CAST(ok AS INT)) FILTER (lang = 'fr'), 6) AS fr FROM g GROUP BY 1")
def m8(spark, d):
    rows = graded(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(M.accuracy(F.col("ok")))
    return rows.select("source", *[F.round(c, 6).alias(c) for c in ("de", "en", "es", "fr")])


@query("m8_judge_rollup", f"WITH {GRADED} SELECT coalesce(source, 'ALL') AS source, coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS acc FROM g GROUP BY ROLLUP (source, lang)")
def m8_rollup(spark, d):
    r = graded(spark, d).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(M.accuracy(F.col("ok")), 6).alias("acc"))
    return r.withColumns({"source": F.coalesce("source", F.lit("ALL")), "lang": F.coalesce("lang", F.lit("ALL"))})


@query("m7_wilson_of_nothing", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 0.0 ELSE 0.206543 END::DOUBLE AS low, CASE WHEN item_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS high FROM benchmark")
def m7_nothing(spark, d):
    n = (F.col("item_id") % 2).cast("double")
    low, high = M.wilson(F.when(n > 0, 1.0), n)
    return table(spark, d, "benchmark").select("item_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_JUDGED = "j AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN 'no' WHEN 2 THEN 'YES' END AS said, 'task' || item_id % 3 AS task FROM benchmark WHERE item_id % 7 <> 0)"


@query("m9_verdicts", f"WITH {_JUDGED} SELECT cut, value, count(*) AS n, count(*) FILTER (contains(upper(coalesce(said, '')), 'YES')) AS yes FROM (SELECT *, 'ALL' AS cut, 'ALL' AS value FROM j UNION ALL SELECT *, 'task', task FROM j) GROUP BY 1, 2")
def m9(spark, d):
    """Lines as a judge writes them: some requests have no line, some lines no answer."""
    b = table(spark, d, "benchmark").filter("item_id % 7 <> 0")
    k = F.col("item_id") % 4
    content = F.when(k == 0, "Yes, it is.").when(k == 1, "no").when(k == 2, "YES")
    message = F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body"))
    raw = b.select(F.to_json(F.struct(F.concat(F.lit("judge__"), F.col("item_id").cast("string")).alias("custom_id"), F.when(k != 3, message).alias("response"))).alias("line"))
    tasks = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.concat(F.lit("task"), (F.col("item_id") % 3).cast("string")).alias("task"))
    rows = M.verdicts(raw, "line").join(tasks, "qa_id", "left")
    return multi_cut(rows, ["task"], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("judge_correct")).alias("yes")])


_BASE = """b AS (SELECT item_id, substr(text, 1, 40) AS q, CASE WHEN item_id % 5 = 0 THEN 'cannot be determined' ELSE text END AS a, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark),
s AS (SELECT 'oracle' AS baseline, a, a AS pred FROM b UNION ALL SELECT 'dummy', a, 'cannot be determined' FROM b UNION ALL SELECT 'echo', a, q FROM b UNION ALL SELECT 'random', x.a, y.a FROM b x JOIN b y ON y.i = (x.i + greatest(1, x.n // 3)) % x.n)"""


@query("m10_baselines", f"WITH {_BASE} SELECT baseline, count(*) AS n, round(avg(CASE WHEN a = pred THEN 1.0 ELSE 0.0 END), 6) AS same, round(avg(CASE WHEN contains(a, pred) OR contains(pred, a) THEN 1.0 ELSE 0.0 END), 6) AS within FROM s GROUP BY 1")
def m10_baselines(spark, d):
    answer = F.when(F.col("item_id") % 5 == 0, "cannot be determined").otherwise(F.col("text"))
    b = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("q"), answer.alias("a"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    each = [M.predicted(name, b, "item_id", "q", "a").select(F.lit(name).alias("baseline"), "a", F.col("prediction").alias("p")) for name in ("oracle", "dummy", "echo", "random")]
    every = each[0].union(each[1]).union(each[2]).union(each[3])
    return every.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), share(F.col("a") == F.col("p")).alias("same"), share(F.contains("a", F.col("p")) | F.contains("p", F.col("a"))).alias("within"))


@query("m10_shifted_baseline", "WITH o AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT a.item_id, b.item_id AS other FROM o a JOIN o b ON b.i = (a.i + greatest(1, a.n // 3)) % a.n")
def m10(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("v"))
    return M.shifted(b, "item_id", "v").select("item_id", F.col("shifted").alias("other"))


@query("m10_oracle_ceiling", "SELECT count(*) AS n, 1.0::DOUBLE AS acc FROM benchmark WHERE text <> ''")
def m10_oracle(spark, d):
    rows = pairs(spark, d).filter("gold <> ''")
    ok = M.metrics(F.col("gold"), F.col("gold"))["soft"]
    return rows.agg(F.count(F.lit(1)).alias("n"), M.accuracy(ok).alias("acc"))


PRICES = "CASE WHEN starts_with(p_type, 'STANDARD') THEN 0.4 WHEN starts_with(p_type, 'SMALL') THEN 1.1 ELSE 2.5 END"


@query("m11_usage_cost", f"SELECT p_brand, count(*) AS calls, CAST(sum(p_size) AS BIGINT) AS tokens, round(sum(p_size * {PRICES}::DOUBLE / 1000), 6) AS cost FROM part GROUP BY 1")
def m11(spark, d):
    price = F.when(F.startswith("p_type", F.lit("STANDARD")), 0.4).when(F.startswith("p_type", F.lit("SMALL")), 1.1).otherwise(2.5)
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("calls"), F.sum("p_size").alias("tokens"), F.round(F.sum(F.col("p_size") * price / 1000), 6).alias("cost"))


@query("m12_projection", "SELECT lang, CAST(sum(CAST(floor(length(text) / 2.45) AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(floor(length(text) / 2.45) AS BIGINT)) * 0.4::DOUBLE / 1000000, 9) AS dollars FROM documents GROUP BY 1")
def m12(spark, d):
    n = F.sum(F.floor(F.length("text") / 2.45).cast("long"))
    return table(spark, d, "documents").groupBy("lang").agg(n.alias("tokens"), F.round(n * 0.4 / 1000000, 9).alias("dollars"))


@query("m13_agreement", f"WITH {GRADED}, t AS (SELECT count(*) FILTER (ok AND doc_id % 7 <> 0)::DOUBLE AS a, count(*) FILTER (ok AND doc_id % 7 = 0)::DOUBLE AS b, count(*) FILTER (NOT ok AND doc_id % 7 <> 0)::DOUBLE AS c, count(*) FILTER (NOT ok AND doc_id % 7 = 0)::DOUBLE AS e FROM g), s AS (SELECT (a + e) / (a + b + c + e) AS o, ((a + b) * (a + c) + (e + b) * (e + c)) / pow(a + b + c + e, 2) AS x FROM t) SELECT round(o, 6) AS raw, round((o - x) / (1 - x), 6) AS kappa FROM s")
def m13(spark, d):
    other = F.col("doc_id") % 7 != 0
    ok = F.col("ok")
    t = graded(spark, d).agg(*[F.count_if(c).cast("double").alias(k) for k, c in {"a": ok & other, "b": ok & ~other, "c": ~ok & other, "e": ~ok & ~other}.items()])
    cells = [F.col(k) for k in "abce"]
    return t.select(F.round((F.col("a") + F.col("e")) / sum(cells[1:], cells[0]), 6).alias("raw"), F.round(M.kappa(*cells), 6).alias("kappa"))
