"""Queries of the predicate engine (P1 to P17) on lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..registry import query
from ..sources.tables import table
from . import predicate as P

RETURNED = {"l_returnflag": "R", "l_quantity": {"min": 10, "max": 20}}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
WHERE = "l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity < 20"
MONTH = "strftime(l_shipdate, '%Y%m')"


def months(spark, d):
    return table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyyMM"))


def flagship(spark, d):
    p = P.Predicate("lineitem", RETURNED, "avg", "l_extendedprice", round=0)
    return P.recompute({"lineitem": months(spark, d)}, p, ORDER, ["month"]).select("month", F.col("value").alias("avg_price"))


def _p(op, alias, field=None, ret=None, digits=None, wanted=None):
    def run(spark, d):
        p = P.Predicate("lineitem", RETURNED if wanted is None else wanted, op, field, ret, digits)
        out = P.recompute({"lineitem": table(spark, d, "lineitem")}, p, ORDER, ["l_linestatus"])
        value = F.col("value")
        if op in ("sum", "min", "max"):
            value = F.round(value, 4)
        return out.select("l_linestatus", value.alias(alias))

    return run


query("p1_equality", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")(_p("count", "n", wanted={"l_returnflag": "R"}))
query("p2_range", f"SELECT l_linestatus, count(*) AS n FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("count", "n"))
query("p5_count", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")(_p("count", "n", wanted={}))
query("p6_sum", f"SELECT l_linestatus, round(sum(l_extendedprice), 4) AS total FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("sum", "total", "l_extendedprice"))
query("p6_min", f"SELECT l_linestatus, round(min(l_extendedprice), 4) AS least FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("min", "least", "l_extendedprice"))
query("p6_max", f"SELECT l_linestatus, round(max(l_extendedprice), 4) AS most FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("max", "most", "l_extendedprice"))
query("p7_avg_half_even", f"SELECT l_linestatus, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS mean FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("avg", "mean", "l_quantity", digits=0))
query("p8_median", f"SELECT l_linestatus, CAST(round_even(median(l_quantity), 0) AS BIGINT) AS mid FROM lineitem WHERE {WHERE} GROUP BY 1")(_p("median", "mid", "l_quantity", digits=0))
_ties = "row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice {}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)"
query("p9_argmax", f"SELECT l_linestatus, k AS part FROM (SELECT l_linestatus, CAST(l_partkey AS VARCHAR) AS k, {_ties.format('DESC')} AS r FROM lineitem WHERE {WHERE}) WHERE r = 1")(_p("argmax", "part", "l_extendedprice", "l_partkey"))
query("p9_argmin", f"SELECT l_linestatus, k AS part FROM (SELECT l_linestatus, CAST(l_partkey AS VARCHAR) AS k, {_ties.format('ASC')} AS r FROM lineitem WHERE {WHERE}) WHERE r = 1")(_p("argmin", "part", "l_extendedprice", "l_partkey"))
query("predicate_by_month", f"SELECT {MONTH} AS month, CAST(round_even(avg(l_extendedprice), 0) AS BIGINT) AS avg_price FROM lineitem WHERE {WHERE} GROUP BY 1")(flagship)


# rows as the sources have them: all strings, numbers with commas, and junk
RAW = """r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN o_orderkey % 7 = 0 THEN 'NaN' WHEN o_orderkey % 11 = 0 THEN NULL ELSE format('{:,}', o_custkey) END AS raw FROM orders),
v AS (SELECT *, CASE WHEN isnan(n) THEN NULL ELSE n END AS x FROM (SELECT *, try_cast(trim(replace(raw, ',', '')) AS DOUBLE) AS n FROM r))"""


def raw_rows(spark, d):
    key = F.col("o_orderkey")
    junk = F.when(key % 5 == 0, F.col("o_orderpriority")).when(key % 7 == 0, "NaN").when(key % 11 == 0, F.lit(None).cast("string"))
    return table(spark, d, "orders").select(key, "o_orderstatus", F.when((key % 5 == 0) | (key % 7 == 0) | (key % 11 == 0), junk).otherwise(F.format_number("o_custkey", 0)).alias("raw"))


def _raw(op, alias, wanted, digits=None, ret=None):
    def run(spark, d):
        p = P.Predicate("rows", wanted, op, "raw", ret, digits)
        return P.recompute({"rows": raw_rows(spark, d)}, p, ["o_orderkey"], ["o_orderstatus"]).select("o_orderstatus", F.col("value").alias(alias))

    return run


query("p2_range_of_strings", f"WITH {RAW} SELECT o_orderstatus, count(*) AS n FROM v WHERE x >= 100 AND x < 1200 GROUP BY 1")(_raw("count", "n", {"raw": {"min": 100, "max": 1200}}))
query("p2_open_range", f"WITH {RAW} SELECT o_orderstatus, count(*) AS n FROM v WHERE x >= 100 GROUP BY 1")(_raw("count", "n", {"raw": {"min": 100}}))
query("p7_avg_of_strings", f"WITH {RAW} SELECT o_orderstatus, CAST(round_even(avg(x), 0) AS BIGINT) AS mean FROM v WHERE x < 1200 GROUP BY 1")(_raw("avg", "mean", {"raw": {"max": 1200}}))
query("p8_median_of_strings", f"WITH {RAW} SELECT o_orderstatus, round_even(median(x), 1) AS mid FROM v WHERE x < 1200 GROUP BY 1")(_raw("median", "mid", {"raw": {"max": 1200}}, 1))
_first = "row_number() OVER (PARTITION BY o_orderstatus ORDER BY x {}, o_orderkey)"
query("p9_argmax_of_strings", f"WITH {RAW} SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS k FROM (SELECT *, {_first.format('DESC')} AS i FROM v WHERE x < 1200) WHERE i = 1")(_raw("argmax", "k", {"raw": {"max": 1200}}, None, "o_orderkey"))


@query("p9_of_nothing", "SELECT CAST(NULL AS VARCHAR) AS most, CAST(NULL AS BIGINT) AS mean, CAST(0 AS BIGINT) AS n FROM orders WHERE o_orderkey = -1 HAVING count(*) = 0")
def p9_nothing(spark, d):
    """Over nothing, argmax and avg are null and count is 0."""
    rows = {"rows": raw_rows(spark, d)}
    values = [P.recompute(rows, P.Predicate("rows", {"o_orderstatus": "none"}, op, "raw", "o_orderkey"), ["o_orderkey"]).select(F.col("value").alias(name)) for op, name in (("argmax", "most"), ("avg", "mean"), ("count", "n"))]
    return values[0].crossJoin(values[1]).crossJoin(values[2])  # one row each


@query("p3_numeric_views", """
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN CAST(s AS BIGINT) END AS whole, try_cast(t AS DOUBLE) AS real
FROM (SELECT o_orderkey, replace(CASE WHEN o_orderkey % 3 = 0 THEN format('{:,}', o_custkey) ELSE o_orderpriority END, ',', '') AS s,
             CAST(round(o_totalprice, 2) AS VARCHAR) AS t FROM orders)""")
def p3(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.format_number("o_custkey", 0)).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", P.whole(text).alias("whole"), P.real(F.round("o_totalprice", 2)).alias("real"))


@query("p4_select", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {WHERE}")
def p4(spark, d):
    p = P.Predicate("lineitem", RETURNED)
    return P.select({"lineitem": table(spark, d, "lineitem")}, p).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("p10_row_ids", f"SELECT l_orderkey AS row_id FROM lineitem WHERE {WHERE} ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 20")
def p10(spark, d):
    rows = P.select({"lineitem": table(spark, d, "lineitem")}, P.Predicate("lineitem", RETURNED))
    return P.sample_ids(rows, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("p11_human_string", "SELECT 'lineitem[l_returnflag=R&l_quantity=10..20].avg(l_extendedprice)' AS predicate, count(*) AS n FROM lineitem WHERE " + WHERE)
def p11(spark, d):
    p = P.Predicate("lineitem", RETURNED, "avg", "l_extendedprice")
    return P.select({"lineitem": table(spark, d, "lineitem")}, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(str(p)).alias("predicate"), "n")


@query("p12_catalogue_counts", f"SELECT l_returnflag AS area, {MONTH} AS month, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def p12(spark, d):
    return months(spark, d).groupBy(F.col("l_returnflag").alias("area"), "month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("p12_top_names", """
SELECT n_name, c_mktsegment, n, r FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY n DESC, c_mktsegment) AS r
FROM (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)) WHERE r <= 3""")
def p12_top(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("n"), "c_mktsegment")).cast("long")).filter("r <= 3")


def profile(df, columns):
    """A row a column: present, non-empty and digit-like values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("field").agg(
        F.count("v").alias("present"), F.count_if(F.col("v") != "").alias("filled"), F.count_if(F.col("v").rlike("^[0-9][0-9,.]*$")).alias("digits"), F.countDistinct("v").alias("distinct_values")
    )


@query("p12_samples", """
SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, (SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer i WHERE i.c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 3)) AS samples
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""")
def p12_samples(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalogue(c, ["n_name"], "c_mktsegment", "c_name", "c_custkey")


def catalogue(df, by, distinct, sample, order, n=3):
    """The distinct values and the first samples of each group."""
    lists = df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(distinct)), ",").alias("segments"))
    top = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__r") <= n)
    firsts = top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", sample))), lambda x: x[sample]), ",").alias("samples"))
    return lists.join(firsts, by)


def top_values(df, columns, n=3):
    """The n most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v IS NOT NULL AND v <> ''")
    counts = long.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "v")).cast("long")).filter(F.col("rank") <= n)


@query("p13_top_values", """
SELECT field, v, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS rank FROM (SELECT field, v, count(*) AS n FROM (
SELECT 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) WHERE v <> '' GROUP BY 1, 2)) WHERE rank <= 3""")
def p13_top(spark, d):
    return top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("p13_profile", """
SELECT field, count(v) AS present, count(*) FILTER (v <> '') AS filled, count(*) FILTER (regexp_full_match(v, '[0-9][0-9,.]*')) AS digits, count(DISTINCT v) AS distinct_values
FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) GROUP BY 1""")
def p13(spark, d):
    return profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("p14_slice_planning", f"""
SELECT area, month, n, (ord + 2) % 8 AS op FROM (SELECT *, row_number() OVER (ORDER BY n DESC, area, month) - 1 AS ord FROM (
SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, month) AS r FROM (SELECT l_returnflag AS area, {MONTH} AS month, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r <= 2)""")
def p14(spark, d):
    counts = months(spark, d).groupBy(F.col("l_returnflag").alias("area"), "month").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("n"), "month"))).filter("r <= 2")
    # two rows an area are left: one task orders them
    placed = top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "area", "month")) - 1)
    return placed.select("area", "month", "n", F.pmod(F.col("ord") + 2, F.lit(8)).cast("long").alias("op"))


@query("p15_absence", """
SELECT flag, status FROM (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('Z')) a(flag), (VALUES ('F'), ('O')) b(status)) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = flag AND l_linestatus = status)""")
def p15(spark, d):
    wanted = spark.createDataFrame([(f, s) for f in "ANRZ" for s in "FO"], "flag string, status string")
    have = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).distinct()
    return wanted.join(have, ["flag", "status"], "left_anti")


@query("p16_two_hop", """
SELECT doc_id, region, n FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'EUROPE' WHEN lang = 'fr' THEN 'AFRICA' WHEN lang = 'es' THEN 'AMERICA' ELSE 'ASIA' END AS region FROM documents)
JOIN (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) ON r_name = region""")
def p16(spark, d):
    names = spark.createDataFrame([("de", "EUROPE"), ("fr", "AFRICA"), ("es", "AMERICA")], "lang string, region string")
    docs = table(spark, d, "documents").select("doc_id", "lang").join(names, "lang", "left").select("doc_id", F.coalesce("region", F.lit("ASIA")).alias("region"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return docs.join(c.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n")), "region").select("doc_id", "region", "n")


@query("p17_value_check", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) = '7' OR contains(replace(o_orderpriority || format('{:,}', o_custkey), ',', ''), CAST(o_orderkey AS VARCHAR)) AS matches FROM orders""")
def p17(spark, d):
    answer = F.concat("o_orderpriority", F.format_number("o_custkey", 0))
    o = table(spark, d, "orders")
    by_gold = P.value_matches(F.col("o_custkey").cast("string"), F.array(F.lit("7")), F.lit(""))
    return o.select("o_orderkey", (by_gold | P.value_matches(F.col("o_orderkey").cast("string"), F.array(F.lit("none")), answer)).alias("matches"))
