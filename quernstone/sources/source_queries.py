"""Queries of sources and sinks (S1 to S21). What writes files does so in the folder of `scratch`."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window, functions as F

from ..operators.numbering import shared_folder
from ..registry import query
from . import markup as M
from . import sinks as K
from . import tables as S


def scratch(spark) -> str:
    """A new folder in the shared one of the session."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("s1_json_lines", "SELECT item_id, text FROM benchmark")
def s1(spark, d):
    path = scratch(spark)
    K.write_json_lines(S.table(spark, d, "benchmark"), path)
    return S.json_lines(spark, path, "item_id bigint, text string")


@query("s1_missing_path", "SELECT item_id, text FROM benchmark WHERE false")
def s1_missing(spark, d):
    return S.json_lines(spark, scratch(spark), "item_id bigint, text string")


@query("s2_strict_json", "SELECT count(*) FILTER (item_id % 5 <> 0) AS rows, count(*) FILTER (item_id % 5 = 0) AS faults FROM benchmark")
def s2(spark, d):
    path = scratch(spark)
    good = F.to_json(F.struct("item_id", "text"))
    S.table(spark, d, "benchmark").select(F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("{broken "), F.col("item_id").cast("string"))).otherwise(good).alias("value")).write.text(path)
    schema = spark.createDataFrame([], "item_id bigint, text string").schema
    rows, faults = S.strict_json_lines(spark, path, schema)
    return rows.agg(F.count("item_id").alias("rows")).withColumn("faults", faults.agg(F.count("line")).scalar())


@query("s2_fault_lines", "SELECT item_id + 1 + CASE WHEN item_id >= 10 THEN 1 ELSE 0 END AS line_no, '{broken ' || item_id AS line FROM benchmark WHERE item_id % 5 = 0")
def s2_lines(spark, d):
    """Faults with the number of their line; a blank line counts, too."""
    path = scratch(spark)
    rows = S.table(spark, d, "benchmark")
    value = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("{broken "), F.col("item_id").cast("string"))).otherwise(F.to_json(F.struct("item_id")))
    lines = rows.select("item_id", F.explode(F.when(F.col("item_id") == 10, F.array(F.lit(""), value)).otherwise(F.array(value))).alias("value"))
    lines.coalesce(1).sortWithinPartitions("item_id", "value").select("value").write.text(path)
    return S.strict_json_lines(spark, path, spark.createDataFrame([], "item_id bigint").schema)[1].select("line_no", "line")


@query("s3_json_document", "SELECT conv_id, turn FROM conversations")
def s3(spark, d):
    path = scratch(spark)
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "role")
    # a document a role, each a file of one JSON value
    rows.groupBy("role").agg(F.to_json(F.collect_list(F.struct("conv_id", "turn"))).alias("value")).repartition("role").write.partitionBy("role").text(path)
    return S.json_document(spark, path, "conv_id bigint, turn bigint").select("conv_id", "turn")


@query("s4_partitioned", "SELECT doc_id, lang, source FROM documents WHERE lang = 'de'")
def s4(spark, d):
    path = scratch(spark)
    K.write_partitioned(S.table(spark, d, "documents").select("doc_id", "lang", "source"), path, "lang")
    return S.partitioned(spark, path).filter("lang = 'de'").select("doc_id", "lang", "source")


@query("s5_xml_items", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s5(spark, d):
    item = F.format_string("<response><header><resultCode>00</resultCode></header><items><item><name>%s</name><region>%d</region></item></items></response>", "n_name", "n_regionkey")
    rows = S.table(spark, d, "nation").select("n_nationkey", item.alias("xml"))
    return rows.select("n_nationkey", F.inline(S.xml_items(F.col("xml"), "name string, region string")))


@query("s6_json_items", "SELECT n_nationkey, n_name AS name FROM nation")
def s6(spark, d):
    listed = F.to_json(F.array(F.struct(F.col("n_name").alias("name"))))
    held = lambda k: F.concat(F.lit(f'{{"ERROR_CODE": "0", "total": 1, "{k}": '), listed, F.lit("}"))
    k = F.col("n_nationkey") % 4
    body = F.when(k == 0, listed).when(k == 1, held("data")).when(k == 2, held("result")).otherwise(held("rows"))
    rows = S.table(spark, d, "nation").select("n_nationkey", body.alias("body"))
    return rows.select("n_nationkey", F.inline(S.json_items(F.col("body"), "struct<name: string>")))


@query("s7_digests", "SELECT item_id, sha256(text || chr(10)) AS sha256, CAST(strlen(text) + 1 AS BIGINT) AS bytes FROM benchmark")
def s7(spark, d):
    """Files that were acquired before: one for each passage."""
    path = scratch(spark)
    S.table(spark, d, "benchmark").select("item_id", "text").repartition(4, "item_id").write.partitionBy("item_id").text(path)
    audit = S.digests(spark, path)
    return audit.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "sha256", "bytes")


@query("s8_fetch_plan", "SELECT r_name, strftime(m, '%Y%m') AS month FROM region, range(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH) t(m)")
def s8(spark, d):
    return S.fetch_plan(S.table(spark, d, "region").select("r_name"), "202311", "202402")


@query("s9_form_feed_pages", "SELECT doc_id, i AS page_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(regexp_replace(p, '\\s+', ' ', 'g')) <> ''")
def s9(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return S.text_pages(docs).select("doc_id", "page_no")


@query("s10_grids", "SELECT doc_id, len(g) AS n_rows, len(g[1]) AS n_cols FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: string_split(x, '|')) AS g FROM documents) WHERE len(g) >= 2 AND len(g[1]) >= 2")
def s10(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", S.grids(F.col("text")).alias("g")).filter("g IS NOT NULL")
    return rows.select("doc_id", F.size("g").cast("long").alias("n_rows"), F.size(F.get("g", F.lit(0))).cast("long").alias("n_cols"))


@query("s11_hwpx_text", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name || chr(10) || 'region ' || n_regionkey END AS text FROM nation")
def s11(spark, d):
    """Archives made of rows, and some bytes that are none."""

    @F.pandas_udf("binary")
    def archive(key: pd.Series, name: pd.Series, region: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(k, n, r):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("Contents/section1.xml", f'<s xmlns:hp="urn:p"><hp:p><hp:run><hp:t>region </hp:t><hp:t>{r}</hp:t></hp:run></hp:p></s>')
                z.writestr("Contents/section0.xml", f'<s xmlns:hp="urn:p"><hp:p><hp:t>{n}</hp:t></hp:p></s>')
            return held.getvalue() if k % 5 else b"no archive"

        return pd.Series([one(*x) for x in zip(key, name, region, strict=True)])

    files = S.table(spark, d, "nation").select("n_nationkey", archive("n_nationkey", "n_name", "n_regionkey").alias("content"))
    return S.hwpx_text(files, "n_nationkey", "content")


@query("s12_html_blocks", r"""
SELECT page_id, i - 1 AS block, t AS text FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>', chr(1)), '\x01([^\x01]*)', 1), lambda x: regexp_replace(regexp_replace(replace(replace(x, '</p>', ''), '<br>', chr(10)), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pages))""")
def s12(spark, d):
    rows = S.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("main"))
    return rows.select("page_id", F.posexplode(S.html_blocks(F.col("main"))).alias("block", "text")).withColumn("block", F.col("block").cast("long"))


_DECODED = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query("s12_selected_blocks", f"""
SELECT page_id, i AS block, {_DECODED.format("trim(l[i])")} AS text FROM (SELECT page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) AS l FROM pages), range(1, 1000) t(i) WHERE i <= len(l) AND trim(l[i]) <> ''""")
def s12_selected(spark, d):
    """Elements by tag and class, from the tree of a page as rows."""
    tree = M.page_tree(S.spread(S.table(spark, d, "pages")), "page_id", "html")
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).cast("long")
    return M.texts(tree, "page_id", M.chosen("div", "ad")).select("page_id", nth.alias("block"), "text")


@query("s12_nested_links", f"""
SELECT page_id, href, {_DECODED.format("label")} AS label, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)) GROUP BY ALL""")
def s12_nested(spark, d):
    """Links within the menus of a page: elements inside elements."""
    tree = M.page_tree(S.spread(S.table(spark, d, "pages")), "page_id", "html")
    links = tree.filter(M.chosen("a")).select("page_id", "pre", F.col("attributes")["href"].alias("href"))
    within = M.inside(tree.filter(M.chosen("nav")).select("page_id", "pre", "last"), links, "page_id").select("page_id", "inner.*")
    said = within.join(M.texts(tree, "page_id", M.chosen("a")).select("page_id", "pre", F.col("text").alias("label")), ["page_id", "pre"])
    return said.groupBy("page_id", "href", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s10_table_cells", """
WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
c AS (SELECT l_orderkey, 0::BIGINT AS row_no, j AS col_no, (['order & line', 'part', 'mode'])[j + 1] AS text FROM (SELECT DISTINCT l_orderkey FROM l), range(0, 3) t(j) UNION ALL SELECT l_orderkey, 1, 0, l_orderkey::VARCHAR FROM l WHERE r = 1 UNION ALL SELECT l_orderkey, r, 1, l_partkey::VARCHAR FROM l UNION ALL SELECT l_orderkey, r, 2, l_returnflag FROM l)
SELECT c.l_orderkey, row_no, col_no, text, coalesce(CASE WHEN row_no = 0 THEN 'order & line' WHEN row_no = 1 THEN c.l_orderkey::VARCHAR END, '') AS row_header, (['order & line', 'part', 'mode'])[col_no + 1] AS col_header FROM c""")
def s10_table(spark, d):
    """Grids of tables in markup: a page an order, whose first cell reaches down all its lines."""
    lines = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_returnflag"))).alias("l"))
    first = F.concat(F.lit("<td rowspan='"), F.size("l").cast("string"), F.lit("'>"), F.col("l_orderkey").cast("string"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<td>\n "), x["l_partkey"].cast("string"), F.lit("<td><b>"), x["l_returnflag"], F.lit("</b></td>"))
    body = F.array_join(F.transform("l", row), "\n")
    pages = lines.select("l_orderkey", F.concat(F.lit("<p>Lines<table class=grid><tr><th>order &amp; line<th>part<th>mode</tr>"), body, F.lit("</table>")).alias("html"))
    return M.page_cells(pages, "l_orderkey", "html").drop("table_no")


@query("s13_json_sink", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || ' é한\"}' AS line FROM region")
def s13(spark, d):
    """The lines of the files that the sink wrote: characters stay as they are."""
    path = scratch(spark)
    K.write_json_lines(S.table(spark, d, "region").select("r_regionkey", F.concat("r_name", F.lit(" é한")).alias("r_name")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s14_rewrite", "SELECT r_regionkey, lower(r_name) AS r_name FROM region")
def s14(spark, d):
    path = scratch(spark)
    S.table(spark, d, "region").write.parquet(path)
    return K.rewrite(spark.read.parquet(path).withColumn("r_name", F.lower("r_name")), path, scratch(spark)).select("r_regionkey", "r_name")


@query("s15_csv_bom", "SELECT chr(65279) || 'r_regionkey,r_name' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region")
def s15(spark, d):
    """The lines of the file that the sink wrote, from its bytes: a text scan would hide the mark."""
    path = scratch(spark)
    K.write_csv_with_bom(S.table(spark, d, "region"), path, "r_regionkey", "r_name")
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.decode("content", "UTF-8").alias("t"))
    return whole.select(F.explode(F.split(F.rtrim("t", F.lit("\n")), "\n")).alias("line"))


@query("s16_renderings", """
SELECT r_name, format, string_agg(line, chr(10) ORDER BY n_nationkey) AS rendered FROM (SELECT r_name, n_nationkey, unnest(['txt', 'markdown', 'csv', 'json']) AS format, unnest([n_nationkey || ' ' || n_name, '| ' || n_nationkey || ' | ' || n_name || ' |', n_nationkey || ',' || n_name, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}']) AS line FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2""")
def s16(spark, d):
    n = S.table(spark, d, "nation").join(S.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return K.rendered(n, "r_name", ["n_nationkey"], ["n_nationkey", "n_name"])


@query("s17_file_parts", """
WITH RECURSIVE l AS (SELECT role, list(strlen(text) + 1 ORDER BY conv_id * 100 + turn) AS a, list(conv_id * 100 + turn ORDER BY conv_id * 100 + turn) AS ids FROM conversations GROUP BY 1),
f(role, a, ids, i, part, used) AS (SELECT role, a, ids, 1, 0, a[1] FROM l UNION ALL SELECT role, a, ids, i + 1, CASE WHEN used + a[i + 1] > 4000 THEN part + 1 ELSE part END, CASE WHEN used + a[i + 1] > 4000 THEN a[i + 1] ELSE used + a[i + 1] END FROM f WHERE i < len(a))
SELECT role, ids[i] AS line_id, CAST(a[i] AS BIGINT) AS bytes, CAST(part AS BIGINT) AS part FROM f""")
def s17(spark, d):
    rows = S.table(spark, d, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("line_id"), "text")
    return K.file_parts(rows, "role", "line_id", "text", 4000)


@query("s18_safe_output", "SELECT n_nationkey, n_nationkey % 4 < 2 AS allowed FROM nation")
def s18(spark, d):
    """Where outputs may go is asked for before any job: the paths are the plan's, on the driver."""
    paths = [(r.n_nationkey, ["/out/{}", "/out/deep/./{}", "/elsewhere/{}", "/out/../{}"][r.n_nationkey % 4].format(r.n_name)) for r in S.table(spark, d, "nation").collect()]

    def allowed(path):
        try:
            return bool(K.inside(path, "/out"))
        except ValueError:
            return False

    return spark.createDataFrame([(k, allowed(p)) for k, p in paths], "n_nationkey int, allowed boolean")


@query("s19_catalogue", "SELECT CASE role WHEN 'user' THEN 'questions' WHEN 'assistant' THEN 'answers' ELSE 'other' END AS kind, count(DISTINCT conv_id % 3) AS files, count(*) AS lines, count(*) FILTER (turn % 4 = 1) AS blank FROM conversations GROUP BY 1")
def s19(spark, d):
    """Prediction files, by folders; some predictions are blank or missing."""
    path = scratch(spark)
    c = S.table(spark, d, "conversations")
    said = F.when(F.col("turn") % 8 == 1, F.lit("  ")).when(F.col("turn") % 8 != 5, F.lit("x"))
    lines = c.select("role", (F.col("conv_id") % 3).alias("part"), F.to_json(F.struct("turn", said.alias("prediction"))).alias("value"))
    lines.repartition(1).write.partitionBy("role", "part").text(path)
    return K.artifacts(spark, path, [("role=user/", "questions"), ("role=assistant/", "answers")])


@query("s20_upsert", "SELECT doc_id, 'old' AS state FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s20(spark, d):
    old = S.table(spark, d, "labels").select("doc_id", F.lit("old").alias("state"))
    return K.upsert(old, S.table(spark, d, "documents").select("doc_id", F.lit("new").alias("state")), "doc_id")


@query("s21_enrich", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def s21(spark, d):
    side = S.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return K.enriched(S.table(spark, d, "documents").select("doc_id"), side, "doc_id", "quality", "unknown")
