"""Pages as trees of rows: parsing, selection at any depth, grids with spans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quernstone.sources import markup as M


def tree(spark, *pages):
    return M.page_tree(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html", batch=3)


def said(spark, wanted, *pages):
    return [(r.id, r.text) for r in M.texts(tree(spark, *pages), "id", wanted).orderBy("id", "pre").collect()]


def test_blocks_by_class_nested_and_decoded(spark):
    page = '<div class="law lawcon">A &amp; <b>B</b><script>no</script><div class=lawcon> C&#44;<p></div>D</div><div class="lawconx">x</div><div class="lawcon"> </div>'
    assert said(spark, M.chosen("div", "lawcon"), page, None, "", "no markup") == [(0, "A &\nB\nC,\nD"), (0, "C,")]
    assert said(spark, M.chosen("a", href="x&y"), "<A HREF='x&amp;y'>go</A><a href=z>no</a>") == [(0, "go")]


def test_implied_and_stray_ends(spark):
    assert said(spark, M.chosen("p"), "<p>a<p>b<div>c</div></p>d</b>") == [(0, "a"), (0, "b")]
    assert said(spark, M.chosen("li"), "<ul><li>1<ul><li>2</ul><li>3</ul>") == [(0, "1\n2"), (0, "2"), (0, "3")]
    assert said(spark, M.chosen("title"), "<title>a <b> c</TITLE>d") == [(0, "a <b> c")]


def test_inside_is_all_pairs_of_nested_nodes(spark):
    rng = random.Random(5)
    pages = []
    for _ in range(6):
        open_, page = [], ""
        for _ in range(150):
            if open_ and rng.random() < 0.45:
                page += f"</{open_.pop()}>"
            else:
                open_.append(rng.choice(["b", "i", "em"]))
                page += f"<{open_[-1]}>"
        pages.append(page)
    t = tree(spark, *pages).select("id", "pre", "last", "tag")
    rows = t.collect()
    want = sorted((a.id, a.pre, z.pre) for a in rows for z in rows if a.id == z.id and a.tag == "b" and a.pre < z.pre <= a.last)
    got = M.inside(t.filter("tag = 'b'"), t, "id").select("id", F.col("outer.pre"), F.col("inner.pre")).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_grid_with_spans_and_small_tables(spark):
    page = "<table><tr><th>h1<th colspan=2>h2<th>h3<tr><td rowspan=2>a<td>b<td>c<td>d<tr><td>e<td><table><tr><td>in<td>ner</table><td> f \n g</table>"
    rows = M.table_cells(tree(spark, page, "<table><tr><td>one</table>", "<table></table>"), "id").orderBy("row_no", "col_no").collect()
    assert {r.id for r in rows} == {0} and {r.table_no for r in rows} == {1}
    assert [(r.row_no, r.col_no, r.text) for r in rows] == [(0, 0, "h1"), (0, 1, "h2"), (0, 3, "h3"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 1, "e"), (2, 2, "in ner"), (2, 3, "f g")]
    assert [(r.row_header, r.col_header) for r in rows][-1] == ("", "h3")
    assert M.table_cells(tree(spark).filter("false"), "id").count() == 0


@pytest.mark.parametrize("bit", ['<b "> "', '<b x="', "<!--", "<b><li></li>", "<ul><li><b>", "<script>", "<td><table>", "<a = ", "<script></scrip", "<b x=' "])
def test_linear_time(bit):
    def took(n):
        began = time.process_time()
        for _ in M.nodes(bit * n):
            pass
        return time.process_time() - began

    took(1000)
    assert took(80_000) < 12 * took(10_000) + 0.2


def test_any_page_is_a_tree():
    rng = random.Random(11)
    bits = ["<p>", "</p>", "<div class='a'>", "</div>", "<", ">", "&amp;", "<!--", "-->", "<td>", "<table>", "</table>", "<script>", "</script>", "x ", "'", '"', "<br/>", "<li ", "=", "</"]
    for _ in range(300):
        rows = sorted(M.nodes("".join(rng.choices(bits, k=60))))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        up = []
        for pre, last, depth, *_ in rows:
            while up and up[-1] < pre:
                up.pop()
            assert depth == len(up) and last >= pre and (not up or last <= up[-1])
            up.append(last)


def test_pages_are_read_once_and_nothing_is_joined(spark):
    t = tree(spark, "<table><tr><td>a<td>b<tr><td>c<td>d</table>")
    for made in (M.table_cells(t, "id"), M.texts(t, "id", M.chosen("td")), M.inside(t.filter("tag = 'tr'").select("id", "pre", "last"), t.select("id", "pre"), "id")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
    assert M.table_cells(t, "id")._jdf.queryExecution().executedPlan().toString().count("MapInArrow run") == 1


def test_pairs_over_batches(spark):
    page = "<b><i>" + "<u></u>" * 50 + "</i></b><u></u>"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        t = tree(spark, page, page)
        got = M.inside(t.filter("tag IN ('b', 'i')"), t.filter("tag = 'u'").select("id", "pre"), "id").groupBy("id", "outer.tag").count().collect()
        assert sorted(map(tuple, got)) == [(0, "b", 50), (0, "i", 50), (1, "b", 50), (1, "i", 50)]
        assert said(spark, M.chosen("b"), "<b>1<i>2</i>3<i>4</b>5") == [(0, "1\n2\n3\n4")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_of_pages_are_those_of_their_trees(spark):
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<", ">", "&amp;", "<!--", "-->", "<td>", "<TD colspan=2>", "<td rowspan=' 03' x>", '<th rowspan="2">', "<td colspan='2.5' rowspan=9999999999>", "<tr>", "<tr>", "<td>", "</tr>", "</td>", "<table>", "<table a=b>", "</table>"]
    bits += ["<script>", "</script>", "x ", " \x1cy", "　", "'", "<hr>", "<li ", "<ul>", "=", "</", "<title>", "</title>", "<td colspan='&#50;'>", "<td = colspan=2>", '<a href=x"y>', "<b/>", "<!d>"]
    tame = [x for x in bits if x[0] not in "<=>-'" or x[1:] and x[1] not in "! " and x[-1] == ">" and "= " not in x and '"y' not in x and x[1:3] not in ("sc", "/s", "ti", "/t")]
    pages = ["<table><tr><td>1<td>2<tr>" * (i % 3 < 2) + "".join(rng.choices(tame if i % 2 else bits, k=rng.randint(5, 60))) for i in range(400)]
    df = spark.createDataFrame([*enumerate([*pages, None, ""]), (None, pages[0])], "id long, html string")
    got = M.page_cells(df, "id", "html", batch=7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = M.table_cells(M.page_tree(df, "id", "html"), "id")
    assert got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 1000 and rows == sorted(map(tuple, want.collect()))


def test_cells_take_linear_time():
    def took(n):
        began = time.process_time()
        M._laid_out(*M._tags("<table><tr><td><b x='1'>a</b><td rowspan=2>c</table>" * n)[:2], 2)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 14 * took(5_000) + 0.3


def test_table_query_shuffles_lines_only(spark):
    from quernstone.sources.source_queries import s10_table

    plan = s10_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
