"""Extraction: facts with snippets, units, enumerations, links, grids, page alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapsed
from .numbering import checkpointed, numbered


def facts(df: DataFrame, id_col: str, text_col: str, pattern: str, around: int = 80) -> DataFrame:
    """(id, ord, value, snippet) of each match: the text between matches is split off, so offsets are running sums.

    The number of parts is the number of matches and one; a part's length and those before it tell where a match lies."""
    values = F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))
    rows = df.select(id_col, text_col, values.alias("__v"), F.split(text_col, pattern, -1).alias("__p")).filter(F.size("__v") > 0)
    lengths = F.transform("__v", lambda v, i: F.length(v) + F.length(F.get("__p", i)))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    each = rows.select(id_col, text_col, F.posexplode(F.transform(F.arrays_zip(F.col("__v").alias("v"), F.slice(ends, F.lit(2), F.size("__v")).alias("end")), lambda x: x)).alias("ord", "x"))
    end = F.col("x.end")
    start = end - F.length("x.v")
    snip = F.substring(F.col(text_col), F.greatest(start - around, F.lit(0)) + 1, end + around - F.greatest(start - around, F.lit(0)))
    return each.select(id_col, F.col("ord").cast("long").alias("ord"), F.col("x.v").alias("value"), start.cast("long").alias("start"), collapsed(snip).alias("snippet"))


def mined(df: DataFrame, id_col: str, text_col: str, kinds: dict[str, str]) -> DataFrame:
    """(id, kind, value) over several patterns, in one scan."""
    def of(kind, pattern):
        return F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.array(*[of(k, p) for k, p in kinds.items()])
    return df.select(id_col, F.inline(F.flatten(found)))


def units(df: DataFrame, id_col: str, text_col: str, mark: str, label: str) -> DataFrame:
    """Parts after each mark with their label; a label's second part gets `#2`, and so on."""
    parts = df.select(id_col, F.posexplode(F.split(text_col, mark)).alias("pos", "body"))
    named = parts.withColumn("label", F.regexp_extract("body", label, 0))
    nth = F.row_number().over(Window.partitionBy(id_col, "label").orderBy("pos"))
    return named.withColumn("label", F.when(nth > 1, F.concat("label", F.lit("#"), nth.cast("string"))).otherwise(F.col("label")))


def links(html: Column) -> Column:
    """(href, label) of each anchor."""
    hrefs = F.regexp_extract_all(html, F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(2))
    return F.arrays_zip(hrefs.alias("href"), labels.alias("label"))


def cells(df: DataFrame, id_col: str, grid: Column) -> DataFrame:
    """A grid (array of rows of cells) of 2 x 2 at least: a row a cell below and beside its headers, with confidence."""
    g = df.select(id_col, grid.alias("g")).filter((F.size("g") >= 2) & (F.size(F.get("g", F.lit(0))) >= 2))
    filled = F.flatten("g")
    density = F.size(F.filter(filled, lambda c: c != "")) / F.size(filled)
    rows = g.select(id_col, density.alias("density"), F.get("g", F.lit(0)).alias("head"), F.posexplode(F.col("g")).alias("row_index", "row"))
    each = rows.filter("row_index > 0").select(id_col, "density", "head", "row_index", F.get("row", F.lit(0)).alias("row_header"), F.posexplode("row").alias("col_index", "cell_text")).filter("col_index > 0")
    by_length = F.when(F.length("cell_text") == 0, 0.2).when(F.length("cell_text") <= 40, 1.0).otherwise(0.7)
    return each.select(
        id_col, F.col("row_index").cast("long").alias("row_index"), F.col("col_index").cast("long").alias("col_index"), "row_header",
        F.get("head", F.col("col_index")).alias("col_header"), "cell_text", F.round(F.least("density", by_length), 4).alias("confidence"),
    )


def aligned(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_words: Column, right_words: Column, least: float = 0.5) -> DataFrame:
    """Each left text's page of the greatest share of its words, if it is `least` or more; ties to the smaller id.

    Of n words a page must have least * n; so of the n - least * n + s rarest it has s. Pages are met by those only (s is half of what
    they must have), which leaves the commonest words of a text out of the join, and whole sets are compared for what has s of them."""
    hashed = lambda words: F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    a = checkpointed(left.select(F.col(left_id).alias("l"), hashed(left_words).alias("lw")))
    b = checkpointed(right.select(F.col(right_id).alias("r"), hashed(right_words).alias("rw")))
    need = F.ceil(F.lit(least) * F.size("lw")).cast("int")
    each = a.select("l", F.size("lw").alias("n"), need.alias("need"), F.greatest(F.lit(1), F.floor(need / 2)).cast("int").alias("s"), F.explode("lw").alias("w"))
    words = b.select("r", F.explode("rw").alias("w"))
    freq = words.join(each.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.coalesce("df", F.lit(0)), "w"))
    rare = each.join(freq, "w", "left").withColumn("k", place).filter(F.col("k") <= F.col("n") - F.col("need") + F.col("s")).select("l", "s", "w")
    met = words.join(rare, "w").groupBy("l", "r", "s").agg(F.count(F.lit(1)).alias("c")).filter("c >= s").select("l", "r")
    share = F.size(F.array_intersect("lw", "rw")) / F.size("lw")
    kept = met.join(a, "l").join(b, "r").select("l", "r", share.alias("share")).filter(F.col("share") >= least)
    best = kept.groupBy("l").agg(F.min_by("r", F.struct((-F.col("share")).alias("s"), F.col("r").alias("i"))).alias("r"), F.max("share").alias("share"))
    return best.select("l", "r", F.round("share", 6).alias("share"))


def pseudo_pages(text: Column, width: int) -> Column:
    """Text in pages of fixed width."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / width), F.lit(0)).cast("int")), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def paragraph_pages(text: Column, least: int = 2600) -> Column:
    """Trimmed paragraphs, blank ones left out, joined to pages that end with the paragraph at which they reach `least`
    characters; a text without paragraphs is one page.

    Where a page begins depends on the page before: a fold over one text's paragraphs, inside the row."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))

    def step(a, p):
        held, size = F.concat(a["held"], F.array(p)), a["size"] + F.length(p)
        full = size >= least
        done = F.when(full, F.concat(a["done"], F.array(F.array_join(held, "\n")))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full, F.array().cast("array<string>")).otherwise(held).alias("held"), F.when(full, 0).otherwise(size).alias("size"))

    pages = F.aggregate(paragraphs, begin, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], "\n")))).otherwise(a["done"]))
    return F.when(F.size(paragraphs) == 0, F.array(text)).otherwise(pages)


def scored(c: Column, words: list[str]) -> Column:
    """How often the words come, together."""
    return sum((F.regexp_count(c, F.lit(w)) for w in words[1:]), F.regexp_count(c, F.lit(words[0]))).cast("long")


def ring_pairs(df: DataFrame, id_col: str, offsets: list[int]) -> DataFrame:
    """Each row with those so many places further on, in a circle."""
    placed = numbered(df.select(F.col(id_col).alias("a")), ["a"], "i").select("a", (F.col("i") - 1).alias("i")).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    other = placed.select(F.col("a").alias("b"), F.col("i").alias("j"))
    return placed.withColumn("o", F.explode(F.array(*map(F.lit, offsets)))).withColumn("j", F.pmod(F.col("i") + F.col("o"), F.col("n"))).join(other, "j").select("a", "b")


def all_pairs(df: DataFrame, id_col: str) -> DataFrame:
    """Every pair a < b of a stated set, in blocks that meet by their numbers."""
    blocks = max(1, -(-df.count() // 4096))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = df.select(F.col(id_col).alias("a"), block.alias("x"), every.alias("y"))
    b = df.select(F.col(id_col).alias("b"), block.alias("y"), every.alias("x"))
    return a.join(b, ["x", "y"]).filter("a < b").select("a", "b")


def merged_arrays(spark, path: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(items with their file, faults) of files that each hold a JSON array: a fault names the file and what is wrong."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.trim("value").alias("value"))
    kind = F.get_json_object("value", "$")
    listed = F.when(F.startswith("value", F.lit("[")) & kind.isNotNull(), F.from_json("value", f"array<{item}>"))
    reason = F.when(kind.isNull(), "no JSON").when(~F.startswith("value", F.lit("[")), "not a list")
    read = files.select("file", listed.alias("items"), reason.alias("reason"))
    return read.filter("reason IS NULL").select("file", F.inline("items")), read.filter("reason IS NOT NULL").select("file", "reason")
