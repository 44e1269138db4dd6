"""Scans: Parquet tables, JSON lines (lenient and strict), whole JSON documents, partitioned folders, XML and JSON payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, where it has fewer partitions than those: a small file of one row group would
    keep one core busy with whatever is made of its texts. Larger scans stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row a line; blank lines are no rows; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): a fault names the file, the number and the text of each line that isn't such a JSON object.

    A file is read in blocks; a block's lines are numbered as they are read, and the blocks' counts (a row a block) say how many lines lie
    before it. Blank lines count, but are no rows."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # lines are read as text and parsed, so that faults can be asked for alone
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    read = lines.filter(F.trim("value") != "").select("file", "start", "at", F.from_json("value", marked, {"mode": "PERMISSIVE"}).alias("__row"))
    bad = F.col("__row._corrupt_record").isNotNull()
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("before", before).select("file", "start", "first", "before")
    faults = read.filter(bad).select("file", "start", "at", F.col("__row._corrupt_record").alias("line")).join(placed, ["file", "start"])
    number = (F.col("before") + F.col("at") - F.col("first") + 1).cast("long")
    return read.filter(~bad).select("__row.*").drop("_corrupt_record"), faults.select("file", number.alias("line_no"), "line")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: whole files, each one JSON value."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def partitioned(spark: SparkSession, root: str) -> DataFrame:
    """A folder tree by key=value, as written by `partition_by`; partition filters prune folders."""
    return spark.read.parquet(root)


def text_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "\f") -> DataFrame:
    """Extracted text to pages at form feeds; blank pages are dropped, numbers keep counting them."""
    pages = documents.select(id_col, F.posexplode(F.split(text_col, mark)).alias("page_index", "page_text"))
    return pages.filter(F.trim(F.regexp_replace("page_text", r"\s+", " ")) != "").withColumn("page_no", (F.col("page_index") + 1).cast("long")).drop("page_index")


def checked(payload: Column, code: Column, fine: list[str]) -> Column:
    """The payload, if its code is among the fine ones (none counts as fine); else an error that stops the query."""
    return F.when(code.isNull() | (code == "") | code.isin(fine), payload).otherwise(F.raise_error(F.concat(F.lit("the response has the code "), code)).cast("string"))


def xml_items(payload: Column, schema: str, path: str = "//item", header: str = "//resultCode") -> Column:
    """The items of an XML response, as an array of structs of strings; a header that isn't fine is an error."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    good = checked(payload, F.xpath_string(payload, F.lit(header)), ["0", "00", "000"])
    values = [F.xpath(good, F.lit(f"{path}/{n}/text()")) for n in names]
    return F.arrays_zip(*[v.alias(n) for v, n in zip(values, names, strict=True)])


#: Where responses keep their list.
LIST_KEYS = ["data", "items", "list", "result", "rows"]


def json_items(payload: Column, item: str, keys: list[str] | None = None, code: str = "ERROR_CODE") -> Column:
    """The items of a JSON response: a list itself, or the first list under one of the keys; an error code is an error."""
    listed = f"array<{item}>"
    good = checked(payload, F.get_json_object(payload, f"$.{code}"), ["0", "00"])
    bare = F.when(F.ltrim(good).startswith("["), F.from_json(good, listed))
    held = [F.when(F.startswith(F.get_json_object(good, f"$.{k}"), F.lit("[")), F.from_json(F.get_json_object(good, f"$.{k}"), listed)) for k in keys or LIST_KEYS]
    return F.coalesce(bare, *held)


def html_blocks(html: Column, tag: str = "p") -> Column:
    """The texts of the blocks of a tag, in order, with line breaks as new lines and other tags left out."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)(?=</?{tag}\b|</article|</body|$)"), F.lit(1))
    broken = F.transform(inner, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]+>", ""))
    return F.filter(F.transform(broken, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def grids(text: Column, mark: str = "|", least: int = 2) -> Column:
    """The grid of a text's lines that hold the mark, as rows of trimmed cells; smaller ones than least x least are null."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(mark))), lambda x: F.transform(F.split(x, F.lit("\\Q" + mark + "\\E")), lambda c: F.trim(c)))
    return F.when((F.size(rows) >= least) & (F.size(F.get(rows, F.lit(0))) >= least), rows)


def hwpx_text(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, text) of HWPX files (zip archives of XML): the paragraphs of all sections in order; what is no such archive gives null.

    (The older binary format needs a library that is not here.)"""

    def run(batches):
        import io
        import re as regex
        import xml.etree.ElementTree as Tree
        import zipfile

        import pyarrow as pa

        def text(raw):
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    sections = sorted((n for n in z.namelist() if regex.search(r"section[0-9]+\.xml$", n)), key=lambda n: int(regex.findall("[0-9]+", n)[-1]))
                    paragraphs = [p for n in sections for p in Tree.fromstring(z.read(n)).iter() if p.tag.rpartition("}")[2] == "p"]
            except (zipfile.BadZipFile, Tree.ParseError, TypeError):
                return None
            return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t") for p in paragraphs)

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(c.as_py()) for c in b.column(1)], pa.string())], names=[key, "text"])

    return df.select(key, content).mapInArrow(run, T.StructType([df.schema[key], T.StructField("text", T.StringType())]))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """The audit of acquired files: path, bytes, SHA-256. (Fetching over a network is not offered.)"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fetch_plan(areas: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """A row for each area and month, between two months as yyyyMM."""
    day = lambda m: F.to_date(F.lit(m + "01"), "yyyyMMdd")
    months = F.sequence(day(first_month), day(last_month), F.expr("interval 1 month"))
    return areas.withColumn("month", F.explode(F.transform(months, lambda d: F.date_format(d, "yyyyMM"))))
