"""Sinks: JSON lines, CSV with a byte order mark, renderings of a slice, size-bounded files, registries."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import next_fit, numbered


def json_text(*columns: str) -> Column:
    """A row as one JSON object, nulls left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each value of the keys."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def rewrite(df: DataFrame, path: str, staged: str) -> DataFrame:
    """What replaces a table that `df` itself reads: written beside it first, then over it."""
    df.write.mode("overwrite").parquet(staged)
    df.sparkSession.read.parquet(staged).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def csv_text(df: DataFrame, *columns: str) -> DataFrame:
    """Lines of a CSV for spreadsheets; the header line has the byte order mark. `line_no` orders them."""
    head = df.sparkSession.createDataFrame([(0, "﻿" + ",".join(columns))], "line_no long, line string")
    body = numbered(df.select(*columns), list(columns), "line_no").select("line_no", F.to_csv(F.struct(*columns)).alias("line"))
    return head.unionByName(body)


def write_csv_with_bom(df: DataFrame, path: str, *columns: str) -> None:
    """One CSV file for a spreadsheet: a sheet that people fill in, so one task writes it."""
    csv_text(df, *columns).coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def rendered(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each group's rows as plain text, Markdown, CSV and JSON: one row a group and format."""
    as_text = [F.col(c).cast("string") for c in columns]
    line = {
        "txt": F.concat_ws(" ", *as_text),
        "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", *as_text), F.lit(" |")),
        "csv": F.concat_ws(",", *as_text),
        "json": F.to_json(F.struct(*columns)),
    }
    kinds = df.select(group, F.struct(*order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(k).alias("format"), v.alias("line")) for k, v in line.items()])).alias("__f"))
    lines = kinds.groupBy(group, F.col("__f.format").alias("format")).agg(F.array_sort(F.collect_list(F.struct("__o", F.col("__f.line").alias("line")))).alias("__l"))
    return lines.select(group, "format", F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("rendered"))


def file_parts(df: DataFrame, group: str, order: str, line: str, most_bytes: int) -> DataFrame:
    """Next-fit of lines to files of at most most_bytes each: `part` from 0, within each group."""
    sizes = df.select(group, order, (F.octet_length(line) + 1).cast("long").alias("bytes"))
    return next_fit(sizes, group, order, "bytes", most_bytes)


def inside(path: str, root: str) -> str:
    """The path, if it lies under the root; else an error."""
    clean = PurePosixPath(path)
    if ".." in clean.parts or not clean.is_relative_to(PurePosixPath(root)):
        raise ValueError(f"{path} is outside {root}")
    return str(clean)


def catalogued(df: DataFrame, name: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first pattern that a name matches, else 'other'."""
    out = F.lit("other")
    for pattern, kind in reversed(rules):
        out = F.when(name.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def artifacts(spark, path: str, rules: list[tuple[str, str]], field: str = "prediction") -> DataFrame:
    """By class of file (by its name under the path): files, lines, and lines whose field is blank."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    blank = F.trim(F.coalesce(F.get_json_object("value", f"$.{field}"), F.lit(""))) == ""
    per_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"))
    return per_file.groupBy(catalogued(per_file, F.col("file"), rules).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("blank").alias("blank"))


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The registry with the rows whose key it lacks."""
    return registry.unionByName(rows.join(registry.select(key), key, "left_anti"), allowMissingColumns=True)


def enriched(registry: DataFrame, side: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """The registry with a column of a side table, or a default where that has no row."""
    return registry.join(side.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
