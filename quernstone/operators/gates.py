"""Validation gates: rules as columns, references as anti joins, thresholds as aggregates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def errors(rules: dict[str, Column]) -> Column:
    """V1, V5, V7: the names of the rules that a row breaks (a null verdict breaks it)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """V8: `df` with errors and status."""
    return df.withColumn("errors", errors(rules)).withColumn("status", F.when(F.size("errors") == 0, "ok").otherwise("fail"))


def known_ids(*tables: tuple[DataFrame, str]) -> DataFrame:
    """V2: the ids of several tables together."""
    every = [df.select(F.col(key).alias("id")) for df, key in tables]
    for df in every[1:]:
        every[0] = every[0].union(df)
    return every[0].distinct()


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """V2, V3: rows whose key no known row has."""
    return rows.join(known.select(F.col(known_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def keys_of(schema: T.DataType, path: str = "") -> Iterator[str]:
    """V9: every field name at any depth."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            yield f"{path}{f.name}"
            yield from keys_of(f.dataType, f"{path}{f.name}.")
    elif isinstance(schema, T.ArrayType):
        yield from keys_of(schema.elementType, path)
    elif isinstance(schema, T.MapType):
        yield from keys_of(schema.valueType, path)


def forbidden_keys(df: DataFrame, names: set[str]) -> list[str]:
    """V9: paths of forbidden fields, from the schema alone."""
    return [k for k in keys_of(df.schema) if k.rpartition(".")[2] in names]


def forbidden_in_json(df: DataFrame, key: str, column: str, names: set[str]) -> DataFrame:
    """V9: (key, path) of forbidden keys at any depth of a JSON text; what is no JSON has none."""

    def paths(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                if k in names:
                    yield f"{path}{k}"
                yield from paths(v, f"{path}{k}.")
        elif isinstance(value, list):
            for v in value:
                yield from paths(v, path)

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(1):
                try:
                    value = json.loads(t.as_py() or "null")
                except ValueError:
                    value = None
                found.append(sorted(set(paths(value, ""))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=[key, "paths"])

    made = df.select(key, F.col(column).cast("string")).mapInArrow(run, df.select(key).schema.add("paths", T.ArrayType(T.StringType())))
    return made.select(key, F.explode("paths").alias("path"))


def secret_values(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, secret) of every match of every pattern, its first group."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("found")) for kind, p in patterns.items()])
    return df.select(key, F.inline(each)).select(key, "kind", F.explode("found").alias("secret"))


def scanned(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) of each forbidden term that a text holds anywhere, inside words as well."""
    each = F.explode(F.array(*map(F.lit, terms)))
    return df.select(key, text, each.alias("term")).filter(F.contains(text, F.col("term"))).select(key, "term")


def scanned_files(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(file, term) of each forbidden term on a line of a file under a path, at any depth. A line is a row: no file is held whole."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return scanned(lines, "file", "value", terms).distinct()


def thresholds(df: DataFrame, rules: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(rule, value, ok) of aggregates that must lie within bounds; one pass."""
    values = df.agg(*[c.cast("double").alias(k) for k, (c, _, _) in rules.items()])
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value"), F.col(k).between(lo, hi).alias("ok")) for k, (_, lo, hi) in rules.items()])
    return values.select(F.inline(each))


def dominance(df: DataFrame, entities: str) -> DataFrame:
    """Each entity's share of the rows, counted once a row."""
    n = df.agg(F.count(F.lit(1))).scalar()
    per = df.select(F.explode(F.array_distinct(entities)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("rows"))
    return per.withColumn("share", F.round(F.col("rows") / n, 6))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The first column that differs between two versions of a row (nulls equal nulls)."""
    a, b = old.select(key, F.struct(*columns).alias("a")), new.select(key, F.struct(*columns).alias("b"))
    first = F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns])
    return a.join(b, key).select(key, first.alias("changed")).filter("changed IS NOT NULL")


def run_steps(steps: list[tuple[str, object]], ready: dict[str, bool] | None = None) -> list[tuple[str, str]]:
    """Named steps in order, with what they return; a missing precondition stops all before the first, a failure all after it."""
    if missing := [k for k, v in (ready or {}).items() if not v]:
        return [(k, "missing") for k in missing]
    done = []
    for name, step in steps:
        try:
            said = step()
        except Exception as e:
            return [*done, (name, f"failed: {re.sub(chr(10), ' ', str(e))[:80]}")]
        done.append((name, "done" if said is None else f"done: {said}"))
    return done
