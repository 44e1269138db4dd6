"""The predicate engine: a declarative filter and aggregate, compiled to DataFrame columns.

A predicate is a mapping: source, filter, op, field, return_field, round. The filter's entries hold together; a scalar
asks for the same string (a missing value counts as ''), a mapping of min and max for min <= value < max of the number (what is
no number, or not a number, fails). Numbers are read from strings with commas; whole-number views take no decimals. Averages and
medians are rounded half to even, to whole numbers where `round` is not given; over nothing every op but count is null."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpointed, running


@dataclass
class Predicate:
    source: str
    filter: dict[str, Any] = field(default_factory=dict)
    op: str = "count"
    field: str | None = None
    return_field: str | None = None
    round: int | None = None

    def __str__(self) -> str:
        """P11."""
        parts = [f"{k}={v['min'] if 'min' in v else ''}..{v['max'] if 'max' in v else ''}" if isinstance(v, dict) else f"{k}={v}" for k, v in self.filter.items()]
        return f"{self.source}[{'&'.join(parts)}].{self.op}({self.field or '*'})"


def whole(c: Column) -> Column:
    """A whole number written with commas; anything else, decimals too, is null."""
    bare = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("long"))


def real(c: Column) -> Column:
    """A number written with commas."""
    return F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def number(df: DataFrame, key: str, views: dict[str, Column] | None = None) -> Column:
    """A field's number: its view; a column of numbers as it is, so that the scan can prune by it; else what its text says."""
    if views and key in views:
        return views[key]
    return df[key] if isinstance(df.schema[key].dataType, T.NumericType) else real(df[key])


def condition(df: DataFrame, wanted: dict[str, Any], views: dict[str, Column] | None = None) -> Column:
    """One conjunction, which Catalyst can push to the scan."""

    def one(key, value):
        if not isinstance(value, dict) or not value.keys() & {"min", "max"}:
            return F.coalesce(F.col(key).cast("string"), F.lit("")) == F.lit(str(value))
        n = number(df, key, views)
        parts = [n >= F.lit(value["min"])] if "min" in value else []
        # not a number is greater than all numbers here
        parts += [n < F.lit(value["max"])] if "max" in value else [~F.isnan(n)] if "double" in df.select(n).dtypes[0][1] else []
        return reduce(Column.__and__, parts, n.isNotNull())

    return reduce(Column.__and__, (one(k, v) for k, v in wanted.items()), F.lit(True))


def select(tables: dict[str, DataFrame], p: Predicate, views: dict[str, Column] | None = None) -> DataFrame:
    """P4."""
    return tables[p.source].filter(condition(tables[p.source], p.filter, views))


def aggregate(df: DataFrame, p: Predicate, order: list[str], views: dict[str, Column] | None = None) -> Column:
    """The aggregate that the predicate asks for. order: the columns that stand for file order in ties."""
    n = number(df, p.field, views) if p.field else None
    digits = p.round or 0
    rounded = lambda c: F.bround(c, digits) if digits else F.bround(c, 0).cast("long")
    returned = lambda: F.coalesce(F.col(p.return_field).cast("string"), F.lit(""))
    ord_up = F.struct(*order)
    match p.op:
        case "count":
            return F.count(F.lit(1))
        case "sum":
            return F.sum(n)
        case "min":
            return F.min(n)
        case "max":
            return F.max(n)
        case "avg":
            return rounded(F.avg(n))
        case "median":
            return rounded(F.median(n))
        case "argmin":
            return F.min_by(returned(), F.when(n.isNotNull(), F.struct(n.alias("v"), ord_up.alias("o"))))
        case "argmax":
            # the first in order of the greatest: the least by (-value, order)
            return F.min_by(returned(), F.when(n.isNotNull(), F.struct((-n).alias("v"), ord_up.alias("o"))))
    raise ValueError(f"no such op: {p.op}")


def recompute(tables: dict[str, DataFrame], p: Predicate, order: list[str], by: list[str] | None = None, views: dict[str, Column] | None = None) -> DataFrame:
    """The predicate's value, over all that matches or by groups of it."""
    rows = select(tables, p, views)
    if p.op == "median":
        return median(rows, p, by or [], views)
    return rows.groupBy(*(by or [])).agg(aggregate(rows, p, order, views).alias("value"))


def median(rows: DataFrame, p: Predicate, by: list[str], views: dict[str, Column] | None = None) -> DataFrame:
    """Exact, with no task that holds a group's values: equal ones are counted first, and running counts, which are split over
    ranges of the values, say where the middle is."""
    values = rows.select(*by, number(rows, p.field, views).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    values = checkpointed(values)
    totals = values.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.sum("__n").alias("__all"))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    upto = running(values, by, ["__v"], "__n", "__upto")
    placed = upto.join(totals, same) if by else upto.crossJoin(totals)  # one row
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    first = lambda at: F.min(F.when(F.col("__upto") >= at, F.col("__v")))
    middle = (first(low) + first(high)) / 2
    # groups without a number stay, with none
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    digits = p.round or 0
    value = F.bround("__m", digits) if digits else F.bround("__m", 0).cast("long")
    found = placed.groupBy(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]).agg(middle.alias("__m"))
    joined = groups.join(found, [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)], "left") if by else groups.crossJoin(found)
    return joined.select(*by, value.alias("value"))


def sample_ids(rows: DataFrame, id_col: str, order: list[str], n: int = 20) -> DataFrame:
    """P10: the first n ids in order: a top-n of each task, then of those."""
    return rows.orderBy(*order).limit(n).select(F.col(id_col).alias("row_id"))


def value_matches(value: Column, gold: Column, answer: Column) -> Column:
    """Among the gold values, or part of the answer without commas."""
    return F.coalesce(F.array_contains(gold, value), F.lit(False)) | F.contains(F.replace(answer, F.lit(","), F.lit("")), value)
