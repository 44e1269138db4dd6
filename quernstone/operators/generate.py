"""Question generation: filters, uniqueness, interacting caps, comparisons, keep-first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def unique_in(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key comes once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def nested_caps(df: DataFrame, group: str, order: list[str], caps: dict[str, int]) -> DataFrame:
    """Rows of a group in order, each taken while none of its caps is used up; a refused row uses up nothing.

    A row equal to a refused one in all keys is refused as well, so that of equal rows the first few are enough, as many as the least cap: the
    others go before the shuffle. What is left of a group streams past counts of its keys; no group is held. With a single cap that is all."""
    names = list(caps)
    nth = F.row_number().over(Window.partitionBy(*dict.fromkeys([group, *names])).orderBy(*order))
    few = df.withColumn("__r", nth).filter(F.col("__r") <= min(caps.values())).drop("__r")
    if len(names) == 1:
        return few

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []
        used: dict[tuple, int] = {}
        for b in batches:
            keep = []
            for g, *row in zip(*(b.column(c).to_pylist() for c in [group, *names]), strict=True):
                if [g] != at:
                    at, used = [g], {}
                keys = list(zip(names, row, strict=True))
                ok = all(used.get(k, 0) < caps[k[0]] for k in keys)
                for k in keys if ok else ():
                    used[k] = used.get(k, 0) + 1
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return few.repartition(group).sortWithinPartitions(group, *order).mapInArrow(take, df.schema)


def ends(df: DataFrame, by: str, page: str, order: list, early: int = 6, share: float = 0.58, caps: tuple[int, int] = (11, 7)) -> DataFrame:
    """Early rows (page <= early) and late ones (page >= max(8, floor(share * last))), up to a cap each."""
    # a row a group, joined; caps that are literals cut a group before its rows are sent
    last = df.groupBy(F.col(by).alias("__by")).agg(F.max(page).alias("__last"))
    place = F.when(F.col(page) <= early, "early").when(F.col(page) >= F.greatest(F.lit(8), F.floor(F.col("__last") * share)), "late")
    rows = df.join(last, F.col(by).eqNullSafe(F.col("__by"))).withColumn("place", place).drop("__by", "__last")
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    some = [rows.filter(F.col("place") == name).withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth") for name, most in zip(("early", "late"), caps, strict=True)]
    return some[0].unionByName(some[1])


def compared(df: DataFrame, group: str, key: str, value: str, most: int) -> DataFrame:
    """Pairs of a group's neighbours in value order, with the greater one, up to a cap: each pair once."""
    w = Window.partitionBy(group).orderBy(F.desc(value), key)
    rows = df.withColumns({"other": F.lead(key).over(w), "other_value": F.lead(value).over(w), "nth": F.row_number().over(w)})
    pair = F.array_join(F.array_sort(F.array(F.col(key).cast("string"), F.col("other").cast("string"))), "|")
    return rows.filter(F.col("other").isNotNull() & (F.col("nth") <= most)).select(group, pair.alias("pair"), F.col(key).alias("winner"))


def all_pairs(df: DataFrame, group: str, key: str, value: str, most: int) -> DataFrame:
    """All pairs (a < b) of a group's members with the one of the greater value (none: a tie), the first `most` of a group.

    The first `most` pairs are of the first `most` + 1 members, whatever a group has: only these are gathered."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(key))
    listed = df.select(group, key, value).withColumn("__r", nth).filter(F.col("__r") <= most + 1).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = listed.select(group, F.posexplode(F.slice(pairs, 1, most)).alias("nth", "p"))
    winner = F.when(F.col(f"p.a.{value}") > F.col(f"p.b.{value}"), F.col(f"p.a.{key}")).when(F.col(f"p.a.{value}") < F.col(f"p.b.{value}"), F.col(f"p.b.{key}"))
    return each.select(group, F.col(f"p.a.{key}").alias("a"), F.col(f"p.b.{key}").alias("b"), winner.alias("winner"))


def quantity_cells(df: DataFrame, cell: Column, header: Column, confidence: Column, grounded: Column, units: list[str], least: float = 0.9, longest: int = 40) -> DataFrame:
    """Cells that hold a number, with a unit in the cell or its header, sure and short enough, and grounded."""
    unit = "|".join(units)
    return df.filter(cell.rlike("[0-9]") & (cell.rlike(unit) | header.rlike(unit)) & (confidence >= least) & (F.length(cell) <= longest) & (F.length(header) > 0) & grounded)


def eligible(cell: Column, keywords: list[str], refused: str) -> Column:
    """The cell has one of the words, and nothing of the refused pattern."""
    return F.exists(F.array(*map(F.lit, keywords)), lambda w: F.contains(cell, w)) & ~cell.rlike(refused)


def schedule_cells(df: DataFrame, cell: Column, pattern: str, headers: list[Column]) -> DataFrame:
    """Cells that hold a date of a pattern, with the first usable of the headers; without any they are left out."""
    return df.withColumn("header", F.coalesce(*[F.when(F.length(F.trim(h)) > 0, h) for h in headers])).filter(cell.rlike(pattern) & F.col("header").isNotNull())


def absent_pairs(entities: DataFrame, values: DataFrame, have: DataFrame) -> DataFrame:
    """Pairs of an entity and a value, each a column, that no row of `have` has. values: a small set, gathered once."""
    name = values.columns[0]
    wanted = entities.withColumn("__v", values.agg(F.array_sort(F.collect_set(name))).scalar())
    return wanted.select(*entities.columns, F.explode("__v").alias(name)).join(have.distinct(), [*entities.columns, name], "left_anti")


def keep_first(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def verified(df: DataFrame, ok: Column) -> DataFrame:
    """Only rows that hold by construction."""
    return df.filter(F.coalesce(ok, F.lit(False)))
