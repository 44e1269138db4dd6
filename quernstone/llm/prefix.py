"""Exact prefix sums over a whole table, in native DataFrame functions.

Rows are dealt to partitions by ranges of their order key; each partition's rows are summed on their own, and the
partitions' totals (one small row each) give each partition its offset. No task ever holds more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed


def with_prefix(rows: DataFrame, order: list[Column], weights: list[str], by: list[str] | None = None) -> DataFrame:
    """`rows` (narrow, checkpointed ones), and, both within `by`: `__start_` and the name of each weight, the sum of it over the
    rows before, and `__row`, their number.

    The last order key is a row's place in the input, so that even equal rows are split over ranges. Range bounds come
    from a sample: the dealt rows are checkpointed, and every later job sees the same ranges."""
    by = by or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)} | {"__place": F.monotonically_increasing_id()})
    keys = [*by, *(f"__o{i}" for i in range(len(order))), "__place"]
    dealt = checkpointed(keyed.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counted = {f"__start_{w}": w for w in weights}
    totals = dealt.groupBy("__part", *by).agg(*[F.sum(w).alias(f"__sum{i}") for i, w in enumerate(weights)], F.count(F.lit(1)).alias("__count"))
    offsets = totals.select(
        F.col("__part").alias("__p"),
        *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"__sum{i}").over(before), F.lit(0)).cast("long").alias(f"__off{i}") for i in range(len(weights))],
        F.coalesce(F.sum("__count").over(before), F.lit(0)).cast("long").alias("__count0"),
    )
    within = Window.partitionBy("__part", *by).orderBy(*keys[len(by) :])
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"__in{i}": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for i, w in enumerate(weights)} | {"__count1": F.row_number().over(within) - 1})
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    # without `by` there is one row a partition: as small as the number of partitions, which is set, not grown
    joined = local.join(offsets if by else F.broadcast(offsets), same)
    starts = [(F.col(f"__off{i}") + F.col(f"__in{i}")).alias(name) for i, name in enumerate(counted)]
    return joined.select(*rows.columns, *starts, (F.col("__count0") + F.col("__count1")).alias("__row"))
