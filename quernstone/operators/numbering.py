"""Global row numbers without a single task for all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local master, whose tasks share this machine, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the session's shared checkpoint folder, and read from there on."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, out: str = "number") -> DataFrame:
    """`df` with numbers from 1 in a total order.

    Rows are dealt by ranges of the order and numbered within each; a range starts after the rows of those before, of
    which there are as many counts as shuffle partitions. Ranges come of a sample, so they are fixed by a checkpoint."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # a row a partition: as small as the number of partitions, which is set
    return dealt.withColumn("__own", within).join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__before")


def running(df: DataFrame, by: list[str], order: list, weight: str, out: str = "cum") -> DataFrame:
    """`df` with the running sum of `weight` within `by`, the row's own included; `order` is total within a group.

    A group, however large, is dealt by ranges of its order; each range is summed on its own and starts after the sums of those
    before, of which a group has as many as shuffle partitions at most."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part", *by).agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return dealt.withColumn("__own", F.sum(weight).over(within)).join(offsets, same).select(*df.columns, (F.col("__before") + F.col("__own")).alias(out))


def _chains(sizes: np.ndarray, most: int) -> list[tuple[int | None, int, int]]:
    """How a range of a group leaves what comes into it: (above, parts, held) for what is held at its start, in ascending order.

    The first entry is for nothing held (above: none); each other one for what is greater than `above`. `parts` are begun, and `held` is held at the
    end; -1 stands for what came in and the whole range on top. Only rows of the first `most` can be the first to begin a part, so entries are few."""
    total = np.cumsum(sizes)
    before = total - sizes
    filled = np.flatnonzero(sizes > 0)
    full = int(total[-1])

    def after(start: int) -> int:
        # zeros at a part's start hold nothing yet: whatever comes next is added
        k = int(np.searchsorted(filled, start))
        if k == len(filled):
            return len(sizes)
        return max(int(filled[k]) + 1, int(np.searchsorted(total, before[start] + most, side="right")))

    known: dict[int, tuple[int, int]] = {}

    def chain(start: int) -> tuple[int, int]:
        walked = []
        while start < len(sizes) and start not in known:
            walked.append(start)
            start = after(start)
        parts, held = known.get(start, (-1, full - int(before[walked[-1]]) if walked else 0))
        for at in reversed(walked):
            known[at] = parts, held = parts + 1, held
        return parts, held

    entries = [(None, *(chain(int(filled[0])) if len(filled) else (0, -1)))]
    begins = []
    last = most + 1
    for j in range(len(sizes)):
        if (above := max(0, most - int(total[j]))) < last or j == 0:
            parts, held = chain(j)
            begins.append((above, parts + 1, held))
            last = above
        if above == 0:
            break
    if begins[-1][0] > 0:
        begins.append((0, 0, -1))
    return entries + begins[::-1]


def next_fit(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """by, order, size and `part` (from 0): rows of a group in order, a new part where the next would pass `most`. A null size is 0.

    Where a part ends hangs on the part before, yet no task sees a whole group: groups are dealt by ranges of their order, and a range tells
    what it makes of anything that may come into it (`_chains`: as many entries as a part has rows, for a partition's first and last group
    alone). Put together range by range, these give what each partition starts with, and partitions are numbered side by side. A task holds the
    sizes of its range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(by, order, size).repartitionByRange(n, by, order).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(rows.sortWithinPartitions(by, order))
    group = df.schema[by]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list] = []
        for b in batches:
            of, sizes = b.column(0).to_pylist(), b.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1])] if of else []
            for i, z in zip(starts, [*starts[1:], len(of)], strict=True):
                if not runs or runs[-1][0] != of[i]:
                    # a group between the first and the last lies here as a whole
                    runs = [*runs[:1], [of[i], b.column(3)[0].as_py(), []]]
                runs[-1][2].append(sizes[i:z])
        told = [(g, p, sum(int(s.sum()) for s in sizes), *e) for g, p, sizes in runs for e in _chains(np.concatenate(sizes), most)]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), [b.schema.field(0).type, *[pa.int64()] * 5], strict=True)], names=[by, "__part", "total", "above", "parts", "held"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part, met, total = None, 0, 0, (0, -1), 0
        out: list[tuple] = []
        for b in batches:
            for g, p, whole, above, parts, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, p) != at:
                    if at is None or at[0] != g:
                        held, part = 0, 0
                    else:
                        part, held = part + met[0], (held + total if met[1] < 0 else met[1])
                    out.append((g, p, held, part))
                    at, total = (g, p), whole
                if above is None or held > above:
                    met = (parts, left) if above is not None or held == 0 else met
            kind = b.schema.field(0).type
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *[pa.int64()] * 3], strict=True)], names=[by, "__part", "__held", "__from"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, part, begun = None, 0, 0, False
        for b in batches:
            parts = []
            for g, n, start, first in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if not begun or g != group:
                    group, held, part, begun = g, start or 0, first or 0, True
                n = n or 0
                if held and held + n > most:
                    held, part = 0, part + 1
                held += n
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts, pa.int64())], names=[*b.schema.names[:3], "part"])

    longs = lambda *names: T.StructType([group, *[T.StructField(c, T.LongType()) for c in names]])
    told = dealt.mapInArrow(tell, longs("__part", "total", "above", "parts", "held"))
    begun = told.repartition(by).sortWithinPartitions(by, "__part", F.asc_nulls_first("above")).mapInArrow(compose, longs("__part", "__held", "__from"))
    # two rows a partition at most: as small as the number of partitions, which is set
    starts = F.broadcast(begun.select(F.col("__part").alias("__p"), F.col(by).alias("__g"), "__held", "__from"))
    placed = dealt.join(starts, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__g")), "left").select(by, order, size, "__held", "__from")
    return placed.sortWithinPartitions(by, order).mapInArrow(run, df.select(by, order, size).schema.add("part", "long"))
