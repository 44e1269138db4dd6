"""Mixing sources to target weights by a time-varying curriculum, in native DataFrame functions.

Method. Sources, in code point order with null last, weigh 5, 2, 1, repeating, and share the number of all words; a
source's target stops at `most` times its own words and the excess is reshared by weight (`targets`: water filling in
closed form over the sources). Each source has a weight schedule over training time t in [0, 1], 1 + c (2 t - 1), where
c = -0.5, 0, 0.5 by its place: early, even, late. Its integral, F(t) = t + c (t^2 - t), is the share of the source's target that is
asked for until t: its cumulative demand. The source's documents stand in a fixed shuffled order (md5 of the id) and are passed
through up to `most` times, until the target is reached: a copy takes the words between its offset and the target, so a
source's taken words equal its target rounded to a word. A copy whose middle lies at the share u of the target is trained at the
time t with F(t) = u, by inversion; its position is the number of words that all sources together have asked for by
then: the sum of target * F(t), which is T t + C (t^2 - t), T being the sum of targets and C that of target * c. Copies are
sorted by position over the whole table, by ranges.

Offsets are exact prefix sums (`prefix.with_prefix`): a hot source is split over ranges of the order, as any other, and the
sources themselves, however many, are ordered and filled in the same way. Texts are read once for the plan.

Cases. Null and empty texts have size 0, take 0 and have no position. A null source is a source of its own. Null ids stand in one
place of the order, equal rows beside one another; each is mixed on its own. An empty table gives no rows. Reruns agree: the
order depends on ids and sizes alone (rows equal in both are interchangeable). Columns of the input other than id, text and
source are carried by `mix` only, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, digest
from .prefix import with_prefix

# The weights of the sources in their order, and how their schedules lean.
WEIGHTS = [5, 2, 1]
LEANS = [-0.5, 0.0, 0.5]


def targets(sizes: DataFrame, most=3) -> DataFrame:
    """From source and source_size (a row a source): target, and lean. Target = min(most * size, level * weight), where
    the level makes the targets add up to all words. Sources sorted by the level at which they are full; at each, the
    level if it were the first that isn't full; the greatest that its own source can bear is the true one."""
    sizes = checkpointed(sizes)
    by_name = [F.col("source").isNull(), F.col("source")]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("__row") % len(WEIGHTS) + 1).cast("int"))
    rows = with_prefix(sizes, by_name, []).select("source", "source_size", pick(WEIGHTS).alias("w"), pick(LEANS).alias("lean"))
    rows = checkpointed(rows.withColumn("full", most * F.col("source_size") / F.col("w")))
    filled = with_prefix(rows, [F.col("full"), *by_name], ["source_size", "w"])
    total, weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    filled = filled.withColumn("level", (F.lit(total) - most * F.col("__start_source_size")) / (F.lit(weights) - F.col("__start_w")).cast("double"))
    level = filled.agg(F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).alias("level")).scalar()
    target = F.least((most * F.col("source_size")).cast("double"), level * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "lean")


def plan(docs: DataFrame, most=3, id_col="doc_id", text_col="text", source_col="source", key: Column | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, and copies: array of (words, position)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        *([key.alias("__key")] if key is not None else []),
    )
    rows = checkpointed(rows)
    placed = with_prefix(rows, [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("size")], ["size"], ["source"])
    # a row a source: Spark measures it and broadcasts it where it is small
    quota = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most))
    asked, leaning = quota.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(F.col("target") * F.col("lean")), F.lit(0.0))).first()
    q = quota.select(F.col("source").alias("__source"), "source_size", "target", "lean")
    placed = placed.join(q, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__quota", F.least(F.round("target").cast("long"), most * F.col("source_size")))
    start = lambda k: F.col("__start_size") + k * F.col("source_size")
    take = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.col("__quota") - start(k))).cast("long")

    def position(k):
        share = (start(k) + take(k) / 2) / F.col("__quota")
        b = 1 - F.col("lean")
        time = F.when(F.col("lean") == 0, share).otherwise((F.sqrt(b * b + 4 * F.col("lean") * share) - b) / (2 * F.col("lean")))
        return F.lit(asked) * time + F.lit(leaning) * (time * time - time)

    every = F.array(*[F.when(take(F.lit(k)) > 0, F.struct(take(F.lit(k)).alias("words"), position(F.lit(k)).alias("position"))) for k in range(most)])
    copies = F.array_compact(every)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        sum((take(F.lit(k)) for k in range(1, most)), take(F.lit(0))).alias("taken"), copies.alias("copies"),
        *(["__key"] if key is not None else []),
    )


def in_order(planned: DataFrame) -> DataFrame:
    """A row a document of a plan, sorted by the position of its first copy (documents without one last): the plan's columns,
    n_copies, and position and last_position: those of its first and its last copy, in whole words."""
    at = lambda i: F.floor(F.element_at("copies", i)["position"]).cast("long")
    some = F.size("copies") > 0
    rows = planned.select("*", F.size("copies").alias("n_copies"), F.when(some, at(1)).alias("position"), F.when(some, at(-1)).alias("last_position"))
    return rows.orderBy(F.col("position").isNull(), F.get("copies", F.lit(0))["position"], "doc_id")


def mix(docs: DataFrame, most=3, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed corpus: all columns of `docs`, a row for each copy, sorted by training position over the whole table.

    A copy at a source's very end, of which the target takes less than half, is left out; others stay whole. Rows are told apart by a
    digest of all their columns; of rows that are equal in all, one is kept and comes as often as their copies together."""
    key = digest(*[docs[f"`{c}`"] for c in docs.columns])
    planned = plan(docs, most, id_col, text_col, source_col, key)
    copies = planned.select(F.col("__key").alias("key"), "size", F.explode("copies").alias("copy")).filter(2 * F.col("copy.words") >= F.col("size"))
    # the row is packed: no column of it can be taken for one of these
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("__key"))
    each = packed.groupBy("__key").agg(F.first("row").alias("row"))
    out = each.join(copies, F.col("__key") == F.col("key")).select("row", "copy.position")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position"), F.col("row")[id_col]]
    return out.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*[F.col("row")[c].alias(c) for c in docs.columns])
