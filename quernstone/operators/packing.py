"""Context packing: budgets by running sums, cyclic padding, bands, offsets, interleaving, manifests, attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .numbering import running


def prefix_pack(df: DataFrame, by: list[str], order: list, weight: str, budget: int | Column) -> DataFrame:
    """What fits from the start of the order (D5: give a descending one), up to the first overflow."""
    return running(df, by, order, weight).filter(F.col("cum") <= budget)


def prefill(df: DataFrame, by: list[str], order: list, weight: str, budget: int | Column) -> DataFrame:
    """A row is taken while the total before it is under the budget."""
    return running(df, by, order, weight).filter(F.col("cum") - F.col(weight) < budget)


def cyclic(df: DataFrame, by: list[str], order: list, weight: str, budget: int, guard: int = 200_000) -> DataFrame:
    """The list again and again while the total before a row is under the budget; at most `guard` rows a group.

    A cycle's length is known beforehand, so each row knows its copies without a loop."""
    # a row a group, joined: a window over a group would hold all of it
    totals = df.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.sum(weight).alias("__total"))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    rows = running(df, by, order, weight).join(totals, same).drop(*[f"__g{i}" for i in range(len(by))]).withColumn("__before", F.col("cum") - F.col(weight))
    # cycles c with c * total + before < budget
    copies = F.when(F.col("__total") > 0, F.ceil((F.lit(budget) - F.col("__before")) / F.col("__total"))).otherwise(0)
    many = rows.filter(copies > 0).withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.least(copies.cast("long"), F.lit(guard)) - 1)))
    return many.withColumn("offset", F.col("cycle") * F.col("__total") + F.col("__before")).drop("__total", "__before", "cum")


def band(offset: Column, size: Column, total: Column) -> Column:
    """By the middle's share of the whole: early under .34, middle under .67, else late."""
    at = F.try_divide(offset + size / 2, total)
    return F.when(at < 0.34, "early").when(at < 0.67, "middle").otherwise("late")


def blocks(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The number of the block of n rows that a row belongs to, from 0; no task numbers a whole group."""
    nth = running(df.withColumn("__one", F.lit(1)), by, order, "__one", "__nth")
    return nth.withColumn("block", F.floor((F.col("__nth") - 1) / n).cast("long")).drop("__one", "__nth")


def interleaved(df: DataFrame, group: str, order: list) -> DataFrame:
    """The i-th of each group in turn: `turn` and the group order the rows."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def covers(needed: Column, have: Column) -> Column:
    """All needed ids are there (relational division)."""
    return F.size(F.array_except(needed, have)) == 0


def largest_covering(needs: DataFrame, bundles: DataFrame, item: str, needed: str, have: str, rank: list) -> DataFrame:
    """For each item the first by `rank` of the bundles that hold all ids it needs; items that no bundle covers are left out.

    Joined by id: only bundles that hold one of an item's ids are counted, and a bundle that covers it is met as often as it has ids."""
    asked = needs.select(item, F.size(F.array_distinct(needed)).alias("__n"), F.explode(F.array_distinct(needed)).alias("__id"))
    held = bundles.select(*[c for c in bundles.columns if c != have], F.explode(F.array_distinct(have)).alias("__id"))
    others = [c for c in bundles.columns if c != have]
    met = asked.join(held, "__id").groupBy(item, "__n", *others).agg(F.count(F.lit(1)).alias("__met")).filter("__met = __n")
    return met.withColumn("__r", F.row_number().over(Window.partitionBy(item).orderBy(*rank))).filter("__r = 1").select(item, *others)


def attached(items: DataFrame, places: DataFrame, item: str, family: str, pages: str, rules: dict[str, str], default: str = "middle") -> DataFrame:
    """(item, bundle, tier, position) of every item: the bundle that its family's rule finds, or nulls, so that no stale reference stays.

    places: a row (bundle, tier, page, band) for each page of each bundle. Rules: `early` and `late` take the smallest and the largest tier that has the
    item's first page in that band, `all` the largest that has all its pages (position `multi`), `middle` the middle one by tier of those that have
    the first page. Ties go to the smaller bundle. What a page offers is worked out once, a row a page, and then joined: items that share a page
    don't multiply its bundles."""
    rule = F.lit(default)
    for name, what in rules.items():
        rule = F.when(F.col(family) == name, what).otherwise(rule)
    asked = items.select(item, F.col(pages).alias("__pages"), F.get(pages, F.lit(0)).alias("__page"), rule.alias("__rule"))
    up = F.struct("tier", "bundle", "band")
    down = F.struct((-F.col("tier")).alias("down"), F.col("bundle"))
    ordered = Window.partitionBy("page").orderBy("tier", "bundle")
    # a page's bundles are as many as hold it; they are ranked, not gathered
    ranked = places.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("page")), "__nth": F.row_number().over(ordered)})
    offers = ranked.groupBy(F.col("page").alias("__page")).agg(
        F.min(F.when(F.col("band") == "early", up)).alias("early"),
        F.min(F.when(F.col("band") == "late", down)).alias("late"),
        F.min(F.when(F.col("__nth") == F.floor(F.col("__n") / 2) + 1, up)).alias("middle"),
    )
    told = lambda bundle, tier, position: F.struct(bundle.alias("bundle"), tier.alias("tier"), position.alias("position"))
    of = F.when((F.col("__rule") == "early") & F.col("early").isNotNull(), told(F.col("early.bundle"), F.col("early.tier"), F.lit("early")))
    of = of.when((F.col("__rule") == "late") & F.col("late").isNotNull(), told(F.col("late.bundle"), (-F.col("late.down")).cast(places.schema["tier"].dataType), F.lit("late")))
    of = of.when((F.col("__rule") == "middle") & F.col("middle").isNotNull(), told(F.col("middle.bundle"), F.col("middle.tier"), F.col("middle.band")))
    one = asked.filter("__rule <> 'all'").join(offers, "__page", "left").select(item, of.alias("__at"))
    several = asked.filter("__rule = 'all'")
    wanted = several.select(item, F.size(F.array_distinct("__pages")).alias("__n"), F.explode(F.array_distinct("__pages")).alias("page"))
    met = wanted.join(places.select("page", "bundle", "tier").distinct(), "page").groupBy(item, "__n", "bundle", "tier").agg(F.count(F.lit(1)).alias("__met")).filter("__met = __n")
    best = met.groupBy(item).agg(F.min(F.struct((-F.col("tier")).alias("down"), F.col("bundle"), F.col("tier"))).alias("__b"))
    many = several.select(item).join(best, item, "left").select(item, F.when(F.col("__b").isNotNull(), told(F.col("__b.bundle"), F.col("__b.tier"), F.lit("multi"))).alias("__at"))
    return one.unionByName(many).select(item, "__at.bundle", "__at.tier", "__at.position")


__all__ = ["running", "prefix_pack", "prefill", "cyclic", "band", "blocks", "interleaved", "covers", "largest_covering", "attached"]
