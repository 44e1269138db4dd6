"""Splitting, masking, leakage checks and stratified sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def masked(df: DataFrame, hidden: Column, answer: str, dropped: list[str], mask: str = "[hidden]") -> DataFrame:
    """L2: hidden rows without answer and gold columns."""
    return df.withColumns({answer: F.when(hidden, F.lit(mask)).otherwise(F.col(answer)), **{c: F.when(~hidden, F.col(c)) for c in dropped}})


def entities(ids: Column, pages: Column, pattern: str = r"^(.+)-p\d{3}$") -> Column:
    """L3: own ids and those parsed from page ids, each once."""
    return F.array_sort(F.array_union(ids, F.transform(pages, lambda p: F.regexp_extract(p, pattern, 1))))


def leaked(df: DataFrame, entity: str, split: str, eval_splits: list[str]) -> DataFrame:
    """L4: entities in more than one evaluation split."""
    return df.filter(F.col(split).isin(eval_splits)).groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def moved(df: DataFrame, entity: str, split: str, order: str) -> DataFrame:
    """Entities with a row outside the split they were first seen in."""
    seen = df.groupBy(entity).agg(F.min_by(split, order).alias("first_split"), F.countDistinct(split).alias("n"))
    return seen.filter("n > 1").select(entity, "first_split")


def unanimous(df: DataFrame, item: str, split: str, default: str = "dev") -> DataFrame:
    """The split all of an item's entities share; mixed: null; none: the default."""
    g = df.groupBy(item).agg(F.countDistinct(split).alias("n"), F.min(split).alias("s"))
    return g.select(item, F.when(F.col("n") == 0, F.lit(default)).when(F.col("n") == 1, F.col("s")).alias("split"))


def capped(df: DataFrame, by: list[str], most: int | Column, seed: str, key: str) -> DataFrame:
    """Up to so many rows a stratum, in an order fixed by the key's hash and a seed.

    Smaller draws are beginnings of greater ones. The order is MD5, which other engines have as well. A task sends no more than the greatest
    cap of a stratum: where caps are a column, their maximum (one number) is asked for first."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    if isinstance(most, Column):
        greatest = df.agg(F.max(most)).first()[0] or 0
        return capped(df, by, int(greatest), seed, key).filter(F.col("draw") <= most)
    return df.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(order, key)).cast("long")).filter(F.col("draw") <= most)


def quotas(df: DataFrame, by: str, total: int, least: int = 4) -> DataFrame:
    """Shares of a total by stratum size, half-even, at least max(least, total // (2 strata)), at most the stratum."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    floor = F.greatest(F.lit(least), F.floor(F.lit(total) / (2 * F.count(F.lit(1)).over(w))))
    share = F.bround(F.lit(float(total)) * F.col("n") / F.sum("n").over(w))
    return counts.withColumn("quota", F.least(F.col("n"), F.greatest(floor, share)).cast("long"))


def drawn(df: DataFrame, by: str, cluster: str, total: int, seed: str, key: str, per_cluster: int = 1, least: int = 4) -> DataFrame:
    """A stratified draw: each stratum's quota in shuffled order, rows of clusters that are not drawn yet first; what is over the
    total is taken back from the largest strata, the last drawn first, down to the floor."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    quota = quotas(df, by, total, least).select(by, "quota")
    greatest = int(quota.agg(F.max("quota")).first()[0] or 0)
    # ranks under a literal bound: a task sends the first few of a cluster or stratum alone
    first = lambda rows, keys, n: rows.withColumn("__h", F.row_number().over(Window.partitionBy(*keys).orderBy("__late", "__o", key))).filter(F.col("__h") <= n)
    shuffled = df.withColumns({"__o": order, "__late": F.lit(False)})
    early = first(shuffled, [by, cluster], per_cluster).drop("__h")
    late = shuffled.join(early.select(key), key, "left_anti").withColumn("__late", F.lit(True))
    picked = first(early.unionByName(first(late, [by], greatest).drop("__h")), [by], greatest).join(quota, by).filter(F.col("__h") <= F.col("quota"))
    floor = F.greatest(F.lit(least), F.floor(F.lit(total) / (2 * F.lit(df.select(by).distinct().count()))))
    # the draw is a sample of about `total` rows: one task orders it
    over = picked.agg(F.greatest(F.count(F.lit(1)) - total, F.lit(0))).scalar()
    rank = F.row_number().over(Window.orderBy(F.col("__h") <= floor, F.desc("__h"), by))
    return picked.withColumn("__rank", rank).filter((F.col("__h") <= floor) | (F.col("__rank") > over)).select(*df.columns)


def review_sample(df: DataFrame, key: str, strata: dict[str, int], ensure: tuple[str, list[str], int], total: int, seed: str) -> DataFrame:
    """Up to so many of each value of each column, then, if fewer than so many rows have one of the ensured values, as many more of
    them, then any rows up to the total. A sample: its counts are taken on the driver."""
    picked = None
    for i, (column, most) in enumerate(strata.items()):
        some = capped(df, [column], most, f"{seed}{i}", key).select(key)
        picked = some if picked is None else picked.union(some)
    picked = picked.distinct()
    column, values, least = ensure
    if df.filter(F.col(column).isin(values)).join(picked, key, "left_semi").count() < least:
        pool = df.filter(F.col(column).isin(values)).join(picked, key, "left_anti")
        picked = picked.union(pool.orderBy(F.md5(F.concat(F.lit(f"{seed}e"), F.col(key).cast("string")).cast("binary")), key).limit(least).select(key))
    if (lacking := total - picked.count()) > 0:
        pool = df.join(picked, key, "left_anti")
        picked = picked.union(pool.orderBy(F.md5(F.concat(F.lit(f"{seed}t"), F.col(key).cast("string")).cast("binary")), key).limit(lacking).select(key))
    return picked


def blind_sample(df: DataFrame, key: str, hard: tuple[str, list[str], int], tier: tuple[str, str, int], verdict: str, total: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(sheet, key file): so many of each hard category and verdict, so many of a tier, half of what is lacking from wrong ones, the
    rest from right ones. The sheet is numbered in another shuffled order and does not show the verdict."""
    order = [F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), F.col(key)]
    picked = df.sparkSession.createDataFrame([], df.select(key).schema)

    def take(pool, n):
        nonlocal picked
        if n > 0:
            picked = picked.union(pool.join(picked, key, "left_anti").orderBy(*order).limit(n).select(key))

    column, values, each = hard
    first = df.filter(F.col(column).isin(values))
    picked = picked.union(capped(first, [column, verdict], each, seed, key).select(key))
    take(df.filter(F.col(tier[0]) == tier[1]), tier[2])
    take(df.filter(~F.col(verdict)), max(0, (total - picked.count()) // 2))
    take(df.filter(verdict), total - picked.count())
    rows = df.join(picked, key, "left_semi")
    again = F.md5(F.concat(F.lit(f"{seed}s"), F.col(key).cast("string")).cast("binary"))
    sheet = rows.withColumn("row", F.row_number().over(Window.orderBy(again, key)).cast("long")).drop(verdict)
    return sheet, rows.select(key, verdict)
