"""Near-duplicates of short texts: template signatures, clusters, weights, and Jaccard joins on equal parts of word sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .numbering import checkpointed, numbered

# Provinces, and what a signature masks, in order.
PROVINCES = "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 강원도 충청북도 충청남도 전북특별자치도 전라북도 전라남도 경상북도 경상남도 제주특별자치도".split()
MASKS = [
    ("「[^」]*」", "「T」"),
    ('"[^"]*"', '"A"'),
    (r"\(p\.[0-9]+\)", "(p.N)"),
    ("|".join(PROVINCES), "<시도>"),
    (r"[\x{AC00}-\x{D7A3}]+(?:시|군|구)([^0-9A-Za-z_\x{AC00}-\x{D7A3}]|$)", "<시군구>{1}"),
    (r"20[0-9]{2}\s*년?\s*[0-9]{0,2}\s*월?", "<날짜>"),
    (r"[0-9][0-9,.]*", "<수>"),
]


def signature(c: Column, family: Column) -> Column:
    """The family, and the text with its variable parts masked."""
    for pattern, mask in MASKS:
        c = F.regexp_replace(c, pattern, mask.replace("{1}", "$1"))
    return F.concat(F.coalesce(family, F.lit("")), F.lit("|"), F.trim(F.regexp_replace(c, r"\s+", " ")))


def clustered(df: DataFrame, sig: str, order: str) -> DataFrame:
    """cluster_no by first appearance, from 0, cluster_id, size and weight. Signatures are numbered once each, not rows."""
    first = df.groupBy(sig).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("cluster_size"))
    digits = F.col("cluster_no").cast("string")
    named = numbered(first, ["__first"], "__number").withColumn("cluster_no", F.col("__number") - 1).withColumn("cluster_id", F.concat(F.lit("clu_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))).drop("__number")
    return df.join(named.withColumn("cluster_weight", F.round(1 / F.col("cluster_size"), 6)).drop("__first"), sig)


#: Longs of a set's parities.
PARITIES = 4


def parities(w: Column, n: int = PARITIES) -> list[Column]:
    """64 * n bits of a set of hashes: whether an odd number of members falls on each. Two sets' bits differ no oftener than their members do."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    at = lambda x: F.pmod(F.shiftright(x, 6), F.lit(n))
    part = lambda i: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.when(at(x) == i, a.bitwiseXOR(bit(x))).otherwise(a))
    return [part(i) for i in range(n)]


def summary(sizes: DataFrame, sig: str, largest: int = 5) -> DataFrame:
    """From a row a cluster (signature, cluster_size): rows, clusters, singletons, their share, and the largest sizes."""
    whole = sizes.agg(F.sum("cluster_size").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("cluster_size") == 1).alias("singletons"))
    top = sizes.orderBy(F.desc("cluster_size"), F.desc(sig)).limit(largest).agg(F.array_join(F.reverse(F.array_sort(F.collect_list("cluster_size"))), ",").alias("largest"))
    return whole.crossJoin(top).withColumn("share", F.round(F.col("singletons") / F.col("clusters"), 6))  # one row each


#: Mates of a set that are looked at first; pairs that a task makes at once; sets whose keys it makes at once.
NEXT, AT_ONCE, TOGETHER = 3, 1 << 18, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters its input (SplitMix64's finaliser)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _classes(least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least size, the number of parts) of each class of sizes up to that of `most`: a set's mates are of its class or a next one. Of two sets
    of a similarity of `least`, the smaller one of the class, fewer members than parts are in one of them only."""
    low, parts = [1], []
    while True:
        high = math.floor(low[-1] / least + 1e-9)
        parts.append(math.floor(high * (1 - least) / least + 1e-9) + 1)
        if high >= most:
            return np.array(low), np.array(parts)
        low.append(high + 1)


def _keys(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """key, k, own: of each set (k, f, w) a key for each of its parts, by the class of its size (own) and by the one before."""
    for whole in batches:
        for start in range(0, whole.num_rows, TOGETHER):
            b = whole.slice(start, TOGETHER)
            w, family = b.column(2), b.column(1).to_numpy().view(np.uint64)
            members = w.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            low, parts = _classes(least, max(1, int(n.max(initial=1))))
            of, scattered, added = np.repeat(np.arange(len(n)), n), _mixed(members), _mixed(members + np.uint64(0x9E3779B97F4A7C15))
            for own in (True, False):
                slot = np.searchsorted(low, n, "right") - (1 if own else 2)
                many = np.where((n > 0) & (slot >= 0), parts[np.maximum(slot, 0)], 0)
                base = np.cumsum(many) - many
                takes = many[of] > 0
                at = of[takes]
                sums = np.zeros(many.sum(), np.uint64)
                np.add.at(sums, base[at] + (scattered[takes] % many[at].astype(np.uint64)).astype(np.int64), added[takes])
                row = np.repeat(np.arange(len(n)), many)
                place = (slot[row] << 32 | np.arange(len(row)) - base[row]).astype(np.uint64)
                key = _mixed(sums + _mixed(place + _mixed(family[row]))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row)), pa.array(np.full(len(row), own))], names=["key", "k", "own"])


def _runs(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Calls `use` with the columns of whole runs of an equal first column, as they come; yields what it yields."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from use([c[:last] for c in held])
            held = [c[last:] for c in held]
    if held is not None:
        yield from use(held)


def _ends(key: np.ndarray) -> np.ndarray:
    """For each row of a sorted key, where its run ends."""
    cuts = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    return np.repeat(cuts, np.diff(cuts, prepend=0))


def _met(columns):
    """The rows whose key several sets have, one of them by its own class."""
    key, k, own = columns
    end = _ends(key)
    owners = np.concatenate([[0], np.cumsum(own)])
    first = np.searchsorted(key, key)
    some = (end - first > 1) & (owners[end] > owners[first])
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=["key", "k", "own"])


def _mates(columns, most: int | None):
    """(k, k_2): open rows and later ones of their key, the next `most` or all, a bounded number at a time."""
    key, k, own, open_ = columns
    after = np.where(open_, _ends(key) - np.arange(len(key)) - 1, 0)
    if most:
        after = np.minimum(after, most)
    before = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(before, before[at] + AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(at, to), after[at:to])
        j = i + 1 + np.arange(len(i)) - (before[i] - before[at])
        new = (own[i] | own[j]) & (k[i] != k[j])
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[i[new]]), pa.array(k[j[new]])], names=["k", "k_2"])
        at = to


def with_later_match(df: DataFrame, id_col: str, family: str, words: Column, least: float) -> DataFrame:
    """The ids that have a later near-duplicate in their family (each counted once): a row with a greater id whose word set is the same or has a
    Jaccard of at least `least` with theirs. Sets are told apart by 128 bits; null ids and null sets have no match.

    Pigeonholes: words are dealt by their hash to one part more than two such sets of their sizes can differ in members, so that one part at least is
    equal. Parts have about least / (1 - least) words, so that sets that are not alike hardly share one, however many sets have the same
    words. Sets that share a part are compared whole. Of a set only its greatest id is in doubt, and one later mate settles it: each
    set looks at the next `NEXT` of a part first, and what then has no mate at all later ones, so that a large group of near copies does not give
    its square."""
    made = F.sort_array(F.array_distinct(F.transform(words, lambda t: F.xxhash64(t))))
    hashed = df.select(F.col(family).alias("fam"), F.col(id_col).alias("id"), made.alias("w"))
    # nulls go after the checkpoint: a filter before it would make the words twice
    rows = checkpointed(hashed.select("id", "fam", "w", F.xxhash64("fam", "w").alias("s1"), F.xxhash64(F.lit(1), "fam", "w").alias("s2"))).filter("id IS NOT NULL AND w IS NOT NULL")
    # read several times below: written once
    sets = checkpointed(rows.groupBy("s1", "s2").agg(F.first("fam").alias("fam"), F.first("w").alias("w"), F.max("id").alias("last")).withColumn("k", F.monotonically_increasing_id()))
    keys = sets.select("k", F.xxhash64("fam").alias("f"), "w").mapInArrow(lambda b: _keys(b, least), "key long, k long, own boolean")
    shared = checkpointed(keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _runs(b, _met), "key long, k long, own boolean"))
    # of the others, none is looked at again
    likely = checkpointed(sets.select("k", "fam", "w", "last").join(shared.select("k").distinct(), "k", "left_semi"))
    met = checkpointed(shared.join(likely.select("k", "last"), "k").select("key", "k", "own", "last"))

    def mates(rows, most):
        dealt = rows.repartition("key").sortWithinPartitions("key", "last", "k").select("key", "k", "own", "open")
        pairs = dealt.mapInArrow(lambda b: _runs(b, lambda c: _mates(c, most)), "k long, k_2 long").distinct()
        one, two = likely, likely.select(F.col("k").alias("k_2"), F.col("fam").alias("fam2"), F.col("w").alias("w2"), F.col("last").alias("last2"))
        share = F.size(F.array_intersect("w", "w2"))
        alike = F.col("fam").eqNullSafe(F.col("fam2")) & (F.col("last") < F.col("last2")) & (share >= least * (F.size("w") + F.size("w2") - share))
        return checkpointed(pairs.join(one, "k").join(two, "k_2").filter(alike).select("k").distinct())

    first = mates(met.withColumn("open", F.lit(True)), NEXT)
    second = mates(met.join(first.withColumn("done", F.lit(True)), "k", "left").withColumn("open", F.col("done").isNull()), None)
    found = first.union(second).withColumn("later", F.lit(True))
    settled = sets.select("s1", "s2", "k", "last").join(found, "k", "left").drop("k")
    return rows.select("id", "s1", "s2").join(settled, ["s1", "s2"]).filter((F.col("id") < F.col("last")) | F.col("later")).select("id")
