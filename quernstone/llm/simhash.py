"""SimHash near-duplicates over BK-trees.

Method. A document's fingerprint: bit i is set if it is set in over half of the XXH64 hashes (seed 42) of its word shingles.
Fingerprints that differ in `radius` bits at most are linked; components of links are groups of near-duplicates.
Links are looked up in BK-trees, whose children hang on edges keyed by the Hamming distance to the parent: a search
follows only edges within the radius of its own distance. One tree of all fingerprints would be neither small enough to
broadcast nor allowed to be collected, so fingerprints are dealt to shards, each with a tree of its own, built and searched
where the shard lies. (The README has figures for both ways.) Shards: the 64 bits are four blocks of 16, and with two differing bits at least two blocks
are equal; so each fingerprint goes to the six shards named by two of its blocks, and linked ones meet in one of them. A
shard of more than `split` fingerprints is dealt again by three pieces of its other 32 bits, of which one must be equal: as they
are distinct, a part then has 2^22 fingerprints at most.

Size. Only distinct fingerprints are searched (copies share one), a shard gives at most one link a member, to the tree's
member it was found near, and components are found by distributed stars; nothing but counts reaches the driver.

Cases. Null and empty texts have no word and fingerprint 0, linked as any other. Texts of fewer words than a shingle are
hashed whole. Null ids count as greater than any other id; a group of nulls only has a null component. Equal rows have equal
results. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, doc_key, ship
from .components import components

NO_ID = 2**63 - 1


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, as an unsigned integer of 64 bits."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    set_in = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


class BKTree:
    """Children keyed by the Hamming distance to their parent."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.nodes.append(x)
        self.children.append({})
        new, at = len(self.nodes) - 1, 0
        while new:
            d = (x ^ self.nodes[at]).bit_count()
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = new
                return
            at = down

    def near(self, x: int, radius: int) -> list[int]:
        """The members within the radius."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            at = todo.pop()
            d = (x ^ self.nodes[at]).bit_count()
            if d <= radius:
                found.append(self.nodes[at])
            children = self.children[at]
            for edge in range(max(0, d - radius), d + radius + 1):
                if edge in children:
                    todo.append(children[edge])
        return found


def _shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is near within a shard: no more than members, whatever the number of near pairs."""
    tree, parent, links = BKTree(), {}, []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in members:
        parent[x] = x
        for y in tree.near(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                links.append((x, y))
        tree.add(x)
    return links


def fingerprints(docs: DataFrame, shingle=3, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""

    def run(frames):
        for f in frames:
            prints = np.fromiter((fingerprint(t, shingle) for t in f["text"]), np.uint64, len(f)).view(np.int64)
            yield pd.DataFrame({"key": f["key"], "fp": prints})

    # ids go through as longs: null ids as the greatest one
    rows = docs.select(doc_key(docs, id_col).alias("key"), F.col(text_col).alias("text"))
    return ship(rows).mapInPandas(run, "key long, fp long")


def _shards(prints: DataFrame, split: int) -> DataFrame:
    """(shard, fp): six rows a fingerprint, of shards with at least two members."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    named = [F.struct(F.lit(n).alias("n"), (block(i) * 65536 + block(j)).alias("v"), *(block(k).alias(f"r{m}") for m, k in enumerate(k for k in range(4) if k not in (i, j)))) for n, (i, j) in enumerate(pairs)]
    rows = prints.select("fp", F.explode(F.array(*named)).alias("s")).select("fp", "s.*")
    sizes = rows.groupBy("n", "v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rest = F.col("r0") * 65536 + F.col("r1")
    cuts = [(0, 11), (11, 11), (22, 10)]
    again = F.array(*[F.lit(k + 1) * (1 << 11) + F.shiftright(rest, at).bitwiseAND(F.lit((1 << width) - 1)) for k, (at, width) in enumerate(cuts)])
    part = F.explode(F.when(F.col("size") > split, again).otherwise(F.array(F.lit(0).cast("long"))))
    return rows.join(sizes, ["n", "v"]).select("n", "v", part.alias("part"), "fp")


def links(prints: DataFrame, radius=2, split=4096) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to join all that are linked. radius: 2 at most."""
    if radius > 2:
        raise ValueError("two equal blocks of four are sure for a radius of 2 at most")

    def run(frames):
        held: list[int] = []
        shard, found = None, []
        for f in frames:
            for n, v, part, fp in zip(f["n"].tolist(), f["v"].tolist(), f["part"].tolist(), f["fp"].to_numpy().view(np.uint64).tolist(), strict=True):
                if (n, v, part) != shard:
                    if len(held) > 1:
                        found += _shard_links(held, radius)
                    shard, held = (n, v, part), []
                held.append(fp)
            if found:
                yield pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype=np.uint64).astype(np.int64)
                found = []
        if len(held) > 1:
            found = _shard_links(held, radius)
            yield pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype=np.uint64).astype(np.int64)

    keys = ["n", "v", "part"]
    return ship(_shards(prints, split)).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius=2, shingle=3, id_col="doc_id", text_col="text", split=4096) -> DataFrame:
    """A row a document: doc_id, fingerprint (hex), component_id (the smallest doc_id reachable over links)."""
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min("key").alias("first"))
    stars = components(links(prints.select("fp"), radius, split))
    rooted = prints.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = rooted.join(groups, "root").select("fp", "component")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(of, "fp").select(known("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), known("component").alias("component_id"))
