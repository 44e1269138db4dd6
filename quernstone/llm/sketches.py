"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Rule. A document's set holds its distinct `shingle`-word shingles; a text of fewer words is one shingle. Two documents are linked if their
sets have a Jaccard similarity of 0.8 or more; components of links are groups, named by their smallest id.

Sketch. A sketch has `SIZE` coordinates. In each round every element of the set is hashed to a bin, and a coordinate takes the first, least
hash that falls into it. In the first `SIZE` rounds the bin is hashed, too; then round `SIZE` + i throws all elements into bin i, so that
every coordinate is filled after 2 `SIZE` rounds at most, however small the set. A set of n elements fills nearly all in about
SIZE log SIZE / n rounds, and equal coordinates estimate the similarity with the concentration of independent draws. A byte of each coordinate is
kept. A band is `ROWS` coordinates; sets that share a band, and `ENOUGH` coordinates in all, are candidates. At a similarity of 0.8 a pair shares no
band with a probability of (1 - 0.8^ROWS)^(SIZE / ROWS), about 5e-9, and fewer coordinates with one of about 5e-9; near copies are more alike than that.

Prints. Behind the coordinates stand `PARITIES` parities: of the elements in each of as many bins, whether their number is odd. The parities of two sets
differ in no more bins than the sets have elements that are not common, and those of a similarity of 0.8 are a ninth of both sizes at most: what
differs in more is no candidate, for certain. Of sets of some hundred elements, which meet in few bins, this leaves hardly a pair that is no link.

Verification. Candidates are compared by their whole sets. In a bucket (sets of one band; the first `GUIDES` bands only), ordered by size, each set is
first paired with the next; what these links join is one cluster. Then, in the buckets of all bands, sets of different clusters are paired:
a large group of near copies gives no square of pairs, and no pair is left out. Buckets are dealt by ranges, not by key, so a hot one
lies in many tasks: for the second pairing it is cut into fragments, which meet two by two. There only sets outside of a bucket's largest cluster
look for mates.

Size. Documents of equal sets are one node. Only bands (hashes), the sketches of sets that share some, and the texts of candidates are shuffled;
components are found by distributed stars. Only sums reach the driver.

Cases. A-Z are lower-cased; words are runs of characters other than space and U+0009 to U+000D. Null texts, and texts without words, have an empty
set and are linked with nothing. Null ids count as the greatest id; a group of null ids only has a null component, and its rows are kept.
Rows of one id are documents of their own; repeated rows have equal results. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, doc_key, ship
from .components import components

SIZE, ROWS, ENOUGH = 240, 5, 156
PARITIES = 1024
GUIDES = 12
FRAGMENT = 256
NO_ID = 2**63 - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters its input (SplitMix64's finaliser)."""
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def shingles(text: bytes | None, shingle: int = 2) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (unsigned); none for a text without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and white space of ASCII only
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(words))
    if not n:
        return each
    made = np.full(len(each) - n + 1, n, np.uint64)
    for i in range(n):
        made = _mixed(made + _A + each[i : len(each) - n + 1 + i])
    return np.unique(made)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The `SIZE` coordinates of a set that is not empty: the round in the upper 9 bits, then the least hash of that round."""
    best = np.full(SIZE, np.uint64(2**64 - 1))
    at, together = 0, max(1, 2048 // len(elements))
    while at < 2 * SIZE:
        # a later round never beats an earlier one, so that several can be taken at once
        rounds = np.arange(at, min(at + together, 2 * SIZE), dtype=np.uint64)[:, None]
        hashed = _mixed(elements[None] + (rounds + np.uint64(1)) * _A)
        bins = np.where(rounds < SIZE, _mixed(hashed + _B) % np.uint64(SIZE), rounds % np.uint64(SIZE)).astype(np.int64)
        np.minimum.at(best, bins.ravel(), (rounds << np.uint64(55) | hashed >> np.uint64(9)).ravel())
        at += together
        if int(best.max()) >> 55 < at:
            break
    return best


def parities(elements: np.ndarray) -> np.ndarray:
    """`PARITIES` bits: whether an odd number of elements has a hash that begins with this number."""
    return np.packbits(np.bincount((elements >> np.uint64(54)).astype(np.int64), minlength=PARITIES) % 2 == 1)


def sketched(docs: DataFrame, shingle=2, id_col="doc_id", text_col="text") -> DataFrame:
    """key, row (a hash of the text), n (the set's size), uid (a hash of 128 bits of the set), sketch (a byte of each coordinate, then the
    parities; null for an empty set) of each row."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sets = [shingles(t.as_py(), shingle) for t in part.column(2)]
                made = [sketch(s).astype(np.uint8).tobytes() + parities(s).tobytes() if len(s) else None for s in sets]
                columns = [part.column(0), part.column(1), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "n", "uid", "sketch"])

    return ship(_texts(docs, id_col, text_col)).mapInArrow(run, "key long, row long, n long, uid binary, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(doc_key(docs, id_col).alias("key"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))


def banded(nodes: DataFrame) -> DataFrame:
    """node, n, k, band: a row for each band of a node; band is a hash of its number k and its coordinates."""
    each = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.substring("sketch", ROWS * k + 1, ROWS)).alias("band")) for k in range(SIZE // ROWS)]
    return nodes.select("node", "n", F.inline(F.array(*each)))


def _prints(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates and the parities (words of 64; none, if there are coordinates only) of sketches."""
    rows = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    return rows[:, :SIZE], np.ascontiguousarray(rows[:, SIZE:]).view(np.uint64)


def _near(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether parities x and y of two sets, of `sizes` elements together, leave room for a similarity of 0.8."""
    return 9 * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= sizes


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1) >= ENOUGH


def neighbours(buckets: DataFrame) -> DataFrame:
    """(a, b): each row of a bucket (band, n, node, sketch) and the next one of its bucket by size, if they are candidates."""

    def run(batches):
        last = None
        for b in batches:
            band, n, node = (c.to_numpy() for c in b.columns[:3])
            if not len(band):
                continue
            rows, bits = _prints(b.column(3).to_pylist())
            if last:
                band, n, node, rows, bits = (np.concatenate([x, y]) for x, y in zip(last, (band, n, node, rows, bits), strict=True))
            last = [x[-1:] for x in (band, n, node, rows, bits)]
            fit = (band[1:] == band[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & _near(n[1:] + n[:-1], bits[1:], bits[:-1]) & _alike(rows[1:], rows[:-1])
            a, z = node[:-1][fit], node[1:][fit]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], names=["a", "b"])

    order = ["band", "n", "node"]
    return ship(buckets.select(*order, "sketch").repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(run, "a long, b long").distinct()


def across(buckets: DataFrame, nodes: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """(a, b): all candidates of different clusters (root) within a bucket (k, band, n, node, root), each made in the first band that the two
    share. nodes: node, sketch.

    Only strays, the members outside of a bucket's largest cluster, look for mates, so that a bucket of one cluster gives nothing and one of m
    members and s strays compares s * m. Strays are dealt to fragments of about `fragment` rows, members to those of 16 times as many,
    and each two of them meet as a key of their own."""
    clusters = buckets.groupBy("band", "root").agg(F.count(F.lit(1)).alias("rows"))
    parts = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    mixed = (
        clusters.groupBy("band").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max_by("root", F.struct("rows", "root")).alias("main"))
        .withColumn("strays", F.col("rows") - F.col("most")).filter("strays > 0")
        .select("band", "main", parts("strays", fragment).alias("ps"), parts("rows", 16 * fragment).alias("qs"))
    )
    of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = buckets.join(mixed, "band").withColumns({"p": of("ps"), "q": of("qs"), "stray": F.col("root") != F.col("main")}).join(nodes.select("node", "sketch"), "node")
    looking = members.filter("stray").select("band", "p", every("qs").alias("q"), F.lit(True).alias("left"), "k", "stray", "n", "node", "root", "sketch")
    found = members.select("band", every("ps").alias("p"), "q", F.lit(False).alias("left"), "k", "stray", "n", "node", "root", "sketch")

    def first_band(x, y):
        return (x == y).reshape(len(x), SIZE // ROWS, ROWS).all(axis=2).argmax(axis=1)

    def meet(k, left, right):
        for start in range(0, len(left[0]), 64):
            some = [c[start : start + 64, None] for c in left[:4]]
            stray, n, node, root = (c[None] for c in right[:4])
            # two strays are a pair once
            fit = (some[3] != root) & (5 * np.minimum(some[1], n) >= 4 * np.maximum(some[1], n)) & (~stray | (some[2] < node))
            i, j = np.nonzero(fit)
            for at in range(0, len(i), 16_384):
                x, y = i[at : at + 16_384] + start, j[at : at + 16_384]
                near = _near(left[1][x] + right[1][y], left[5][x], right[5][y])
                x, y = x[near], y[near]
                like = _alike(left[4][x], right[4][y]) & (first_band(left[4][x], right[4][y]) == k)
                a, z = left[2][x[like]], right[2][y[like]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], names=["a", "b"])

    def run(batches):
        at, held = None, ([], [])

        def flush():
            if held[0] and held[1]:
                sides = []
                for rows in held:
                    numbers, stray, n, node, root, prints = zip(*rows, strict=True)
                    sides.append([np.array(stray), *(np.array(c, np.int64) for c in (n, node, root)), *_prints(prints)])
                yield from meet(numbers[0], *sides)

        for b in batches:
            for band, p, q, left, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, p, q) != at:
                    yield from flush()
                    at, held = (band, p, q), ([], [])
                held[not left].append(row)
        yield from flush()

    keys = ["band", "p", "q"]
    return ship(looking.union(found)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle=2, id_col="doc_id", text_col="text") -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets have a similarity of 0.8 or more. nodes: node, and key and row of one of its documents."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                made = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1).slice(start, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, 256), pa.array(made, pa.list_(pa.int64()))], names=["node", "hashes"])

    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "key", "row")
    # equal rows are one; a text that has only its hash in common is told apart by its set
    texts = _texts(docs, id_col, text_col).join(wanted, ["key", "row"]).select("node", "text").dropDuplicates(["node"])
    sets = checkpointed(ship(texts).mapInArrow(run, "node long, hashes array<long>"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common, sizes = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    # the union has sizes - common
    return checkpointed(both.filter(100 * common >= 80 * (sizes - common)).select("a", "b"))


def links(docs: DataFrame, nodes: DataFrame, shingle=2, id_col="doc_id", text_col="text", fragment: int = FRAGMENT) -> DataFrame:
    """(a, b): links between nodes (node, key, row, n, sketch), enough to join all that are linked."""
    each = banded(nodes)
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("band")
    buckets = checkpointed(each.join(shared, "band"))
    guides = buckets.filter(F.col("k") < GUIDES).join(nodes.select("node", "sketch"), "node")
    first = confirmed(neighbours(guides), docs, nodes, shingle, id_col, text_col)
    roots = components(first).withColumnRenamed("node", "own")
    rooted = buckets.join(roots, F.col("node") == F.col("own"), "left").select("k", "band", "n", "node", F.coalesce("root", "node").alias("root"))
    return first.union(confirmed(across(rooted, nodes, fragment), docs, nodes, shingle, id_col, text_col))


def near_duplicates(docs: DataFrame, shingle=2, id_col="doc_id", text_col="text", fragment: int = FRAGMENT) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is its own)."""
    rows = checkpointed(sketched(docs, shingle, id_col, text_col))
    firsts = rows.filter("n > 0").groupBy("uid").agg(F.min(F.struct("key", "row")).alias("of"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = checkpointed(firsts.select("uid", "of.*", "n", "sketch", F.monotonically_increasing_id().alias("node")))
    stars = components(links(docs, nodes, shingle, id_col, text_col, fragment)).withColumnRenamed("node", "own")
    rooted = nodes.join(stars, F.col("node") == F.col("own"), "left").select("uid", F.col("key").alias("first"), F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = rooted.join(groups, "root").select("uid", "component")
    known = lambda c: F.when(c != NO_ID, c)
    joined = rows.select("key", "n", F.when(F.col("n") > 0, F.col("uid")).alias("uid")).join(of, "uid", "left").withColumn("component", F.coalesce("component", "key"))
    return joined.select(known(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.col("component")).alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
