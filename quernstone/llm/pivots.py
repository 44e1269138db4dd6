"""Exact top-k search by pivot-table elimination.

Method. A vector's components are floor(256 x); the score is the integer inner product. Squared distance and score are tied:
d^2 = |q|^2 + |x|^2 - 2 score. Each row keeps a table of its distances to `n_pivots` pivots; for any pivot p the triangle
gives d(q, x) >= |d(q, p) - d(x, p)|, and the greatest of these bounds caps x's score. A query evaluates candidates in the
order of their caps (the `STEP` greatest, then four times as many, and so on) and stops when no cap reaches its k-th best score: nothing
left can enter, ties included. Its k-th best score among the pivots' sample is known to every block from the start.

Exactness. Components are whole numbers in doubles; a score is a sum of doubles where |q| |x| < 2^53, so that every partial sum is
exact, and one of Python integers beyond. Distances come of differences, so their error is relative, and caps have a slack of more
than that (`SLACK` roundings a component); a cap that overflows is infinite. So results are exact at any norm.

Dealing. Rows lie in blocks of `block` rows at most, queries in blocks of `query_block`; each pair of blocks meets in
one task of bounded memory (a stated query set against all rows, in blocks), gives k rows a query at most, and these are ranked
over all blocks. Pivots are rows of a bounded sample (`sample` rows of the smallest hash), the next always the farthest from
those before; only the sample is collected.

Cases. Vectors that are null, hold a null or a non-finite component, or have no id take no part. Vectors are compared with those of the
same length; empty ones score 0 with each other. Scores past a long count as the greatest or least long. Components of double vectors
past 2^500 count as 2^500. Equal rows are candidates of their own (only the query's own row is left out). Ties go to the smaller
vec_id. An empty table, or a lone row, gives no rows. Columns other than the id and the vector are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, ship

STEP = 256  # how many candidates a query evaluates first
GROUP = 64  # queries that are searched at once
SLACK = 16
EXACT = 2.0**105  # of the product of squared norms: below, |q| |x| < 2^53
LONG = 2**63


def quantised(vectors, length: int) -> np.ndarray:
    """Whole numbers, as doubles."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), length)
    return np.floor(np.clip(x, -(2.0**500), 2.0**500) * 256)


@np.errstate(over="ignore", invalid="ignore")
def choose_pivots(vectors: np.ndarray, n_pivots: int) -> np.ndarray:
    """Farthest first."""
    if not len(vectors):
        return vectors
    chosen = [0]
    nearest = np.full(len(vectors), np.inf)
    while len(chosen) < min(n_pivots, len(vectors)):
        nearest = np.minimum(nearest, np.square(vectors - vectors[chosen[-1]]).sum(1))
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
    return vectors[chosen]


@np.errstate(over="ignore", invalid="ignore")
def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.square(x - p).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 1))


@np.errstate(over="ignore", invalid="ignore")
def caps(q_norms, q_table, norms, table, length) -> np.ndarray:
    """The greatest score that each of the queries can have with each of the rows, or a little more."""
    bound = np.zeros((len(q_norms), len(norms)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(q_table[:, p, None] - table[None, :, p]), out=bound)
    both = q_norms[:, None] + norms[None, :]
    reach = np.square(q_table.max(1)[:, None] + table.max(1)[None, :])
    cap = (both - bound * bound) / 2 + (length + SLACK) * np.finfo(np.float64).eps * (both + reach) + 1
    return np.where(np.isfinite(cap), cap, np.inf)


@np.errstate(over="ignore", invalid="ignore")
def scores(q, x, q_norms, norms) -> np.ndarray:
    """Inner products as longs, exactly: all queries (rows of q) with all rows of x, or, if x has three dimensions, with their own."""
    product = q @ x.T if x.ndim == 2 else np.matmul(x, q[:, :, None])[:, :, 0]
    unsafe = ~(q_norms[:, None] * norms < EXACT)
    out = np.where(unsafe, 0.0, product).astype(np.int64)
    for i, j in zip(*np.nonzero(unsafe), strict=True):
        other = x[j] if x.ndim == 2 else x[i, j]
        exact = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), other.tolist(), strict=True))
        out[i, j] = min(max(exact, -LONG), LONG - 1)
    return out


@np.errstate(over="ignore")
def search(q, q_table, floor, x, table, ids, own, k, step=STEP) -> tuple[list[list[tuple[int, int]]], int]:
    """For each query its k best (score, place) of x, exactly, and how many scores were computed. floor: scores that a query has
    k times anyway, as far as known; own: a row's place where it is the query, else -1."""
    q_norms, norms = np.square(q).sum(1), np.square(x).sum(1)
    cap = caps(q_norms, q_table, norms, table, x.shape[1])
    rows = np.flatnonzero(own >= 0)
    cap[rows, own[rows]] = -np.inf
    best, seen = [[] for _ in q], 0
    kth = floor.astype(np.float64)  # a long as a double may lie above it: one step down is safe
    kth = np.where(kth > -LONG, np.nextafter(kth, -np.inf), -np.inf)

    def enter(i, places, found):
        keep = found >= kth[i]
        best[i] = sorted(best[i] + list(zip((-found[keep].astype(object)).tolist(), ids[places[keep]].tolist(), places[keep].tolist(), strict=True)))[:k]
        if len(best[i]) == k and -best[i][-1][0] > -LONG:
            kth[i] = max(kth[i], np.nextafter(float(-best[i][-1][0]), -np.inf))

    size = step
    while True:
        alive = (cap >= kth[:, None]) & (cap > -np.inf)
        left = alive.sum(1)
        if not left.any():
            break
        if size >= len(x) or left.max() <= size or left.mean() > len(x) / 2 and size > step:
            # what is left is most of the block, or little: all of it at once, as one product of matrices
            some = np.flatnonzero(alive.any(0))
            found = scores(q, x[some], q_norms, norms[some])
            for i in np.flatnonzero(left):
                mine = alive[i, some]
                enter(i, some[mine], found[i, mine])
            seen += int(left.sum())
            break
        first = np.argpartition(-cap, size - 1, axis=1)[:, :size]
        found = scores(q, x[first], q_norms, norms[first])
        for i in np.flatnonzero(left):
            mine = alive[i, first[i]]
            enter(i, first[i][mine], found[i, mine])
        seen += int(np.take_along_axis(alive, first, 1).sum())
        np.put_along_axis(cap, first, -np.inf, 1)
        size *= 4
    return [[(-s, at) for s, _, at in found] for found in best], seen


@np.errstate(over="ignore", invalid="ignore")
def floors(q, uids, sample: dict, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample's other rows; -inf where it is not known exactly."""
    out = np.full(len(q), -np.inf)
    x = sample["x"]
    if len(x) > k:
        q_norms, norms = np.square(q).sum(1), np.square(x).sum(1)
        found = q @ x.T
        known = q_norms * norms.max() < EXACT
        found[sample["uid"][None, :] == uids[:, None]] = -np.inf
        out = np.where(known, np.partition(np.where(known[:, None], found, 0.0), -k, axis=1)[:, -k], -np.inf)
    return out


def top_k(rows: DataFrame, every=50, k=5, n_pivots=32, block=8192, query_block=32768, sample=4096, id_col="vec_id", vector_col="embedding", counted=False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by `every`. counted: instead, query_id and
    evaluated, the number of scores that each block computed for its queries, by one row a block."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))
    own = rows.filter(ok).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = checkpointed(own)
    total, queries = own.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    picked = own.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("uid", "v").toPandas()
    samples = {}
    for n, part in picked.groupby(picked["v"].map(len)):
        x = quantised(part["v"], n)
        samples[n] = {"uid": part["uid"].to_numpy(), "x": x, "pivots": choose_pivots(x, n_pivots)}
    # enough cells for all cores, in blocks that a task can hold
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_query_blocks = max(1, -(-queries // query_block))
    n_blocks = max(1, -(-total // block), min(-(-total // 1024), -(-4 * cores // n_query_blocks)))
    cells = n_blocks * n_query_blocks

    def with_table(frames):
        for f in frames:
            lengths = f["v"].map(len)
            # lengths that the sample lacks go without a table: every candidate is evaluated
            tables, levels = pd.Series([None] * len(f), index=f.index, dtype=object), pd.Series(-np.inf, index=f.index)
            for n, part in f.groupby(lengths):
                x, known = quantised(part["v"], n), samples.get(n, {"uid": np.zeros(0, np.int64), "x": np.zeros((0, n)), "pivots": np.zeros((0, n))})
                tables[part.index] = list(distances(x, known["pivots"]))
                asked = (part["vec_id"] % every == 0).to_numpy()
                levels[part.index[asked]] = floors(x[asked], part["uid"].to_numpy()[asked], known, k)
            yield pd.DataFrame({"uid": f["uid"], "vec_id": f["vec_id"], "v": f["v"], "d": tables, "floor": levels})

    tabled = ship(own).mapInPandas(with_table, "uid long, vec_id long, v array<double>, d array<double>, floor double")
    salt = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tabled.select("uid", "vec_id", "v", "d", salt(n_blocks, 1).alias("b"), others(n_query_blocks).alias("qb")).withColumn("cell", F.col("b") * n_query_blocks + F.col("qb"))
    right = tabled.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "v", "d", "floor", salt(n_query_blocks, 2).alias("qb"), others(n_blocks).alias("b")).withColumn("cell", F.col("b") * n_query_blocks + F.col("qb"))
    # new names: both sides come of one table, and their columns must not be taken for one another
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])

    def meet(x, q):
        out, said = [], []
        x_lengths, q_lengths = x["v"].map(len), q["q_v"].map(len)
        for n in sorted(set(x_lengths) & set(q_lengths)):
            part, asked = x[x_lengths == n], q[q_lengths == n]
            v, table = quantised(part["v"], n), np.stack(part["d"].to_list())
            uids, ids = part["uid"].to_numpy(), part["vec_id"].to_numpy()
            place = {u: i for i, u in enumerate(uids.tolist())}
            for s in range(0, len(asked), GROUP):
                g = asked.iloc[s : s + GROUP]
                mine = np.array([place.get(u, -1) for u in g["q_uid"].tolist()])
                found, seen = search(quantised(g["q_v"], n), np.stack(g["q_d"].to_list()), g["q_floor"].to_numpy(), v, table, ids, mine, k)
                said.append((int(g["q_vec_id"].iloc[0]), len(g), seen))
                out += [(uid, qid, int(ids[at]), sc) for uid, qid, best in zip(g["q_uid"].tolist(), g["q_vec_id"].tolist(), found, strict=True) for sc, at in best]
        if counted:
            return pd.DataFrame(said, columns=["query_id", "queries", "evaluated"]).astype("int64")
        return pd.DataFrame(out, columns=["uid", "query_id", "vec_id", "score"]).astype("int64")

    # a set number of partitions: adaptive execution would join cells by bytes, which say little of their work
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 4 * cores))
    sides = left.repartition(n, "cell").groupBy("cell").cogroup(right.repartition(n, "q_cell").groupBy("q_cell"))
    if counted:
        return sides.applyInPandas(meet, "query_id long, queries long, evaluated long")
    met = sides.applyInPandas(meet, "uid long, query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
