"""Ranked lexical search over inverted treaps.

Method. Documents are tokenised once, in shards of bounded size; a shard gives a row a term, with its postings. Only rows of terms that some
item asks for go on. Shards are put together to units of about `UNIT_WORDS` words. In a unit each term's postings make a treap:
a search tree by document, a heap by impact (what one occurrence of the term's weight is worth there; equal impacts are heaped by a hash
of the place, so that a treap of equal impacts is not a list). An item's treaps are traversed at once. A range of documents is
known by the root that each treap has within it, and no document of it can score more than the sum of the roots' impacts: ranges
whose sum cannot enter the item's `k` best are left out with all their documents. Of the others the document of the greatest root is scored in
full, and the range is split there. Ranges of the greatest sums come first, `WIDTH` at a time, and a task's later units begin with the k best of
its earlier ones. The k best of the tasks are merged by a window, which takes no more than k rows an item from a task.

Scores. N documents have a term, L terms are in all, n in one, df documents have this term: w = floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles; m = 75 +
(25 n N) div L; a term that occurs tf times adds w * ((10^9 tf) div (1000 tf + 12 m)), as often as the item says it. Integers are of 64 bits.

Size. Nothing is broadcast by hand: terms that are asked for meet the index by joins, which Spark broadcasts only where it has
measured them to be small, and else splits where a term is hot (a row a shard, so its documents are pre-aggregated). Items are asked in blocks of `BLOCK`: a
task holds a unit's postings of one block's terms. Depth of a treap and work of an item are bounded by the unit.

Cases. Null and empty texts have no terms and are not counted in N. Items without terms, or whose terms no document has, give no rows. Null doc_ids
rank as the greatest. Every row of either table is an item or document of its own: repeated items are each answered, repeated
documents each ranked (equal scores by doc_id, then in any order, of the same values). Empty tables give no rows. Other columns are not read."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, doc_key, ship

# Only ASCII letters and digits and all other characters than ASCII are of terms, and A-Z are lower-cased.
TERM_BYTES = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

SHARD_DOCS, SHARD_WORDS = 4096, 2_000_000
UNIT_WORDS = 6_000_000
BLOCK = 256
WIDTH = 512
POSTING = np.dtype([("doc", "<i8"), ("row", "<i8"), ("n", "<i4"), ("tf", "<i4")])
NO_ID = 2**63 - 1
#: A row of this term, which no text has, tells of a shard its documents with a term, and their terms.
SUMS = b""


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return (text or b"").translate(TERM_BYTES).split()


def index(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """shard, term, docs, words, postings: a row for each term of a shard (docs of its documents have it), and one for the shard's sums."""

    def shard(number, ids, rows, words):
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.fromiter((vocabulary[t] for w in words for t in w), np.int64, int(lengths.sum()))
        packed, tf = np.unique(word << 32 | np.repeat(np.arange(len(words)), lengths), return_counts=True)
        place, starts = packed & 0xFFFFFFFF, np.searchsorted(packed >> 32, np.arange(len(vocabulary) + 1))
        postings = np.empty(len(packed), POSTING)
        postings["doc"], postings["row"], postings["n"], postings["tf"] = np.array(ids, np.int64)[place], np.array(rows, np.int64)[place], lengths[place], tf
        raw, names = memoryview(postings.tobytes()), list(vocabulary)
        each = [bytes(raw[s * POSTING.itemsize : e * POSTING.itemsize]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        columns = [[number] * (len(names) + 1), [*names, SUMS], [*np.diff(starts).tolist(), len(ids)], [0] * len(names) + [len(word)], [*each, b""]]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for at in range(0, len(names) + 1, 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8192], t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "term", "docs", "words", "postings"])

    def run(batches):
        ids, rows, words, held = [], [], [], 0
        for b in batches:
            for key, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if found := terms(text.as_py()):
                    ids.append(key)
                    rows.append(row)
                    words.append(found)
                    held += len(found)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_WORDS:
                        yield from shard(rows[0], ids, rows, words)
                        ids, rows, words, held = [], [], [], 0
        if ids:
            yield from shard(rows[0], ids, rows, words)

    # numbers of rows tell shards and equal documents apart; a task that runs again gives its rows anew
    rows = docs.select(doc_key(docs, id_col).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("text"))
    return ship(rows).mapInArrow(run, "shard long, term binary, docs long, words long, postings binary")


def asked_terms(items: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """item (a number of the row), item_id, term, times."""

    def run(batches):
        for b in batches:
            rows = [(i, own, t, n) for i, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for t, n in Counter(terms(text)).items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.int64()], strict=True)], names=["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return ship(rows).mapInArrow(run, "item long, item_id long, term binary, times long")


class Treaps:
    """The treaps of a unit: nodes are postings, sorted by term, then place (the documents' order by id)."""

    def __init__(self, parts: list[np.ndarray], n: int, total: int):
        """parts: the postings of each term; n, total: N and L."""
        sizes = np.array([len(p) for p in parts])
        all_ = np.concatenate(parts) if parts else np.empty(0, POSTING)
        term = np.repeat(np.arange(len(parts)), sizes)
        rows, first, back = np.unique(all_["row"], return_index=True, return_inverse=True)
        by_id = np.lexsort((rows, all_["doc"][first]))
        rank = np.empty(len(rows), np.int64)
        rank[by_id] = np.arange(len(rows))
        self.docs = all_["doc"][first][by_id]
        place = rank[back]
        order = np.lexsort((place, term))
        self.place, tf = place[order], all_["tf"][order].astype(np.int64)
        m = 75 + 25 * all_["n"][order].astype(np.int64) * n // max(total, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        self.key = term << 32 | self.place
        self.scored = 0  # documents that were scored in full
        starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        # equal impacts are heaped by a hash of the place
        mixed = (self.place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        self._link((self.impact << 20 | mixed).tolist(), starts)

    def _link(self, heap: list[int], starts: list[int]) -> None:
        left, right, self.roots = [-1] * len(heap), [-1] * len(heap), []
        for s, e in zip(starts, starts[1:], strict=False):
            path: list[int] = []  # the right edge of the treap so far
            for v in range(s, e):
                h, below = heap[v], -1
                while path and heap[path[-1]] < h:
                    below = path.pop()
                left[v] = below
                if path:
                    right[path[-1]] = v
                path.append(v)
            self.roots.append(path[0] if path else -1)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def _within(self, node, lo, hi):
        """The roots of the treaps below `node` cut to places between lo and hi (both out); -1: nothing is there."""
        node, at = node.copy(), np.arange(len(node))
        while True:
            v = node[at]
            p = self.place[v]
            low, high = p <= lo[at], p >= hi[at]
            out = low | high
            if not out.any():
                return node
            at, v, low = at[out], v[out], low[out]
            node[at] = v = np.where(low, self.right[v], self.left[v])
            at = at[v >= 0]

    def best(self, terms_: np.ndarray, weights: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents of the k best, those `known` included, sorted. terms_: places of terms; weights: what an impact counts."""
        scores, docs = known
        roots = np.array(self.roots, np.int64)[terms_]
        have = roots >= 0
        start = np.flatnonzero(have)
        # ranges (lo, hi), and the entries of each in turn: which of the item's terms, which node
        todo = [(np.array([-1]), np.array([len(self.docs)]), np.array([len(start)]), start, roots[start])] if len(start) else []
        while todo:
            lo, hi, size, term, node = todo.pop()
            owner = np.repeat(np.arange(len(lo)), size)
            gain = weights[term] * self.impact[node]
            bound = np.add.reduceat(gain, np.cumsum(size) - size)
            alive = bound > 0
            if len(scores) >= k:
                alive &= (bound > scores[-1]) | (bound == scores[-1]) & (self.docs[lo + 1] < docs[-1])
            if (n := int(alive.sum())) > WIDTH:
                first = alive & (bound >= np.partition(bound[alive], n - WIDTH)[n - WIDTH])
                rest = alive & ~first
                if rest.any():
                    todo.append((lo[rest], hi[rest], size[rest], term[rest[owner]], node[rest[owner]]))
                alive = first
            if not alive.any():
                continue
            use = alive[owner]
            lo, hi, size, term, node, gain = lo[alive], hi[alive], size[alive], term[use], node[use], gain[use]
            starts = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(lo)), size)
            # the document of the greatest root, scored by all terms of its range
            tops = np.flatnonzero(gain == np.maximum.reduceat(gain, starts)[owner])
            pivot = self.place[node[tops[np.searchsorted(tops, starts)]]]
            wanted = terms_[term] << 32 | pivot[owner]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            score = np.add.reduceat(np.where(self.key[at] == wanted, weights[term] * self.impact[at], 0), starts)
            self.scored += len(pivot)
            enough = score > 0 if len(scores) < k else score >= scores[-1]
            if enough.any():
                s, d = np.concatenate([scores, score[enough]]), np.concatenate([docs, self.docs[pivot[enough]]])
                order = np.lexsort((d, -s))[:k]
                scores, docs = s[order], d[order]
            # both sides of it
            below, above = self._within(node, lo[owner], pivot[owner]), self._within(node, pivot[owner], hi[owner])
            made = [(lo, pivot, below), (pivot, hi, above)]
            lo, hi, nodes = (np.concatenate([m[i] for m in made]) for i in range(3))
            owner, term = np.concatenate([owner, owner + len(pivot)]), np.concatenate([term, term])
            live = nodes >= 0
            size = np.bincount(owner[live], minlength=len(lo))
            if live.any():
                todo.append((lo[size > 0], hi[size > 0], size[size > 0], term[live], nodes[live]))
        return scores, docs


def _search(k: int, n: int, total: int):
    """Answers items from rows sorted by block, then unit: block, unit, term, w, items (item, item_id, times), postings."""

    def answer(found, rows):
        by_term: dict[bytes, list] = {}
        for t, w, items, postings in rows:
            by_term.setdefault(t, [w, items, []])[2].append(np.frombuffer(postings, POSTING))
        treaps = Treaps([np.concatenate(parts) for _, _, parts in by_term.values()], n, total)
        asked: dict[tuple, list] = {}
        for place, (w, items, _) in enumerate(by_term.values()):
            for i in items:
                asked.setdefault((i["item"], i["item_id"]), []).append((place, w * i["times"]))
        for item, pairs in asked.items():
            places, weights = np.array(pairs, np.int64).T
            found[item] = treaps.best(places, weights, k, found.get(item, (np.empty(0, np.int64), np.empty(0, np.int64))))

    def said(found):
        for item, (scores, docs) in found.items():
            m = len(scores)
            columns = [[item[0]] * m, [item[1]] * m, docs, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc", "score"])

    def run(batches):
        at, held, found = None, [], {}
        for b in batches:
            for block, unit, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, unit) != at:
                    if held:
                        answer(found, held)
                    if at and block != at[0]:
                        yield from said(found)
                        found = {}
                    at, held = (block, unit), []
                held.append(row)
        if held:
            answer(found, held)
        yield from said(found)

    return run


def search(items: DataFrame, docs: DataFrame, k=20, item_id="item_id", item_text="text", id_col="doc_id", text_col="text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item that score above 0."""
    asked = checkpointed(asked_terms(items, item_id, item_text))
    wanted = asked.select("term").distinct().union(asked.sparkSession.createDataFrame([(SUMS,)], "term binary"))
    hits = checkpointed(index(docs, id_col, text_col).join(wanted, "term", "left_semi").select("shard", "term", "docs", "words", "postings"))
    n, total = hits.filter(F.col("term") == F.lit(SUMS)).agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    units, blocks = max(1, -(-total // UNIT_WORDS)), max(1, -(-asked.select("item").distinct().count() // BLOCK))
    of = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    df = hits.filter(F.col("term") != F.lit(SUMS)).groupBy("term").agg(F.sum("docs").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    who = asked.groupBy("term", of("item", blocks).alias("block")).agg(F.collect_list(F.struct("item", "item_id", "times")).alias("items"))
    plan = who.join(df, "term").select("term", "block", "items", w.alias("w"))
    rows = hits.join(plan, "term").select("block", of("shard", units).alias("unit"), "term", "w", "items", "postings")
    dealt = rows.repartition("block", "unit").sortWithinPartitions("block", "unit", "term")
    best = dealt.mapInArrow(_search(k, n, total), "item long, item_id long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
