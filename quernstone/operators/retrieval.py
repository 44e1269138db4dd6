"""Retrieval: pages and chunks, BM25, dense similarity, rank fusion, diversity, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.text import quotes, squeezed, tokens
from .numbering import checkpointed


def split_pages(docs: DataFrame, mark: str, id_col="doc_id", text_col="text") -> DataFrame:
    """What follows each marker, with the marker's page number; no marker: one page 0; blank pages are none."""
    parts = F.split(text_col, mark)
    pages = docs.select(id_col, F.posexplode(parts).alias("page_no", "page_text"))
    return pages.filter(F.regexp_replace("page_text", r"\s+", "") != "")


def chunks(text: Column, most: int = 1200) -> Column:
    """Lines packed in order to chunks of `most` characters; a longer line stays whole; blank chunks are dropped.

    Where a chunk begins depends on the chunk before: a fold over one text's lines, inside the row."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(False).alias("any"))

    def step(a, line):
        full = a["any"] & (F.length(a["held"]) + F.length(line) + 1 > most)
        done = F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])
        held = F.when(full | ~a["any"], line).otherwise(F.concat(a["held"], F.lit("\n"), line))
        return F.struct(done.alias("done"), held.alias("held"), F.lit(True).alias("any"))

    packed = F.aggregate(F.split(text, "\n"), begin, step, lambda a: F.concat(a["done"], F.array(a["held"])))
    return F.filter(F.transform(packed, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf, dl): one explode and one aggregate; dl counts a text's tokens, pairs included."""
    words = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("__t"))
    terms = words.select("doc", F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    return terms.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k1=1.5, b=0.75) -> DataFrame:
    """(query, doc, score) of each pair that shares a term; score has 6 decimals. By units of documents, as `bm25_top`: a task holds
    a unit's postings and scores, whatever the number of documents."""
    return _searched(queries, docs, query_id, query_text, id_col, text_col, None, k1, b, UNIT_DOCS // 4)


#: Rows of a narrow table that a join broadcasts at most: a set number, whatever the size of the tables; more are shuffled, as what they meet is.
FEW = 1 << 17


def narrow(df: DataFrame) -> DataFrame:
    """`df`, checkpointed, to be broadcast if it has `FEW` rows at most: then all tokens, marks or texts of a table stay where they are read."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= FEW else df


#: Documents of a unit, which one task searches, and of a block; blocks that are scored at once.
UNIT_DOCS, BLOCK_DOCS, FIRST_BLOCKS = 8192, 16, 32
#: Stands beside the tokens of every text, so that one pass over the texts gives their number and lengths, too; no text has it.
EVERY = ""


def bm25_top(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k: int, k1=1.5, b=0.75, unit=UNIT_DOCS) -> DataFrame:
    """(query, doc, score) of `bm25` for the documents that can be among a query's k best, by a block-max index.

    Texts are tokenised once; postings of asked terms, with their parts of a score, are dealt by document to units. A unit meets all queries, a
    stated set, in a cogroup, and gives its k best documents of each (more where scores are equal): pairs of a query and a document are no rows."""
    return _searched(queries, docs, query_id, query_text, id_col, text_col, k, k1, b, unit)


def _searched(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k: int | None, k1: float, b: float, unit: int) -> DataFrame:
    """Scores of the k best documents of each unit (None: of all that share a term)."""
    asked = checkpointed(queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")))
    spark, terms = asked.sparkSession, asked.select("term").distinct()
    split = docs.select(F.col(id_col).alias("doc"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("__t"))
    each = split.select("doc", F.size("__t").alias("dl"), F.explode(F.concat("__t", F.array(F.lit(EVERY)))).alias("term"))
    wanted = each.join(narrow(terms.union(spark.createDataFrame([(EVERY,)], "term string"))), "term", "left_semi")
    wanted = checkpointed(wanted.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    n, words = wanted.filter(F.col("term") == EVERY).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    found = wanted.filter(F.col("term") != EVERY)
    df = checkpointed(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("number", F.monotonically_increasing_id()))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(words / n if words else 1.0)))
    units = max(-(-n // unit), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    postings = found.join(df, "term").select(F.pmod(F.xxhash64("doc"), F.lit(units)).alias("unit"), "doc", F.col("number").alias("term"), part.alias("part"))
    every = asked.join(df, "term").select("query", F.col("number").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit"))
    schema = T.StructType([asked.schema["query"], found.schema["doc"], T.StructField("score", T.DoubleType())])
    best = postings.groupBy("unit").cogroup(every.groupBy("unit")).applyInArrow(_block_max(k), schema)
    return best.withColumn("score", F.round("score", 6))


class BlockMax:
    """Postings of a unit (doc: 0 to n - 1, term, part), in blocks of documents; a block has each term's greatest part."""

    def __init__(self, doc, term, part, block: int = BLOCK_DOCS):
        import numpy as np

        _, term_at, df = np.unique(term, return_inverse=True, return_counts=True)
        # documents that share their commonest term (mostly a language), and are of like weight, lie together
        by_df = np.lexsort((df[term_at], doc))
        last = np.flatnonzero(np.diff(doc[by_df], append=-1))
        self.docs = np.lexsort((np.bincount(doc, part), term_at[by_df][last]))
        place = np.empty_like(self.docs)
        place[self.docs] = np.arange(len(self.docs))
        order = np.lexsort((place[doc], term))
        self.place, self.part, term = place[doc][order], part[order], term[order]
        at = self.place // block
        self.starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        self.ends = np.append(self.starts[1:], len(term))
        self.most, self.block, self.term = np.maximum.reduceat(self.part, self.starts), at[self.starts], term[self.starts]
        self.blocks, self.scored = -(-len(self.docs) // block), 0

    def every(self, terms):
        """Places of all documents that have a term, and their scores."""
        import numpy as np

        rows = [np.arange(self.starts[s], self.ends[e - 1]) for s, e in zip(np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right"), strict=True) if e > s]
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        score = np.bincount(self.place[rows], self.part[rows], len(self.docs))
        found = np.flatnonzero(score > 0)
        return found, score[found]

    def best(self, terms, k: int, first: int = FIRST_BLOCKS):
        """Places of documents and their scores: all of the k best by rounded scores, and perhaps more."""
        import numpy as np

        spans = [np.arange(s, e) for s, e in zip(np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right"), strict=True)]
        rows = np.concatenate(spans) if spans else np.empty(0, np.int64)
        bound = np.bincount(self.block[rows], self.most[rows], self.blocks)

        def scores(chosen):
            use = rows[chosen[self.block[rows]]]
            sizes = self.ends[use] - self.starts[use]
            at = np.repeat(self.starts[use] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            made = np.bincount(self.place[at], self.part[at], len(self.docs))
            self.scored += int((made > 0).sum())
            return made

        begun = np.zeros(self.blocks, bool)
        begun[np.argsort(-bound, kind="stable")[:first]] = True
        score = scores(begun)
        least = lambda: np.partition(score, -k)[-k] if len(score) >= k else 0.0
        # a bound that rounds to the k-th best score reaches it
        score = score + scores(~begun & (bound > 0) & (bound >= least() - 1e-6))
        found = np.flatnonzero((score > 0) & (score >= least() - 1e-6))
        return found, score[found]


def _block_max(k: int | None):
    def run(postings, asked):
        import numpy as np
        import pyarrow as pa

        doc, query = (t[c].combine_chunks().dictionary_encode() for t, c in ((postings, "doc"), (asked, "query")))
        if not len(doc) or not len(query):
            return pa.table([query.dictionary.slice(0, 0), doc.dictionary.slice(0, 0), pa.array([], pa.float64())], names=["query", "doc", "score"])
        index = BlockMax(doc.indices.to_numpy(), postings["term"].to_numpy(), postings["part"].to_numpy())
        of, term = query.indices.to_numpy(), asked["term"].to_numpy()
        order = np.argsort(of, kind="stable")
        queries, docs, scores = [], [], []
        for q, terms in enumerate(np.split(term[order], np.flatnonzero(np.diff(of[order])) + 1)):
            at, score = index.best(terms, k) if k else index.every(terms)
            queries.append(np.full(len(at), of[order[0]] + q))
            docs.append(index.docs[at])
            scores.append(score)
        return pa.table([query.dictionary.take(pa.array(np.concatenate(queries))), doc.dictionary.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=["query", "doc", "score"])

    return run


def ranked(scores: DataFrame, k: int, doc="doc", query="query") -> DataFrame:
    """The k best of each query, ties by document; only k of a task's rows leave it."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    """Documents without a score fill a top k up, in document order: no more than k a query can be needed."""
    first = docs.select(F.col(id_col).alias("doc")).orderBy("doc").limit(k * 2)
    asked = queries.select(F.col(query_id).alias("query"))
    # k * 2 rows beside the queries: the first documents in order that a query may lack
    fill = asked.withColumn("__one", F.lit(1)).join(F.broadcast(first.withColumn("__one", F.lit(1))), "__one").drop("__one")
    missing = fill.join(scores.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return scores.unionByName(missing)


def dot(a: Column, b: Column) -> Column:
    """The dot product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


#: Queries that a task holds at once, rows of a part, and pairs that are scored at once.
QUERY_BLOCK, PART_ROWS, TILE = 8192, 16384, 1 << 20


def similarities(queries: DataFrame, docs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, doc, score) of every query (query, q) with every other row (doc, v): a stated set against all rows, in blocks."""
    return _scored(queries, docs, None, block)


def nearest(queries: DataFrame, docs: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Of `similarities` the rows that can be among a query's k best by rounded scores: about k of a batch of rows leave a task."""
    return _scored(queries, docs, k, block)


def _scored(queries: DataFrame, docs: DataFrame, k: int | None, block: int) -> DataFrame:
    """Each part of the rows streams past each block of the queries, in tiles of pairs; a task holds a block of queries, a batch of rows and a tile.

    Products are summed in the vectors' order. Vectors that are null, of another length, or hold null or non-finite numbers meet the others one by one."""
    spark = docs.sparkSession
    fine = lambda c, n: F.coalesce((F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    n_rows, size = docs.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = max(size or 0, 1)
    n_queries, odd_queries = queries.agg(F.count(F.lit(1)), F.count_if(~fine("q", size))).first()
    parts, blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS)), max(1, -(-n_queries // block))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.filter(fine("q", size)).select(of("query", blocks).alias("b"), every(parts).alias("p"), F.lit(0).alias("kind"), F.col("query").alias("id"), F.col("q").cast("array<double>").alias("v"))
    right = docs.filter(fine("v", size)).select(every(blocks).alias("b"), of("doc", parts).alias("p"), F.lit(1).alias("kind"), F.col("doc").alias("id"), F.col("v").cast("array<double>").alias("v"))
    met = left.union(right).repartition(parts, "p", "b").sortWithinPartitions("p", "b", "kind")
    schema = T.StructType([T.StructField("query", met.schema["id"].dataType), T.StructField("doc", met.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    made = met.mapInArrow(_tiles(size, k), schema).select(F.col("query").cast(queries.schema["query"].dataType).alias("query"), F.col("doc").cast(docs.schema["doc"].dataType).alias("doc"), F.round("score", 6).alias("score"))
    plain = lambda a, z: a.join(z, F.col("query") != F.col("doc")).select("query", "doc", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
    if odd_queries:
        made = made.union(plain(queries.filter(~fine("q", size)), docs))
    if docs.filter(~fine("v", size)).limit(1).count():
        made = made.union(plain(queries.filter(fine("q", size)), docs.filter(~fine("v", size))))
    return made


def _tiles(size: int, k: int | None):
    """Scores of pairs from rows (b, p, kind, id, v): of a block the queries (kind 0) first, then the rows; k: only those that can be the k best."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, held = None, []

        def exact(q, v):
            out = np.zeros(np.broadcast_shapes(q.shape[:-1], v.shape[:-1]))
            for j in range(size):
                out += q[..., j] * v[..., j]
            return out

        def pairs(ids, vectors):
            asked, q = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            slack = 1e-6 + 1e-13 * size * np.linalg.norm(q, axis=1).max() * np.linalg.norm(vectors, axis=1).max()
            step = max(1, TILE // len(ids))
            for s in range(0, len(asked), step):
                of, some = asked[s : s + step], q[s : s + step]
                other = of[:, None] != ids
                if k is None or len(ids) <= k + 1:
                    x, y = np.nonzero(other)
                    score = exact(some[:, None], vectors[None])[other]
                else:
                    near = np.where(other, some @ vectors.T, -np.inf)
                    x, y = np.nonzero(other & (near >= np.partition(near, -k, axis=1)[:, -k][:, None] - slack))
                    score = exact(some[x], vectors[y])
                yield pa.RecordBatch.from_arrays([pa.array(of[x]), pa.array(ids[y]), pa.array(score)], names=["query", "doc", "score"])

        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("p", "b", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1), b.num_rows] if b.num_rows else []
            for start, end in zip(cuts, cuts[1:]):
                p, block, kind = marks[:, start]
                if (p, block) != at:
                    at, held = (p, block), []
                ids, v = b.column("id").slice(start, end - start).to_numpy(), b.column("v").slice(start, end - start).flatten().to_numpy().reshape(-1, size)
                if not kind:
                    held.append((ids, v))
                elif held:
                    yield from pairs(ids, v)

    return run


#: Bytes of a gram, and grams of a window: a term that fills a window has marks, a shorter one is a gram of its own length.
GRAM, WINDOW = 8, 16


def containing(terms: DataFrame, docs: DataFrame, term_id: str, term: str, id_col: str, text_col: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(query, doc) of each term and each text that holds it, character by character; null and empty terms are held by none.

    Of each window of neighbouring grams in a text the least hash is a mark. A text that holds a term has the term's windows and so its marks:
    marks meet by hash, and of a term's marks the one that fewest texts have gives the candidates, which are looked through. Terms shorter than a
    window are looked up among all grams of their length. Texts are read once for the marks, whatever the number of terms, and candidates once
    more; only the lengths of short terms (fewer than a window has bytes) reach the driver."""
    asked = terms.select(F.col(term_id).alias("query"), F.col(term).alias("term")).filter(F.length("term") > 0)
    each = asked.select("term").distinct()
    n_bytes, whole = F.octet_length("term"), gram + window - 1
    short = sorted(r[0] for r in each.filter(n_bytes < whole).select(n_bytes).distinct().collect())
    of_term = checkpointed(each.mapInArrow(_marks(gram, window, None), "key string, h long").withColumnRenamed("key", "term"))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("copy", T.LongType()), T.StructField("h", T.LongType())])
    hits = checkpointed(rows.mapInArrow(_marks(gram, window, short), schema).join(narrow(of_term.select("h").distinct()), "h", "left_semi"))
    seen = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_term.join(seen, "h", "left").groupBy("term").agg(F.min_by("h", F.struct(F.coalesce("n", F.lit(0)), "h")).alias("h"))
    # copies of a row are one candidate, and meet all of their rows below
    pairs = checkpointed(hits.join(rarest, "h").select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), "term").distinct())
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("copy") == F.col("__copy"))
    looked = rows.join(narrow(pairs.select("__doc", "__copy").distinct()), same, "left_semi")
    held = looked.join(pairs, same).filter(F.contains("text", "term"))
    return held.select("doc", "term").join(asked, "term").select("query", "doc")


def _marks(gram: int, window: int, lengths: list[int] | None, most: int = 65536):
    """In batches of about `most` rows, from columns of which the last is text: the others, or the text itself if there is none, and the hashes of its different marks. lengths: of
    the short terms that texts are looked through for; None: the texts are the terms."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def grams(raw, n):
            x = np.frombuffer(raw, np.uint8).astype(np.uint64)
            h = np.full(max(0, len(x) - n + 1), n, np.uint64)
            for i in range(n):
                h = (h ^ x[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return h

        def least(h):
            """The least of each `window` neighbours, by doubling."""
            n = 1
            while n < window:
                step = min(n, window - n)
                h, n = np.minimum(h[:-step], h[step:]), n + step
            # runs of one mark are one
            return np.unique(h[np.append(True, h[1:] != h[:-1])])

        for b in batches:
            keys = list(b.columns[:-1]) or [b.columns[-1]]
            names = [*b.schema.names[:-1], "h"] if len(b.columns) > 1 else ["key", "h"]
            rows, made, held = [], [], 0

            def told():
                at = pa.array(np.concatenate(rows))  # noqa: B023
                return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(np.concatenate(made))], names=names)  # noqa: B023

            for row, text in enumerate(b.columns[-1]):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own = lengths if lengths is not None else [len(raw)] if len(raw) < gram + window - 1 else []
                marks = [np.unique(grams(raw, n)) for n in own]
                if len(raw) >= gram + window - 1:
                    marks.append(least(grams(raw, gram)))
                marks = np.unique(np.concatenate(marks)).view(np.int64) if marks else np.empty(0, np.int64)
                rows.append(np.full(len(marks), row, np.int32))
                made.append(marks)
                held += len(marks)
                if held >= most:
                    yield told()
                    rows, made, held = [], [], 0
            if rows:
                yield told()

    return run


def retrieve(retriever: str, rankings: dict[str, DataFrame], k: int, page: str | None = None, most: int = 0) -> DataFrame:
    """(query, doc) of what a retriever picks: bm25 or dense (rankings: query, doc, rank), hybrid (both fused), each with at most so
    many of a page; or oracle, all of its ranking. An unknown name is an error."""
    match retriever:
        case "oracle":
            return rankings["oracle"].select("query", "doc")
        case "bm25" | "dense":
            full = rankings[retriever]
        case "hybrid":
            both = fused([rankings["bm25"], rankings["dense"]])
            full = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")).cast("long"))
            full = full.join(rankings["pages"], "doc") if page and most > 0 else full
        case _:
            raise ValueError(f"no such retriever: {retriever}")
    picked = diverse(full, page, most) if page else full
    return picked.filter(F.col("rank") <= k).select("query", "doc")


def diagnosed(ranking: DataFrame, gold: DataFrame, pages: DataFrame, ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """By k, how many queries have a gold document among the first k, and the mean number of tokens there; and in one row: queries,
    queries with a gold document in the ranking, the least, upper median and greatest of its ranks, and the mean number of
    repeated pages among the first five. pages: doc, page, tokens; queries: those of gold."""
    asked = gold.select("query").distinct()
    best = gold.join(ranking.select("query", "doc", "rank"), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("best"))
    listed = ranking.join(asked, "query", "left_semi").join(pages, "doc")
    sums = [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("tokens"))), F.lit(0)).alias(f"t{k}") for k in ks]
    top5 = F.col("rank") <= 5
    each = listed.groupBy("query").agg(*sums, (F.count_if(top5) - F.countDistinct(F.when(top5, F.col("page")))).alias("dup5"))
    rows = best.join(each, "query", "left").na.fill(0, ["dup5", *(f"t{k}" for k in ks)])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("tokens")) for k in ks])).alias("x")
    by_k = rows.select("best", at).groupBy(F.col("x.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("best") <= F.col("x.k"), 1.0).otherwise(0.0)), 6).alias("hit"), F.round(F.avg("x.tokens"), 6).alias("mean_tokens")
    )
    # the upper median of ranks from their counts, of which there are no more than ranks
    counts = rows.filter("best IS NOT NULL").groupBy("best").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("best"))).withColumn("all", F.sum("c").over(Window.partitionBy(F.lit(0))))
    ranks = upto.agg(F.min("best").alias("rank_min"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("best"))).alias("rank_median"), F.max("best").alias("rank_max"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count("best").alias("found"), F.round(F.avg("dup5"), 6).alias("mean_dup5"))
    return by_k, whole.crossJoin(ranks)  # one row each


def fused(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal ranks summed over rankings (query, doc, rank)."""
    every = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    return every.groupBy("query", "doc").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))


def diverse(ranking: DataFrame, page: str, most: int) -> DataFrame:
    """At most so many of a page in rank order (0 or less: all), ranked anew."""
    if most <= 0:
        return ranking
    seen = ranking.withColumn("__n", F.row_number().over(Window.partitionBy("query", page).orderBy("rank"))).filter(F.col("__n") <= most).drop("__n")
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long"))


def recall(found: Column, gold: Column) -> Column:
    """The share of gold pages that were found; no gold: null."""
    return F.try_divide(F.size(F.array_intersect(found, gold)), F.size(F.array_distinct(gold)))


def multi_cut(rows: DataFrame, cuts: list[str], measures: list[Column]) -> DataFrame:
    """Measures over all rows and over each of the cuts, in one pass: (cut, value, measures)."""
    named = rows.select("*", F.explode(F.array(F.struct(F.lit("ALL").alias("cut"), F.lit("ALL").alias("value")), *[F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("value")) for c in cuts])).alias("__c"))
    return named.groupBy(F.col("__c.cut").alias("cut"), F.col("__c.value").alias("value")).agg(*measures)


def hashed_words(dimensions: int = 64):
    """A local model: words hashed to signed places, of unit length; texts without words are zero."""
    import numpy as np
    import xxhash

    def model(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                row[h % dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return model


def embedded(df: DataFrame, id_col: str, text_col: str, provider, batch: int = 256) -> DataFrame:
    """(id, embedding): texts go to the model in batches; provider() makes it, once a task. Null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        model = None
        for b in batches:
            for start in range(0, b.num_rows, batch):
                model = model or provider()
                part = b.slice(start, batch)
                made = model([t.as_py() or "" for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def non_quote_slice(items: DataFrame, bundles: DataFrame, item: str, question: str, pages: str, bundle: str, text: str, have: str, style: str, styles: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(slice, missing): the first `most` items of the given styles whose bundle has one of their pages and none of the spans they quote;
    and the bundles that items of those styles name but that are not there, with how many items go for it: a slice without them is not whole.

    Items without a bundle or pages take no part. Only items with quotes meet their bundle's text."""
    fit = items.filter(F.col(style).isin(styles) & F.col(bundle).isNotNull() & (F.size(pages) > 0)).withColumn("__q", F.array_distinct(quotes(F.col(question))))
    missing = fit.join(bundles.select(bundle), bundle, "left_anti").groupBy(bundle).agg(F.count(F.lit(1)).alias("n_items"))
    met = fit.join(bundles.select(bundle, F.col(have).alias("__have")), bundle).filter(F.arrays_overlap(pages, "__have")).drop("__have")
    spans = met.select(item, bundle, F.explode("__q").alias("__span"))
    quoting = spans.join(bundles.select(bundle, squeezed(F.col(text)).alias("__text")), bundle).filter(F.contains("__text", F.col("__span"))).select(item).distinct()
    return met.join(quoting, item, "left_anti").drop("__q").orderBy(item).limit(most), missing
