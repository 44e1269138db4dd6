"""Line dedup by a log-template tree.

Method. A line's tokens are its words, those that hold a digit generalised to a variable. The tree has a fixed depth: the
token count, then the first `leading` tokens, then the other tokens in up to `RUNS` runs of neighbours (a run is a token, where
there are as few). At up to two runs (one in lines of 6 or 7 tokens, or with variables, none if these are over a sixth of the tokens) a line
may also take the variable branch, so each line stands in every template that generalises that many of its runs: lines have a
template in common if token count and leading tokens agree and no more runs differ than may vary. At least two thirds of a template
are fixed. Lines of fewer than `min_tokens` tokens, or with variables for more than a third, have one template: the line itself.

A template that recurs is dropped from all documents but the one of the smallest id, so that what recurs stays once. When it recurs depends
on how much of it is fixed. Two documents are enough for equal lines, for lines that differ only in variables that are a sixth of their tokens
or fewer, and for generalised runs in lines of `SURE` tokens or more with as few variables (20 of which, or more, are equal).
Any other template needs `support` documents, counted as the different smallest ids of its different lines: two facts told in
the same words are no template. So a line goes if a document of a smaller id has a line of the same template, and the template recurs.

Which templates a line has depends on the line alone, and whether one recurs on counts of ids, so the result depends neither on the order nor on
the dealing of lines, and no leaf is ever gathered.

Size. Lines travel as hashes (a leaf and up to `RUNS` fields of 64 bits), never as text. Leaves of one document are set aside; only
the different lines of the others take their (up to 17) paths, which are summed before they are shuffled. Keys that many lines
share are salted (`common.meet`). Texts are shuffled once, to meet the numbers of their dropped lines, which are no more
than their lines.

Cases. Null texts stay null, empty ones empty. Lines without words stay. Rows of the same id are one document and keep each
other's lines; null ids count as the greatest id and as one document. A document whose every line is dropped keeps an empty text
(the pipeline leaves it out). Equal rows have equal results. An empty table gives no rows. All columns are carried, whatever
their names; the input's own n_lines and n_dropped are replaced."""

from __future__ import annotations

import re
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, doc_key, meet, ship

RUNS = 6
SURE = 30
SUPPORT = 5
DIGIT = re.compile(rb"[0-9]")
VARIABLE = b"<*>"
WHOLE = -1  # the mask of a template that is the line itself


def fields(line: bytes, leading: int, min_tokens: int) -> tuple[int, list[int], int | None] | None:
    """(leaf, fields, whole) of a line, or None for one without words. The last two bits of a leaf say how many fields may vary, the one
    before them whether the line has `SURE` tokens. whole tells lines of the same fields apart, where these leave out too much."""
    tokens = line.split()
    if not tokens:
        return None

    def digest(t: bytes) -> int:
        return xxhash.xxh64_intdigest(t) >> 1

    n, free, whole = len(tokens), 0, None
    masked = [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens
    variables = masked.count(VARIABLE) if masked is not tokens else 0
    if n < max(min_tokens, leading + 2) or 3 * variables > n:
        head, found = tokens, [digest(b" ".join(tokens))]
    else:
        head, rest = masked[:leading], masked[leading:]
        few = 6 * variables <= n
        free = few + (n >= 8 and not variables)
        m = len(rest)
        # in lines of the same length the runs are the same
        found = [digest(t) for t in rest] if m <= RUNS else [digest(b" ".join(rest[m * i // RUNS : m * (i + 1) // RUNS])) for i in range(RUNS)]
        if not few:
            whole = digest(b" ".join(tokens))
    leaf = xxhash.xxh64_intdigest(b" ".join([b"%d" % n, *head]))
    return leaf >> 4 << 3 | (n >= SURE) << 2 | free, found, whole


def hashed_lines(docs: DataFrame, leading=4, min_tokens=6, id_col="doc_id", text_col="text") -> DataFrame:
    """key (the id), uid (of the text), number, leaf, fields and whole of each line with a word."""
    line = pa.list_(pa.struct([("number", pa.int32()), ("leaf", pa.int64()), ("fields", pa.list_(pa.int64())), ("whole", pa.int64())]))

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                made = []
                for t in part.column(2):
                    found = []
                    for number, raw in enumerate((t.as_py() or "").encode().split(b"\n")):
                        f = fields(raw, leading, min_tokens)
                        if f:
                            found.append({"number": number, "leaf": f[0], "fields": f[1], "whole": f[2]})
                    made.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, line)], names=["key", "uid", "lines"])

    rows = docs.select(doc_key(docs, id_col).alias("key"), F.xxhash64(text_col).alias("uid"), F.col(text_col).alias("text"))
    made = ship(rows).mapInArrow(run, "key long, uid long, lines array<struct<number: int, leaf: long, fields: array<long>, whole: long>>")
    return made.select("key", "uid", F.inline("lines"))


def _paths(lines: DataFrame) -> DataFrame:
    """`lines`, with a row for each template of theirs: path, a hash of what does not vary in it, and two, whether two documents are enough."""
    masks = lambda r, free: F.array(*[F.lit(sum(1 << i for i in c)) for c in combinations(range(r), min(r, free))])
    upto = lambda r, free: F.concat(*[masks(r, k) for k in range(free + 1)])
    free, size = F.col("leaf").bitwiseAND(F.lit(3)), F.size("fields")
    every: Column = F.array(F.lit(0))
    for r in range(2, RUNS + 1):
        every = F.when((free == 1) & (size == r), upto(r, 1)).when((free == 2) & (size == r), upto(r, 2)).otherwise(every)
    told = F.col("whole").isNotNull()
    each = lines.select("*", F.explode(F.when(told, F.concat(F.array(F.lit(WHOLE)), every)).otherwise(every)).alias("__mask"))
    mask = F.col("__mask")
    fixed = [F.when(mask.bitwiseAND(F.lit(1 << i)) == 0, F.get("fields", F.lit(i))) for i in range(RUNS)]
    sure = (mask == 0) | (F.col("leaf").bitwiseAND(F.lit(4)) != 0)
    two = (mask == WHOLE) | (~told & sure)
    return each.withColumns({"path": F.xxhash64("__mask", *fixed, F.when(mask == WHOLE, F.col("whole")), two), "two": two}).drop("__mask")


def dropped_lines(docs: DataFrame, leading=4, min_tokens=6, id_col="doc_id", text_col="text", wide=1024, support=SUPPORT) -> DataFrame:
    """key, uid, dropped: the numbers of each document's lines that go, for documents that have some."""
    lines = checkpointed(hashed_lines(docs, leading, min_tokens, id_col, text_col))
    line = ["leaf", "fields", "whole"]
    span = [F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")]
    leaves = checkpointed(lines.groupBy("leaf").agg(*span).filter("first < last").select("leaf", "n"))
    shared = checkpointed(meet(lines, leaves, ["leaf"], "n", ["key", "uid", "number"], wide))
    # a line is named by what tells it apart; `whole` is null where its fields do
    distinct = checkpointed(shared.groupBy(*line).agg(*span).withColumn("name", F.xxhash64("fields", "whole")))
    by_first = _paths(distinct.drop("n", "name")).groupBy("leaf", "path", "two", "first").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n"))
    paths = by_first.groupBy("leaf", "path", "two").agg(F.min("first").alias("owner"), F.max("last").alias("last"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    recurs = F.col("two") | (F.col("documents") >= support)
    paths = checkpointed(paths.filter((F.col("owner") < F.col("last")) & recurs).select("leaf", "path", "owner", "n"))
    owned = meet(_paths(distinct.select(*line, "name", "last", F.col("n").alias("rows"))), paths, ["leaf", "path"], "n", ["fields"], wide)
    owners = owned.groupBy("leaf", "name").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.max("rows").alias("n"))
    owners = checkpointed(owners.filter("owner < last").select("leaf", "name", "owner", "n"))
    named = shared.select("key", "uid", "number", "leaf", F.xxhash64("fields", "whole").alias("name"))
    gone = meet(named, owners, ["leaf", "name"], "n", ["key", "uid", "number"], wide).filter("owner < key")
    return gone.groupBy("key", "uid").agg(F.sort_array(F.collect_set("number")).alias("dropped"))


def drop_recurring(docs: DataFrame, leading=4, min_tokens=6, id_col="doc_id", text_col="text", wide=1024, support=SUPPORT) -> DataFrame:
    """`docs` with its texts without recurring lines, and n_lines, n_dropped."""
    gone = dropped_lines(docs, leading, min_tokens, id_col, text_col, wide, support).select(F.col("key").alias("__key"), F.col("uid").alias("__uid"), F.col("dropped").alias("__dropped"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row is packed: no column of it can be taken for one of these
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), doc_key(docs, id_col).alias("key"), F.xxhash64(text_col).alias("uid"))
    joined = packed.join(gone, (F.col("key") == F.col("__key")) & (F.col("uid") == F.col("__uid")), "left")
    # split after the join: a text is shuffled once, not beside its lines
    joined = joined.select("row", "__dropped", F.split(F.col("row")[text_col], "\n").alias("lines"))
    # sets of numbers, so that a long document costs its lines and not their square
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("__dropped"))
    text = F.when(F.col("__dropped").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *[(text if c == text_col else F.col("row")[c]).alias(c) for c in keep],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
