"""Quality rules: surface rules and a hashed n-gram log-likelihood ratio, all in native DataFrame functions.

Method. Word unigrams and bigrams are hashed into `buckets` cells. Two multinomials over the cells are counted: the raw
corpus (every document) and the trusted target (labelled documents of quality 1 that are not toxic). A document's score
is the mean over its n-grams of log(p_target / p_raw), so it does not depend on its length; every document whose score
is under `threshold` is rejected. Raw counts are scaled to the target's size and both get `prior` pseudo-counts a cell: a cell
that the sample is too small to judge has a ratio near 1, and without labels every score is 0: nothing is rejected.

Bounds. The target is fitted on at most `trusted_rows` labelled ids (those of the smallest hash), which are broadcast;
the table of log ratios has `buckets` doubles at any input size. Everything else covers all documents: one pass
counts (partial sums of at most `buckets` rows leave a task), one pass scores, and no text is shuffled.

Cases. Null and empty texts have no word: all counts 0, base_failed true. Repeated rows are scored alike, one by one. An
empty table gives an empty result; no labels, or labels with nulls, give as much of a target as there is. Other columns
of the input are carried under other names until the end, whatever they are called; those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import NOT_BLANK, words

WINDOW = 8


def _joined(hashes: Column, step: int) -> Column:
    """A hash of each two members that lie `step` apart: of h, 1 gives pairs of words; of those, 2 gives windows of four."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(hashes) - step), lambda i: F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + step)))
    return F.when(F.size(hashes) > step, pairs).otherwise(F.array().cast("array<bigint>"))


def _sorted_pairs(grams: Column) -> Column:
    """(window, place) by window, where any window comes twice (a set of longs tells); else empty."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))


def _repeated_starts(pairs: Column) -> Column:
    """The places of windows found twice or more: in sorted pairs, those that equal a neighbour."""
    same = lambda p, other: F.coalesce(p["g"] == F.get(pairs, other)["g"], F.lit(False))
    return F.sort_array(F.array_compact(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))))


def _covered(starts: Column) -> Column:
    """How many words the windows that begin at these places cover together."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """`__h`: a hash of each word, `__p`: a hash of each two adjoining words, of the column `__words`."""
    return docs.select(*keep, F.transform("__words", lambda w: F.xxhash64(w)).alias("__h")).select(*keep, "__h", _joined(F.col("__h"), 1).alias("__p"))


def _counts(docs: DataFrame, text_col: str, buckets: int, name: str) -> DataFrame:
    grams = _hashed(docs.select(words(text_col).alias("__words"))).select(F.explode(F.concat("__h", "__p")).alias("__gram"))
    return grams.groupBy(F.pmod("__gram", F.lit(buckets)).cast("int").alias("__cell")).agg(F.count(F.lit(1)).alias(name))


def _fenced(value: Column) -> Column:
    """The value, so that no filter on it is moved below: there, its arrays would be made anew for each of their members."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def log_ratios(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", buckets=1 << 16, trusted_rows=20_000, prior=5.0) -> DataFrame:
    """One row, `ratios`: array<double> with log(p_target / p_raw) of each cell. Counts cover all documents."""
    trusted = (
        labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__trusted"))
        .distinct()
        .orderBy(F.xxhash64("__trusted"), "__trusted")
        .limit(trusted_rows)
    )
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    raw = _counts(own, "__text", buckets, "raw")
    target = _counts(own.join(F.broadcast(trusted), F.col("__id") == F.col("__trusted"), "left_semi"), "__text", buckets, "target")
    # the cells are a fixed range: every one gets a row, so that position and cell agree
    cells = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("__cell"))
    full = cells.join(raw, "__cell", "left").join(target, "__cell", "left").na.fill(0)
    gathered = full.agg(
        F.sort_array(F.collect_list(F.struct("__cell", F.col("raw"), F.col("target")))).alias("c"),
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
    )
    # the raw counts at the target's size, then as many pseudo-counts for both: two multinomials of the same weight
    scaled = lambda x: x["raw"] * F.col("n_target") / F.greatest(F.col("n_raw"), F.lit(1))
    return gathered.select(F.transform("c", lambda x: F.log((x["target"] + prior) / (scaled(x) + prior))).alias("ratios"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", buckets=1 << 16, trusted_rows=20_000, prior=5.0, threshold=-0.2) -> DataFrame:
    """All columns of `docs`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    carried = {f"__c{i}": c for i, c in enumerate(c for c in docs.columns if c not in own)}
    rest = list(carried)  # under other names, none of which can be taken for one of these
    ratios = log_ratios(docs, labels, id_col, text_col, buckets, trusted_rows, prior)
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_BLANK))
    step = docs.select(*[docs[f"`{c}`"].alias(n) for n, c in carried.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__text"), words(text_col).alias("__words"))
    step = step.withColumn("__lines", lines).select(
        *rest,
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    plain = [*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    step = _hashed(step, *plain).withColumn("__four", _joined(F.col("__p"), 2)).withColumn("__g", _joined(F.col("__four"), 4))
    step = step.withColumn("__pairs", _sorted_pairs(F.col("__g")))
    # the ratios are one row of `buckets` doubles: a scalar subquery, evaluated once
    step = step.withColumns({"__starts": _repeated_starts(F.col("__pairs")), "__ratios": ratios.scalar()})
    add = lambda a, x: a + F.get("__ratios", F.pmod(x, F.lit(buckets)).cast("int"))
    total = F.aggregate("__h", F.lit(0.0), add) + F.aggregate("__p", F.lit(0.0), add)
    step = step.select(
        *plain,
        _fenced(_covered(F.col("__starts"))).alias("n_repeat_words"),
        _fenced(F.when(F.size("__h") > 0, total / (F.size("__h") + F.size("__p"))).otherwise(F.lit(0.0))).alias("llr"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    return step.select(*[F.col(n).alias(c) for n, c in carried.items()], *own)
