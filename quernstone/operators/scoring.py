"""Scoring: answer metrics, weighted accuracies over many cuts, intervals, agreement, baselines, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import numbers, squeezed, token_set
from .numbering import numbered


def bare(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def legacy_correct(metric: Column, pred: Column, gold: Column, gold_numbers: Column, markers: list[str]) -> Column:
    """M1: a blank prediction fails; else by metric: a marker, all gold numbers as parts, or one text within the other.

    Containment goes both ways, and numbers may be parts of longer ones: both are the scorer's definition."""
    p, g = squeezed(F.lower(pred)), squeezed(F.lower(gold))
    said = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(pred, m))
    numeric = F.forall(gold_numbers, lambda n: F.contains(bare(pred), bare(n)))
    either = F.contains(p, g) | F.contains(g, p)
    return F.when(F.coalesce(p, F.lit("")) == "", False).otherwise(F.when(metric == "abstain", said).when(metric == "number", numeric).otherwise(either))


def listed_ids(lines: DataFrame, column: str = "value", field: str = "id") -> DataFrame:
    """M5: (id: string), each once, of the lines of an ids file: an id a line, or JSON objects with the id in a field, so that a file of predictions
    serves as well. An object without the field is left out; what begins like an object and is none counts as an id. Blank lines are none."""
    line = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    broken = F.try_parse_json(line).isNull()
    ids = F.when(F.startswith(line, F.lit("{")) & ~broken, F.get_json_object(line, f"$.{field}")).otherwise(line)
    return lines.select(ids.alias("id")).filter("id <> ''").distinct()


def subset(gold: DataFrame, key: str, ids: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """M5: the gold rows among the listed ids (`listed_ids`) and, if predictions are given, with one of these. Keys are compared as text."""
    for kept in [x for x in (ids.select(F.col("id").alias("__id")) if ids is not None else None, predictions.select(F.col(key).cast("string").alias("__id")) if predictions is not None else None) if x is not None]:
        gold = gold.join(kept, F.col(key).cast("string") == F.col("__id"), "left_semi")
    return gold


def token_recall(pred: Column, gold: Column) -> Column:
    """M3: the share of the gold's token set that the prediction has; no token: 0."""
    g = token_set(gold)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(g, token_set(pred))), F.size(g)), F.lit(0.0))


def metrics(pred: Column, gold: Column, least: float = 0.6) -> dict[str, Column]:
    """M2: num, em, contains, recall and soft."""
    p, g = squeezed(F.lower(pred)), squeezed(F.lower(gold))
    nums = F.transform(numbers(gold), bare)
    num = (F.size(nums) > 0) & F.forall(nums, lambda n: F.contains(bare(pred), n))
    filled = p != ""
    em, contains = filled & (p == g), filled & (F.contains(p, g) | F.contains(g, p))
    recall = token_recall(pred, gold) >= least
    return {"num": num, "em": em, "contains": contains, "recall": recall, "soft": contains | recall | num}


def answered(gold: DataFrame, preds: DataFrame, key: str, order: str) -> DataFrame:
    """M4: every gold row with its last prediction; none counts as an empty one."""
    last = preds.groupBy(key).agg(F.max_by("prediction", order).alias("prediction"))
    return gold.join(last, key, "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def accuracy(ok: Column, weight: Column | None = None) -> Column:
    """M6: share of right ones; weighted, a missing weight counts 1."""
    hit = ok.cast("double")
    if weight is None:
        return F.avg(hit)
    w = F.coalesce(weight, F.lit(1.0))
    return F.sum(hit * w) / F.sum(w)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """M7: the interval of a share p of n (which may be fractional), in [0, 1]; of nothing: (0, 0)."""
    p, n = F.when(n > 0, p), F.when(n > 0, n)
    middle, root = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - root) / (1 + z * z / n), (middle + root) / (1 + z * z / n)
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(n.isNull(), 0.0).otherwise(F.least(high, F.lit(1.0)))


def shifted(df: DataFrame, order: str, value: str) -> DataFrame:
    """Each row with the value of the row n // 3 (1 at least) further on, in a circle."""
    placed = numbered(df, [order], "__at").withColumn("__at", F.col("__at") - 1).withColumn("__n", df.agg(F.count(F.lit(1))).scalar())
    by = F.greatest(F.floor(F.col("__n") / 3), F.lit(1))
    other = placed.select(F.col("__at").alias("__from"), F.col(value).alias("shifted"))
    return placed.withColumn("__from", F.pmod(F.col("__at") + by, F.col("__n"))).join(other, "__from").drop("__at", "__n", "__from")


def predicted(name: str, df: DataFrame, order: str, question: str, answer: str, dummy: str = "cannot be determined") -> DataFrame:
    """`df` with the prediction of a trivial baseline: oracle (the answer), dummy (one sentence), echo (the question), or random
    (the answers, shifted). An unknown name is an error."""
    match name:
        case "oracle":
            return df.withColumn("prediction", F.col(answer))
        case "dummy":
            return df.withColumn("prediction", F.lit(dummy))
        case "echo":
            return df.withColumn("prediction", F.col(question))
        case "random":
            return shifted(df, order, answer).withColumnRenamed("shifted", "prediction")
    raise ValueError(f"no such baseline: {name}")


def verdicts(raw: DataFrame, line: str) -> DataFrame:
    """M9: (qa_id, judge_correct) from the lines of a judge's output: the answer says YES in any case; no answer says no."""
    body = F.from_json(line, "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>")
    said = F.coalesce(F.get(F.col("b.response.body.choices"), F.lit(0))["message"]["content"], F.lit(""))
    parsed = raw.filter(F.trim(line) != "").select(body.alias("b"))
    return parsed.select(F.split("b.custom_id", "__", 2)[1].alias("qa_id"), F.contains(F.upper(said), F.lit("YES")).alias("judge_correct"))


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table."""
    n = both + only_a + only_b + neither
    seen = (both + neither) / n
    chance = ((both + only_a) * (both + only_b) + (neither + only_a) * (neither + only_b)) / (n * n)
    return (seen - chance) / (1 - chance)
