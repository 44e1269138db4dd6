"""Assembly: public projections, keep-first unions, prompts, batch requests, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .generate import keep_first
from .numbering import numbered


def public(df: DataFrame, allowed: list[str]) -> Column:
    """A1: the allowed columns as JSON, without nulls, empty strings and empty arrays."""
    def shown(name, kind):
        if kind == "string":
            return F.nullif(F.col(name), F.lit(""))
        return F.when(F.size(name) > 0, F.col(name)) if kind.startswith("array") else F.col(name)

    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*[shown(c, kinds[c]).alias(c) for c in allowed]), {"ignoreNullFields": "true"})


def united(sources: list[tuple[str, DataFrame]], key: str, order: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """A2: (kept, dropped): rows of ranked sources, the first of each key with sequential numbers (qa_no) and ids; the rest with their source."""
    every = None
    for rank, (name, df) in enumerate(sources):
        marked = df.withColumns({"origin": F.lit(name), "__rank": F.lit(rank)})
        every = marked if every is None else every.unionByName(marked, allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("__rank", order))
    ranked = every.withColumn("__r", nth)
    kept = ranked.filter("__r = 1")
    kept = numbered(kept, ["__rank", order], "qa_no").withColumn("qa_id", F.format_string(f"{prefix}_%04d", "qa_no")).drop("__r", "__rank")
    return kept, ranked.filter("__r > 1").drop("__r", "__rank")


def single(c: Column, many: str = "multiple") -> Column:
    """A4: a set's only member, else a word for many; an empty one is null."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).when(F.size(c) > 1, F.lit(many))


def listed(ids: Column, most: int = 20) -> Column:
    """Up to so many ids, and how many more there are."""
    more = F.when(F.size(ids) > most, F.concat(F.lit(" +"), (F.size(ids) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(ids, 1, most), ", "), more)


def prompt(instruction: Column, context: Column, question: Column) -> Column:
    """A8."""
    return F.concat_ws("\n\n", instruction, F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), question))


def injected(text: Column, marker: str, body: Column) -> Column:
    """A10: the body after the first marker; without one the text stays."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at + len(marker) - 1), body, F.substring(text, at + len(marker), F.length(text)))).otherwise(text)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work without a result."""
    return work.join(done.select(key), key, "left_anti")


def request_id(*parts: Column) -> Column:
    """A13."""
    return F.concat_ws("__", *parts)


def results(raw: DataFrame, id_col: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(answers, faults) of a batch's lines; ids fall apart into regime, split and the rest."""
    parts = F.split(id_col, "__", 3)
    parsed = raw.select(parts[0].alias("regime"), parts[1].alias("split"), parts[2].alias("qa_id"), F.from_json(payload, "answer string, error string").alias("p"))
    bad = F.col("p").isNull() | F.col("p.error").isNotNull() | F.col("p.answer").isNull()
    return parsed.filter(~bad).select("regime", "split", "qa_id", F.col("p.answer").alias("answer")), parsed.filter(bad).select("regime", "split", "qa_id", F.col("p.error").alias("error"))


def listed_ids(df: DataFrame, group: str, key: str, most: int = 20) -> DataFrame:
    """(group, ids): up to so many ids of each group in order, and how many more there are; only those shown are gathered."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(key))
    top = df.select(group, key).withColumn("__r", nth).filter(F.col("__r") <= most)
    shown = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ", ").alias("__ids"))
    counts = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    more = F.when(F.col("__n") > most, F.concat(F.lit(" +"), (F.col("__n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return shown.join(counts, F.col(group).eqNullSafe(F.col("__g"))).select(group, F.concat("__ids", more).alias("ids"))


def prompts(items: DataFrame, answers: DataFrame, bundles: DataFrame, key: str, bundle: str, instruction: Column, question: Column, context: Column) -> tuple[DataFrame, DataFrame]:
    """(prompts, skipped): items with their question and bundle; skipped counts, by reason, the items that have no question or whose
    bundle is not there."""
    joined = items.join(answers.withColumn("__has_answer", F.lit(True)), key, "left").join(bundles.withColumn("__has_bundle", F.lit(True)), bundle, "left")
    reason = F.when(F.col("__has_answer").isNull(), "no question").when(F.col("__has_bundle").isNull(), "no bundle")
    marked = joined.withColumn("reason", reason)
    made = marked.filter("reason IS NULL").select(key, prompt(instruction, context, question).alias("prompt"))
    return made, marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Families of models that take their own name for the limit of tokens, and no temperature.
REASONING = r"^(gpt-5|o1|o3|o4)"


def chat_request(model: Column, text: Column, limit: int, temperature: float = 0.0) -> Column:
    """The body of a chat request as JSON, with the parameters that the model's family takes."""
    thinks = F.lower(model).rlike(REASONING)
    message = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    body = F.struct(model.alias("model"), message.alias("messages"), F.when(thinks, limit).alias("max_completion_tokens"), F.when(~thinks, limit).alias("max_tokens"), F.when(~thinks, F.lit(temperature)).alias("temperature"))
    return F.to_json(body, {"ignoreNullFields": "true"})


def generated(df: DataFrame, key: str, text: str, provider, mock: bool = False, said: str = "mock answer") -> DataFrame:
    """(key, prediction). provider() makes a client, once a task and only where a row needs it; the client maps a prompt to a text.
    A mock run makes none and answers every prompt alike."""
    schema = df.select(key).schema.add("prediction", "string")

    def run(batches):
        import pyarrow as pa

        client = None
        for b in batches:
            if client is None and not mock and b.num_rows:
                client = provider()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([said if mock else client(t.as_py() or "") for t in b.column(1)], pa.string())], names=[key, "prediction"])

    return df.select(key, text).mapInArrow(run, schema)


def dry_run(df: DataFrame, text: str, model: str, dollars_per_million: float) -> DataFrame:
    """What a run would send: requests, characters, tokens (two characters each) and their price; nothing is sent."""
    tokens = F.sum(F.floor(F.length(text) / 2))
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.length(text)).cast("long").alias("chars"), tokens.alias("tokens"), F.round(tokens * dollars_per_million / 1e6, 9).alias("dollars"))


def all_pages(fetch, limit: int = 100):
    """The rows of all pages of a store: fetch(after, limit) gives (rows, whether there are more), rows with an `id`; a page that
    does not move on is an error."""
    after = None
    while True:
        rows, more = fetch(after, limit)
        yield from rows
        if not more or not rows:
            return
        if rows[-1]["id"] == after:
            raise ValueError(f"the page after {after} ends where it began")
        after = rows[-1]["id"]


__all__ = ["public", "united", "single", "listed", "listed_ids", "prompt", "prompts", "injected", "pending", "request_id", "results", "chat_request", "generated", "dry_run", "all_pages", "keep_first"]
