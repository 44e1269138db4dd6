"""The registered queries of the training-data operators: op1 to op13 and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, html, lines, migrate, mixing, pivots, quality, secrets, shards, simhash, sketches, treaps
from .common import spread, table


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), radius=2, shingle=3)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(turns.unionByName(probe)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.in_order(mixing.plan(table(spark, sf_dir, "documents")))
    return planned.select("doc_id", "source", "size", "source_size", "target", "taken", "n_copies", "position", "last_position")


def op11_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=20)


def op12_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.rewritten_clients(spark, table(spark, sf_dir, "clients"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), shingle=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_level_bpe": op1_byte_level_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_chat": op7_chat,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_treaps": op11_treaps,
    "op12_migration": op12_migration,
    "op13_minhash": op13_minhash,
    "pipeline": pipeline,
}

#: SQL has no XXH64, no CRC-32, no byte-pair merges and no places of matches, and op12 writes files: the other queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS uid FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.uid <> b.uid AND len(a.q) = len(b.q))
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "op7_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length(regexp_replace(text, '[\\<\[]', '\\\0', 'g')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(regexp_replace(role, '[\\<\[]', '\\\0', 'g')) END) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, 3 * source_size / CAST(w AS DOUBLE) AS full_at FROM w),
g AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM f WINDOW o AS (ORDER BY full_at, source IS NULL, source)),
q AS (SELECT source, source_size, CASE w WHEN 5 THEN -0.5::DOUBLE WHEN 2 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS lean, coalesce(least(CAST(3 * source_size AS DOUBLE), max(level) FILTER (level <= full_at) OVER () * w), 0) AS target FROM g),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
u AS (SELECT sum(target) AS asked, sum(target * lean) AS leaning FROM q),
t AS (SELECT p.*, source_size, target, lean, least(CAST(round(target) AS BIGINT), 3 * source_size) AS quota FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, list_filter(list_transform([0, 1, 2], lambda k: {k: k, words: CAST(greatest(0, least(size, quota - start - k * source_size)) AS BIGINT)}), lambda x: x.words > 0) AS copies FROM t),
m AS (SELECT *, list_transform(copies, lambda x: (start + x.k * source_size + x.words / 2) / quota) AS shares FROM c),
z AS (SELECT *, list_transform(shares, lambda s: CASE WHEN lean = 0 THEN s ELSE (sqrt((1 - lean) * (1 - lean) + 4 * lean * s) - (1 - lean)) / (2 * lean) END) AS times FROM m)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(list_sum(list_transform(copies, lambda x: x.words)), 0) AS BIGINT) AS taken, CAST(len(copies) AS INTEGER) AS n_copies,
  CAST(floor(asked * times[1] + leaning * (times[1] * times[1] - times[1])) AS BIGINT) AS position, CAST(floor(asked * times[-1] + leaning * (times[-1] * times[-1] - times[-1])) AS BIGINT) AS last_position
FROM z, u""",
    "op11_treaps": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT item, item_id, term, CAST(count(*) AS BIGINT) AS times FROM i GROUP BY ALL),
p AS (SELECT uid, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
t AS (SELECT uid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, n GROUP BY term, nn),
s AS (SELECT item, item_id, uid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score FROM a JOIN t USING (term) JOIN w USING (term), n GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op13_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, uid, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) ELSE w END AS s FROM w),
e AS MATERIALIZED (SELECT uid, len(s) AS n, unnest(s) AS g FROM d),
p AS MATERIALIZED (SELECT a.uid AS x, b.uid AS y FROM e a JOIN e b ON a.g = b.g AND a.uid <> b.uid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.uid, b.uid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT uid, uid AS z FROM d UNION SELECT r.uid, p.y FROM r JOIN p ON r.z = p.x)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d JOIN r ON d.uid = r.uid JOIN d o ON o.uid = r.z GROUP BY d.uid, d.doc_id, d.s""",
}
