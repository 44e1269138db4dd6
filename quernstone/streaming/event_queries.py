"""Queries on events, all beyond the surveyed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from . import events as E


@query("beyond_stream_windows", """
WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, n, total FROM w WHERE epoch(s) + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def windows(spark, d):
    out = E.drained(E.tumbling(E.stream(spark, d), "1 hour", "10 minutes"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("beyond_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def dedup(spark, d):
    out = E.drained(E.stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("beyond_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return E.sessions(E.batch(spark, d), "30 minutes").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


@query("beyond_as_of", """
SELECT event_id, (SELECT max(p.value) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS as_of FROM events e WHERE event_type = 'view'""")
def as_of(spark, d):
    e = E.batch(spark, d)
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return E.as_of(left, e.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "as_of")


@query("beyond_cube", "SELECT coalesce(event_type, 'ALL') AS event_type, coalesce(user_id % 3, -1) AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube(spark, d):
    c = E.batch(spark, d).withColumn("shard", F.col("user_id") % 3).cube("event_type", "shard").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), F.coalesce("shard", F.lit(-1)).alias("shard"), "n")
