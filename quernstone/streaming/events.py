"""Streams on the events table: windows with watermarks, sessions, and streaming duplicates (beyond the surveyed operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.source_queries import scratch
from ..sources.tables import table

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: one folder is watched, so the file is named by a glob."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, to a table of files, and reads that."""
    spark = df.sparkSession
    out = scratch(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type; a window is given out once its end lies `late` before the newest event."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of users: runs of events less than a gap apart."""
    s = F.session_window("ts", gap)
    return events.groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last value of the right at or before it: one sort of both sides, no range join."""
    both = left.select("*", F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side")).unionByName(right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__v", "__side")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
