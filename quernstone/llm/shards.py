"""Contiguous shards of near-equal bytes, in native DataFrame functions.

Method. Documents stand in the order of their id. A document's place on the byte line is the sum of the sizes before it,
got from per-partition totals (`prefix.with_prefix`); the line is cut at equal targets, and a document belongs to the
shard in which its middle byte lies. So shards are contiguous in doc_id, and none is off its target by more than the
halves of the two documents at its cuts.

Size: UTF-8 bytes of the text plus 1 (null text: 1). Law: `bytes`; `grown_shard` belongs to another law and is null.

Cases. Null ids stand last; equal ids by checksum and size; fully equal rows take neighbouring slots. Empty texts count 1
byte, very long ones may leave a shard with less than its target. An empty table gives no rows. Only the id and the text
are read: the result is narrow (texts stay where they are), and other columns can't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed
from .prefix import with_prefix


def assign_shards(docs: DataFrame, n_shards=16, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # narrow rows, written once: the texts are read a single time
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = checkpointed(rows)
    placed = with_prefix(rows, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_crc32"), F.col("size")], ["size"])
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).scalar()
    # the middle of a document, doubled to stay in integers
    middle = 2 * F.col("__start_size") + F.col("size")
    sharded = placed.withColumn("__total", total).withColumn("shard", F.least(F.floor(middle * n_shards / (2 * F.col("__total"))), F.lit(n_shards - 1)).cast("int"))
    # a shard's first row: at most n_shards rows, small at any input size
    first = sharded.groupBy("shard").agg(F.min("__row").alias("__first"))
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__row") - F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
