"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space of the contracts, as a Java pattern.
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def words(text: str | Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D; null gives none."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANK), "")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local master, whose tasks share this machine, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so that later jobs read the very same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def digest(*columns: Column) -> Column:
    """SHA-256 of these values (32 bytes), each after its length, so that different rows have different inputs; nulls are told apart."""
    said = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*said), 256))


#: A key is hot if it has more than WIDE rows and more than one in HOT_KEYS of all rows: there are fewer than HOT_KEYS such keys.
WIDE, HOT_KEYS = 1024, 10_000


def meet(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, salt_by: list[str], wide: int = WIDE) -> DataFrame:
    """`rows` joined with `keyed` (checkpointed, a row a key), whose column `weight` says how many of `rows` have the key.

    The hot keys are broadcast, and their rows are dealt by a salt, a hash of `salt_by`: no task is filled by one key."""
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bound = max(wide, total // HOT_KEYS)
    parts = F.when(F.col(weight) > bound, F.ceil(F.col(weight) / bound)).otherwise(F.lit(1)).cast("int")
    hot = keyed.filter(F.col(weight) > bound).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], parts.alias("__parts"))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left")
    salt = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*salt_by), F.col("__parts"))).cast("int")
    salted = marked.select(*rows.columns, salt.alias("__salt"))
    others = [c for c in keyed.columns if c not in keys and c != weight]
    right = keyed.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *others, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    on = [F.col(k) == F.col(f"__key_{k}") for k in keys] + [F.col("__salt") == F.col("__part")]
    return salted.join(right, on).select(*rows.columns, *others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, where it has fewer partitions than those (a small file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def doc_key(df: DataFrame, id_col: str = "doc_id") -> Column:
    """A document's id as an order key: null ids come last."""
    return F.coalesce(df[id_col].cast("long"), F.lit(2**63 - 1))


def ship(df: DataFrame) -> DataFrame:
    """Makes this package importable where Python workers run; once a context. Returns `df`."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_quernstone_shipped", False):
        package = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
        sc._quernstone_shipped = True
    return df
