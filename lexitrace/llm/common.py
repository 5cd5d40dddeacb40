"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space, and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share. Only on
    a session of one machine (a local master) a temporary folder stands in for an unset
    one; elsewhere that is an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/lexitrace-scratch"
    return f"{base.rstrip('/')}/lexitrace/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *sort: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and
    a lost executor costs a re-read, not a recomputation."""
    path = scratch_dir(df.sparkSession)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Remove what operators left in the shared folder over ``hours`` ago; how many
    tables went. A returned DataFrame reads such tables until its rows are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).getParent()
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    old = [x.getPath() for x in fs.listStatus(folder) if x.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    return sum(bool(fs.delete(x, True)) for x in old)


def words_of(text: Column) -> Column:
    """Maximal runs without white space, in order; null text has none."""
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a membership filter: 256 bitmaps of 4 KB, whatever the size of the input.
FILTER_BITS = 1 << 23


def filter_bits(members: int) -> int:
    """Bits of a filter for so many members: sixteen or more a member, 2^20 to 2^30 in all
    (128 MB), so it prunes well up to some hundred million members."""
    return min(1 << 30, max(1 << 20, 1 << (16 * members).bit_length()))


def member_bitmaps(members: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A filter of the values of ``column``: a row of 4 KB for each 32,768 bits, at most, fit
    to broadcast."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    return members.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bitmap"))


def may_contain(rows: DataFrame, column: str, bitmaps: DataFrame, keep: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``column`` is among the members, and a few others by chance; with
    ``keep`` all rows, and whether they pass in ``maybe``."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    probed = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "__bucket", "left" if keep else "inner")
    passes = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return (probed.withColumn("maybe", passes) if keep else probed.where(passes)).drop("__bucket", "__bitmap")


def among(rows: DataFrame, members: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """``may_contain`` by a filter whose size follows the number of ``members``, a written
    table: it prunes as well on large inputs as on small ones."""
    bits = filter_bits(members.count())
    return may_contain(rows, column, member_bitmaps(members, column, bits), keep, bits)
