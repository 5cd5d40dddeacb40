"""Driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables under so many bytes are dealt out over all cores: a small file is one row
#: group, which one task would read and work on alone. Larger ones are split as they are.
SMALL = 256 << 20
#: Bytes of a table's files in one part of a table that is dealt by a key.
PART = 4 << 20


def _size(df: DataFrame) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if 1 << 20 < _size(df) < SMALL else df


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Parts that grow with the table, so that no task's share does."""
    return max(spark.sparkContext.defaultParallelism, -(-_size(spark.read.parquet(f"{sf_dir}/{name}.parquet")) // PART))


def deal_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns``, the rows of a key in one part: what is grouped by the key later
    isn't shuffled again."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *columns).repartition(parts_of(spark, sf_dir, name), key)


def lies_whole(spark: SparkSession, sf_dir: str, name: str, key: str) -> bool:
    """Whether a table is a larger one whose keys are there once: it needs no dealing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _size(df) >= SMALL and df.groupBy(key).count().where("count > 1").isEmpty()


def in_a_row(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """``deal_table`` with the rows of a key in a row; a larger table whose keys are there once
    is read as it lies, nothing is shuffled."""
    if lies_whole(spark, sf_dir, name, key):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *columns)
    return deal_table(spark, sf_dir, name, key, *columns).sortWithinPartitions(key)
