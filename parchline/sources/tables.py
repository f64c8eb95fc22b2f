"""Parquet tables, spread over the cores where a file's few row groups would leave them idle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The table ``name``. With ``spread``, for work that is heavy by row, a table of fewer splits than cores is dealt out anew.

    What is shuffled then is under one split (spark.sql.files.maxPartitionBytes) for each core, whatever the data; larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def place(folder: str, name: str) -> Column:
    """A row's place in the table ``name``: file, then row in it. Only for columns taken from the table as it was read."""
    path = F.replace(F.col("_metadata.file_path"), F.lit(f"{folder}/{name}.parquet"), F.lit(""))
    return F.struct(path.alias("file"), F.col("_metadata.row_index").alias("row"))


def by_key(df: DataFrame, *keys: str, size: int = 8 << 20) -> DataFrame:
    """``df`` dealt out by ``keys``, a partition for each ``size`` bytes of the files under it and one for each core at least.

    A task's rows then stay as many whatever the table's size. The planner's own count is fixed, or follows the compressed bytes of a shuffle, of which
    a sorted task needs many times as much memory. Rows that don't come from files (size unknown) are left to the planner.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    whole = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if whole >= 1 << 62:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-whole // size)), *keys)
