"""A parquet table read as a stream and drained once, for incremental ingestion and for tests of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import new_folder
from ..streaming.ingest import deduplicated, drain, to_folders


def drain_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """Rows of the file ``name`` in ``folder``, one of each key, through a file stream and folders of the shared directory."""
    root = new_folder(spark, "stream")
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = deduplicated(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder), key)
    drain(rows, f"{root}/checkpoint", to_folders(f"{root}/out"))
    return spark.read.schema(schema).parquet(f"{root}/out")
