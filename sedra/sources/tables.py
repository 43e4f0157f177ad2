"""Tables of a data set folder, one Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies. How many tasks read it is for its layout and the session's split size to say."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
