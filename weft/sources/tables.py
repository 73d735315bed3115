"""Tables of a data folder, one Parquet file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; its columns are pruned and its filters pushed down by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
