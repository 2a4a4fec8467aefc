"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table as stored; filters and column lists applied to it reach the Parquet scan."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
