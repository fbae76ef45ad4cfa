"""Reading the project's tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under sf_dir."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
