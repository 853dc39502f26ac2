"""Reading the test tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of directory `sf_dir`; Parquet, one file or folder per table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
