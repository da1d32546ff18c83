"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a DataFrame; filters and column lists reach the parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
