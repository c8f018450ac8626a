"""Parquet table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
