"""Parquet tables by name, read only through Spark so that any Hadoop path works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
