"""Parquet table scans by name; every reader takes the folder that holds ``<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scans ``folder/name.parquet`` and keeps ``columns`` (all, if none are given), so the scan reads only those."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
