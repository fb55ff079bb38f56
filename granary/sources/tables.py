"""Sinks: chunk tables by module, replaced where new rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
