"""Sinks for result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(result: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a result as JSON lines or Parquet, replacing what is there."""
    result.write.mode("overwrite").format(kind).save(path)
