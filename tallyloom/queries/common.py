"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_sql(column: str) -> str:
    """SQL text of functions.folded()."""
    return f"nullif(lower(regexp_replace({column}, '[^A-Za-z0-9]', '', 'g')), '')"
