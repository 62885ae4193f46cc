"""Where rows come from and go to: Parquet tables, number series, session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table

__all__ = ["empty", "series", "settings", "table", "write_parquet"]


def series(spark: SparkSession, first: int, last: int) -> DataFrame:
    """One column `value`: whole numbers from first to last, both included."""
    return spark.range(first, last + 1).select(F.col("id").alias("value"))


def settings(spark: SparkSession, like: str = "%") -> DataFrame:
    """Session settings (name, value), filtered by a LIKE pattern."""
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value").where(F.col("name").like(like))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Copies a query's result to Parquet and returns the written table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
