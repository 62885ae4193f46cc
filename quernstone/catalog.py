"""Tables by name: a folder of Parquet files as temporary views, and the example tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder, on any path that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Registers tables of a folder as temporary views; only file footers are read."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


# The example tables' sizes, remainders, dates and segments.
def example_orders(spark: SparkSession, rows: int = 20_000) -> DataFrame:
    """order_id from 1 on, a hundred customers in turn, even orders in 2024 and odd ones in 2023."""
    return spark.range(1, rows + 1).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 100 + 1).alias("cust_id"),
        (F.col("id") % 50).cast("double").alias("total"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-03-01")).otherwise("2023-06-01").cast("date").alias("order_date"),
    )


def example_customers(spark: SparkSession, rows: int = 100) -> DataFrame:
    """id from 1 on; segments retail, wholesale and online for remainders 0, 1 and 2."""
    return spark.range(1, rows + 1).select("id", F.element_at(F.array(*map(F.lit, ("retail", "wholesale", "online"))), (F.col("id") % 3 + 1).cast("int")).alias("segment"))
