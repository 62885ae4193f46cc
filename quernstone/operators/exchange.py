"""Exchanges: how rows get from the tasks of one stage to those of the next.

Spark adds the exchanges that its joins, aggregates and sorts need. These are for
where a plan names one, or where a scan of one row group would leave cores idle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a side counts as small enough to be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def hash_exchange(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    """Equal keys meet in one of `partitions` partitions."""
    return df.repartition(max(1, partitions), *keys)


def round_robin_exchange(df: DataFrame, partitions: int) -> DataFrame:
    """Rows in equal shares, whatever they hold."""
    return df.repartition(max(1, partitions))


def coalesce_exchange(df: DataFrame) -> DataFrame:
    """One partition. For results that are small by nature: it takes all rows through one task."""
    return df.coalesce(1)


def merge_exchange(df: DataFrame, *keys: Column) -> DataFrame:
    """All rows in order: a range exchange and a sort of each range, so no task merges everything."""
    return df.orderBy(*keys)


def broadcast_side(df: DataFrame) -> DataFrame:
    """`df` marked for broadcasting if the optimizer's estimate, or else a count, shows that it is small."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) <= BROADCAST_BYTES or df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def colocated(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, partitions): the keys that more than one partition holds; none after a hash exchange on the key."""
    placed = df.select(key, F.spark_partition_id().alias("p")).distinct()
    return placed.groupBy(key).agg(F.count("*").alias("partitions")).where("partitions > 1")
