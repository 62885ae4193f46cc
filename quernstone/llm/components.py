"""Connected components of a graph of links, wholly distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond"): every round each node learns the least node near it and passes
it on, until the links form stars. Minima are combined before the shuffle, so a node of
many links is one row per task. A round's result is written to the shared folder, by few
tasks where links are few: each file that a task writes costs its executor processes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Minima of up to this many nodes (16 bytes each) are broadcast to their links; more are joined by a shuffle that splits hot nodes.
BROADCAST_NODES = 250_000
#: A round is written by TASKS tasks, or one for each TASK_LINKS links where that is more; never by more than there are partitions.
TASKS, TASK_LINKS = 8, 50_000


def checked(df: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """`df`, which must be cheap to count, marked for broadcasting if it has `most` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def _star(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(checked(least), "x")


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that has a link to another; root is the least node that can be reached.

    Links are undirected; those of a node with itself, repeated ones and those with a null end
    don't matter. Without links the result is empty.
    """
    pairs = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        seen, tasks = mark, max(TASKS, math.ceil(mark[0] / TASK_LINKS))
        # Large star: what is above x is linked to the least node near x.
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")).coalesce(tasks), "links-least")
        large = materialize(_star(both, least).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct().coalesce(tasks), "links-large")
        # Small star: x and what is below it are linked to the least node below x.
        below = materialize(large.groupBy("x").agg(F.min("y").alias("m")).coalesce(tasks), "links-below")
        small = _star(large, below).where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = materialize(small.unionByName(below.select("x", F.col("m").alias("y"))).distinct().coalesce(tasks), "links")
    raise RuntimeError(f"links don't settle in {rounds} rounds")
