"""Aggregation in two phases: partial in each task, final after one exchange on the keys. Catalyst splits every groupBy so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def two_phase(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """`aggs` maps an output name to (function, argument). One exchange, of one row per key and task."""
    return df.groupBy(*keys).agg(*(FUNCTIONS[f](c).alias(n) for n, (f, c) in aggs.items()))
