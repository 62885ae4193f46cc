"""Expressions whose meaning differs between engines, spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(name: str, descending: bool = False, nulls: str | None = None) -> Column:
    """A sort key with explicit null order; by default nulls count as the largest value, as in the ascending-last, descending-first convention."""
    if nulls not in (None, "first", "last"):
        raise ValueError("nulls must be 'first' or 'last'")
    nulls = nulls or ("first" if descending else "last")
    c = F.col(name)
    return getattr(c, f"{'desc' if descending else 'asc'}_nulls_{nulls}")()


def whole_division(a: Column, b: Column) -> Column:
    """Division of whole numbers that drops the remainder towards zero (Spark's `/` gives a fraction)."""
    return ((a - a % b) / b).cast("long")


def money(c: Column, digits: int = 2) -> Column:
    """A floating sum rounded, so that the order of addition doesn't show."""
    return F.round(c, digits)
