"""SQL texts of other engines' habits, where Spark's SQL lacks the words: COPY, generate_series and a settings table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .errors import InvalidArgument

_LITERALS = re.compile(r"('(?:[^']|'')*')")
_COPY = re.compile(r"\s*COPY\s*\((?P<query>.*)\)\s*TO\s*'(?P<path>(?:[^']|'')*)'\s*(?:STORED\s+AS\s+(?P<format>\w+))?\s*;?\s*", re.I | re.S)
_SERIES = re.compile(r"\bgenerate_series\s*\(\s*([^(),]+?)\s*,\s*([^(),]+?)\s*\)", re.I)
_SETTINGS = re.compile(r"\binformation_schema\s*\.\s*df_settings\b", re.I)


def translated(text: str) -> str:
    """The text in Spark's words; string literals stay as they are."""

    def outside(part: str) -> str:
        part = _SERIES.sub(r"(SELECT id AS value FROM range(\1, \2 + 1))", part)
        return _SETTINGS.sub("quernstone_settings", part)

    return "".join(p if k % 2 else outside(p) for k, p in enumerate(_LITERALS.split(text)))


def prepared(spark: SparkSession, text: str) -> Callable[[], DataFrame]:
    """Analyses the text now, so that mistakes show at once; what is returned runs it. A copy isn't written before."""
    if found := _COPY.fullmatch(text):
        if (found["format"] or "PARQUET").upper() != "PARQUET":
            raise InvalidArgument(f"COPY writes PARQUET, not {found['format']}")
        inner, path = prepared(spark, found["query"]), found["path"].replace("''", "'")
        return lambda: sources.write_parquet(inner(), path).selectExpr("count(*) AS count")
    if _SETTINGS.search(text):
        sources.settings(spark).createOrReplaceTempView("quernstone_settings")
    df = spark.sql(translated(text))
    df.schema
    return lambda: df


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Runs a query, or copies one to Parquet: COPY (query) TO 'path' STORED AS PARQUET gives the written table's count.

    generate_series(a, b) is a table of one column `value`, both ends included. Null order and `/`
    keep Spark's meaning: write NULLS FIRST or LAST, and `div` for whole division.
    """
    return prepared(spark, text)()
