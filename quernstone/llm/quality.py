"""Quality rules with host-level verdicts.

Each document is measured once. Rule failures are summed by host; a host's failure
rate is shrunk towards all hosts' with a beta prior fitted to the hosts themselves
(method of moments), so that a host of three documents isn't condemned for two. A host
whose shrunk rate of any rule is over the limit is rejected, and the verdict is joined
back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize, positional, slices, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Rejected hosts up to this many are broadcast (an id of some ten bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, the first included."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k == n:
        return 0
    pair = ids[:-1] * k + ids[1:]
    if k < 2_000_000:
        window = pair[:-1] * k + ids[2:]
    else:  # three numbers of this size pass 63 bits: number the pairs first
        window = np.unique(pair, return_inverse=True)[1][:-1] * k + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The MEASURES of one text in UTF-8. Words are what is left between space, tab, line feed, vertical tab, form feed and carriage return."""
    words = text.split()
    solid = text.translate(None, _SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode())
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.translate(None, _SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text"):
            columns = zip(*map(measure, part.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "source", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, and the MEASURES) for every row of `docs`. A null text has no words and no lines."""
    types = "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    return arrow_map(docs.select("doc_id", F.col("source").cast("string").alias("source"), text_bytes()), _measured, types)


def rules(min_words: int = 50, repeat_percent: int = 50, symbol_percent: int = 10, dup_lines: int = 10) -> dict[str, Column]:
    """What a document fails by: too few words, too many repeated words; and by measures of their own, symbols and repeated lines."""
    return {
        "too_short": F.col("n_words") < min_words,
        "repetitive": F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"),
        "symbols": F.lit(100) * F.col("n_symbols") > F.lit(symbol_percent) * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > dup_lines,
    }


def beta_prior(hosts: DataFrame, failures: str, total: str = "n_docs") -> tuple[float, float]:
    """(a, b) of the beta distribution that host failure rates follow, by the moments of the rates weighted by host size.

    Variance beyond what sampling alone gives is the spread between hosts; without any (or
    with one host) the prior is firm: 1e6 documents at the common rate. Without documents: (1, 1).
    """
    rate = F.col(failures) / F.col(total)
    row = hosts.agg(F.sum(total).alias("n"), F.sum(failures).alias("f"), F.sum(F.col(total) * rate * rate).alias("r2"), F.count("*").alias("hosts"), F.sum(F.col(total).cast("double") * F.col(total)).alias("n2")).first()
    if not row or not row["n"]:
        return 1.0, 1.0
    n, mean = float(row["n"]), row["f"] / row["n"]
    if not 0 < mean < 1:
        return (mean * 1e6 + 1e-6, (1 - mean) * 1e6 + 1e-6)
    within = mean * (1 - mean)
    spread = row["r2"] / n - mean * mean
    # E[spread] = var * (1 - n2/n^2) + (within - var) * (hosts - 1) / n for rates of variance var between hosts
    lost = (row["hosts"] - 1) / n
    scale = 1 - row["n2"] / (n * n) - lost
    var = (spread - within * lost) / scale if scale > 1e-12 else 0.0
    strength = within / var - 1 if var > within / 1e6 else 1e6
    strength = min(max(strength, 1e-3), 1e6)
    return mean * strength, (1 - mean) * strength


def quality_verdicts(docs: DataFrame, max_host_rate: float = 0.5, **limits: int) -> DataFrame:
    """Rows (doc_id, source, the MEASURES, base_failed, host_rejected, kept) for every row of `docs`.

    base_failed: too_short or repetitive. host_rejected: the host's shrunk rate of any rule
    is over `max_host_rate`; one answer per host, however many documents it has. kept: neither.
    A null source is no host: its documents stand on their own. A null doc_id stays null;
    repeated rows count and return once each; other columns are ignored; no rows, no result.
    """
    spark = docs.sparkSession
    measured = materialize(measures(docs), "quality-measures")
    judged = _with_hosts(measured, _rejected(measured, max_host_rate, limits))
    failed = rules(**limits)["too_short"] | rules(**limits)["repetitive"]
    return judged.select("doc_id", "source", *MEASURES, failed.alias("base_failed"), F.coalesce("_rejected", F.lit(False)).alias("host_rejected")).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def _rejected(measured: DataFrame, max_host_rate: float, limits: dict[str, int]) -> DataFrame:
    """Rows (_host, _rejected) of the hosts that are over the limit."""
    named = rules(**limits)
    hosts = materialize(
        measured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(r) for r, c in named.items())),
        "quality-hosts",
    )
    over = F.lit(False)
    for rule in named:
        a, b = beta_prior(hosts, rule)
        over = over | ((F.col(rule) + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)) > F.lit(max_host_rate))
    return materialize(hosts.where(over).select(F.col("source").alias("_host"), F.lit(True).alias("_rejected")), "quality-rejected")


def _with_hosts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    few = rejected.count() <= BROADCAST_HOSTS
    return rows.join(F.broadcast(rejected) if few else rejected, F.col("source").cast("string") == F.col("_host"), "left")


def keep_good(docs: DataFrame, max_host_rate: float = 0.5, **limits: int) -> DataFrame:
    """The rows of `docs` that quality_verdicts keeps, with all their columns. Texts are measured twice rather than shuffled.

    Nulls, repeated rows and empty tables are as in quality_verdicts; names of other columns don't matter.
    """
    apart, at = positional(docs)
    own, text, source = apart.columns, at["text"], at["source"]
    rejected = _rejected(materialize(measures(apart.select(*(F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")))), "quality-measures"), max_host_rate, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sized = whole.append_column("_size", whole.column(text).cast(pa.binary()))
            for part in slices(sized, "_size"):
                columns = zip(*(measure(t or b"") for t in part.column("_size").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], [*whole.schema.names, *MEASURES])

    measured = arrow_map(apart, run, T.StructType([*apart.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    fine = measured.where(~(rules(**limits)["too_short"] | rules(**limits)["repetitive"])).withColumn("source", F.col(source))
    return _with_hosts(fine, rejected).where(F.col("_rejected").isNull()).select(*own).toDF(*docs.columns)
