"""Line dedup across documents.

Lines are exploded with their position; a line's normalised key is hashed to 128 bits;
documents are counted per hash (smallest and largest doc_id, combined before the
shuffle, so a line of every document is one row per task); hashes over the threshold
are joined back to the positions that hold them; and each text is put together again
from the positions that stay. Line texts are never shuffled, only hashes and positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, positional, retexted, row_key, slices, text_bytes

_SPACES = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """A line without the six ASCII spaces at its ends, A-Z in lower case."""
    return line.strip(_SPACES).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _exploded(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for part in slices(whole, "text"):
                at, hashes, positions = [], [], []
                for row, text in enumerate(part.column(3).to_pylist()):
                    for p, line in enumerate(text.split(b"\n")):
                        key = line.strip(_SPACES).lower()
                        if len(key) >= least and long_enough(key, least):
                            at.append(row)
                            hashes.append(digest(key))
                            positions.append(p)
                if not at:
                    continue
                two = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(positions, pa.int32())],
                    ["doc_id", "_k1", "_k2", "_h1", "_h2", "_pos"],
                )

    return run


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text"):
            rows = []
            for text, drop in zip(part.column("text").to_pylist(), part.column("_drop").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n = len(lines)
                if drop:
                    gone = set(drop)
                    text = b"\n".join([x for p, x in enumerate(lines) if p not in gone])
                rows.append((n, len(set(drop or ())), text))
            n, d, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_k1"), part.column("_k2"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "_k1", "_k2", "n_lines", "n_dropped", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _rebuilt(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array([hashlib.sha256(x).hexdigest() for x in b.column(5).to_pylist()], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dropped_positions(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """Rows (_k1, _k2, _drop): the line positions that each document loses, for those that lose any.

    A key of `least_chars` code points or more that `least_docs` documents hold (by distinct
    doc_id; null is none) is dropped but in the smallest doc_id that holds it. Rows of one
    doc_id count as one document.
    """
    lines = materialize(arrow_map(docs.select("doc_id", *row_key("doc_id", "text"), text_bytes()), _exploded(least_chars), "doc_id long, _k1 long, _k2 long, _h1 long, _h2 long, _pos int"), "line-hashes")
    by = lines.groupBy("_h1", "_h2")
    # Two documents are enough where the smallest and the largest id differ; more need each id once.
    counted = by.agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")) if least_docs <= 2 else lines.groupBy("_h1", "_h2", "doc_id").agg(F.lit(1).alias("_one")).groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("doc_id").alias("_n")).where(F.col("_n") >= least_docs)
    often = materialize(counted.where(F.col("_first") < F.col("_last") if least_docs == 2 else F.lit(True)).select("_h1", "_h2", "_first"), "line-often")
    losing = lines.join(often, ["_h1", "_h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    return losing.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_drop"))


def _with_drops(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    drops = materialize(dropped_positions(docs, least_chars, least_docs), "line-drops")
    return docs.select("doc_id", *row_key("doc_id", "text"), text_bytes()).join(drops, ["_k1", "_k2"], "left").select("doc_id", "_k1", "_k2", "text", "_drop")


def dedup_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """Rows (doc_id, _k1, _k2, n_lines, n_dropped, kept) for every row of `docs`; kept is the text that is left, as UTF-8 bytes.

    Texts are split at line feeds; a null or empty text is one empty line. A document that
    loses every line keeps an empty text. A null doc_id holds no line against others, and its
    lines go where another document has them. _k1 and _k2 identify the row (row_key of
    doc_id and text); equal rows are treated alike. Other columns are ignored.
    """
    return arrow_map(_with_drops(docs, least_chars, least_docs), _rebuilt, "doc_id long, _k1 long, _k2 long, n_lines long, n_dropped long, kept binary")


def digest_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """dedup_lines with the sha256 of what is left in its place."""
    return arrow_map(_with_drops(docs, least_chars, least_docs), _digested, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """The rows of `docs`, all of them and with all their columns, their texts without the lines that dedup_lines drops.

    A null text stays null; a null doc_id and repeated rows are as in dedup_lines; no rows, no result; names of other columns don't matter.
    """
    apart, at = positional(docs)
    drops = materialize(dropped_positions(apart.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), least_chars, least_docs), "line-drops")

    def left(text: bytes, drop) -> bytes:
        gone = set(drop)
        return b"\n".join([x for p, x in enumerate(text.split(b"\n")) if p not in gone])

    return retexted(docs, drops, "_drop", left)
