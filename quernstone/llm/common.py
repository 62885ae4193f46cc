"""What the operators of this subpackage share: shared storage, row keys, Arrow plumbing."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = threading.get_ident()
    return path


#: By path, the thread that wrote it.
_WRITTEN: dict[str, int] = {}


def written() -> set[str]:
    """The tables that exist, for `clean`."""
    return set(_WRITTEN)


def clean(spark: SparkSession, keep: DataFrame | None = None, before: set[str] | None = None) -> None:
    """Deletes the tables that this process has materialized: to be called when no result that reads them is needed any more.

    What `keep` reads stays. With `before`, only what this thread has written since then goes.
    """
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for path, thread in list(_WRITTEN.items()):
        if path.rsplit("/", 1)[-1] not in kept and (before is None or path not in before and thread == threading.get_ident()):
            _delete(spark, path)
            del _WRITTEN[path]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's own setting: a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs; afterwards they are as before."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and reads it back: lineage ends at files that outlive executors.

    Nothing reads the shuffles of the writing query again, so Spark deletes their files when it has ended.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with held(spark, {CLEANUP: "true"}):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*names: str) -> list[Column]:
    """Two 64-bit hashes of a row's columns, nulls included: equal rows share a key, others don't."""
    cols = [F.col(n) for n in names]
    marks = [c.isNull() for c in cols]
    return [F.xxhash64(F.lit(17), *marks, *cols).alias("_k1"), F.xxhash64(F.lit(91), *cols, *marks).alias("_k2")]


def text_bytes(name: str = "text", alias: str | None = None) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(alias or name)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named by position (c0, c1, ...), so that they clash with no column of ours, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(reversed(list(zip(df.columns, names, strict=True))))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with workers that can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the binary column of a part holds about `most` bytes (one row at least)."""
    import numpy as np

    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(written: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        _delete(written.sparkSession, path)


def retexted(docs: DataFrame, extra: DataFrame, column: str, fn: Callable[[bytes, object], bytes]) -> DataFrame:
    """The rows of `docs`, all columns kept: text becomes fn(text as bytes, the row's `column` of `extra`), n_chars its code points where there is such a column.

    `extra` has a row for some rows of `docs`, by _k1 and _k2 (row_key of doc_id and text); the others stay as they are.
    A null text stays null. Bytes that are no whole character are left out.
    """
    apart, at = positional(docs)
    counted = [at[f.name] for f in docs.schema.fields if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)]
    own, text = apart.columns, at["text"]
    keyed = apart.select("*", *row_key(at["doc_id"], text)).join(extra.select("_k1", "_k2", F.col(column).alias("_extra")), ["_k1", "_k2"], "left").select(*own, "_extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sized = whole.append_column("_size", whole.column(text).cast(pa.binary()))
            for part in slices(sized, "_size"):
                texts = [t if t is None or x is None else fn(t, x) for t, x in zip(part.column("_size").to_pylist(), part.column("_extra").to_pylist(), strict=True)]
                texts = [None if t is None else t.decode(errors="ignore") for t in texts]
                made = {text: pa.array(texts, part.column(text).type)}
                for n in counted:
                    made[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, part.column(n).to_pylist(), strict=True)], part.column(n).type)
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(n)) for n in own], own)

    return arrow_map(keyed, run, apart.schema).toDF(*docs.columns)
