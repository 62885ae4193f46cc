"""Token ids as ORC files.

Texts are range-partitioned and sorted by doc_id and encoded where they land; each
partition becomes one file whose stripes hold the ids as run-length encoded integers,
with row indexes and a Bloom filter on doc_id. Stripes are read in parallel, and a
reader that wants some documents skips the stripes and row groups whose statistics or
Bloom filter exclude them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, held, materialize, slices, text_bytes
from .components import checked
from .tokens import REMEMBERED, Encoder, le32, loaded

#: The files' columns: shard is the file's place in the order of all, first the ids before the document in its file.
FORMAT = "doc_id long, shard int, first long, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
}
#: Bytes that travel at once between Spark and a worker; one row at least. Both keep memory for what the largest needed.
BATCH = 1 << 20
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH), "spark.sql.orc.columnarReaderBatchSize": "256"}


def _encoded(tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        coder, shard, first = loaded(Encoder, tokenizer, REMEMBERED // 2), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else le32([end_id])
        for whole in batches:
            for part in slices(whole, "text", BATCH):
                ids = [coder.ids(t.decode()) + end for t in part.column(1).to_pylist()]
                bounds = np.cumsum([0, *(len(x) // 4 for x in ids)])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(first + bounds[:-1], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)],
                    ["doc_id", "shard", "first", "ids"],
                )
                first += int(bounds[-1])

    return run


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, options: dict[str, str] | None = None) -> None:
    """Writes every row of `docs` to `path` in ascending doc_id order (nulls first), over all files.

    Rows of one doc_id, or without any, may be many: they are ordered by the first bytes of their texts, then
    by hash, and files are cut between them as well. A null text is an empty one: `end_id` alone.
    Repeated rows are written once each; other columns are ignored; without rows there are files
    without rows, or none. `options` are added to OPTIONS.
    """
    rows = docs.select("doc_id", text_bytes())
    order = [F.col("doc_id"), F.substring("text", 1, 64).alias("_p"), F.xxhash64("text").alias("_h")]
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    with held(docs.sparkSession, SMALL_BATCHES):
        arrow_map(rows.select("doc_id", "text"), _encoded(tokenizer, end_id), FORMAT).write.options(**OPTIONS | (options or {})).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Rows of the files; with `doc_ids`, only theirs: the filter reaches stripe statistics and Bloom filters."""
    rows = spark.read.schema(FORMAT).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        ids = b.column("ids")
        bounds = ids.offsets.to_numpy().astype(np.int64)
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("first"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "shard", "first", "n_tokens", "ids_crc32"])


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) as the files have them; start counts the ids of all documents before.

    The files' totals, one row of twelve bytes a file, are added up on the driver.
    """
    with held(spark, SMALL_BATCHES):
        digests = materialize(arrow_map(read_documents(spark, path), _digested, "doc_id long, shard int, first long, n_tokens long, ids_crc32 long"), "orc-digests")
    totals = digests.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toArrow()
    n = totals.column("n").to_numpy()
    base = spark.createDataFrame(pa.table({"shard": totals.column("shard"), "_base": pa.array(n.cumsum() - n, pa.int64())}))
    return digests.join(checked(base), "shard").select("doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Writes `docs` to a folder of its own among the shared ones and reads digests back."""
    path = fresh_path(docs.sparkSession, "token-ids")
    write_documents(docs, path, tokenizer, end_id)
    return digest_files(docs.sparkSession, path)
