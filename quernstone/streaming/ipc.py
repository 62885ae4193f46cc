"""Arrow IPC chunks: each is a complete stream of one batch, so that any of them can be read alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def encode_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode_chunk(chunk: bytes) -> list[pa.RecordBatch]:
    with pa.ipc.open_stream(chunk) as stream:
        return list(stream)


def to_chunks(df: DataFrame, rows: int = 65_536) -> Iterator[bytes]:
    """The result in its order, a chunk per `rows` rows at most; an empty result has none.

    Chunks are made on the executors and come partition by partition, so the driver never holds the whole result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield pa.record_batch({"chunk": pa.array([encode_batch(batch.slice(k, rows))], pa.binary())})

    for row in df.mapInArrow(run, "chunk binary").toLocalIterator():
        yield bytes(row["chunk"])


def from_chunks(chunks: Iterable[bytes], schema: pa.Schema | None = None) -> pa.Table:
    batches = [b for c in chunks for b in decode_chunk(c)]
    return pa.Table.from_batches(batches, schema)


def ipc_round_trip(df: DataFrame) -> DataFrame:
    """Every row through an Arrow IPC stream and back, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            with pa.ipc.open_stream(sink.getvalue()) as back:
                yield from back

    return df.mapInArrow(run, df.schema)
