"""Packing documents into training sequences: best-fit decreasing.

Each document is encoded once and cut: full windows first, then its remainder. Pieces
are dealt to shards by a hash of their place of origin, about SHARD pieces each, and
each shard is packed on its own, the longest piece first, into the open window that
leaves least room. A segment tree over remaining capacity finds that window. Only
piece metadata is shuffled, unless the ids themselves are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices, text_bytes
from .tokens import Encoder, le32, loaded

#: Pieces of a shard, about. A shard leaves at most about one window part empty.
SHARD = 2048


class OpenWindows:
    """Windows by remaining capacity: a segment tree counts them, stacks hold them."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.used: list[int] = []

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of `need` or more that some window has."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        room = self.tightest(length)
        if room is None:
            w, room = len(self.used), self.window
            self.used.append(0)
        else:
            w = self.at[room].pop()
            self._add(room, -1)
        offset = self.used[w]
        self.used[w] += length
        if left := room - length:
            self.at[left].append(w)
            self._add(left, 1)
        return w, offset


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; equal lengths keep their order."""
    windows = OpenWindows(window)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = windows.place(lengths[i])
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _task int, _n long"


def _cut(tokenizer: str, end_id: int | None, window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, task, made = loaded(Encoder, tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else le32([end_id])
        for whole in batches:
            for part in slices(whole, "text"):
                rows, parts = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = coder.ids(text.decode()) + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, task, made))
                        made += 1
                        if keep_ids:
                            parts.append(piece)
                if not rows:
                    continue
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_n"]
                if keep_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _packed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            placed = best_fit_decreasing(t.column("length").to_pylist(), window)
            t = t.drop_columns(["_shard", "_task", "_n"])
            t = t.append_column("sequence_id", pa.array([shard << 24 | w for w, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
            return t.to_batches()[0]

        open_shard, held = None, []
        for batch in batches:  # a shard's rows follow each other
            shards = batch.column("_shard").to_pylist()
            at = 0
            while at < len(shards):
                to = at
                while to < len(shards) and shards[to] == shards[at]:
                    to += 1
                if held and shards[at] != open_shard:
                    yield pack(open_shard, held)
                    held = []
                open_shard = shards[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield pack(open_shard, held)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1, keep_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with `keep_ids`.

    A document is its ids and `end_id`; a null or empty text is `end_id` alone (nothing
    without one). start counts the document's ids before the piece; offset is the piece's
    place in its sequence, gapless from 0. Sequences hold `window` ids at most. Repeated
    rows are packed once each; a null doc_id stays null; other columns are ignored.
    """
    types = _PIECE + (", ids binary" if keep_ids else "")
    pieces = materialize(arrow_map(docs.select("doc_id", text_bytes()), _cut(tokenizer, end_id, window, keep_ids), types), "packing-pieces")
    shards = max(1, -(-pieces.count() // max(1, shard)))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_task", "_n"), F.lit(shards)))
    dealt = dealt.repartition("_shard").sortWithinPartitions("_shard", F.desc("length"), "_task", "_n")
    done = types.replace(", _task int, _n long", "") + ", sequence_id long, offset long"
    return arrow_map(dealt, _packed(window), done)
