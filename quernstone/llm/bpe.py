"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

A piece starts as one symbol per byte (its last symbol carries the end-of-word suffix
where the vocabulary has one). The queue holds (rank, position) of adjacent symbols
that merge; the lowest rank goes first, the leftmost of equals. Merging relinks the
list and pushes the two new neighbours; entries whose symbols have changed since are
stale and skipped. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_bytes
from .tokens import Encoder, le32, loaded


class MergeEncoder(Encoder):
    """Encodes with this module's merge loop; keeps ids and decoded text of each word."""

    def __init__(self, path: str, **kw):
        super().__init__(path, **kw)
        model = self.spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = [vocab[s] for s in self.symbols]
        self.last = [vocab[s + suffix] for s in self.symbols]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.decoder = (self.spec.get("decoder") or {}).get("type")
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}

    def merge(self, piece: str) -> list[int]:
        raw = piece.encode()
        if not raw:
            return []
        inner, ranks, merged = self.inner, self.ranks.get, self.merged
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        queue = [(r, i) for i in range(n - 1) if (r := ranks(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks(ids[i] << 32 | ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(ids[i] << 32 | ids[k])) is not None:
                    heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := ranks(ids[h] << 32 | ids[i])) is not None:
                heappush(queue, (r, h))
        return [x for x in ids if x >= 0]

    def value(self, piece: str, ids: list[int]) -> tuple[bytes, bytes]:
        return le32(ids), self.join([self.strings[i] for i in ids])

    def combine(self, values: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return b"".join([v[0] for v in values]), (b"" if self.decoder == "ByteLevel" else b" ").join([v[1] for v in values if v[0]])

    def join(self, strings: list[str]) -> bytes:
        """Vocabulary strings as decoded bytes: one space between them where the file names no decoder, else the bytes that they stand for."""
        if self.decoder == "ByteLevel":
            return b"".join(s.encode() if s in self.special else bytes(map(self.byte_of.__getitem__, s)) for s in strings)
        return " ".join(strings).encode()

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """The whole text's ids and what they decode to."""
        kept = [x for x in self.values(text) if x[0]]
        decoded = (b"" if self.decoder == "ByteLevel" else b" ").join([x[1] for x in kept])
        if self.decoder == "ByteLevel":
            decoded = decoded.decode(errors="replace").encode()
        return b"".join([x[0] for x in kept]), decoded


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(MergeEncoder, path)
        for whole in batches:
            for part in slices(whole, "text"):
                both = [coder.encode_decode(t.decode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) // 4 for i, _ in both], pa.int64()),
                        pa.array([i for i, _ in both], pa.binary()),
                        pa.array([d.decode() for _, d in both], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded) for every row of `docs`, in any order.

    ids are little-endian unsigned 32-bit integers without special tokens added; special
    tokens that stand in a text count. A null text is an empty one: no ids, "" decoded.
    Repeated rows give repeated rows; a null doc_id stays null; other columns are ignored.
    """
    return arrow_map(docs.select("doc_id", text_bytes()), _encoded(tokenizer), "doc_id long, n_tokens long, ids binary, decoded string")


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(MergeEncoder, path)
        for whole in batches:
            for part in slices(whole, "text"):
                rows = []
                for t in part.column(1).to_pylist():
                    ids, decoded = coder.encode_decode(t.decode())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """encode_documents with sha256 digests in place of ids and decoded text, made where the text is encoded."""
    return arrow_map(docs.select("doc_id", text_bytes()), _digested(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, decoded) from rows with doc_id and ids as encode_documents gives them. Null ids decode to ""; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = loaded(MergeEncoder, tokenizer)
        for whole in batches:
            for part in slices(whole, "ids"):
                out = [coder.join([coder.strings[i] for i in np.frombuffer(x, "<u4").tolist()]).decode(errors="replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return arrow_map(encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")), run, "doc_id long, decoded string")
