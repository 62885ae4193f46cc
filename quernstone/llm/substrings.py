"""Suffix-array dedup: bytes under a string of LENGTH bytes that starts anywhere else as well are removed.

Equal windows of LENGTH bytes hold the same least hash of their short substrings (their
anchor), so windows are dealt out by anchor: runs of windows that share an anchor
become one context, its text long enough for all of them. Anchors of one context alone
need no look at texts, unless the anchor comes twice in it: all its windows repeat, or
none. For the others, the distinct contexts are cut from the texts and their windows compared by suffix arrays (suffixes.py).
An anchor with more than HOT distinct contexts isn't held by a task: its windows are dealt
out anew, in blocks by what they have in common, and the blocks' distinct texts compared by suffix
arrays in turn. What more than HOT distinct texts of blocks have in common is all but
a few bytes of a window; their windows are dealt out one by one, and equal ones meet. Spans go back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, positional, retexted, row_key, slices, text_bytes
from .components import checked
from .suffixes import repeated_windows

#: Windows of one context, at most.
RUN = 256
#: Distinct contexts of an anchor, and distinct texts of blocks of one core, that one task holds (under 500 bytes each).
HOT = 1_000
#: Windows of a block of a hot anchor's context.
BLOCK = 8
#: Bytes of contexts that go into one suffix array, about.
BATCH = 1 << 18

_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD1, _ODD2, _ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD2
    x ^= x >> np.uint64(29)
    return x


def substring_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each substring of `size` bytes (a power of two), from hashes of its halves."""
    h, n = _TABLE[raw], 1
    while n < size:
        h = _mixed(h[:-n] * _ODD1 + h[n:]) if len(h) > n else h[:0]
        n *= 2
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n, size = len(h) - width + 1, 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size : width - size + n])


def anchor_size(length: int) -> int:
    """Bytes of the substrings whose hashes are compared: a power of two, a sixth of the window or less."""
    size = 1
    while size * 12 <= length:
        size *= 2
    return size


def contexts(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(anchor, first window, number of windows, whether the anchor comes twice) of the text's runs of windows with one anchor."""
    size = anchor_size(length)
    hashes = substring_hashes(np.frombuffer(raw, np.uint8), size)
    least = window_minima(hashes, length - size + 1)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(least)])))
    if count.max() > RUN:  # long runs are cut from their start on
        parts = -(-count // RUN)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        anchors, count = np.repeat(least[first], parts), np.minimum(RUN, np.repeat(count, parts) - RUN * inner)
        first = np.repeat(first, parts) + RUN * inner
    else:
        anchors = least[first]
    # Two equal windows of one run hold the anchor at two places.
    twice = [np.count_nonzero(hashes[a:b] == v) > 1 for a, b, v in zip(first.tolist(), (first + count + length - size).tolist(), anchors, strict=True)]
    return anchors, first, count, twice


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                at, anchors, firsts, counts, twice, hashes = [], [], [], [], [], []
                for row, raw in enumerate(part.column(2).to_pylist()):
                    if len(raw) < length:
                        continue
                    a, f, c, t = contexts(raw, length)
                    at.append(np.full(len(a), row, np.int32))
                    anchors.append(a)
                    firsts.append(f)
                    counts.append(c)
                    twice += t
                    hashes += [digest(raw[s:e]) for s, e in zip(f.tolist(), (f + c + length - 1).tolist(), strict=True)]
                if not at:
                    continue
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        part.column(1).take(take),
                        pa.array(np.concatenate(anchors).view(np.int64)),
                        pa.array(np.array(hashes, np.uint64).view(np.int64)),
                        pa.array(np.concatenate(firsts), pa.int32()),
                        pa.array(np.concatenate(counts), pa.int32()),
                        pa.array(twice, pa.bool_()),
                    ],
                    ["_k1", "_k2", "_anchor", "_context", "_first", "_count", "_twice"],
                )

    return run


def _cut(length: int):
    """Texts of contexts from rows (text, _wanted: array of (_anchor, _context, _first, _count))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                rows = []
                for raw, wanted in zip(part.column("text").to_pylist(), part.column("_wanted").to_pylist(), strict=True):
                    rows += [(w["_anchor"], w["_context"], raw[w["_first"] : w["_first"] + w["_count"] + length - 1]) for w in wanted]
                if rows:
                    a, c, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(b, pa.binary())], ["_anchor", "_context", "_bytes"])

    return run


def runs_of(starts: np.ndarray) -> list[int]:
    """Sorted numbers as first, last, first, last, ... of their unbroken runs."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > 1)
    return np.stack((starts[np.concatenate(([0], new + 1))], starts[np.concatenate((new, [len(starts) - 1]))]), 1).ravel().tolist()


def _compared(length: int):
    """Repeated windows of contexts that come sorted by _anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None

        def flush():
            found = repeated_windows(list(held.values()), length)
            rows = [(*key, runs_of(starts)) for key, starts in zip(held, found, strict=True) if len(starts)]
            if rows:
                a, c, r = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.list_(pa.int32()))], ["_anchor", "_context", "_runs"])

        for batch in batches:
            for anchor, context, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if anchor != last and size >= BATCH:
                    yield from flush()
                    held, size = {}, 0
                last = anchor
                held.setdefault((anchor, context), raw)  # repeated rows of one document bring a context twice
                size += len(raw)
        if held:
            yield from flush()

    return run


def _blocks(length: int):
    """Blocks of windows of the contexts of hot anchors.

    A window's distance to its anchor's first place in it is the same in equal windows, so windows
    of one context are cut into blocks by that distance, BLOCK at a time. What all windows of
    a block have in common (_core) deals the blocks out anew; _sub tells blocks of one core apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, size = xxhash.xxh3_64_intdigest, anchor_size(length)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for anchor, context, raw in zip(*(part.column(c).to_pylist() for c in ("_anchor", "_context", "_bytes")), strict=True):
                    n = len(raw) - length + 1
                    places = np.flatnonzero(substring_hashes(np.frombuffer(raw, np.uint8), size).view(np.int64) == anchor)
                    start = np.arange(n)
                    place = places[np.searchsorted(places, start)]
                    level = (place - start) // BLOCK
                    cuts = np.flatnonzero(np.diff(place) | np.diff(level)) + 1
                    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                        top = int(place[first] - level[first] * BLOCK)  # the last window that the block can have
                        core = digest(b"%d %d " % (anchor, level[first]) + raw[top : top + length - BLOCK + 1])
                        own = raw[first : end + length - 1]
                        rows.append((anchor, context, core - (1 << 63), digest(own) - (1 << 63), first, end - first, own))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["_anchor", "_context", "_core", "_sub", "_from", "_count", "_bytes"])

    return run


def _windows(length: int):
    """Each window of the blocks' texts by itself: its block, its start there and 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column("_bytes").to_pylist()
            if texts:
                counts = np.array([len(t) - length + 1 for t in texts])
                of = pa.array(np.repeat(np.arange(len(texts)), counts))
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[s : s + length]) for t, n in zip(texts, counts.tolist(), strict=True) for s in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("_core").take(of), batch.column("_sub").take(of), pa.array(at.astype(np.int32)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["_core", "_sub", "_at", "_w1", "_w2"])

    return run


def _hot_windows(contexts_: DataFrame, length: int, hot: int) -> DataFrame:
    """Rows (_anchor, _context, _runs) of the repeated windows of hot anchors' distinct contexts.

    Blocks go the way of contexts, with their cores as anchors: a core of one block has no repeated window, blocks of one
    text repeat as a whole, and the distinct texts of a core are compared by suffix arrays. Only the windows of
    cores with more than `hot` distinct texts are dealt out singly: a window is its own core then, and one that comes twice repeats.
    """
    blocks = materialize(arrow_map(contexts_, _blocks(length), "_anchor long, _context long, _core long, _sub long, _from int, _count int, _bytes binary"), "substring-blocks")
    cores = materialize(blocks.groupBy("_core").agg(F.count("*").alias("_n"), F.min("_sub").alias("_s1"), F.max("_sub").alias("_s2")).where("_n > 1").select("_core", (F.col("_s1") < F.col("_s2")).alias("_differ")), "substring-cores")
    shared = materialize(blocks.join(checked(cores), "_core"), "substring-shared-blocks")
    discard(blocks)
    texts = materialize(shared.where("_differ").groupBy("_core", "_sub").agg(F.count("*").alias("_n"), F.any_value("_bytes").alias("_bytes")), "substring-block-texts")
    crowded = materialize(texts.groupBy("_core").agg(F.count("*").alias("_m")).where(F.col("_m") > hot).select("_core"), "substring-hot-cores")
    some_hot = not crowded.isEmpty()
    cold = texts.join(checked(crowded), "_core", "left_anti") if some_hot else texts
    dealt = cold.select(F.col("_core").alias("_anchor"), F.col("_sub").alias("_context"), "_bytes").repartition("_anchor").sortWithinPartitions("_anchor")
    found = materialize(arrow_map(dealt, _compared(length), "_anchor long, _context long, _runs array<int>"), "substring-found-blocks")
    if some_hot:
        windows = materialize(arrow_map(texts.join(checked(crowded), "_core", "left_semi").select("_core", "_sub", "_bytes"), _windows(length), "_core long, _sub long, _at int, _w1 long, _w2 long"), "substring-windows")
        often = materialize(windows.groupBy("_w1", "_w2").agg(F.count("*").alias("_n")).where("_n > 1").select("_w1", "_w2"), "substring-often")
        hits = windows.join(checked(often), ["_w1", "_w2"]).groupBy(F.col("_core").alias("_anchor"), F.col("_sub").alias("_context"))
        found = found.unionByName(hits.agg(F.flatten(F.collect_list(F.array("_at", "_at"))).alias("_runs")))
    # A text that occurs twice repeats as a whole.
    whole = texts.where("_n > 1").select("_core", "_sub", F.lit(True).alias("_whole"))
    verdicts = materialize(found.toDF("_core", "_sub", "_runs").join(whole, ["_core", "_sub"], "full"), "substring-block-verdicts")
    entire = F.array(F.col("_from"), F.col("_from") + F.col("_count") - 1)
    single = shared.where(~F.col("_differ")).select("_anchor", "_context", entire.alias("_r"))
    others = shared.where("_differ").join(verdicts, ["_core", "_sub"]).select("_anchor", "_context", F.when(F.col("_whole"), entire).otherwise(F.transform("_runs", lambda r: r + F.col("_from"))).alias("_r"))
    return single.unionByName(others).groupBy("_anchor", "_context").agg(F.flatten(F.collect_list("_r")).alias("_runs"))


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """Rows (_k1, _k2, _spans): for each document (row_key of doc_id and text) the first bytes and ends of what repeats, unsorted, overlapping.

    Its own windows count as elsewhere where they start at another byte. Texts under `length` bytes have none.
    """
    if length < 12:
        raise ValueError("length must be 12 or more")
    keyed = docs.select(*row_key("doc_id", "text"), text_bytes())
    occurrences = materialize(arrow_map(keyed, _occurrences(length), "_k1 long, _k2 long, _anchor long, _context long, _first int, _count int, _twice boolean"), "substring-runs")
    anchors = materialize(occurrences.groupBy("_anchor").agg(F.count("*").alias("_n"), F.min("_context").alias("_c1"), F.max("_context").alias("_c2"), F.max("_twice").alias("_t")).where("_n > 1 or _t").select("_anchor", ((F.col("_c1") < F.col("_c2")) | F.col("_t")).alias("_differ")), "substring-anchors")
    shared = materialize(occurrences.drop("_twice").join(checked(anchors), "_anchor"), "substring-shared")
    discard(occurrences)
    # Where an anchor's contexts differ, each distinct one is taken from one document.
    distinct = materialize(shared.where("_differ").groupBy("_anchor", "_context").agg(F.count("*").alias("_n"), F.min(F.struct("_k1", "_k2", "_first", "_count")).alias("_at")), "substring-contexts")
    crowded = materialize(distinct.groupBy("_anchor").agg(F.count("*").alias("_m")).where(F.col("_m") > hot).select("_anchor", F.lit(True).alias("_hot")), "substring-hot")
    wanted = distinct.select("_at._k1", "_at._k2", F.struct("_anchor", "_context", "_at._first", "_at._count").alias("_w")).groupBy("_k1", "_k2").agg(F.collect_list("_w").alias("_wanted"))
    wanted = materialize(wanted, "substring-wanted")
    cut = arrow_map(keyed.join(wanted, ["_k1", "_k2"]).select("text", "_wanted"), _cut(length), "_anchor long, _context long, _bytes binary")
    texts = materialize(cut, "substring-texts")
    some_hot = not crowded.isEmpty()
    cold = texts.join(checked(crowded), "_anchor", "left_anti") if some_hot else texts
    found = materialize(arrow_map(cold.repartition("_anchor").sortWithinPartitions("_anchor"), _compared(length), "_anchor long, _context long, _runs array<int>"), "substring-found")
    if some_hot:
        distinct_hot = texts.join(checked(crowded), "_anchor", "left_semi").dropDuplicates(["_anchor", "_context"])
        found = found.unionByName(materialize(_hot_windows(distinct_hot, length, hot), "substring-found-hot"))
    # A context that occurs twice repeats as a whole.
    whole = distinct.where("_n > 1").select("_anchor", "_context", F.lit(True).alias("_whole"))
    verdicts = materialize(found.select("_anchor", "_context", "_runs").join(whole, ["_anchor", "_context"], "full"), "substring-verdicts")
    span = lambda a, b: F.array(F.struct((F.col("_first") + a).alias("a"), (F.col("_first") + b + F.lit(length)).alias("b")))
    entire = span(F.lit(0), F.col("_count") - 1)
    parts = F.transform(F.sequence(F.lit(0), F.expr("cast(size(_runs) div 2 - 1 as int)")), lambda i: F.struct((F.col("_first") + F.get("_runs", 2 * i)).alias("a"), (F.col("_first") + F.get("_runs", 2 * i + 1) + F.lit(length)).alias("b")))
    single = shared.where(~F.col("_differ")).select("_k1", "_k2", entire.alias("_s"))
    others = shared.where("_differ").join(verdicts, ["_anchor", "_context"]).select("_k1", "_k2", F.when(F.col("_whole"), entire).otherwise(parts).alias("_s"))
    return single.unionByName(others).groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("_s")).alias("_spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as sorted maximal runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _removed(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                rows = []
                for raw, spans in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    runs = merged([(s["a"], s["b"]) for s in spans or ()])
                    kept, at = [], 0
                    for a, b in runs:
                        kept.append(raw[at:a])
                        at = b
                    kept = b"".join([*kept, raw[at:]]) if runs else raw
                    rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digests else kept))
                n, r, s, k = zip(*rows, strict=True)
                fixed = [pa.array(x, pa.int64()) for x in (n, r, s)]
                if digests:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *fixed, pa.array(k, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_k1"), part.column("_k2"), *fixed, pa.array(k, pa.binary())], ["doc_id", "_k1", "_k2", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _with_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    spans = materialize(repeated_spans(docs, length, hot), "substring-spans")
    return docs.select("doc_id", *row_key("doc_id", "text"), text_bytes()).join(spans, ["_k1", "_k2"], "left")


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, _k1, _k2, n_bytes, n_removed, n_spans, kept) for every row of `docs`; kept is what is left of the text, as bytes.

    Every byte goes that lies in a string of `length` bytes (of UTF-8) which also starts
    elsewhere, in the same document or another; no copy is spared. n_spans counts unbroken runs of
    removed bytes. A null text is empty. Repeated rows repeat each other. doc_id may be null;
    _k1 and _k2 identify the row (row_key of doc_id and text). Other columns are ignored. A cut
    can fall inside a character, so kept needn't be valid UTF-8.
    """
    return arrow_map(_with_spans(docs, length, hot), _removed(False), "doc_id long, _k1 long, _k2 long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest_repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """remove_repeats with the sha256 of what is left in its place."""
    return arrow_map(_with_spans(docs, length, hot), _removed(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """The rows of `docs`, all of them and with all their columns, their texts without what remove_repeats removes.

    Bytes left of a character that was cut go as well. A null text stays null; a null doc_id and repeated
    rows are as in remove_repeats; no rows, no result; names of other columns don't matter.
    """
    apart, at = positional(docs)
    spans = materialize(repeated_spans(apart.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), length, hot), "substring-spans")

    def left(text: bytes, own) -> bytes:
        kept, at = [], 0
        for a, b in merged([(s["a"], s["b"]) for s in own]):
            kept.append(text[at:a])
            at = b
        return b"".join([*kept, text[at:]])

    return retexted(docs, spans, "_spans", left)
