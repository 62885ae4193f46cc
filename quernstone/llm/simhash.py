"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ by at most d bits are cut into d // 2 + 1 segments (two at least), so that
one segment differs by one bit at most. Each segment is indexed once per bit with that
bit as a wildcard: two fingerprints within reach share such a variant. Equal
fingerprints are one class and indexed once. Variants are brought together by an
equality shuffle; within a variant's bucket distances are verified in blocks and only a
spanning forest of the links is passed on, never the pairs. Buckets over BUCKET
fingerprints aren't held by a task: up to a distance of MASKED their members go through d
wildcard bits at once, where equal keys are within reach by construction and a minimum per
key is enough; beyond, they are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, positional, row_key, slices, text_bytes
from .components import checked, components

BITS = 64
#: Fingerprints of a bucket that one task holds (8 bytes each).
BUCKET = 500_000
#: Distances up to which members of larger buckets go through wildcard bits: 64 * 63 / 2 rows each at 2.
MASKED = 2
#: Fingerprints of a bucket that are compared all with all, in blocks; more are looked up mask by mask.
DENSE = 6_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The text's fingerprint, unsigned: a bit is set if over half of the shingles' XXH64 have it; 0 without words."""
    import numpy as np
    import xxhash

    own = text.lower().split()
    n = len(own) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(own), seed) if own else 0
    digest, joined, at = xxhash.xxh64_intdigest, b" ".join(own), 0
    starts = []
    for w in own:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[words:], len(joined) + 1]
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends, strict=False)], dtype=">u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 200):  # sums of bytes stay below 256
        counts += np.unpackbits(hashes[k : k + 200].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprinted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for part in slices(whole, "text"):
                prints = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_k1"), part.column("_k2"), pa.array(prints)], ["doc_id", "_k1", "_k2", "_fp"])

    return run


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of the segments for a distance."""
    m = max(2, distance // 2 + 1)
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            prints = batch.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(prints), 4096):
                own, number = prints[k : k + 4096], 0
                for low, size in segments(distance):
                    part = (own >> np.uint64(low)) & np.uint64((1 << size) - 1)
                    keys = np.empty((size, len(own)), np.uint64)
                    for bit in range(size):
                        # the segment without the bit, and which bit of which segment that is
                        high = (part >> np.uint64(bit + 1)) << np.uint64(bit) if bit + 1 < 64 else np.zeros_like(part)
                        keys[bit] = (np.uint64(number) << np.uint64(57)) | (high | (part & np.uint64((1 << bit) - 1)))
                        number += 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(own, size).view(np.int64))], ["_key", "_fp"])

    return run


class Forest:
    """Labels of nodes 0 to n-1 under links that come in arrays."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.label = np, np.arange(n)

    def roots(self):
        label = self.label
        while True:
            up = label[label]
            if (up == label).all():
                self.label = label
                return label
            label = up

    def link(self, i, j) -> None:
        np = self.np
        while len(i):
            label = self.roots()
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def spread(n: int, near):
    """Roots of 0 to n-1 under links that near(some, others) tells, a matrix: what has been reached is compared with what hasn't."""
    import numpy as np

    rest, root = np.arange(n), np.arange(n)
    while len(rest):
        first, reached, rest = rest[0], [rest[:1]], rest[1:]
        while reached and len(rest):
            now = reached.pop()
            for k in range(0, len(now), 128):
                hit = near(now[k : k + 128], rest).any(0)
                if hit.any():
                    root[rest[hit]] = first
                    reached.append(rest[hit])
                    rest = rest[~hit]
                if not len(rest):
                    break
    return root


def bucket_links(prints, distance: int):
    """(node, root) arrays, a spanning forest of the links among sorted distinct fingerprints."""
    import numpy as np

    n = len(prints)
    forest = Forest(n)
    if n <= DENSE:
        for k in range(0, n, 512):
            near = np.bitwise_count(prints[k : k + 512, None] ^ prints[None, k:]) <= distance
            i, j = np.nonzero(near)
            forest.link(i + k, j + k)
    else:
        differ = int(np.bitwise_or.reduce(prints ^ prints[0]))
        free = [b for b in range(BITS) if differ >> b & 1]
        if sum(comb(len(free), size) for size in range(1, distance + 1)) > n:  # more lookups than comparisons
            root = spread(n, lambda some, others: np.bitwise_count(prints[some, None] ^ prints[None, others]) <= distance)
            node = np.flatnonzero(root != np.arange(n))
            return prints[node], prints[root[node]]
        for size in range(1, distance + 1):
            for bits in combinations(free, size):
                other = prints ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(prints, other), n - 1)
                i = np.flatnonzero((prints[at] == other) & (prints < other))
                forest.link(i, at[i])
    root = forest.roots()
    node = np.flatnonzero(root != np.arange(n))
    return prints[node], prints[root[node]]


def _bucket_links(distance: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(a, b, over=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([over] * len(a), pa.int64())], ["_a", "_b", "_over"])

        def verified(parts) -> pa.RecordBatch | None:
            prints = np.sort(np.concatenate(parts))
            a, b = bucket_links(prints, distance)
            return out(a, b) if len(a) else None

        key, held, size, over = None, [], 0, False
        for batch in batches:  # sorted by key
            keys, prints = batch.column("_key").to_numpy(), batch.column("_fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            # runs of one inside the batch are buckets of one fingerprint; pairs are verified together
            inner = np.zeros(len(sizes), bool)
            inner[1:-1] = True
            pairs = np.flatnonzero(inner & (sizes == 2))
            a, b = prints[cuts[pairs]], prints[cuts[pairs] + 1]
            near = np.bitwise_count(a ^ b) <= distance
            if near.any():
                yield out(np.maximum(a, b)[near], np.minimum(a, b)[near])
            for r in np.flatnonzero(~inner | (sizes > 2)).tolist():
                run_prints = prints[cuts[r] : cuts[r + 1]]
                if keys[cuts[r]] != key:
                    if not over and size > 1 and (found := verified(held)):
                        yield found
                    key, held, size, over = keys[cuts[r]], [], 0, False
                size += len(run_prints)
                held.append(run_prints.copy())
                if size > bucket:
                    over = True
                if over and held:
                    all_held = np.concatenate(held)
                    yield out(all_held, all_held, int(key))
                    held = []
        if not over and size > 1 and (found := verified(held)):
            yield found

    return run


def _block_links(distance: int):
    """Forests of pairs of blocks that come sorted by (_key, _i, _j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def linked(parts) -> Iterator[pa.RecordBatch]:
            a, b = bucket_links(np.unique(np.concatenate(parts)), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["_a", "_b"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("_key", "_i", "_j")], 1)
            prints = batch.column("_fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := tuple(keys[a])) != key:
                    if held:
                        yield from linked(held)
                    key, held = now, []
                held.append(prints[a:b].copy())
        if held:
            yield from linked(held)

    return run


def blocked(rows: DataFrame, sizes: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """`rows` with (_own, _i, _j): the row's block, and 0, 0 where `sizes` (keys, _blocks) has nothing, else once for each pair of blocks that its own is in."""
    own = rows.join(checked(sizes), keys, "left").withColumn("_own", F.pmod(F.xxhash64(*spread_by), F.coalesce("_blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)).alias("_with")
    return own.select("*", other).withColumn("_i", F.least("_own", "_with").cast("int")).withColumn("_j", F.greatest("_own", "_with").cast("int")).drop("_blocks", "_with")


def _masked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            prints = batch.column("_fp").to_numpy().view(np.uint64)
            for number, bits in enumerate(combinations(range(BITS), distance)):
                kept = prints & ~np.uint64(sum(1 << b for b in bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), number, np.int64)), pa.array(kept.view(np.int64)), pa.array(prints.view(np.int64))], ["_mask", "_rest", "_fp"])

    return run


def fingerprint_links(prints: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Rows (_a, _b) that join distinct fingerprints (column _fp) into the groups that links of at most `distance` bits make."""
    if not 0 < distance < 8:
        raise ValueError("distance must be 1 to 7")
    variants = arrow_map(prints.select("_fp"), _variants(distance), "_key long, _fp long")
    dealt = variants.repartition("_key").sortWithinPartitions("_key")
    found = materialize(arrow_map(dealt, _bucket_links(distance, bucket), "_a long, _b long, _over long"), "simhash-links")
    links, over = found.where("_over is null").select("_a", "_b"), found.where("_over is not null").select(F.col("_over").alias("_key"), F.col("_a").alias("_fp"))
    if not over.isEmpty() and distance > MASKED:
        sizes = over.groupBy("_key").agg(F.ceil(F.count("*") / min(bucket, DENSE)).cast("int").alias("_blocks"))
        by = ["_key", "_i", "_j"]
        met = blocked(over, materialize(sizes, "simhash-hot"), ["_key"], ["_fp"]).select(*by, "_fp").repartition(*by).sortWithinPartitions(*by)
        links = links.unionByName(materialize(arrow_map(met, _block_links(distance), "_a long, _b long"), "simhash-block-links"))
    elif not over.isEmpty():
        over = over.select("_fp").distinct()
        masked = materialize(arrow_map(over, _masked(distance), "_mask long, _rest long, _fp long"), "simhash-masked")
        least = materialize(masked.groupBy("_mask", "_rest").agg(F.min("_fp").alias("_b"), F.max("_fp").alias("_most")).where("_b < _most").drop("_most"), "simhash-least")
        links = links.unionByName(masked.join(least, ["_mask", "_rest"]).where("_fp != _b").select(F.col("_fp").alias("_a"), "_b"))
    return links


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for every row of `docs`.

    fingerprint is 16 hexadecimal digits. Rows whose fingerprints differ by at most
    `distance` bits are linked; component_id is the least doc_id that can be reached, itself
    included. A null text has no words, like an empty one: fingerprint zero, linked like any
    other. Repeated rows are linked by their equal fingerprints; a null doc_id is never the
    least (null only if all of a group are). Other columns are ignored.
    """
    return _grouped(docs, words, distance, bucket).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, words: int, distance: int, bucket: int) -> DataFrame:
    """Rows (doc_id, _k1, _k2, _fp, component_id, _group); _k1 and _k2 are row_key of doc_id and text."""
    prints = materialize(arrow_map(docs.select("doc_id", *row_key("doc_id", "text"), text_bytes()), _fingerprinted(words), "doc_id long, _k1 long, _k2 long, _fp long"), "simhash-prints")
    classes = materialize(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "simhash-classes")
    roots = components(fingerprint_links(classes, distance, bucket), "_a", "_b")
    rooted = materialize(classes.join(checked(roots), classes["_fp"] == roots["node"], "left").select("_fp", F.coalesce("root", "_fp").alias("_root"), "_least"), "simhash-rooted")
    least = materialize(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "simhash-least-ids")
    named = materialize(rooted.select("_fp", "_root").join(checked(least), "_root").select("_fp", "component_id", F.col("_root").alias("_group")), "simhash-named")
    return prints.join(checked(named), "_fp")


def first_of_groups(keyed: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Of each group's rows one, with the columns `names`: `keyed` has those (under other names), then _k1 and _k2; `rows` has (_id, _k1, _k2, _root) for each of them.

    The row of the least (_id, _k1, _k2) stays, a null _id last; equal rows are one.
    """
    rows = materialize(rows, "group-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")).alias("_stay")
    stays = materialize(rows.groupBy("_root").agg(F.count("*").alias("_m"), first).where("_m > 1").select("_root", F.col("_stay._k1").alias("_s1"), F.col("_stay._k2").alias("_s2")), "group-stays")
    judged = rows.join(checked(stays), "_root").groupBy("_k1", "_k2").agg(F.max((F.col("_k1") != F.col("_s1")) | (F.col("_k2") != F.col("_s2"))).alias("_gone"))
    judged = materialize(judged, "group-judged")
    marked, own = keyed.join(checked(judged), ["_k1", "_k2"], "left"), [c for c in keyed.columns if c not in ("_k1", "_k2")]
    single = marked.where(F.col("_gone").isNull()).select(*own)
    return single.unionByName(marked.where(~F.col("_gone")).dropDuplicates(["_k1", "_k2"]).select(*own)).toDF(*names)


def drop_near_duplicates(docs: DataFrame, words: int = 5, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs`, with all their columns, but of each group of near_duplicates only one: that of the least doc_id.

    Rows that are equal in doc_id and text are one. Of several texts of the least doc_id, or of a
    group without doc_id, the one of the least hash stays. Names of other columns don't matter.
    """
    apart, at = positional(docs)
    keyed = apart.select("*", *row_key(at["doc_id"], at["text"]))
    grouped = _grouped(keyed.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), words, distance, bucket)
    return first_of_groups(keyed, grouped.select(F.col("doc_id").alias("_id"), "_k1", "_k2", F.col("_group").alias("_root")), docs.columns)
