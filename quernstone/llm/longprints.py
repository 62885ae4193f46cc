"""SimHash near-dedup at a Jaccard similarity of word shingles, by long fingerprints.

Sets of a similarity of 0.8 differ in some 15 % of fingerprint bits, far beyond what 64 bits
cut into a few segments can bear. So the fingerprint is long: it has as many segments as it
takes for two such sets to agree in one, but for one bit at most, with the target recall.
A segment's wildcard lies in one of its halves, so each segment is dealt out twice, by
either half as it stands; the one-wildcard variants of the other half meet in the task that
has the group, and pairs found are verified on the first 128 bits. A task passes on a
spanning forest, never pairs. What forests join are candidates: their texts meet in
blocks, and only similarities counted on whole sets of shingles become links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, positional, row_key, slices, text_bytes
from .components import checked, components
from .simhash import Forest, blocked, first_of_groups, spread

#: The least similarity, as a fraction; and the share of pairs of just that similarity whose fingerprints shall meet.
LEAST, RECALL = (4, 5), 0.985
#: Bits of half a segment, at least: random members of a group are 2 ** HALF times fewer than fingerprints. Tables of over 2 ** (HALF + ROOM) get longer halves.
HALF, ROOM = 10, 13
#: Bits in which candidates may differ among the first 128. Sets at the least similarity differ in 19, with a deviation of 4; unrelated ones in 64, with one of 5.7.
NEAR = 32
#: Fingerprints of a group that one task compares with each other; larger groups are cut into blocks that meet pairwise.
GROUP = 100_000
#: Shingles (and OWN more for each text) of a block of candidates.
BLOCK, OWN = 1 << 18, 256
_LATER = np.uint64(0x9E3779B97F4A7C15)


def segment_plan(rows: int, half: int = HALF) -> tuple[int, int]:
    """(bits of half a segment, number of segments) for a table of so many rows."""
    half = min(15, max(half, math.ceil(math.log2(max(rows, 2))) - ROOM))
    share = 2 * LEAST[0] / (LEAST[0] + LEAST[1])  # the cosine of two equally large sets at the least similarity
    differ, bits = math.acos(share) / math.pi, 2 * half
    agree = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return half, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct XXH64 of the text's shingles in lower case, sorted; fewer words are one shingle, none are the shingle of the empty text."""
    import xxhash

    own, at, starts = text.lower().split(), 0, []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(own)
    if len(own) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    for w in own:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[words:], len(joined) + 1]
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)], np.uint64))


def long_fingerprint(hashes: np.ndarray, count: int) -> np.ndarray:
    """`count` words of 64 bits: a bit is set if over half of the set's hashes have it, each hash being mixed anew for each word."""
    votes, seeds = np.zeros(64 * count, np.int64), np.arange(1, count + 1, dtype=np.uint64) * _LATER
    for k in range(0, len(hashes), 240):  # sums of bytes stay below 256
        z = hashes[k : k + 240, None] + seeds
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        votes += np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).view(np.uint64)


def _printed(words: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for part in slices(whole, "_text"):
                sets = [shingles(t, words) for t in part.column("_text").to_pylist()]
                node = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
                prints = np.stack([long_fingerprint(s, count) for s in sets])
                two = prints[:, :2].copy().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", "_k1", "_k2")), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array([p.tobytes() for p in prints], pa.binary())],
                    ["_id", "_k1", "_k2", "_node", "_size", "_f1", "_f2", "_print"],
                )

    return run


def segment_values(prints: np.ndarray, half: int, count: int) -> np.ndarray:
    """Values of both halves of each segment, (fingerprints, segments, 2)."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)[:, : 2 * half * count].reshape(len(prints), count, 2, half)
    return bits.astype(np.int32) @ (1 << np.arange(half, dtype=np.int32))


def _dealt(half: int, count: int):
    """Each fingerprint twice for each segment: _key tells segment, half and its value, _other is the other half's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = np.arange(2 * count, dtype=np.int64).reshape(1, count, 2) << half
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                n = batch.num_rows
                values = segment_values(np.frombuffer(b"".join(batch.column("_print").to_pylist()), np.uint64).reshape(n, -1), half, count)
                f1, f2 = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), 2 * count) for c in ("_f1", "_f2"))
                yield pa.RecordBatch.from_arrays([pa.array((values + side).ravel()), pa.array(values[:, :, ::-1].ravel().astype(np.int32)), pa.array(f1), pa.array(f2)], ["_key", "_other", "_f1", "_f2"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def group_forest(other: np.ndarray, prints: np.ndarray, half: int, near: int = NEAR) -> np.ndarray:
    """Of each fingerprint (two words) of a group, one that it is a candidate with, directly or over others.

    Pairs whose `other` agrees but for one bit are compared. Where that would be over 256 a member, whatever is near
    is joined instead: each step compares what has been reached with what hasn't.
    """
    n, order = len(other), np.argsort(other, kind="stable")
    ranked, forest = other[order], Forest(n)
    wanted = np.concatenate((ranked[:, None], ranked[:, None] ^ (1 << np.arange(half, dtype=ranked.dtype))), axis=1)
    low, high = np.searchsorted(ranked, wanted, "left"), np.searchsorted(ranked, wanted, "right")
    low = np.maximum(low, np.arange(1, n + 1)[:, None])  # each pair once
    size = np.maximum(high - low, 0)
    if int(size.sum()) <= 256 * n:
        own = prints[order]
        low, size = low.ravel(), size.ravel()
        some = np.flatnonzero(size)
        cuts = np.searchsorted(np.cumsum(size[some]), np.arange(1 << 20, int(size.sum()) + (1 << 20), 1 << 20))
        for a, b in zip([0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist(), strict=False):
            part = some[a:b]
            m = size[part]
            i = np.repeat(part // (half + 1), m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[part], m)
            hit = _apart(own[i], own[j]) <= near
            forest.link(order[i[hit]], order[j[hit]])
        return forest.roots()
    return spread(n, lambda some, others: _apart(prints[some, None], prints[None, others]) <= near)


def _met(half: int):
    """Forests of groups that come sorted by (_key, _i, _j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def joined():
            other = np.concatenate([h[0] for h in held])
            if len(other) < 2:
                return
            prints = np.concatenate([h[1] for h in held])
            root = group_forest(other, prints, half)
            node = np.flatnonzero(root != np.arange(len(root)))
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(prints[node, 0].view(np.int64)), pa.array(prints[root[node], 0].view(np.int64))], ["_a", "_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("_key", "_i", "_j")], 1)
            other = batch.column("_other").to_numpy()
            prints = np.stack([batch.column(c).to_numpy() for c in ("_f1", "_f2")], 1).view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := tuple(keys[a])) != key:
                    if held:
                        yield from joined()
                    key, held = now, []
                held.append((other[a:b].copy(), prints[a:b].copy()))
        if held:
            yield from joined()

    return run


def candidate_links(classes: DataFrame, half: int, count: int, group: int = GROUP) -> DataFrame:
    """Rows (_a, _b) that join fingerprints (columns _f1, _f2, _print; _f1 is unique) into groups of candidates."""
    dealt = arrow_map(classes.select("_f1", "_f2", "_print"), _dealt(half, count), "_key long, _other int, _f1 long, _f2 long")
    sizes = materialize(dealt.groupBy("_key").agg(F.count("*").alias("_m")).where(F.col("_m") > group).select("_key", F.ceil(F.col("_m") / group).cast("int").alias("_blocks")), "simhash-hot")
    split = not sizes.isEmpty()
    rows = blocked(dealt, sizes, ["_key"], ["_f1"]).drop("_own") if split else dealt.select("*", F.lit(0).alias("_i"), F.lit(0).alias("_j"))
    by = ["_key", "_i", "_j"]
    return materialize(arrow_map(rows.repartition(*(by if split else by[:1])).sortWithinPartitions(*by), _met(half), "_a long, _b long"), "simhash-candidates")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Numbers of hashes that each of `sets` shares with each of `others`."""
    a, b = np.concatenate(sets), np.concatenate(others)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others))
    both = np.intersect1d(a, b)
    in_a, in_b = np.isin(a, both), np.isin(b, both)
    a, of_a, b, of_b = np.searchsorted(both, a[in_a]), of_a[in_a], np.searchsorted(both, b[in_b]), of_b[in_b]
    out, wide = np.zeros((len(sets), len(others)), np.float32), max(64, (1 << 23) // max(len(sets), len(others)))
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, of_a, b, of_b = a[by_a], of_a[by_a], b[by_b], of_b[by_b]
    for low in range(0, len(both), wide):
        x, y = np.zeros((len(sets), wide), np.float32), np.zeros((len(others), wide), np.float32)
        i, j = np.searchsorted(a, [low, low + wide]), np.searchsorted(b, [low, low + wide])
        x[of_a[i[0] : i[1]], a[i[0] : i[1]] - low] = 1
        y[of_b[j[0] : j[1]], b[j[0] : j[1]] - low] = 1
        out += x @ y.T
    return out


def _verified(words: int):
    """Forests of links of the least similarity, for candidates that come sorted by (_root, _i, _j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        key = None

        def joined():
            nodes = np.array(list(held), np.int64)
            block = np.array([b for b, _ in held.values()])
            sets = [s for _, s in held.values()]
            left = np.flatnonzero(block == key[1])
            right = left if key[1] == key[2] else np.flatnonzero(block == key[2])
            if not len(left) or not len(right) or len(nodes) < 2:
                return
            size = np.array([len(s) for s in sets])
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            i, j = np.nonzero(sum(LEAST) * both >= LEAST[0] * (size[left][:, None] + size[right][None, :]))
            forest = Forest(len(nodes))
            forest.link(left[i], right[j])
            root = forest.roots()
            some = np.flatnonzero(root != np.arange(len(nodes)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["_a", "_b"])

        for batch in batches:
            for root, i, j, own, node, text in zip(*(batch.column(c).to_pylist() for c in ("_root", "_i", "_j", "_own", "_node", "_text")), strict=True):
                if (root, i, j) != key:
                    if held:
                        yield from joined()
                    key, held = (root, i, j), {}
                if node not in held:
                    held[node] = own, shingles(text, words)
        if held:
            yield from joined()

    return run


def similar_groups(docs: DataFrame, words: int = 5, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Rows (_id, _k1, _k2, _root) for the rows (_id, _k1, _k2, _text) of `docs`, where equal _k1 and _k2 mean equal rows: _root is the same where links of the least similarity lead.

    Recall of links at exactly the least similarity is RECALL at least, and near 1 from 0.85 on; what is found is exact.
    """
    half, count = segment_plan(docs.count())
    types = "_id long, _k1 long, _k2 long, _node long, _size long, _f1 long, _f2 long, _print binary"
    prints = materialize(arrow_map(docs, _printed(words, -(-2 * half * count // 64)), types), "simhash-prints")
    classes = materialize(prints.groupBy("_f1").agg(F.min(F.struct("_f2", "_print")).alias("_c")).select("_f1", "_c._f2", "_c._print"), "simhash-classes")
    roots = components(candidate_links(classes, half, count, group), "_a", "_b")
    # Each distinct set of a group of candidates, with one row that has it.
    sets = prints.groupBy("_node").agg(F.min(F.struct("_f1", "_size", "_k1", "_k2")).alias("_r")).select("_node", "_r.*")
    sets = materialize(sets.join(checked(roots), sets["_f1"] == roots["node"], "left").select("_node", "_size", "_k1", "_k2", F.coalesce("root", "_f1").alias("_root")), "simhash-sets")
    many = materialize(sets.groupBy("_root").agg(F.count("*").alias("_m"), F.sum(F.col("_size") + OWN).alias("_w")).where("_m > 1").select("_root", F.ceil(F.col("_w") / block).cast("int").alias("_blocks")), "simhash-groups")
    asked = materialize(blocked(sets.join(checked(many.select("_root")), "_root"), many.where("_blocks > 1"), ["_root"], ["_node"]).select("_root", "_i", "_j", "_own", "_node", "_k1", "_k2"), "simhash-asked")
    texts = docs.select("_k1", "_k2", "_text").join(checked(asked), ["_k1", "_k2"]).select("_root", "_i", "_j", "_own", "_node", "_text")
    by = ["_root", "_i", "_j"]
    found = materialize(arrow_map(texts.repartition(*by).sortWithinPartitions(*by), _verified(words), "_a long, _b long"), "simhash-links")
    for done in (classes, sets, many, asked):
        discard(done)
    linked = components(found, "_a", "_b")
    return prints.select("_id", "_k1", "_k2", "_node").join(checked(linked), prints["_node"] == linked["node"], "left").select("_id", "_k1", "_k2", F.coalesce("root", "_node").alias("_root"))


def drop_similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, but of each group only one: that of the least doc_id.

    Texts whose sets of `words`-word shingles (A-Z in lower case) have a Jaccard similarity of 0.8 or more are linked,
    and groups are what links reach. A null text is like an empty one; such texts are one group. Rows
    that are equal in doc_id and text are one. Of several texts of the least doc_id, or of a group
    without doc_id, the one of the least hash stays. No rows, no result; names of other columns don't matter.
    """
    apart, at = positional(docs)
    keyed = apart.select("*", *row_key(at["doc_id"], at["text"]))
    own = keyed.select(F.col(at["doc_id"]).cast("long").alias("_id"), "_k1", "_k2", text_bytes(at["text"], "_text"))
    return first_of_groups(keyed, similar_groups(own, words), docs.columns)
