"""Embedding near-dedup with an inverted multi-index.

Codebooks are learned for each half of the vectors on their own; together they span a
product grid of cells, and every vector is listed in the cell of its nearest centroids.
A query visits cells in order of the sum of its two distances (the multi-sequence
traversal: a frontier over two sorted lists), as many as it takes for the target recall
on links that just reach the threshold; cosines are verified in double precision.

Equal vectors are one class and indexed once. Dense regions are found in a sample and
kept out of the index: a region has the vectors within the threshold's angle of its
centre. Those within half of it, its core, are linked with each other by the triangle
inequality and never compared; its rim, and whatever lies near enough outside to reach a
member, meets it in blocks, so links of a region's members are complete. The index has
the rest; a hot cell is split into blocks that meet pairwise. A pair that both sides can
find counts in the cell with the smaller number. Tasks pass on sums and spanning forests,
never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, row_key
from .components import checked, components
from .simhash import Forest

#: Vectors that codebooks are fitted to, at most, and centroids per half, at most.
SAMPLE, CENTROIDS = 65_536, 4_096
#: Vectors per cell that the number of centroids aims at.
PER_CELL = 32
#: Members of a cell from which it is hot, which is also the size of its blocks; probes that meet a block in one task.
HOT, PROBES = 512, 8_192
#: Sample rows that dense regions are looked for in; how many of them make a region, at least; blocks of a region are so many times a hot cell's.
DENSE, CLOSE, WIDE = 8_192, 16, 8


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids by Lloyd's rounds from random rows; empty ones start anew at the worst-served rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            d = nearest(x[a : a + 4096], centroids)
            own[a : a + 4096] = d.argmin(1)
            far[a : a + 4096] = d.min(1)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.cumsum(np.concatenate(([0], n[:-1])))
        full = n > 0
        centroids[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full, None]
        if (~full).any():
            centroids[~full] = x[np.argsort(-far)[: (~full).sum()]]
    return centroids


@dataclass
class Index:
    """Codebooks of the halves, the dimension, and how many cells a query visits."""

    first: np.ndarray
    second: np.ndarray
    dim: int
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dim // 2
        return nearest(unit[:, :half], self.first), nearest(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cells in visiting order, row by row: multi-sequence traversal, all rows in step.

        Both lists are sorted; row i of the first list keeps a pointer into the second, and
        each step takes the least sum on the frontier. A row of the first list is opened when
        the one before it has been taken once, so sums come out in ascending order.
        """
        d1, d2 = self.distances(unit)
        n, k2 = len(unit), d2.shape[1]
        deep = min(self.visits, d1.shape[1])
        wide = min(self.visits, k2)
        o1 = np.argsort(d1, axis=1, kind="stable")[:, :deep]
        o2 = np.argsort(d2, axis=1, kind="stable")[:, :wide]
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        s2 = np.concatenate((s2, np.full((n, 1), np.inf)), axis=1)
        steps = min(self.visits, deep * wide)
        pointer = np.zeros((n, deep), np.int64)
        frontier = np.full((n, deep), np.inf)
        frontier[:, 0] = s1[:, 0] + s2[:, 0]
        out, rows = np.empty((n, steps), np.int64), np.arange(n)
        for step in range(steps):
            i = frontier.argmin(1)
            j = pointer[rows, i]
            out[:, step] = o1[rows, i] * k2 + o2[rows, np.minimum(j, wide - 1)]
            pointer[rows, i] = j + 1
            frontier[rows, i] = s1[rows, i] + s2[rows, np.minimum(j + 1, wide)]
            opened = np.flatnonzero((j == 0) & (i + 1 < deep))
            frontier[opened, i[opened] + 1] = s1[opened, i[opened] + 1] + s2[opened, 0]
        return out


def dense_centres(sample: np.ndarray, total: int, threshold: float, hot: int = HOT) -> np.ndarray:
    """Mean directions of the regions of unit rows `sample` (of `total` vectors) that hold about `hot` vectors or more within the threshold's angle."""
    rng = np.random.default_rng(13)
    x = sample if len(sample) <= DENSE else sample[rng.choice(len(sample), DENSE, replace=False)]
    near = np.concatenate([x[a : a + 512] @ x.T >= threshold for a in range(0, len(x), 512)])
    count, alive, centres = near.sum(1), np.ones(len(x), bool), []
    least = max(CLOSE, hot * len(x) / total)
    while len(x) and (count[first := int(count.argmax())]) >= least:
        centre = x[near[first] & alive].mean(0)
        centre /= max(np.linalg.norm(centre), 1e-12)
        gone = alive & (x @ centre >= threshold)
        gone[first] = True
        centres.append(centre)
        alive &= ~gone
        count -= near[:, gone].sum(1)
        count[~alive] = 0
    return np.array(centres).reshape(-1, x.shape[1])


def fit(sample: np.ndarray, total: int, threshold: float, recall: float = 0.995, per_cell: int = PER_CELL) -> Index:
    """Codebooks for `total` vectors from unit rows `sample`, and the visits that find `recall` of links that just reach `threshold`.

    Those links are made up from sample rows, each with a random partner at exactly the
    threshold; a link is found when either visits the other's cell.
    """
    n, dim = sample.shape
    half = dim // 2
    k = max(1, min(CENTROIDS, n, round((total / per_cell) ** 0.5)))
    index = Index(codebook(sample[:, :half], k), codebook(sample[:, half:], k), dim, 1)
    rng = np.random.default_rng(11)
    x = sample[rng.choice(n, min(n, 2000), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    y = threshold * x + (1 - threshold**2) ** 0.5 * noise

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells that a visits before b's."""
        (a1, a2), (b1, b2) = index.distances(a), index.distances(b)
        rows = np.arange(len(a))
        own = a1[rows, b1.argmin(1)] + a2[rows, b2.argmin(1)]
        a2.sort(axis=1)
        return np.array([np.searchsorted(a2[r], own[r] - a1[r], "left").sum() for r in rows])

    needed = np.sort(np.minimum(rank(x, y), rank(y, x))) + 1
    index.visits = int(min(k * k, max(4, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])))
    return index


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _placed(index: Index, kind: str, centres: np.ndarray, threshold: float):
    """Region g's core is cell -2g-1 and its rim -2g-2. _meets has the cells of regions that hold what a row may link with, each pair of regions once."""
    angle, slack = float(np.arccos(min(1.0, threshold))), 1e-9
    half, reach, far = (float(np.cos(min(np.pi, x))) for x in (angle / 2 - slack, 1.5 * angle + slack, 2 * angle + slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                unit = unit_rows(batch.column("_vec").to_pylist(), kind)
                n, rows = len(unit), np.arange(len(unit))
                own, core, meets = np.full(n, -1), np.zeros(n, bool), (np.empty(0, np.int64), np.empty(0, np.int64))
                if len(centres):
                    close = unit @ centres.T
                    best = close.argmax(1)
                    own = np.where(close[rows, best] >= threshold, best, -1)
                    core = (own >= 0) & (close[rows, best] >= half)
                    before = (own[:, None] < 0) | (np.arange(len(centres)) < own[:, None])
                    to_core, to_rim = before & (close >= reach - slack), before & (close >= far - slack)
                    rim = np.flatnonzero((own >= 0) & ~core)
                    to_core[rim, own[rim]] = True
                    (i, g), (j, h) = np.nonzero(to_core), np.nonzero(to_rim)
                    meets = np.concatenate((i, j)), np.concatenate((-2 * g - 1, -2 * h - 2))
                order = np.argsort(meets[0], kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(meets[0], minlength=n)))).astype(np.int32)
                out = np.flatnonzero(own < 0)
                cells = index.cells(unit[out]) if len(out) else np.empty((0, 1), np.int64)
                home = np.where(core, -2 * own - 1, -2 * own - 2)
                home[out] = cells[:, 0]
                starts = np.concatenate(([0], np.cumsum(np.where(own < 0, cells.shape[1], 0)))).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(starts), pa.array(cells.ravel()))
                met = pa.ListArray.from_arrays(pa.array(ends), pa.array(meets[1][order].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_node"), batch.column("_n"), batch.column("_vec"), pa.array(home.astype(np.int64)), visits, met], ["_node", "_n", "_vec", "_home", "_visits", "_meets"])

    return run


def _joined(forest: Forest, hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Links left[i] with right[j] where hit[i, j]; what one link of each j joins already isn't listed."""
    j = np.flatnonzero(hit.any(0))
    forest.link(left[hit.argmax(0)[j]], right[j])
    label = forest.roots()
    i, j = np.nonzero(hit & (label[left][:, None] != label[right][None, :]))
    forest.link(left[i], right[j])


def _verified(threshold: float, kind: str):
    """Rows come sorted by (_cell, _block, _salt, _probe): members first, then probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(t) -> tuple:
            return unit_rows(t.column("_vec").to_pylist(), kind), *(t.column(c).to_numpy() for c in ("_node", "_n", "_home"))

        def members_of(parts: list[pa.RecordBatch]) -> tuple:
            t = pa.Table.from_batches(parts).combine_chunks()
            visits = t.column("_visits").combine_chunks()
            visits = visits.chunk(0) if isinstance(visits, pa.ChunkedArray) else visits
            return *rows_of(t), visits.flatten().to_numpy().reshape(t.num_rows, -1)

        def out(nodes, links, forest) -> pa.RecordBatch | None:
            some = np.flatnonzero(links > 0)
            if not len(some):
                return None
            root = forest.roots()
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(nodes[root[some]])], ["_node", "_links", "_root"])

        def inner(m, cell: int) -> pa.RecordBatch | None:
            if cell < 0 and cell % 2:
                return None  # a core
            unit, node, n, _, _ = m
            links, forest, every = np.zeros(len(node)), Forest(len(node)), np.arange(len(node))
            for a in range(0, len(node), 512):
                hit = np.triu(unit[a : a + 512] @ unit[a:].T >= threshold, 1)
                if hit.any():
                    count = hit.astype(np.float64)
                    links[a : a + 512] += count @ n[a:]
                    links[a:] += n[a : a + 512] @ count
                    _joined(forest, hit, every[a : a + 512], every[a:])
            return out(node, links, forest)

        def outer(m, probes: pa.RecordBatch, cell: int) -> pa.RecordBatch | None:
            unit, node, n, _, seen = m
            p_unit, p_node, p_n, p_home = rows_of(probes)
            hit = unit @ p_unit.T >= threshold
            if not hit.any():
                return None
            if cell >= 0:
                i, j = np.nonzero(hit)
                elsewhere = (seen[i] == p_home[j][:, None]).any(1) & (p_home[j] < cell)
                hit[i[elsewhere], j[elsewhere]] = False
            count = hit.astype(np.float64)
            links = np.concatenate((count @ p_n, n @ count))
            forest = Forest(len(node) + len(p_node))
            _joined(forest, hit, np.arange(len(node)), np.arange(len(p_node)) + len(node))
            return out(np.concatenate((node, p_node)), links, forest)

        key, parts, members = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("_cell", "_block", "_salt")], 1)
            probe = batch.column("_probe").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (probe[1:] != probe[:-1])) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=False):
                a, b = int(a), int(b)
                now = tuple(keys[a])
                if now != key:
                    if parts and members is None and key[2] == 0 and (found := inner(members_of(parts), int(key[0]))):
                        yield found
                    key, parts, members = now, [], None
                if not probe[a]:
                    parts.append(batch.slice(a, b - a))
                    continue
                if not parts:
                    continue  # nobody lives in this cell
                if members is None:
                    members = members_of(parts)
                    if key[2] == 0 and (found := inner(members, int(key[0]))):
                        yield found
                for s in range(a, b, 1024):
                    if found := outer(members, batch.slice(s, min(1024, b - s)), int(key[0])):
                        yield found
        if parts and members is None and key[2] == 0 and (found := inner(members_of(parts), int(key[0]))):
            yield found

    return run


def class_links(classes: DataFrame, kind: str, dim: int, threshold: float, hot: int = HOT, probes: int = PROBES, index: Index | None = None) -> DataFrame:
    """Rows (_node, _links, _root), some for each node with links: vectors linked, and a node of the same component.

    `classes` has a row for each distinct valid vector: _node (unique), _n (its copies), _vec (bytes of numbers of `kind`).
    """
    total = classes.count()
    empty = classes.sparkSession.createDataFrame([], "_node long, _links long, _root long")
    if total < 2:
        return empty
    share = min(1.0, 1.2 * SAMPLE / total)
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(5), "_node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("_vec").limit(SAMPLE).toArrow()
    sample = unit_rows(drawn.column(0).to_pylist(), kind) if drawn.num_rows else np.empty((0, dim))
    centres = dense_centres(sample, total, threshold, hot)
    if index is None:
        rest = sample[(sample @ centres.T < threshold).all(1)] if len(centres) else sample
        rest, part = (rest, len(rest) / len(sample)) if len(rest) else (sample, 1.0)
        index = fit(rest, max(2, round(total * part)), threshold)
    types = "_node long, _n long, _vec binary, _home long, _visits array<long>, _meets array<long>"
    placed = materialize(arrow_map(classes, _placed(index, kind, centres, threshold), types), "vectors-placed")
    core = lambda c: (F.col(c) < 0) & (F.pmod(F.col(c), F.lit(2)) == 1)
    sums = empty
    if len(centres):
        # Within half the angle of one direction, any two are within the whole.
        grouped = placed.where(core("_home"))
        of = grouped.groupBy("_home").agg(F.sum("_n").alias("_sum"), F.min("_node").alias("_root"), F.count("*").alias("_members")).where("_members > 1")
        sums = grouped.join(F.broadcast(of), "_home").select("_node", (F.col("_sum") - F.col("_n")).alias("_links"), "_root")
    seekers = placed.select("*", F.explode(F.concat(F.slice("_visits", 2, max(1, index.visits)), "_meets")).alias("_cell"))
    sizes = placed.groupBy(F.col("_home").alias("_cell")).agg(F.count("*").alias("_m"))
    sought = seekers.groupBy("_cell").agg(F.count("*").alias("_p"))
    blocks = materialize(sizes.join(sought, "_cell", "left").where((F.col("_m") > hot) | (F.col("_p") > probes)).select("_cell", F.ceil(F.col("_m") / F.when(F.col("_cell") < 0, WIDE * hot).otherwise(hot)).cast("int").alias("_blocks"), F.coalesce(F.ceil(F.col("_p") / probes), F.lit(1)).cast("int").alias("_salts")), "vectors-hot")
    blocks = checked(blocks)
    one = lambda c: F.coalesce(c, F.lit(1))
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "_node"), one(F.col(n))).cast("int")
    common = ["_cell", "_block", "_salt", "_probe", "_node", "_n", "_vec", "_home", "_visits"]
    homes = placed.withColumn("_cell", F.col("_home")).join(blocks, "_cell", "left").withColumn("_block", spread("_blocks", 3))
    members = homes.withColumn("_salt", F.explode(F.sequence(F.lit(0), one(F.col("_salts")) - 1))).withColumn("_probe", F.lit(0))
    # Members of a hot cell meet the blocks before their own, unless it is a core.
    between = homes.where((F.col("_block") > 0) & ~core("_home")).withColumn("_own", F.col("_block")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_own") - 1))).withColumn("_salt", spread("_salts", 4)).withColumn("_probe", F.lit(1))
    outside = seekers.join(blocks, "_cell", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), one(F.col("_blocks")) - 1))).withColumn("_salt", spread("_salts", 4)).withColumn("_probe", F.lit(1))
    # only members' visits are asked for
    probing = between.select(common).unionByName(outside.select(common)).withColumn("_visits", F.lit(None).cast("array<long>"))
    dealt = members.select(common).unionByName(probing).repartition("_cell", "_block", "_salt").sortWithinPartitions("_cell", "_block", "_salt", "_probe")
    return materialize(arrow_map(dealt, _verified(threshold, kind), "_node long, _links long, _root long").unionByName(sums), "vectors-links")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, hot: int = HOT, probes: int = PROBES) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    n_links counts the other rows whose cosine is `threshold` or more; component_id is the least
    vec_id that links reach, itself included; kept says that it is the row's own. A vector that
    is null, empty or zero, or holds a null or non-finite component, links with nothing; vectors of
    different dimensions don't link, and each dimension (a table has few) is indexed on its own. Repeated rows
    link with each other; a null vec_id is never the least. Other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    number, kind = ("float", "<f4") if element == "float" else ("double", "<f8")
    big = F.lit(float("inf")).cast(number)
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{number}>").alias("_e"))
    fine = F.col("_e").isNotNull() & (F.size("_e") > 0) & F.forall("_e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists("_e", lambda v: v != 0)
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    out = _alone(rows.where("not _fine"))
    for (dim,) in rows.where("_fine").select(F.size("_e").alias("d")).distinct().orderBy("d").collect():
        own = rows.where("_fine").where(F.size("_e") == dim)
        out = out.unionByName(_line(own) if dim == 1 else _of_dimension(own, dim, kind, threshold, hot, probes))
    return out


def _of_dimension(rows: DataFrame, dim: int, kind: str, threshold: float, hot: int, probes: int) -> DataFrame:
    """near_vectors of rows (vec_id, _e) that are all of one dimension, two at least, and fine."""
    keyed = rows.select("vec_id", "_e", *row_key("_e"))
    classes = keyed.groupBy("_k1", "_k2").agg(F.min("vec_id").alias("_least"), F.count("*").alias("_n"), F.any_value("_e").alias("_e"))
    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("_e").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k1", "_k2", "_least", "_n")), pa.array([x.tobytes() for x in flat], pa.binary())], ["_k1", "_k2", "_least", "_n", "_vec"])

    own = materialize(arrow_map(classes, bytes_of, "_k1 long, _k2 long, _least long, _n long, _vec binary").withColumn("_node", F.monotonically_increasing_id()), "vectors")
    links = class_links(own.select("_node", "_n", "_vec"), kind, dim, threshold, hot, probes)
    counts = materialize(links.groupBy("_node").agg(F.sum("_links").alias("_links")), "vectors-counts")
    roots = components(links.select("_node", "_root"), "_node", "_root")
    rooted = materialize(own.select("_node", "_k1", "_k2", "_least", "_n").join(checked(roots), own["_node"] == roots["node"], "left").join(checked(counts), "_node", "left").select("_k1", "_k2", "_least", "_n", F.coalesce("root", "_node").alias("_root"), F.coalesce("_links", F.lit(0)).alias("_links")), "vectors-rooted")
    least = materialize(rooted.groupBy("_root").agg(F.min("_least").alias("_id")), "vectors-least")
    named = materialize(rooted.join(checked(least), "_root").select("_k1", "_k2", "_id", (F.col("_links") + F.col("_n") - 1).alias("_links")), "vectors-named")
    out = keyed.select("vec_id", "_k1", "_k2").join(checked(named), ["_k1", "_k2"]).select("vec_id", F.col("_links").cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def _line(rows: DataFrame) -> DataFrame:
    """One dimension: all of a sign point the same way."""
    sides = rows.groupBy((F.col("_e")[0] > 0).alias("_up")).agg(F.count("*").alias("_all"), F.min("vec_id").alias("_id"))
    both = rows.withColumn("_up", F.col("_e")[0] > 0).join(F.broadcast(sides), "_up")
    out = both.select("vec_id", (F.col("_all") - 1).alias("n_links"), F.col("_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
