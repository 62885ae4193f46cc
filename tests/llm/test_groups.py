"""Operators on pairs and groups, language, and the pipeline, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import language, longprints, multiindex, packing, quality, registry, simhash
from quernstone.llm.common import written
from quernstone.llm.components import TASKS, components
from quernstone.llm.tokens import public_tokenizer
from tests.llm.corpus import frame, rows, same, words
from tests.llm.test_texts import deduplicated, measured, without_repeats

WORD = public_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pairs():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return frame(spark, pairs).cache()


def grouped(n, links):
    """Least reachable number of 0 to n-1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- components -------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    root = grouped(600, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert same(map(tuple, components(df, "a", "b").collect()), [(x, root[x]) for x in linked if root[x] != x])
    assert components(df.limit(0), "a", "b").count() == 0


def test_components_few_files(spark):
    """Few links are written in few files, however many partitions there are."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.range(2000).selectExpr("id AS a", "id - id % 10 AS b"), "a", "b")
        assert same(map(tuple, found.collect()), [(x, x - x % 10) for x in range(2000) if x % 10])
        assert len(found.inputFiles()) <= TASKS
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# --- SimHash ----------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] or ([" ".join(own)] if own else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_groups(pairs, k, distance):
    prints = [plain_fingerprint(t, k) for _, t in pairs]
    root = grouped(len(pairs), [(i, j) for i in range(len(pairs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance])
    least = defaultdict(list)
    for (d, _), r in zip(pairs, root, strict=True):
        least[r] += [] if d is None else [d]
    return [(d, f"{p:016x}", min(least[r], default=None)) for (d, _), p, r in zip(pairs, prints, root, strict=True)]


@pytest.mark.parametrize(("k", "distance"), [(3, 2), (5, 3), (5, 5)])
def test_near_duplicates(docs, pairs, k, distance):
    assert same(map(tuple, simhash.near_duplicates(docs, k, distance).collect()), plain_groups(pairs, k, distance))


def test_near_duplicates_of_nothing(docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_kept_documents(docs, pairs):
    out = simhash.drop_near_duplicates(docs, 5, 3)
    assert out.schema == docs.schema
    groups = plain_groups(pairs, 5, 3)
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted({c for _, _, c in groups if c is not None})


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
@pytest.mark.parametrize("bucket", [3, 10**6])
def test_links_of_near_fingerprints(spark, distance, bucket):
    """Clouds of fingerprints, in buckets that a task holds and in ones that it doesn't."""
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {rng.getrandbits(64) for _ in range(20)} | {0, 1, 3, (1 << 64) - 1}
    prints = sorted(prints)
    root = grouped(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance])
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "_fp long"), distance, bucket).collect()
    at = {x: k for k, x in enumerate(signed)}
    assert grouped(len(prints), [(at[r["_a"]], at[r["_b"]]) for r in links]) == root


def test_sparse_and_dense_bucket_ways_agree(monkeypatch):
    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(rng.integers(1 << 60)) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 30, (400, 4)).astype(np.uint64), axis=1))
    dense = [x.tolist() for x in simhash.bucket_links(prints, 2)]
    monkeypatch.setattr(simhash, "DENSE", 1)
    assert [x.tolist() for x in simhash.bucket_links(prints, 2)] == dense
    few = prints[:120]  # more lookups than fingerprints
    monkeypatch.setattr(simhash, "DENSE", 1000)
    dense = [x.tolist() for x in simhash.bucket_links(few, 3)]
    monkeypatch.setattr(simhash, "DENSE", 1)
    assert dense[0] and [x.tolist() for x in simhash.bucket_links(few, 3)] == dense


def test_edited_copies_are_dropped(spark):
    """Copies with a few words replaced: exactly those go that links of a Jaccard similarity of 0.8 or more reach."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            texts.append(copy)
    base = [f"h{k}" for k in range(100)]
    texts += [[*base, f"t{k}"] for k in range(60)] + [[], ["one"], ["one"], ["two", "words"]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = sum((plain_fingerprint(" ".join(texts[i]), 5) ^ plain_fingerprint(" ".join(texts[j]), 5)).bit_count() > 5 for i, j in links)
    root = grouped(len(sets), links)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(300, None), (0, " ".join(texts[0])), (0, " ".join(texts[0]) + " ")], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in longprints.drop_similar(df).collect())
    assert far > 50 and got == sorted(set(root))
    assert longprints.drop_similar(df.limit(0)).count() == 0


def pairs_of_similarity(rng, n, low, high):
    """(set, set) pairs of 300 shingles' worth with a Jaccard similarity from low to high."""
    for _ in range(n):
        shared, own = 300, rng.uniform((1 - high) / high, (1 - low) / low) * 300
        a = round(own * rng.random())
        x = rng.getrandbits
        both = [x(64) for _ in range(shared)]
        yield tuple(np.array([*both, *(x(64) for _ in range(k))], np.uint64) for k in (a, round(own) - a))


@pytest.mark.parametrize(("low", "high", "least"), [(0.8, 0.801, 0.97), (0.8, 0.85, 0.98), (0.85, 0.9, 0.995), (0.9, 0.95, 0.999), (0.95, 1, 1)])
def test_recall_of_segments_by_similarity(low, high, least):
    """Pairs meet in a segment and pass the first 128 bits."""
    rng, half, count = random.Random(5), *longprints.segment_plan(100_000)
    met, n = 0, 400
    for a, b in pairs_of_similarity(rng, n, low, high):
        prints = np.stack([longprints.long_fingerprint(x, -(-2 * half * count // 64)) for x in (a, b)])
        one, two = longprints.segment_values(prints, half, count)
        shares = [(s, h) for s in range(count) for h in (0, 1) if one[s, h] == two[s, h] and int(one[s, 1 - h] ^ two[s, 1 - h]).bit_count() <= 1]
        met += bool(shares) and longprints._apart(prints[:1, :2], prints[1:, :2])[0] <= longprints.NEAR
    assert met >= least * n


@pytest.mark.parametrize("dense", [False, True])
def test_forests_of_groups(dense):
    """The groups that pairs of at most NEAR bits make, where `other` agrees but for a bit; where that is too many, whatever is near."""
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 63, size=(5, 2), dtype=np.uint64)
    prints = np.concatenate([np.unique(b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 9, 2)).astype(np.uint64), axis=1), axis=0) for b in base] + [rng.integers(1 << 63, size=(300, 2), dtype=np.uint64)])
    prints = prints[rng.permutation(len(prints))]
    other = np.zeros(len(prints), np.int32) if dense else rng.integers(0, 1 << 4, len(prints)).astype(np.int32)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (dense or int(other[i] ^ other[j]).bit_count() <= 1) and sum(int(prints[i, k] ^ prints[j, k]).bit_count() for k in (0, 1)) <= longprints.NEAR]
    root = longprints.group_forest(other, prints, 10)
    expected = grouped(len(prints), near)
    assert len(near) > 500 and grouped(len(prints), list(enumerate(root.tolist()))) == expected


def test_blocks_of_large_groups_give_the_same(spark):
    """Groups cut into blocks, of fingerprints and of texts, lose no link."""
    rng = random.Random(3)
    base = [f"h{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(120)] = f"x{k}{rng.randrange(9)}"
        texts.append(" ".join(copy))
    sets = [set(longprints.shingles(t.encode(), 5).tolist()) for t in texts]
    root = grouped(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    own = spark.createDataFrame([(k, k, -k, t.encode()) for k, t in enumerate(texts)], "_id long, _k1 long, _k2 long, _text binary")
    for options in ({}, {"group": 20, "block": 9000}):
        groups = defaultdict(list)
        for r in longprints.similar_groups(own, **options).collect():
            groups[r["_root"]].append(r["_id"])
        assert sorted(min(g) for g in groups.values()) == sorted(set(root)) and len(groups) > 5


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 200))).astype(np.uint64) for _ in range(40)]
    assert (longprints.overlaps(sets[:15], sets[15:]) == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]).all()


# --- vectors ----------------------------------------------------------------------------------------


def plain_vectors(data, threshold=0.95):
    fine = [k for k, (_, v) in enumerate(data) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([data[k][1] for k in fine], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    root = grouped(len(fine), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i > j])
    least = defaultdict(list)
    for k, r in zip(fine, root, strict=True):
        least[r] += [] if data[k][0] is None else [data[k][0]]
    out = {k: (int(near[i].sum()) - 1, min(least[root[i]], default=None)) for i, k in enumerate(fine)}
    return [(d, *(own := out.get(k, (0, d))), d == own[1]) for k, (d, _) in enumerate(data)]


def cloud(rng, n, hubs, spread, dim=16):
    base = rng.normal(size=(hubs, dim))
    return [(base[rng.integers(hubs)] + spread * rng.normal(size=dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize(("hot", "probes"), [(512, 8192), (8, 16)])
def test_near_vectors(spark, hot, probes):
    rng = np.random.default_rng(4)
    vectors = cloud(rng, 260, 5, 0.05) + cloud(rng, 120, 4, 0.14) + cloud(rng, 200, 200, 0.0)
    data = [(k, v) for k, v in enumerate(vectors)]
    data += [(700 + k, vectors[k]) for k in range(5)] + [(710, [2 * x for x in vectors[3]]), (720, None), (721, []), (722, [0.0] * 16), (723, [float("nan")] + [1.0] * 15), (724, [None] + [1.0] * 15), (725, [float("inf")] * 16), (726, [1.0, 2.0]), (None, vectors[9]), data[11], data[11]]
    df = spark.createDataFrame([(d, v, "x") for d, v in data], "vec_id long, embedding array<float>, n_links string").repartition(3)
    got = Counter(map(tuple, multiindex.near_vectors(df, hot=hot, probes=probes).collect()))
    expected = Counter(plain_vectors(data))
    true, found = sum(k[1] * n for k, n in expected.items()), sum(k[1] * n for k, n in got.items())
    assert true > 10_000 and 0.97 * true <= found <= true
    if found == true:
        assert got == expected
    by = {k[0]: k for k in expected}
    assert all(k[1] <= by[k[0]][1] for k in got)


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multiindex.near_vectors(df).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert same(map(tuple, multiindex.near_vectors(odd).collect()), [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])
    line = spark.createDataFrame([(1, [2.0]), (2, [3.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    assert same(map(tuple, multiindex.near_vectors(line).collect()), [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)])


def test_vectors_of_several_dimensions(spark):
    """Each dimension links on its own, the rare ones too."""
    data = [(k, [1.0, 0.1 * (k % 3), 0.0]) for k in range(20)] + [(30, [1.0, 2.0]), (31, [2.0, 4.0]), (32, [1.0, -2.0]), (40, [5.0]), (41, [7.0]), (42, [-7.0]), (50, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multiindex.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k] == (19, 0, k == 0) for k in range(20))
    assert (got[30], got[31], got[32]) == ((1, 30, True), (1, 30, False), (0, 32, True))
    assert (got[40], got[41], got[42], got[50]) == ((1, 40, True), (1, 40, False), (0, 42, True), (0, 50, True))


def test_cells_come_in_order():
    """The traversal gives the nearest cells of the whole grid, nearest first."""
    rng = np.random.default_rng(8)
    index = multiindex.Index(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), 8, 25)
    x = rng.normal(size=(50, 8))
    d1, d2 = index.distances(x)
    sums = (d1[:, :, None] + d2[:, None, :]).reshape(50, -1)
    cells = index.cells(x)
    assert all(len(set(row)) == 25 for row in cells.tolist())
    assert np.allclose(np.take_along_axis(sums, cells, 1), np.sort(sums, axis=1)[:, :25])


def test_recall_on_the_drivers_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toArrow()
    x = np.array(table.column("embedding").to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = dict(zip(table.column("vec_id").to_pylist(), ((x @ x.T >= 0.95).sum(1) - 1).tolist(), strict=True))
    got = {r["vec_id"]: r["n_links"] for r in multiindex.near_vectors(df).collect()}
    assert all(got[k] <= n for k, n in true.items()) and sum(got.values()) >= 0.9 * sum(true.values())


def around(rng, centre, n, low, high):
    """Unit vectors with a cosine of low to high with `centre`."""
    x = rng.normal(size=(n, len(centre)))
    x -= (x @ centre)[:, None] * centre
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = rng.uniform(low, high, (n, 1))
    return c * centre + (1 - c * c) ** 0.5 * x


def exact_vectors(x, threshold=0.95):
    """(links, least row reachable) of each row; no pair's cosine may be too near the threshold to tell."""
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links, root = np.zeros(len(x), int), np.arange(len(x))
    near = x @ x.T >= threshold
    while True:
        least = np.array([root[row].min() for row in near])
        if (least == root).all():
            return list(zip((near.sum(1) - 1).tolist(), root.tolist(), strict=True))
        root = least


def found_vectors(spark, x, **options):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>").repartition(4)
    return [(r["n_links"], r["component_id"]) for r in sorted(multiindex.near_vectors(df, **options).collect())]


def test_a_third_of_the_vectors_near_one(spark):
    """Distinct near copies, many beyond half the threshold's angle, that an index would spread over cells none of which is hot."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 64))
    x[::3] = around(rng, x[0] / np.linalg.norm(x[0]), 3000, 0.97, 0.997)
    assert found_vectors(spark, x) == exact_vectors(x)


def test_one_cluster_of_several_regions(spark):
    """Hubs so near each other that members of one link with many of the next: all links count, and they are one component."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2400, 32))
    hubs = around(rng, x[0] / np.linalg.norm(x[0]), 5, 0.97, 0.985)
    for k, hub in enumerate(hubs):
        x[k::12] = around(rng, hub / np.linalg.norm(hub), len(x[k::12]), 0.975, 0.999)
    expected = exact_vectors(x)
    assert sum(n for n, _ in expected) > 200_000 and {c for n, c in expected if n} == {0}
    assert found_vectors(spark, x, hot=64) == expected


def test_pairs_of_tight_clusters(spark):
    """Six pairs of tight clusters fifteen degrees apart, by the parameters of the query: no link is lost, and components are right."""
    rng = np.random.default_rng(1)
    x = []
    for _ in range(6):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        side = rng.normal(size=32)
        side -= side @ a * a
        b = np.cos(np.radians(15)) * a + np.sin(np.radians(15)) * side / np.linalg.norm(side)
        x += [c + 0.012 * rng.normal(size=(600, 32)) for c in (a, b)]
    x = np.concatenate(x)
    expected, got = exact_vectors(x), found_vectors(spark, x)
    true, found = (sum(n for n, _ in y) for y in (expected, got))
    assert found >= 0.99 * true and [c for _, c in got] == [c for _, c in expected]


def test_visits_are_as_many_as_links_ask_for():
    """Cells are visited until links are found, also where many centroids lie in one dense place."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = around(rng, x[0], 2000, 0.98, 0.995)
    index = multiindex.fit(x, 400_000, 0.95)
    a = x[0:900:3]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * noise / np.linalg.norm(noise, axis=1)[:, None]
    ca, cb = index.cells(a), index.cells(b)
    assert index.visits > 128 and ((ca == cb[:, :1]).any(1) | (cb == ca[:, :1]).any(1)).mean() > 0.97


# --- language ---------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.count() > 150 and got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark, docs, pairs):
    langs = {d: ("aa" if d % 2 else "bb") for d, t in pairs if d is not None and d < 40}
    out = language.identify(frame(spark, pairs, langs)).collect()
    assert len(out) == len(pairs)
    texts = {d: t for d, t in pairs}
    for r in out:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert (r["lang_pred"] == "und") == (t is None or not any(map(str.isalpha, t))) and 0 <= r["score"] <= 1
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        else:
            assert r["held_out"] is False
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}  # nothing to learn from
    assert language.identify(docs.limit(0)).count() == 0


def test_predictions_see_the_text_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(df)
    ids = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    other = df.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    assert {r["doc_id"] - 10_000: r["lang_pred"] for r in language.identify(other, model).collect()} == ids


def plain_mixture(log, penalty):
    """The best set of languages by EM over every set, from words' log likelihoods: (set, proportions)."""
    from itertools import combinations

    n, langs, best = len(log), log.shape[1], None
    for size in range(1, langs + 1):
        for own in combinations(range(langs), size):
            ratio, share = np.exp(log[:, own] - log.max(1, keepdims=True)), np.full(size, 1 / size)
            for _ in range(200):
                mine = ratio * share
                share = (mine / mine.sum(1, keepdims=True)).mean(0)
            value = np.log((ratio * share).sum(1)).sum() + log.max(1).sum() - (size - 1) * penalty * 0.5 * np.log(max(n, 2))
            if best is None or value > best[0]:
                best = value, own, share
    return best[1], best[2]


def test_mixtures_against_every_set(spark):
    """One to six languages a document, six in the model: the set and its proportions are those of EM over all sets."""
    rng = np.random.default_rng(2)
    names = [f"l{k}" for k in range(6)]
    letters = ["".join(chr(97 + (5 * k + 3 * j) % 26) for j in range(9)) for k in range(6)]
    word = lambda k: "".join(rng.choice(list(letters[k])) for _ in range(rng.integers(4, 9)))
    train = [(4 * i, " ".join(word(i % 6) for _ in range(300)), names[i % 6]) for i in range(60)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == names
    agreed, total = 0, 0
    for size in range(1, 7):
        for _ in range(8):
            own = sorted(rng.choice(6, size, replace=False).tolist())
            words_ = [word(k).encode() for k in own for _ in range(rng.integers(25, 60))]
            expected, share = plain_mixture(model.likelihoods(words_).astype(np.float64), language.PENALTY)
            got, chosen = model.infer([words_])
            total += 1
            if chosen[0] == len(expected) and set(np.flatnonzero(got[0]).tolist()) == set(expected):
                agreed += 1
                assert np.allclose(got[0][list(expected)], share, atol=0.03)
            assert got[0].argmax() in own
    assert agreed >= 0.95 * total and model.infer([[w for k in range(6) for w in [word(k).encode() for _ in range(60)]]])[1][0] == 6


def test_ties_between_languages(spark):
    """Two languages learned from the same words: the first in order is told, at equal proportions or all for one, and repeated rows come back once each."""
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows_ = [(k, "same words in both of them", lang) for k, lang in zip(ids, ["bb", "aa"] * 4, strict=False)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    out = language.identify(df.unionByName(df)).collect()
    assert len(out) == 16 and {r["lang_pred"] for r in out} == {"aa"} and len({r["score"] for r in out}) == 1


def test_a_mixture_has_both_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(df)
    by = {r["lang"]: r["text"] for r in df.where("lang in ('en', 'fr') and n_chars between 2000 and 4000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    share, chosen = model.infer([language.words_of(by["en"][:1500] + " " + by["fr"][:1500])])
    own = dict(zip(model.langs, share[0].tolist(), strict=True))
    assert chosen[0] >= 2 and own["en"] > 0.25 and own["fr"] > 0.25


# --- pipeline ---------------------------------------------------------------------------------------


def similar_kept(pairs):
    """One of each group of texts that a Jaccard similarity of 0.8 of five-word shingles links: the least id, null last, equal rows being one."""
    sets = []
    for _, t in pairs:
        own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    root = grouped(len(pairs), [(i, j) for i in range(len(pairs)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    best = {}
    for p, r in zip(pairs, root, strict=True):
        if r not in best or (p[0] is None, p[0] or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = p
    return list(best.values())


def plain_pipeline(rows_):
    """(doc_id, source, text) of documents through the first four stages; hosts are rejected if over half of their documents fail a rule, which these are far from or far over."""
    kept, by = [], defaultdict(list)
    for d, s, t in rows_:
        n, chars, symbols, dup, repeats = measured(t)
        bad = n < 50 or 100 * repeats > 50 * n
        by[s].append((n < 50, 100 * repeats > 50 * n, 100 * symbols > 10 * chars, dup > 10))
        kept += [] if bad else [(d, s, t)]
    rejected = {s for s, own in by.items() if s is not None and any(2 * sum(x) > len(own) for x in zip(*own, strict=True))}
    kept = [(d, t) for d, s, t in kept if s not in rejected]
    left = [(d, t) for d, _, _, t in deduplicated(kept)]
    return rejected, [(d, raw.decode(errors="ignore")) for d, _, _, _, raw in without_repeats(similar_kept(left), 200)]


def test_pipeline(spark, tmp_path):
    """Null ids and texts, a rejected host with good documents in it, repeated rows; the rest of the files of a run is deleted."""
    pairs = [p for p in rows(seed=5, n=60) if p[1] != rows(seed=5, n=60)[3][1] or p[0] == 3]
    fine = [(1000 + i, " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest()[:8] for k in range(60))) for i in range(120)]
    every = [(d, None if d is None else f"s{d % 2}", t) for d, t in pairs + fine]
    every += [(None, "s1", " ".join(f"no{k}id" for k in range(70))), (2000, None, " ".join(f"n{k}" for k in range(70)))]
    every += [(3000 + k, "bad", "too short" if k % 10 else " ".join(f"b{k}x{j}" for j in range(60))) for k in range(80)]
    docs = spark.createDataFrame([(d, t, None, s, len(t or "")) for d, s, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{tmp_path}/data"
    docs.write.parquet(f"{folder}/documents.parquet")
    rejected, expected = plain_pipeline(every)
    assert rejected == {"bad"} and None in {d for d, _ in expected} and not any(d is not None and d >= 3000 for d, _ in expected)
    stage, names = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns
    for _, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, folder).cache()
        assert stage.columns == names
    assert same([(r["doc_id"], r["text"] or "") for r in stage.collect()], expected)
    library, before = packing.Encoder(WORD).library, written()
    out = corpus_pipeline.run(spark, folder)
    tokens = Counter()
    for d, t in expected:
        tokens[d] += len(library.encode(t, add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
    assert len(written() - before) == 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names) and quality.rules()
