"""Operators on single texts, lines and substrings, against their contracts written plainly."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from quernstone.llm import attribution, bpe, lines, longprints, orc, packing, quality, registry, simhash, substrings, suffixes, tokens
from quernstone.llm.common import clean, materialize
from quernstone.llm.tokens import REMEMBERED, Encoder, Remembered, le32, public_tokenizer
from tests.llm.corpus import frame, rows, same, words

WORD, BYTE = public_tokenizer("word_bpe_49k.json"), public_tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pairs():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return frame(spark, pairs).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# --- tokenizers -----------------------------------------------------------------------------------


@pytest.fixture(scope="module", params=[WORD, BYTE])
def coders(request):
    return Encoder(request.param, remembered=50), bpe.MergeEncoder(request.param, remembered=50)


def agree(coders, text):
    plain, own = coders
    ids = plain.library.encode(text, add_special_tokens=False).ids
    return plain.ids(text) == le32(ids) and own.encode_decode(text) == (le32(ids), plain.library.decode(ids, skip_special_tokens=False).encode())


def test_every_fast_character_by_the_library(coders):
    for c in [*map(chr, range(0x250)), *"–—‘’“”…€日Σς́　 😀"]:
        for text in (c, f"a{c}b", f" {c} 1", f"{c}{c}'s", f"x {c}\n\n {c}y"):
            assert agree(coders, text), repr(text)


def test_random_texts_by_the_library(coders):
    rng = random.Random(4)
    parts = ["a", "The", "don't", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "ß", "12", "...", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "Σ", "\x1d", "\u0085", "word,", "end.\nStart"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert agree(coders, text), repr(text)


def changed_file(path, tmp_path, change):
    import json

    spec = json.loads(open(path, encoding="utf-8").read())
    change(spec)
    out = tmp_path / "tokenizer.json"
    out.write_text(json.dumps(spec), encoding="utf-8")
    return str(out)


def test_special_tokens_of_any_spelling(tmp_path):
    def change(spec):
        spec["added_tokens"].append({"id": len(spec["model"]["vocab"] | {t["content"]: 0 for t in spec["added_tokens"]}), "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})

    path = changed_file(BYTE, tmp_path, change)
    coders = Encoder(path), bpe.MergeEncoder(path)
    for text in ("a [SEP] b", "[SEP][SEP]", "x[SEP", "no such token", "<|endoftext|>[SEP]"):
        assert agree(coders, text), text


@pytest.mark.parametrize("setting", [{"ignore_merges": True}, {"byte_fallback": True}, {"dropout": 0.5}, {"continuing_subword_prefix": "##"}])
def test_settings_that_are_not_implemented_are_an_error(tmp_path, setting):
    with pytest.raises(ValueError, match="aren't implemented"):
        Encoder(changed_file(BYTE, tmp_path, lambda spec: spec["model"].update(setting)))
    with pytest.raises(ValueError, match="aren't implemented"):
        Encoder(changed_file(WORD, tmp_path, lambda spec: spec.update(normalizer={"type": "NFKC"})))


def test_remembered_is_bounded_and_right():
    made = Counter()

    def fill(k):
        made[k] += 1
        return k * 2

    kept = Remembered(fill, 10)
    for _ in range(3):
        for k in range(100):
            assert kept[k] == 2 * k and len(kept) <= 5 and len(kept.old) <= 5
    kept[99]
    assert made[99] == 3


def test_pieces_are_merged_once_whatever_stands_beside_them():
    coder, made = Encoder(BYTE, remembered=200), Counter()
    merge = coder.merge
    coder.merge = lambda piece: made.update([piece]) or merge(piece)
    stems = [a + b + "stone" for a in "abcdef" for b in "aeiouyklmn"]
    text = " ".join(f"{a}{sign}\n{b}" for _ in range(2) for a in stems for b in stems[:10] for sign in ",.")
    assert coder.ids(text) == le32(coder.library.encode(text, add_special_tokens=False).ids)
    assert max(made.values()) == 1


def test_bpe_encode_and_decode(spark, docs, pairs, nothing):
    library = Encoder(WORD).library
    expected = []
    for d, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(le32(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert same(map(tuple, bpe.digest_documents(docs, WORD).collect()), expected)
    encoded = bpe.encode_documents(docs, WORD)
    both = encoded.join(bpe.decode_ids(encoded, WORD).withColumnRenamed("decoded", "again").distinct(), "doc_id").where("doc_id is not null")
    assert both.count() >= len(pairs) - 3 and both.where("decoded != again").count() == 0
    assert bpe.digest_documents(nothing, WORD).count() == 0


# --- quality --------------------------------------------------------------------------------------


def measured(text):
    own = words(text)
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def test_measures(docs, pairs, nothing):
    got = quality.measures(docs).select("doc_id", *quality.MEASURES).collect()
    assert same(map(tuple, got), [(d, *measured(t)) for d, t in pairs])
    assert quality.quality_verdicts(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


def test_repeated_words_of_many_kinds():
    own = [b"w%d" % (i % 900) for i in range(2000)]
    assert quality.repeated_words(own) == 2000
    assert quality.repeated_words([b"a"] * 3) == 0 and quality.repeated_words([b"a"] * 4) == 4
    assert quality.repeated_words([b"a", b"b", b"c", b"d", b"a", b"b", b"c"]) == 6


def test_verdicts_and_kept_rows(docs, pairs):
    out = {(r["doc_id"], r["n_words"]): r for r in quality.quality_verdicts(docs).collect()}
    for d, t in pairs:
        n, _, _, _, repeats = measured(t)
        assert out[d, n]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    good = [(d, t) for d, t in pairs if out[d, measured(t)[0]]["kept"]]
    assert good and same([(r["doc_id"], r["text"]) for r in kept.collect()], good)


def test_a_bad_host_goes_and_a_small_one_is_spared(spark):
    fine, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    data = [(i, fine, f"good{i % 20}") for i in range(600)] + [(1000 + i, bad if i % 10 else fine, "bad") for i in range(100)] + [(2000, bad, "small"), (2001, fine, "small"), (2002, fine, None)]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[1000]["host_rejected"] and not got[1000]["kept"] and not got[1000]["base_failed"]
    assert not got[2000]["host_rejected"] and not got[2000]["kept"] and got[2001]["kept"] and got[2002]["kept"] and got[0]["kept"]


def test_beta_prior_finds_the_spread(spark):
    rng = np.random.default_rng(1)
    rates = rng.beta(2, 6, 3000)
    hosts = spark.createDataFrame([(int(n), int(rng.binomial(n, p))) for n, p in zip(rng.integers(5, 200, 3000), rates, strict=True)], "n_docs long, f long")
    a, b = quality.beta_prior(hosts, "f")
    assert a == pytest.approx(2, rel=0.25) and b == pytest.approx(6, rel=0.25)
    assert quality.beta_prior(hosts.limit(0), "f") == (1.0, 1.0)


# --- lines ----------------------------------------------------------------------------------------


def deduplicated(pairs):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for d, t in pairs:
        for x in (t or "").split("\n"):
            if d is not None:
                holders[key(x)].add(d)
    for d, t in pairs:
        own = (t or "").split("\n")
        stay = [x for x in own if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and d != min(holders[key(x)]))]
        yield d, len(own), len(own) - len(stay), "\n".join(stay)


def test_line_dedup(docs, pairs, nothing):
    expected = list(deduplicated(pairs))
    assert sum(x[2] for x in expected) > 5
    assert same(map(tuple, lines.digest_lines(docs).collect()), [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in expected])
    out = lines.drop_repeated_lines(docs)
    assert out.schema == docs.schema
    texts = {d: t for d, _, _, t in expected if d is not None}
    for r in out.collect():
        if r["doc_id"] is not None:
            assert (r["text"] or "") == texts[r["doc_id"]] and r["n_chars"] == len(r["text"] or "")
    assert lines.digest_lines(nothing).count() == 0 and lines.drop_repeated_lines(nothing).count() == 0


def test_line_threshold_of_three(spark):
    df = spark.createDataFrame([(i, "a line of many\nanother line") if i < 2 else (i, "a line of many") for i in range(3)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.digest_lines(df, least_docs=3).collect()} == {0: 0, 1: 1, 2: 1}


# --- suffix arrays and repeated substrings ----------------------------------------------------------


def test_suffix_array():
    rng = random.Random(1)
    texts = [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(1500)]
    for t in [*texts, [1] * 400 + [0], [1, 2] * 200 + [0], [2, 1] * 200 + [0], [1, 1, 2] * 150 + [0], list(range(300, -1, -1))]:
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(1500):
        length, letters = rng.choice([3, 5, 12]), rng.choice([b"a", b"ab ", b"abc  \n", b"abcdef "])
        base = bytes(rng.choice(letters) for _ in range(40))
        some = lambda k: bytes(rng.choice(letters) for _ in range(rng.randint(0, k)))
        own = [some(8) + base[(a := rng.randint(0, 39)) : a + rng.randint(0, 30)] + some(8) for _ in range(rng.randint(1, 5))]
        n = Counter(s[i : i + length] for s in own for i in range(len(s) - length + 1))
        assert [x.tolist() for x in suffixes.repeated_windows(own, length)] == [[i for i in range(len(s) - length + 1) if n[s[i : i + length]] > 1] for s in own]


def without_repeats(pairs, length):
    raw = [(d, (t or "").encode()) for d, t in pairs]
    n = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)


@pytest.mark.parametrize(("length", "hot"), [(200, 1000), (200, 1), (30, 1000), (30, 2), (12, 3)])
def test_suffix_dedup(docs, pairs, length, hot):
    expected = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in without_repeats(pairs, length)]
    assert sum(x[2] for x in expected) > 1000
    assert same(map(tuple, substrings.digest_repeats(docs, length, hot).collect()), expected)


@pytest.mark.parametrize("hot", [1000, 20, 3])
def test_suffix_dedup_of_many_ends_of_one_passage(spark, hot):
    """Windows that have all but a few bytes in common: their blocks' cores are as hot as their anchors."""
    rng = random.Random(4)
    words = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, ends = words(196), [words(6) for _ in range(30)]
    pairs = [(k, words(rng.randint(0, 90)) + rng.choice(["", "x", "yz"]) + passage + rng.choice(ends) + words(rng.randint(0, 90))) for k in range(150)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    expected = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in without_repeats(pairs, 200)]
    assert 0 < sum(x[2] > 0 for x in expected)
    assert same(map(tuple, substrings.digest_repeats(df, 200, hot).collect()), expected)


def test_suffix_dedup_of_texts(docs, pairs, nothing):
    out = substrings.drop_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(pairs)
    texts = {d: b.decode(errors="ignore") for d, _, _, _, b in without_repeats(pairs, 200)}
    assert all((r["text"] or "") == texts[r["doc_id"]] for r in out.where("doc_id is not null").collect())
    assert substrings.digest_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        substrings.digest_repeats(nothing, 5).count()


# --- packing, files, sections -----------------------------------------------------------------------


def test_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(200):
        window = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        placed, open_ = packing.best_fit_decreasing(lengths, window), []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [w for w in range(len(open_)) if window - open_[w] >= lengths[i]]
            w, offset = placed[i]
            if fits:  # the tightest of the open ones
                assert window - open_[w] == min(window - open_[k] for k in fits) and offset == open_[w]
                open_[w] += lengths[i]
            else:
                assert (w, offset) == (len(open_), 0)
                open_.append(lengths[i])


@pytest.mark.parametrize("shard", [2048, 5])
def test_packing(docs, pairs, shard):
    library = Encoder(WORD).library
    out = packing.pack_documents(docs, WORD, window=64, keep_ids=True, shard=shard).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in out:
        assert 0 < r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    expected = Counter((d, le32([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in pairs)
    for (d, raw), n in expected.items():
        if d is not None:
            assert sorted(documents[d, len(raw) // 4]) == sorted([(k, raw[4 * k : 4 * k + 256]) for k in range(0, len(raw) // 4, 64)] * n)
    assert sum(r["length"] for r in out) == sum(n * len(raw) // 4 for (_, raw), n in expected.items())


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_orc_files(spark, docs, pairs, nothing, tmp_path):
    library = Encoder(BYTE).library
    path = f"file://{tmp_path}/ids"
    orc.write_documents(docs, path, BYTE)
    own = sorted(((-1 if d is None else d), t or "") for d, t in pairs)
    expected, start = [], 0
    for d, t in own:
        ids = le32([*library.encode(t, add_special_tokens=False).ids, 0])
        expected.append((None if d < 0 else d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert same(map(tuple, orc.digest_files(spark, path).collect()), expected)
    some = orc.read_documents(spark, path, [3, 140])
    assert {r[0] for r in some.select("doc_id").collect()} == {3, 140}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    file = pyarrow.orc.ORCFile(next(iter(tmp_path.glob("ids/*.orc"))))
    assert file.compression == "ZSTD" and file.schema.names == ["doc_id", "shard", "first", "ids"]
    empty = f"file://{tmp_path}/none"
    orc.write_documents(nothing, empty, BYTE)
    assert orc.digest_files(spark, empty).count() == 0


def owner(spans, sections, rule):
    counts, outside, crossing = [0] * len(sections), 0, 0
    for a, b in spans:
        of = [next((k for k, (s, e) in enumerate(sections) if s <= x < e), -1) for x in range(a, b)]
        crossing += len(set(of)) > 1
        if rule == "majority":
            inside = sorted({k for k in of if k >= 0}, key=lambda k: (-of.count(k), k))
            one = inside[0] if inside and of.count(inside[0]) >= of.count(-1) else -1
        else:
            one = of[0] if rule == "start" else of[-1]
        if one < 0:
            outside += 1
        else:
            counts[one] += 1
    return counts, outside, crossing


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_rules(rule):
    rng = random.Random(6)
    for _ in range(300):
        cuts = sorted(rng.sample(range(41), rng.randint(0, 8)))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.8]
        marks = sorted({0, 40, *rng.sample(range(41), 12)})
        spans = list(zip(marks, marks[1:], strict=False))
        assert attribution.attribute(np.array(spans), sections, rule) == owner(spans, sections, rule)


def test_orc_stripes_indexes_and_filters(spark, tmp_path):
    """A file of several stripes has a row index, and a Bloom filter that knows its ids and few others."""
    path = f"file://{tmp_path}/striped"
    df = spark.createDataFrame([(3 * k, " ".join(f"w{(k * j) % 977}" for j in range(60))) for k in range(6000)], "doc_id long, text string").coalesce(1)
    orc.write_documents(df, path, BYTE, options={"orc.stripe.size": "200000", "orc.stripe.row.count": "2000"})
    names = sorted(str(x) for x in tmp_path.glob("striped/*.orc"))
    assert sum(pyarrow.orc.ORCFile(n).nstripes for n in names) >= 3
    j, tested = spark._jvm, 0
    for name in names:
        conf = spark._jsc.hadoopConfiguration()
        reader = j.org.apache.orc.OrcFile.createReader(j.org.apache.hadoop.fs.Path(name), j.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        column = reader.getSchema().findSubtype("doc_id").getId()
        ids = pyarrow.orc.ORCFile(name).read(columns=["doc_id"]).column(0).to_pylist()
        at = 0
        for s in range(reader.getStripes().size()):
            rows = reader.getStripes().get(s).getNumberOfRows()
            wanted = spark.sparkContext._gateway.new_array(j.boolean, reader.getSchema().getMaximumId() + 1)
            wanted[0] = wanted[column] = True
            index = reader.rows().readRowIndex(s, None, wanted)
            filters = index.getBloomFilterIndex()[column]
            assert filters is not None and index.getRowGroupIndex()[column].getEntryCount() == -(-rows // 1000)
            first = filters.getBloomFilter(0)
            assert first.getNumHashFunctions() > 0 and first.getUtf8Bitset().size() > 0
            assert ids[at : at + rows] == sorted(ids[at : at + rows])
            at += rows
            tested += 1
    assert tested >= 3
    some = orc.read_documents(spark, path, [3, 4, 9000])
    assert sorted(r["doc_id"] for r in some.select("doc_id").collect()) == [3, 9000]


def test_rows_of_one_id_are_split_over_files(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    df = spark.createDataFrame([(7 if k % 3 else None, f"{k} text") for k in range(3000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        orc.write_documents(df, path, BYTE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.orc(path).groupBy("shard").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2000
    out = orc.digest_files(spark, path).orderBy("start").collect()
    assert [r["start"] for r in out[1:]] == [r["start"] + r["n_tokens"] for r in out[:-1]] and [r["doc_id"] for r in out] == [None] * 1000 + [7] * 2000


def test_orc_batches_and_pieces_are_bounded(spark, tmp_path, monkeypatch):
    """However many rows a partition has, workers get and give few bytes at a time, and remember half as many pieces as elsewhere."""

    def watched(fn):
        def run(batches):
            def small(rows):
                for b in rows:
                    assert b.nbytes < 3 << 20
                    yield b

            return small(fn(small(batches)))

        return run

    def forgetful(fn):
        def run(batches):
            yield from fn(batches)
            assert any(c.path == BYTE and c.pieces.most == REMEMBERED // 2 for c in tokens._LOADED.values())

        return run

    encoded, digested = orc._encoded, orc._digested
    monkeypatch.setattr(orc, "_encoded", lambda *a: forgetful(watched(encoded(*a))))
    monkeypatch.setattr(orc, "_digested", watched(digested))
    text, path, names = "ab" * 2000, f"file://{tmp_path}/many", [*orc.SMALL_BATCHES]
    before = [spark.conf.get(n, None) for n in names]
    orc.write_documents(spark.range(8000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")), path, BYTE)
    ids = le32([*Encoder(BYTE).library.encode(text, add_special_tokens=False).ids, 0])
    found = orc.digest_files(spark, path).select("start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert list(map(tuple, found)) == [(k * len(ids) // 4, len(ids) // 4, zlib.crc32(ids)) for k in range(8000)]
    assert [spark.conf.get(n, None) for n in names] == before


def test_section_tokens(spark, docs, pairs, nothing):
    library = Encoder(BYTE).library
    got = {(r["doc_id"], tuple(r["section_tokens"])): r for r in attribution.section_tokens(docs, BYTE).collect()}
    for d, t in pairs:
        text = t or ""
        spans = library.encode(text, add_special_tokens=False).offsets
        counts, outside, crossing = owner(spans, attribution.line_sections(text), "majority")
        r = got[d, tuple(counts)]
        assert (r["n_tokens"], r["n_outside"], r["n_crossing"]) == (len(spans), outside, crossing)
    own = docs.where("doc_id = 3").withColumn("own", F.expr("array(named_struct('start', 0, 'end', 4), named_struct('start', 6, 'end', 9))"))
    r = attribution.section_tokens(own, BYTE, "own", "start").first()
    assert sum(r["section_tokens"]) + r["n_outside"] == r["n_tokens"] and r["n_sections"] == 2
    assert attribution.section_tokens(nothing, BYTE).count() == 0
    several = spark.createDataFrame([(1, "one two three", [(0, 3), (None, 2), (4, 90)]), (2, "four five", [None, (5, 9)]), (3, "six", None), (4, None, [(0, 0)])], "doc_id long, text string, own array<struct<start:int,end:int>>").coalesce(1)
    rows_ = {r["doc_id"]: r for r in attribution.section_tokens(several, BYTE, "own").collect()}
    assert [(rows_[k]["section_tokens"], rows_[k]["n_outside"]) for k in (1, 2, 3, 4)] == [([1, 0, 2], 0), ([0, 1], 1), ([], 1), ([0], 0)]
    with pytest.raises(Exception, match="sorted"):
        attribution.section_tokens(spark.createDataFrame([(1, "one two", [(4, 7), (0, 3)])], several.schema), BYTE, "own").collect()
    with pytest.raises(ValueError):
        attribution.section_tokens(docs, BYTE, rule="loudest")
    with pytest.raises(ValueError):
        attribution.SpanEncoder(WORD)


def test_materialized_rows_are_the_same(docs):
    assert same(map(tuple, materialize(docs, "test").collect()), map(tuple, docs.collect()))


def test_written_tables_can_be_cleaned(spark):
    written = materialize(spark.range(5), "test")
    file = written.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(file) and written.count() == 5
    clean(spark)
    assert not os.path.exists(file)


# --- columns of any name, SQL --------------------------------------------------------------------------

CLASHES = ["_k1", "_k2", "_drop", "_n", "_spans", "_size", "_gone", "_extra", "_id", "_text", "_root", "_node", "_stay", "_host", "_rejected", "_pos", "_h1", "_h2", "_first", "_fp", "_f1", "_f2", "_print", "_wanted", "_anchor", "c0", "c1", "_0", "_1", "n_words", "base_failed", "component_id", "DOC_ID", "Text", "start", "count"]


@pytest.mark.parametrize("stage", [quality.keep_good, lines.drop_repeated_lines, simhash.drop_near_duplicates, longprints.drop_similar, substrings.drop_repeats], ids=lambda f: f.__name__)
def test_stages_keep_columns_of_any_name(spark, docs, stage):
    """Columns called like any of ours come through as they are; without rows there are none."""
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    wide = plain.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    expected = {r["doc_id"]: tuple(r) for r in stage(plain).collect()}
    out = stage(wide)
    assert out.columns == wide.columns and out.schema == wide.schema
    got = [tuple(r) for r in out.collect()]
    assert {r[0]: r[:5] for r in got} == expected and len(got) == len(expected)
    assert all(r[5 + k] == f"{c} {r[0]}" for r in got for k, c in enumerate(CLASHES))
    assert stage(wide.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts of several MB beside short ones, in every stage."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) + ("\n" if rng.random() < 0.05 else "") for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "z" * 3_000_000), (3, "short text"), (4, long[:1_000_000] + " other end")], "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1)
    assert [r["doc_id"] for r in longprints.drop_similar(df).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    out = {r["doc_id"]: r["n_removed"] for r in substrings.digest_repeats(df).collect()}
    assert out == {1: 1_000_000, 2: 3_000_000, 3: 0, 4: 1_000_000}
    assert {r["doc_id"]: r["n_words"] for r in quality.measures(df).collect()}[1] == 400_000
    coder = Encoder(BYTE)
    counts = {r["doc_id"]: r for r in attribution.section_tokens(df.where("doc_id <> 2"), BYTE).collect()}
    assert counts[1]["n_tokens"] == len(coder.ids(long)) // 4 == sum(counts[1]["section_tokens"]) and counts[1]["n_sections"] == long.count("\n") + 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(expected.columns)
    assert same(map(tuple, got.select(*expected.columns).collect()), expected.fetchall())
