import random

import pytest
from pyspark.sql import functions as F

from quernstone.errors import AlreadyFragmented, NotExecutable, NotFound
from quernstone.plans import ir
from quernstone.plans.compile import compile_plan
from quernstone.plans.store import ShuffleStore, run_fragments
from quernstone.streaming.ipc import from_chunks


@pytest.fixture
def store(spark, tmp_path):
    return ShuffleStore(spark, f"file://{tmp_path}/buckets")


def test_an_empty_bucket_is_not_a_missing_one(spark, store):
    df = spark.range(6).select("id", (F.col("id") % 2).cast("int").alias("_bucket"))
    store.put("q", 0, 1, df, F.col("_bucket"), 3)
    assert [sorted(r["id"] for r in store.get("q", 0, 1, b).collect()) for b in range(3)] == [[0, 2, 4], [1, 3, 5], []]
    assert store.get("q", 0, 1, 2).columns == ["id", "_bucket"]
    assert list(store.chunks("q", 0, 1, 2)) == []
    assert sorted(from_chunks(store.chunks("q", 0, 1, 0)).column("id").to_pylist()) == [0, 2, 4]
    for key in (("q", 0, 1, 3), ("q", 0, 1, -1), ("q", 0, 0, 0), ("q", 1, 1, 0), ("p", 0, 1, 0)):
        with pytest.raises(NotFound):
            store.get(*key)
        with pytest.raises(NotFound):
            store.chunks(*key)


def test_buckets_are_counted_replaced_and_removed(spark, store):
    assert store.buckets() == 0
    store.put("a", 0, 0, spark.range(4), buckets=4)
    store.put("a", 1, 0, spark.range(0))
    store.put("b", 0, 0, spark.range(2), buckets=2)
    store.put("b", 0, 0, spark.range(1), buckets=2)
    assert (store.buckets(), store.buckets("a"), store.buckets("b", 0), store.buckets("a", 1, 0)) == (7, 5, 2, 1)
    assert store.get("b", 0, 0, 0).count() == 1
    assert store.remove_query("a") == 5 and store.remove_query("a") == 0
    assert store.buckets() == 2
    with pytest.raises(NotFound):
        store.get("a", 0, 0, 0)


def test_a_task_that_failed_has_written_nothing(spark, store):
    with pytest.raises(Exception, match="lost"):
        store.put("q", 0, 0, spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("x")), buckets=2)
    with pytest.raises(NotFound):
        store.get("q", 0, 0, 0)
    assert store.buckets() == 0


AGGS = [{"fn": f, "as": f} | ({"arg": "v"} if f != "count_star" else {}) for f in ("count_star", "count", "sum", "min", "max", "avg")]


def two_halves(keys, kind, partial=AGGS, final=None):
    return ir.aggregate("Final", keys, ir.exchange(kind, ir.aggregate("Partial", keys, ir.exchange("RoundRobin", ir.scan("t")), partial)), final)


@pytest.mark.parametrize("seed", range(3))
def test_halves_of_an_aggregate_agree_with_one_group_by(spark, store, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(7)]), rng.choice([None, *range(9)])) for _ in range(rng.choice([0, 1, 80]))]
    tables = {"t": spark.createDataFrame(rows, "k int, v long")}
    plan = two_halves(["k"], {"Hash": ["k"]})
    own = run_fragments(spark, plan, tables, 3, store)
    one = compile_plan(spark, plan, tables)
    assert own.dtypes == one.dtypes
    assert sorted(own.collect(), key=str) == sorted(one.collect(), key=str)


def test_aggs_of_the_final_are_the_ones_that_count(spark, store):
    tables = {"t": spark.createDataFrame([(1, 2), (1, 4)], "k int, v long")}
    named = [{"fn": "sum", "arg": "v", "as": "total"}]
    for number, partial in enumerate((None, AGGS)):
        got = run_fragments(spark, two_halves(["k"], {"Hash": ["k"]}, partial, named), tables, 2, store, f"q-{number}")
        assert [r.asDict() for r in got.collect()] == [{"k": 1, "total": 6}]


def test_a_wrong_exchange_shows(spark, store):
    """Round robin doesn't bring equal keys together: one query as a whole can't tell, its fragments can."""
    tables = {"t": spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))}
    plan = two_halves(["k"], "RoundRobin")
    assert compile_plan(spark, plan, tables).count() == 2
    assert run_fragments(spark, plan, tables, 4, store).count() > 2
    assert run_fragments(spark, two_halves(["k"], {"Hash": ["k"]}), tables, 4, store, "q-1").count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_joins_of_buckets_with_null_keys_and_clashing_names(spark, store, how):
    tables = {"a": spark.createDataFrame([(i % 5 if i % 4 else None, i) for i in range(23)], "k int, v int"), "b": spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(19)], "k int, v int")}
    plan = ir.join("a.k = b.k", ir.exchange({"Hash": ["k"]}, ir.scan("a")), ir.exchange({"Hash": ["k"]}, ir.scan("b")), how)
    got, one = run_fragments(spark, plan, tables, 3, store), compile_plan(spark, plan, tables)
    assert got.columns == one.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_plans_that_cannot_be_run_by_tasks(spark, store):
    tables = {"t": spark.range(3).toDF("k")}
    with pytest.raises(NotExecutable):
        run_fragments(spark, ir.join("l.k = r.k", ir.exchange({"Hash": ["k"]}, ir.scan("t")), ir.scan("t")), tables, store=store)
    with pytest.raises(NotExecutable):
        run_fragments(spark, two_halves(["k"], "Coalesce", None), tables, store=store)
    with pytest.raises(AlreadyFragmented):
        run_fragments(spark, ir.Node("RemoteRead", {"fragment_id": 0}), tables, store=store)
