import json
import random

import pytest
from pyspark.sql import functions as F

from quernstone.errors import AlreadyFragmented, InvalidArgument, NotExecutable
from quernstone.plans import fragments as fr
from quernstone.plans import ir, tasks
from quernstone.plans.compile import compile_plan
from quernstone.plans.inspect import cut_plan
from quernstone.queries import DESCRIPTION, EXAMPLE_PLAN, described, example_fragments
from quernstone.session import profiled


def agg(mode, input, aggs=None):
    return ir.aggregate(mode, ["k"], input, aggs)


def test_json_round_trip():
    node = ir.loads(EXAMPLE_PLAN)
    assert ir.encode(node) == json.loads(EXAMPLE_PLAN)
    assert ir.loads(ir.dumps(node)) == node


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"Scan":{}}', '{"Scan":{"table":"t","x":1}}', '{"Nope":{}}', '{"Exchange":{"kind":"Nope","input":{"Scan":{"table":"t"}}}}', '{"Aggregate":{"mode":"Half","group_by":[],"input":{"Scan":{"table":"t"}}}}'])
def test_json_that_is_no_plan(text):
    with pytest.raises(InvalidArgument):
        ir.loads(text)


@pytest.mark.parametrize(
    ("plan", "inputs"),
    [
        (ir.filter_("a", ir.scan("t")), [()]),
        (agg("Final", ir.exchange({"Hash": ["k"]}, agg("Partial", ir.filter_("a", ir.scan("t"))))), [(), (0,)]),
        (ir.join("a", ir.exchange("RoundRobin", ir.scan("a")), ir.exchange("RoundRobin", ir.scan("b"))), [(), (), (0, 1)]),
        (ir.sort(["k"], ir.exchange("Coalesce", agg("Final", ir.exchange({"Hash": ["k"]}, ir.scan("t"))))), [(), (0,), (1,)]),
    ],
)
def test_fragment_shapes(plan, inputs):
    found = fr.fragment(plan)
    assert [f.inputs for f in found] == inputs
    assert [f.id for f in found] == list(range(len(found)))
    assert [f.output is None for f in found] == [False] * (len(found) - 1) + [True]
    assert all(f.root.kind == "ShuffleWrite" for f in found[:-1])


@pytest.mark.parametrize("node", [ir.Node("RemoteRead", {"fragment_id": 0}), ir.Node("ShuffleWrite", {"kind": "Coalesce"}, (ir.scan("t"),))])
def test_fragmented_plans_are_refused(node, spark):
    with pytest.raises(AlreadyFragmented):
        fr.fragment(ir.filter_("a", node))
    with pytest.raises(AlreadyFragmented):
        compile_plan(spark, node)


def test_ready_fragments():
    found = fr.fragment(ir.loads(EXAMPLE_PLAN))
    assert fr.ready_fragments(found, set()) == [0, 1]
    assert fr.ready_fragments(found, {0}) == [1]
    assert fr.ready_fragments(found, {0, 1}) == [2]
    assert fr.ready_fragments(found, set(range(5))) == []


def counts(frame):
    return [r["tasks"] for r in frame.orderBy("fragment_id").collect()]


def test_task_counts(spark):
    plan = ir.loads(EXAMPLE_PLAN)
    assert counts(fr.fragments_frame(spark, plan)) == [1, 1, 4, 4, 1]
    assert counts(example_fragments(spark)) == [8, 2, 4, 4, 1]
    assert counts(fr.fragments_frame(spark, ir.exchange({"Hash": ["k"]}, ir.scan("t")), 0, {"t": 0}, 0)) == [1, 1]
    broadcast = fr.fragments_frame(spark, ir.join("a", ir.exchange("Broadcast", ir.scan("small")), ir.scan("big")), scan_splits={"big": 6})
    assert counts(broadcast) == [1, 6]
    assert {r["bucket"] for r in tasks.edges(broadcast).collect()} == {0}
    assert tasks.tasks(example_fragments(spark)).count() == 19


def test_edges_read_every_bucket_once(spark):
    own = tasks.edges(described(spark)).collect()
    assert len(own) == 44
    seen = [(r["input_fragment"], r["producer_partition"], r["bucket"]) for r in own]
    assert len(set(seen)) == 44
    assert sum(n for _, n, _, _ in DESCRIPTION) == 15


def test_readiness_trace(spark):
    frame = example_fragments(spark)
    everything = tasks.tasks(frame).select(*tasks.KEY).cache()

    def ready(where):
        return tasks.ready_tasks(frame, everything.where(where)).count()

    steps = ["false", "fragment_id = 0", "fragment_id = 0 or (fragment_id = 1 and partition = 0)", "fragment_id <= 1", "fragment_id <= 2", "fragment_id <= 3", "true"]
    assert [ready(w) for w in steps] == [10, 2, 1, 4, 4, 1, 0]


def test_render(spark):
    lines = fr.render(example_fragments(spark)).splitlines()
    assert len(lines) == 5
    assert lines[0].startswith("F0  tasks=8") and lines[-1].endswith("output=client")


def test_plans_that_say_too_little_are_not_run(spark):
    tables = {"t": spark.createDataFrame([(1, 2)], "k int, v int")}
    run = lambda p: compile_plan(spark, p, tables)
    for plan in (
        agg("Partial", ir.scan("t")),
        agg("Final", agg("Partial", ir.scan("t"))),
        agg("Final", agg("Partial", ir.scan("t"), [{"fn": "nope", "as": "x"}])),
        ir.sort(["missing"], ir.scan("t")),
        ir.filter_("nowhere >= 1", ir.scan("t")),
        ir.filter_("DATE '2024-01-01' >= 2024-01-01", ir.scan("t")),
        ir.join("k = k", ir.scan("t"), ir.scan("t"), "sideways"),
    ):
        with pytest.raises(NotExecutable):
            run(plan)
    done = run(agg("Final", ir.exchange({"Hash": ["k"]}, agg("Partial", ir.scan("t"), [{"fn": "min", "arg": "v", "as": "lo"}]))))
    assert [tuple(r) for r in done.collect()] == [(1, 2)]


def test_exchanges_are_kept_on_request(spark):
    tables = {"t": spark.range(100).toDF("k")}
    df = compile_plan(spark, ir.exchange({"Hash": ["k"]}, ir.scan("t")), tables, 5, honor_exchanges=True)
    assert df.rdd.getNumPartitions() == 5
    assert compile_plan(spark, ir.exchange("Coalesce", ir.scan("t")), tables, honor_exchanges=True).rdd.getNumPartitions() == 1


def test_cut_of_a_spark_plan(spark):
    own = profiled(spark, "golden")
    a = own.range(1000).selectExpr("id % 10 as k", "id as v")
    frame = cut_plan(a.groupBy("k").count().orderBy("k"))
    rows = frame.orderBy("fragment_id").collect()
    assert [r["output"] for r in rows] == ["hash", "range", None]
    assert [[i["fragment_id"] for i in r["inputs"]] for r in rows] == [[], [0], [1]]
    assert all(r["tasks"] >= 1 for r in rows)
    with pytest.raises(ValueError):
        cut_plan(spark.range(10).groupBy("id").count())


def test_settings_of_the_environment():
    assert fr.expand_settings({}) == {"shuffle_partitions": 4, "default_splits": 1}
    assert fr.expand_settings({"SCHEDULER_SHUFFLE_PARTITIONS": "16", "SCHEDULER_SCAN_SPLITS": "0"}) == {"shuffle_partitions": 16, "default_splits": 1}
    assert fr.expand_settings({"SCHEDULER_SCAN_SPLITS": "many"})["default_splits"] == 1


def test_unknown_partitionings_are_an_error():
    from quernstone.plans import inspect

    assert inspect.output_of("HashPartitioning") == "hash"
    with pytest.raises(inspect.UnsupportedPartitioning):
        inspect.output_of("KeyGroupedPartitioning")


def test_sides_of_one_letter(spark):
    """Tables whose names begin alike, or one table twice, are l and r."""
    spark.range(4).createOrReplaceTempView("same_letter")
    spark.range(2, 6).createOrReplaceTempView("same_other")
    for right, n in (("same_other", 2), ("same_letter", 4)):
        assert compile_plan(spark, ir.join("l.id = r.id", ir.scan("same_letter"), ir.scan(right))).count() == n


# --- joins whose keys meet many rows with many -----------------------------------------------------


@pytest.fixture
def small_blocks(monkeypatch):
    from quernstone.operators import join

    for name, n in {"BLOCK_ROWS": 7, "TASK_PAIRS": 200, "TASK_ROWS": 50, "MANY": 1}.items():
        monkeypatch.setattr(join, name, n)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", ["x.k = y.k", "x.k = y.k AND x.v % 3 = y.w % 3", "x.k = y.k AND x.v < y.w", "x.k <=> y.k", "x.k = y.k AND x.v > 1000", "x.k * -0.5D = y.k * -0.5D"])
def test_joins_in_blocks_are_whole(spark, small_blocks, how, on):
    """Null keys, keys of one side only, repeated rows, a column that both sides have, other conditions."""
    x = spark.range(400).selectExpr("if(id % 9 = 0, null, id % 9) k", "id div 2 v")
    y = spark.range(300).selectExpr("cast(if(id % 11 < 2, null, if(id % 11 < 7, 2, id % 11)) as int) k", "id div 3 w")
    got = compile_plan(spark, ir.join(on, ir.scan("x"), ir.scan("y"), how), {"x": x, "y": y})
    one = x.alias("x").join(y.alias("y"), F.expr(on), how)
    assert got.columns == one.columns and [f.dataType for f in got.schema] == [f.dataType for f in one.schema]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)


def test_joins_in_blocks_behind_a_shuffle_and_of_one_table(spark, small_blocks):
    """Both sides one table, one of them aggregated or joined before; names of sides still hold above the join."""
    t = spark.range(300).selectExpr("id % 4 k", "id v")
    grouped = ir.aggregate("Final", ["v", "k"], ir.aggregate("Partial", ["v", "k"], ir.scan("t"), [{"fn": "count_star", "as": "n"}]))
    plan = ir.project(["l.v AS a", "r.v AS b", "n"], ir.join("l.k = r.k", grouped, ir.scan("t"), "left"))
    got = compile_plan(spark, plan, {"t": t})
    assert got.count() == got.distinct().count() == 300 * 75
    nested = ir.join("l.k = t.k", ir.project(["l.k AS k", "r.v AS v"], ir.join("l.k = r.k", ir.scan("t"), ir.scan("t"))), ir.filter_("v < 8", ir.scan("t")))
    assert compile_plan(spark, nested, {"t": t}).count() == 300 * 75 * 2


@pytest.mark.parametrize("how", ["left", "right", "full", "inner"])
def test_pairs_of_a_key_are_dealt_out(spark, monkeypatch, how):
    """One key, 90,000 pairs: no task gives a quarter of them. Equal rows as well."""
    from quernstone.operators import join

    for name, n in {"BLOCK_ROWS": 20, "TASK_PAIRS": 1000}.items():
        monkeypatch.setattr(join, name, n, raising=False)
    for value in ("id", "1L"):
        tables = {n: spark.range(300).selectExpr("1 k", f"{value} v") for n in ("x", "y")}
        got = compile_plan(spark, ir.join("x.k = y.k", ir.scan("x"), ir.scan("y"), how), tables)
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 90_000 and max(parts) < 22_500


def test_joins_that_do_not_multiply_rows_stay_plain(spark, small_blocks):
    tables = {"x": spark.range(1000).selectExpr("id k"), "y": spark.range(1000).selectExpr("id k", "id v")}
    plan = compile_plan(spark, ir.join("x.k = y.k", ir.scan("x"), ir.scan("y")), tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


# --- random plans against plain loops ---------------------------------------------------------------


def random_plan(rng, deep=6):
    below = lambda: random_plan(rng, deep - 1)
    kind = rng.choice(["scan", "filter", "project", "join", "aggregate", "exchange", "exchange", "exchange"]) if deep else "scan"
    if kind == "scan":
        return ir.scan(rng.choice(["a", "b", "c"]))
    if kind == "filter":
        return ir.filter_("k > 0", below())
    if kind == "project":
        return ir.project(["k"], below())
    if kind == "join":
        return ir.join("l.k = r.k", below(), below())
    if kind == "aggregate":
        return ir.aggregate(rng.choice(["Partial", "Final"]), ["k"], below())
    return ir.exchange(rng.choice([{"Hash": ["k"]}, "RoundRobin", "Broadcast", "Coalesce"]), below())


def plain_fragments(plan, parts, splits):
    """(operators, [(input, partitioned)], output, buckets, tasks) of each fragment."""
    out = []

    def go(node, operators, inputs, tables):
        if node.kind == "Exchange":
            close(node.inputs[0], node.exchange()[0])
            inputs.append((len(out) - 1, out[-1][2] in ("Hash", "RoundRobin")))
            return
        operators.append(node.kind)
        tables += [node.fields["table"]] if node.kind == "Scan" else []
        for child in node.inputs:
            go(child, operators, inputs, tables)

    def close(top, output):
        operators, inputs, tables = [], [], []
        go(top, operators, inputs, tables)
        tasks_ = parts if any(p for _, p in inputs) else max([splits.get(t, 1) for t in tables], default=1)
        out.append((operators, inputs, output, parts if output in ("Hash", "RoundRobin") else 1, tasks_))

    close(plan, None)
    return out


@pytest.fixture(scope="module")
def some_plans(spark):
    rng = random.Random(17)
    plans = {f"q-{k}": random_plan(rng) for k in range(25)}
    splits = {"a": 3, "b": 2}
    plain = {q: plain_fragments(p, 4, splits) for q, p in plans.items()}
    frames = [fr.fragments_frame(spark, p, 4, splits, query_id=q) for q, p in plans.items()]
    rows = [tuple(r) for f in frames for r in f.collect()]
    return plain, spark.createDataFrame(rows, fr.SCHEMA).cache()


def test_random_plans_fragments_tasks_and_edges(some_plans):
    plain, frame = some_plans
    names = {"Hash": "hash", "RoundRobin": "round_robin", "Broadcast": "broadcast", "Coalesce": "coalesce", None: None}
    got = {(r["query_id"], r["fragment_id"]): (r["operators"], [tuple(i) for i in r["inputs"]], r["output"], r["output_partitions"], r["tasks"]) for r in frame.collect()}
    assert got == {(q, i): (*f[:2], names[f[2]], *f[3:]) for q, own in plain.items() for i, f in enumerate(own)}
    assert {tuple(r) for r in fr.output_buckets(frame).collect()} == {(q, i, f[3]) for q, own in plain.items() for i, f in enumerate(own)}
    assert {tuple(r)[:3] for r in tasks.tasks(frame).collect()} == {(q, i, p) for q, own in plain.items() for i, f in enumerate(own) for p in range(f[4])}
    edges = [(q, i, p, j, k, p if part else 0) for q, own in plain.items() for i, f in enumerate(own) for p in range(f[4]) for j, part in f[1] for k in range(own[j][4])]
    assert len(edges) > 400 and sorted(tuple(r) for r in tasks.edges(frame).collect()) == sorted(edges)


def test_random_plans_ready_and_dispatchable(spark, some_plans):
    plain, frame = some_plans
    rng = random.Random(4)
    phases = {}
    for q, own in plain.items():
        likely = rng.choice([0.5, 0.9, 1.0])
        broken = rng.random() < 0.2
        for i, f in enumerate(own):
            for p in range(f[4]):
                phases[q, i, p] = "DONE" if rng.random() < likely * (i < len(own) * 0.7) else rng.choice(["PENDING", "PENDING", "DISPATCHED"] + ["FAILED", "CANCELLED"] * broken)
    complete = {(q, i) for q, own in plain.items() for i, f in enumerate(own) if all(phases[q, i, p] == "DONE" for p in range(f[4]))}
    ready = {(q, i, p) for q, own in plain.items() for i, f in enumerate(own) for p in range(f[4]) if phases[q, i, p] != "DONE" and all((q, j) in complete for j, _ in f[1])}
    dead = {k[0] for k, v in phases.items() if v in ("FAILED", "CANCELLED")}
    rows = spark.createDataFrame([(*k, v, f"w-{k[2]}" if v == "DONE" else None) for k, v in phases.items()], "query_id string, fragment_id int, partition int, phase string, worker_id string")
    assert {tuple(r) for r in tasks.ready_tasks(frame, rows.where("phase = 'DONE'")).collect()} == ready
    assert {tuple(r) for r in tasks.dispatchable(frame, rows).collect()} == {k for k in ready if phases[k] == "PENDING" and k[0] not in dead}
    done = {(q, i) for q, own in plain.items() for i in range(len(own)) if rng.random() < 0.6}
    got = fr.ready_frame(frame, spark.createDataFrame(sorted(done), "query_id string, fragment_id int"))
    assert {tuple(r) for r in got.collect()} == {(q, i) for q, own in plain.items() for i, f in enumerate(own) if (q, i) not in done and all((q, j) in done for j, _ in f[1])}
    located = {tuple(r) for r in tasks.task_inputs(frame, rows.where("phase = 'DONE'").drop("phase")).collect()}
    expected = {(q, i, p, j, k, p if part else 0, f"w-{k}") for q, own in plain.items() for i, f in enumerate(own) for p in range(f[4]) for j, part in f[1] for k in range(own[j][4]) if all((q, x) in complete for x, _ in f[1])}
    assert expected and located == expected


def first_error(rows):
    """The needle of the first rule that a description (id, tasks, buckets, has a plan, inputs) breaks, by the order of the rules."""
    if not rows:
        return "no fragments"
    for at, (own, n, buckets, has_plan, inputs) in enumerate(rows):
        if own != at:
            return "has id"
        if n == 0:
            return "no tasks"
        if buckets == 0:
            return "zero output partitions"
        if not has_plan:
            return "empty plan"
        for i, part in inputs:
            if i >= at or i < 0:
                return "does not precede"
            if part and rows[i][2] != n:
                return "buckets, which"
            if not part and rows[i][2] != 1:
                return "reads only bucket 0"
    return "root fragment" if rows[-1][2] != 1 else None


def test_random_descriptions_by_the_rules(spark):
    rng, made = random.Random(6), {}
    for k in range(150):
        rows = []
        for at in range(rng.randint(0, 5)):
            inputs = [(rng.randint(0, max(0, at - 1)) if at and rng.random() < 0.95 else at, rng.random() < 0.6) for _ in range(rng.choice([0, 1, 1, 2]) if at else 0)]
            n = next((rows[i][2] for i, p in inputs if p and i < at), rng.randint(1, 2)) if rng.random() < 0.9 else rng.randint(0, 3)
            inputs = [(i, rows[i][2] != 1 if i < at and rng.random() < 0.9 else p) for i, p in inputs]
            rows.append((at if rng.random() < 0.97 else at + 1, n, rng.choice([1, 1, 2]) if rng.random() < 0.97 else 0, rng.random() < 0.97, inputs))
        if rows and rng.random() < 0.8:
            rows[-1] = (*rows[-1][:2], 1, *rows[-1][3:])
        made[f"q-{k}"] = rows
    schema = "query_id string, position int, fragment_id int, tasks int, output_partitions int, has_plan boolean, inputs array<struct<fragment_id:int,partitioned:boolean>>"
    data = [(q, at, *r) for q, rows in made.items() for at, r in enumerate(rows)] + [(q, None, None, None, None, None, []) for q, rows in made.items() if not rows]
    got = {r["query_id"]: r["error"] for r in tasks.validate(spark.createDataFrame(data, schema)).collect()}
    wanted = {q: first_error(rows) for q, rows in made.items()}
    assert len(set(wanted.values())) >= 7
    for q, needle in wanted.items():
        assert (got[q] is None) if needle is None else (needle in (got[q] or "")), (q, made[q], needle, got[q])
