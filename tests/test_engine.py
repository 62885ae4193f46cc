import random
import time

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone import catalog, queries, sources
from quernstone.errors import FailedPrecondition, InvalidArgument, NotFound
from quernstone.functions import order_key, whole_division
from quernstone.lifecycle import QueryManager
from quernstone.metrics import serial_share
from quernstone.operators import colocated, hash_exchange, round_robin_exchange
from quernstone.plans import ir, scheduling
from quernstone.streaming import from_chunks, to_chunks


def duck(data):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame, ordered: bool) -> list:
    rows = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return rows if ordered else sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, data, name):
    sql = queries.ORACLES[name]
    got, expected = queries.QUERIES[name](spark, data).toPandas(), duck(data).sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    ordered = "ORDER BY" in sql.rsplit(")", 1)[-1]
    assert plain(got, ordered) == plain(expected, ordered)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_example_tables(spark):
    catalog.example_orders(spark).createOrReplaceTempView("example_orders")
    catalog.example_customers(spark).createOrReplaceTempView("example_customers")
    rows = spark.sql("SELECT c.segment, COUNT(*), SUM(o.total) AS revenue FROM example_orders o JOIN example_customers c ON o.cust_id = c.id WHERE o.order_date >= DATE '2024-01-01' GROUP BY c.segment ORDER BY revenue DESC").collect()
    assert [tuple(r) for r in rows] == [("wholesale", 3400, 83200.0), ("retail", 3400, 80000.0), ("online", 3200, 76800.0)]
    assert spark.table("example_orders").where("cust_id = 7").count() == 200


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = queries.filter_sort_scan(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_orderpriority" not in plan


def test_order_key_and_division(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in df.orderBy(order_key("x")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(order_key("x", True)).collect()] == [None, 2, 1]
    assert spark.range(1).select(whole_division(F.lit(-7), F.lit(2))).first()[0] == -3
    with pytest.raises(ValueError):
        order_key("x", nulls="middle")


def test_exchanges(spark):
    df = spark.range(1000).selectExpr("id % 10 as k")
    assert colocated(hash_exchange(df, 8, "k"), "k").count() == 0
    assert colocated(round_robin_exchange(df, 8), "k").count() == 10


def test_settings_and_empty(spark):
    assert sources.settings(spark, "%session.timeZone").first()["value"] == "UTC"
    assert sources.empty(spark, "a int").count() == 0


def test_chunks(spark):
    df = spark.range(10, numPartitions=3).orderBy("id")
    chunks = list(to_chunks(df, rows=4))
    assert len(chunks) >= 3
    assert from_chunks(chunks).column("id").to_pylist() == list(range(10))
    assert list(to_chunks(df.where("id < 0"))) == []


def replay(log):
    state, allowed = "QUEUED", {"QUEUED": {"RUNNING", "FAILED", "CANCELLED"}, "RUNNING": {"SUCCEEDED", "FAILED", "CANCELLED"}}
    for e in log:
        if e in allowed.get(state, ()):
            state = e
    return state


def test_query_states_against_a_machine(spark):
    rng, states = random.Random(5), ["QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"]
    logs = {f"q-{i}": [rng.choice(states) for _ in range(rng.randint(1, 6))] for i in range(400)}
    events = spark.createDataFrame([(q, k, s) for q, log in logs.items() for k, s in enumerate(log)], "query_id string, seq int, state string")
    assert {r[0]: r[1] for r in scheduling.query_states(events).collect()} == {q: replay(log) for q, log in logs.items()}


def replay_tasks(log):
    """(phase, worker, message, ended) by task after (seq, task or none, event, worker, message) in order; a loss takes back all that is out with that worker."""
    now = {}
    for seq, task, event, worker, message in log:
        if event == "LOST":
            now |= {t: ("PENDING", None, None, None) for t, s in now.items() if s[:2] == ("DISPATCHED", worker)}
            continue
        phase, held, *_ = own = now.setdefault(task, ("PENDING", None, None, None))
        if phase == "PENDING":
            now[task] = {"DISPATCH": ("DISPATCHED", worker, None, None), "CANCEL": ("CANCELLED", None, None, None)}.get(event, own)
        elif phase == "DISPATCHED":
            back = ("PENDING", None, None, None)
            now[task] = {"REVERT": back, "REQUEUE": back, "SUCCESS": ("DONE", held, None, None), "FAILURE": ("FAILED", None, message, seq), "CANCEL": ("CANCELLED", None, None, None)}.get(event, own)
    return now


def lossy_log(rng, step):
    """A random log of sixty tasks and four workers, its numbers `step` apart at most; a fifth are losses."""
    seq, log = 0, []
    for _ in range(1500):
        seq += rng.randint(1, step)
        event = rng.choices(["LOST", "DISPATCH", "REVERT", "REQUEUE", "SUCCESS", "FAILURE", "CANCEL"], [30, 90, 10, 10, 5, 3, 2])[0]
        worker = f"w-{rng.randrange(4)}" if event in ("LOST", "DISPATCH") else None
        log.append((seq, None if event == "LOST" else (f"q-{rng.randrange(10)}", rng.randrange(3), rng.randrange(2)), event, worker, f"message {seq}" if event == "FAILURE" else None))
    return log


TASK_EVENTS = "query_id string, fragment_id int, partition int, seq long, event string, worker_id string, message string"


def split_log(spark, log):
    own = spark.createDataFrame([(*task, seq, event, worker, message) for seq, task, event, worker, message in log if task], TASK_EVENTS)
    return own, spark.createDataFrame([(worker, seq) for seq, task, _, worker, _ in log if not task], "worker_id string, seq long")


@pytest.mark.parametrize("step", [1, 40, 10_000])
def test_lost_workers_against_a_loop(spark, step):
    """Also where a chunk of numbers holds the whole log, a part of it or one event."""
    log = lossy_log(random.Random(step), step)
    every = scheduling.with_lost_workers(*split_log(spark, log))
    got = {(r["query_id"], r["fragment_id"], r["partition"]): (r["phase"], r["worker_id"], r["error_message"], r["ended"]) for r in scheduling.task_phases(every).collect()}
    assert got == replay_tasks(log)


def test_losses_are_not_dealt_to_every_task(spark):
    """Each DISPATCH meets one loss at most: not as many as there are tasks times losses."""
    own = spark.range(300).selectExpr("'q' query_id", "cast(id as int) fragment_id", "0 partition", "id seq", "'DISPATCH' event", "'w-0' worker_id", "cast(null as string) message")
    lost = spark.range(100, 10_100).selectExpr("'w-0' worker_id", "id * 3 seq")
    every = scheduling.with_lost_workers(own, lost)
    assert every.where("event = 'LOST'").count() <= own.count()
    assert scheduling.task_phases(every).where("phase = 'PENDING'").count() == 300


def test_losses_without_a_number_or_a_worker(spark):
    """A null number is before all others, and a DISPATCH before a LOST of the same number; a null worker is none."""
    own = spark.createDataFrame([("q", 0, 0, None, "DISPATCH", "w-0", None), ("q", 1, 0, 5, "DISPATCH", "w-1", None), ("q", 2, 0, 1, "DISPATCH", None, None), ("q", 3, 0, 1, "DISPATCH", "w-0", None)], TASK_EVENTS)
    lost = spark.createDataFrame([("w-0", None), ("w-1", 5), (None, 7)], "worker_id string, seq long")
    assert {r["fragment_id"]: r["phase"] for r in scheduling.task_phases(scheduling.with_lost_workers(own, lost)).collect()} == {0: "PENDING", 1: "PENDING", 2: "DISPATCHED", 3: "DISPATCHED"}


def test_outcomes_of_a_log_with_lost_workers(spark, monkeypatch):
    """The query's losses meet each DISPATCH once at most, and outcomes equal those of a plain loop."""
    log = lossy_log(random.Random(9), 40)
    expected = {}
    for (q, *_), s in replay_tasks(log).items():
        expected.setdefault(q, []).append(s)
    for q, own in expected.items():
        phases, failed = {s[0] for s in own}, sorted((s[3], s[2]) for s in own if s[0] == "FAILED")
        state = next((p for p in ("FAILED", "CANCELLED") if p in phases), None) or ("SUCCEEDED" if phases == {"DONE"} else "RUNNING" if phases & {"DISPATCHED", "DONE"} else "QUEUED")
        expected[q] = (state, failed[0][1] if failed else None)
    phases = scheduling.task_phases(scheduling.with_lost_workers(*split_log(spark, log)))
    assert {r["query_id"]: (r["state"], r["error_message"]) for r in scheduling.query_outcomes(phases).collect()} == expected
    monkeypatch.setattr(scheduling, "task_phases", lambda events: events)
    monkeypatch.setattr(scheduling, "query_outcomes", lambda events: events)
    n = {r["event"]: r["count"] for r in queries.query_outcomes(spark, "/root/testdata/sf0.01").groupBy("event").count().collect()}
    assert 0 < n["LOST"] <= n["DISPATCH"]


def test_assignments_against_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        workers = [(f"w-{i}", rng.randint(1, 5), 0) for i in range(12)]
        load, expected = {w: [used, slots] for w, slots, used in workers}, []
        for _ in range(20):
            free = [(u / s, w) for w, (u, s) in load.items() if u < s]
            if not free:
                break
            w = min(free)[1]
            expected.append(w)
            load[w][0] += 1
        got = scheduling.assignments(spark.createDataFrame(workers, "worker_id string, slots int, in_flight int"), 20).orderBy("n").collect()
        assert [r["worker_id"] for r in got] == expected


def test_stale_is_older_than_the_timeout(spark):
    beats = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('b', TIMESTAMP '2024-01-01 00:00:01') AS t(worker_id, ts)")
    stale = scheduling.stale_workers(beats, F.expr("TIMESTAMP '2024-01-01 00:00:16'"), F.expr("INTERVAL 15 SECONDS"))
    assert [r[0] for r in stale.collect()] == ["a"]


def test_root_outputs(spark):
    frame = queries.example_fragments(spark)
    from quernstone.plans import tasks

    done = tasks.tasks(frame).select(*tasks.KEY, F.lit("DONE").alias("phase"), F.lit("w-0").alias("worker_id"))
    assert [tuple(r) for r in scheduling.root_outputs(frame, done).collect()] == [("q-0", 0, "w-0")]
    assert scheduling.root_outputs(frame, done.where("fragment_id > 0").unionByName(done.where("fragment_id = 0").withColumn("phase", F.lit("PENDING")))).count() == 0


def test_serial_share(spark):
    runs = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 6.0), ("a", 4, 4.0), ("b", 1, 3.0)], "query string, workers int, seconds double")
    rows = {r["query"]: r for r in serial_share(runs).collect()}
    assert rows["a"]["t_serial"] == pytest.approx(2) and rows["a"]["t_parallel"] == pytest.approx(8)
    assert rows["b"]["t_parallel"] is None


def test_lifecycle(spark, data):
    m = QueryManager(spark, {"orders": catalog.table(spark, data, "orders"), "customer": catalog.table(spark, data, "customer")})
    first = m.submit(queries.join_agg_sort(spark, data))
    second = m.submit(plan=ir.dumps(queries.PLAN))
    third = m.submit("SELECT id FROM range(5) ORDER BY id DESC")
    assert [first, second, third] == ["q-0", "q-1", "q-2"]
    assert [m.wait(q, 120) for q in (first, second, third)] == ["SUCCEEDED"] * 3
    a, b = from_chunks(m.fetch(first)), from_chunks(m.fetch(second))
    assert a.column("orders").to_pylist() == b.column("orders").to_pylist() and a.num_rows == 5
    assert from_chunks(m.fetch(third)).column("id").to_pylist() == [4, 3, 2, 1, 0]
    assert m.metrics(first).count() > 0 and m.status(first)["error_message"] == ""
    with pytest.raises(FailedPrecondition):
        m.cancel(first)


def test_lifecycle_errors(spark):
    m = QueryManager(spark)
    for bad in ("", "SELEKT 1", "SELECT * FROM nowhere_at_all"):
        with pytest.raises(InvalidArgument):
            m.submit(bad)
    with pytest.raises(InvalidArgument):
        m.submit("SELECT 1", plan="{}")
    with pytest.raises(InvalidArgument):
        m.submit()
    with pytest.raises(InvalidArgument):
        m.submit(plan="garbage")
    for ask in (m.status, m.fetch, m.cancel, m.metrics):
        with pytest.raises(NotFound):
            ask("q-99")
    failing = m.submit("SELECT raise_error('boom') AS x")
    assert m.wait(failing, 60) == "FAILED" and m.status(failing)["error_message"]
    with pytest.raises(FailedPrecondition):
        m.fetch(failing)


def slow(spark):
    def run(batches):
        for b in batches:
            time.sleep(60)
            yield b

    return spark.range(4, numPartitions=2).mapInArrow(run, "id long")


def test_cancel(spark):
    m = QueryManager(spark)
    own = m.submit(slow(spark))
    waited = time.time()
    while m.status(own)["state"] != "RUNNING" and time.time() - waited < 30:
        time.sleep(0.1)
    m.cancel(own)
    assert m.wait(own, 5) == "CANCELLED"
    m._queries[own].thread.join(30)
    assert not m._queries[own].thread.is_alive()
    assert m.status(own)["state"] == "CANCELLED"
    late = m.submit(slow(spark), timeout_ms=1500)
    assert m.wait(late, 30) == "CANCELLED" and "1500" in m.status(late)["error_message"]


def test_cancel_at_any_moment(spark):
    """Also between the state and the first job."""
    m = QueryManager(spark)
    for k in range(20):
        own = m.submit(slow(spark))
        time.sleep(0.02 * k)
        m.cancel(own)
        m._queries[own].thread.join(20)
        assert not m._queries[own].thread.is_alive() and m.status(own)["state"] == "CANCELLED"


def test_submitted_texts(spark, tmp_path):
    m = QueryManager(spark)
    copy = m.submit(f"COPY (SELECT value % 7 AS k FROM generate_series(1, 100)) TO '{tmp_path}/copied' STORED AS PARQUET")
    assert m.wait(copy, 60) == "SUCCEEDED" and from_chunks(m.fetch(copy)).column("count").to_pylist() == [100]
    assert spark.read.parquet(f"{tmp_path}/copied").distinct().count() == 7
    odd = m.submit("SELECT a.value, b.value, NULL AS none FROM generate_series(1, 3) a JOIN generate_series(2, 4) b ON a.value = b.value ORDER BY 1 DESC")
    assert m.wait(odd, 60) == "SUCCEEDED"
    table = from_chunks(m.fetch(odd))
    assert table.column_names == ["value", "value", "none"] and table.column(0).to_pylist() == [3, 2] and table.column(2).to_pylist() == [None, None]
    settings = m.submit("SELECT value FROM information_schema.df_settings WHERE name = 'spark.sql.session.timeZone'")
    assert m.wait(settings, 60) == "SUCCEEDED" and from_chunks(m.fetch(settings)).column("value").to_pylist() == ["UTC"]
    with pytest.raises(InvalidArgument):
        m.submit(f"COPY (SELECT 1 AS x) TO '{tmp_path}/x' STORED AS CSV")
    m.forget(odd)
    assert list(m.fetch(odd)) == []


def test_large_results_come_in_order(spark, monkeypatch):
    from quernstone import lifecycle

    monkeypatch.setattr(lifecycle, "FILE_ROWS", 700)
    m = QueryManager(spark)
    own = m.submit(spark.range(5000, numPartitions=4).orderBy(F.desc("id")))
    assert m.wait(own, 60) == "SUCCEEDED"
    assert from_chunks(m.fetch(own)).column("id").to_pylist() == list(range(4999, -1, -1))
    assert sum(r["output_rows"] for r in m.metrics(own).groupBy("stage_id").agg(F.sum("output_rows").alias("output_rows")).collect()) >= 5000


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from quernstone.session import shared_folder

    context = SimpleNamespace(getConf=dict, master="spark://somewhere:7077", applicationId="x")
    elsewhere = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(FailedPrecondition):
        shared_folder(elsewhere)
    elsewhere.sparkContext.master, elsewhere.sparkContext.applicationId = "local[4]", "y"
    assert shared_folder(elsewhere).startswith("file:") and shared_folder(spark)


def test_two_phase_has_one_exchange(spark, data):
    plan = queries.agg_two_phase(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_cancel_before_a_slot_is_free(spark):
    m = QueryManager(spark, slots=1)
    first = m.submit(slow(spark))
    waiting = m.submit("SELECT 1 AS x")
    time.sleep(0.5)
    assert m.status(waiting)["state"] == "QUEUED"
    m.cancel(waiting)
    m.cancel(first)
    assert m.wait(waiting, 5) == "CANCELLED"
    for q in (first, waiting):
        m._queries[q].thread.join(30)
        assert not m._queries[q].thread.is_alive()


def test_arrow_chunks_are_whole_streams():
    from quernstone.streaming.ipc import decode_chunk, encode_batch

    batch = pa.record_batch({"n": pa.array([1, 2, 3], pa.int32()), "s": pa.array(["a", "b", "c"])})
    assert decode_chunk(encode_batch(batch)) == [batch]
