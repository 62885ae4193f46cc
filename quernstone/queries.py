"""The engine's registered queries over the driver's tables, each with the same question in DuckDB's SQL where SQL can ask it.

Queries of plans and schedules run over fixed small descriptions (their sizes are known
numbers); the others run over whole tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators, sources
from .catalog import TABLES, table
from .functions import money, order_key
from .metrics import scaling_efficiency
from .plans import fragments as fr
from .plans import ir, scheduling, tasks
from .plans.compile import compile_plan
from .plans.inspect import cut_plan
from .plans.store import ShuffleStore, run_fragments
from .session import profiled, shared_folder
from .streaming import ipc_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


# --- Relational queries over tables -------------------------------------------------------------

FLAGSHIP = """SELECT c.c_mktsegment AS segment, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate >= DATE '1998-01-01' GROUP BY c.c_mktsegment ORDER BY revenue DESC NULLS FIRST"""


@query(FLAGSHIP)
def join_agg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by segment: filter below the join, two-phase aggregate, order by a sum. The join side is chosen at run time by size."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), money(F.sum("o_totalprice")).alias("revenue")).orderBy(order_key("revenue", True))


PLAN = ir.sort(
    [{"col": "revenue", "desc": True}],
    ir.exchange(
        "Coalesce",
        ir.aggregate(
            "Final",
            ["c_mktsegment"],
            ir.exchange(
                {"Hash": ["c_mktsegment"]},
                ir.aggregate(
                    "Partial",
                    ["c_mktsegment"],
                    ir.join(
                        "o.o_custkey = c.c_custkey",
                        ir.exchange({"Hash": ["o_custkey"]}, ir.filter_("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'", ir.scan("orders"))),
                        ir.exchange({"Hash": ["c_custkey"]}, ir.scan("customer")),
                    ),
                    [{"fn": "count_star", "as": "orders"}, {"fn": "sum", "arg": "o_totalprice", "as": "revenue"}],
                ),
            ),
        ),
    ),
)


@query(FLAGSHIP, "plan_join_agg_sort")
def plan_join_agg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question as a JSON plan, through its text and the compiler."""
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    return compile_plan(spark, ir.loads(ir.dumps(PLAN)), tables).select(F.col("c_mktsegment").alias("segment"), "orders", money(F.col("revenue")).alias("revenue"))


PROJECT_PLAN = ir.project(
    ["c_custkey", "n_name AS nation", "c_acctbal * 2 AS twice"],
    ir.exchange("RoundRobin", ir.join("c.c_nationkey = n.n_nationkey", ir.exchange({"Hash": ["c_nationkey"]}, ir.scan("customer")), ir.exchange("Broadcast", ir.scan("nation")))),
)


@query("SELECT c_custkey, n_name AS nation, c_acctbal * 2 AS twice FROM customer JOIN nation ON c_nationkey = n_nationkey")
def plan_project_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with Project, RoundRobin and Broadcast nodes, its exchanges honoured."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    return compile_plan(spark, ir.loads(ir.dumps(PROJECT_PLAN)), tables, honor_exchanges=True)


@query(FLAGSHIP, "fragments_join_agg_sort")
def fragments_join_agg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's plan run task by task of its fragments, over stored buckets."""
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    return run_fragments(spark, PLAN, tables).select(F.col("c_mktsegment").alias("segment"), "orders", money(F.col("revenue")).alias("revenue"))


@query(ORACLES["plan_project_broadcast"], "fragments_project_broadcast")
def fragments_project_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_fragments(spark, PROJECT_PLAN, {t: table(spark, sf_dir, t) for t in ("customer", "nation")})


@query("SELECT o_orderkey, o_custkey, o_custkey % 5 AS bucket FROM orders")
def bucket_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table put into seven buckets by a key and read back bucket by bucket; two of them are empty."""
    store = ShuffleStore(spark)
    store.put("q", 0, 0, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("pmod(o_custkey, 5)").cast("int"), 7)
    parts = [store.get("q", 0, 0, b).withColumn("bucket", F.lit(b).cast("long")) for b in range(7)]
    return reduce(DataFrame.union, parts)


def _join_plan(how: str) -> ir.Node:
    rich = ir.filter_("c_acctbal > 0", ir.scan("customer"))
    return ir.join("c.c_nationkey = s.s_nationkey AND c.c_custkey % 7 = s.s_suppkey % 7", ir.exchange({"Hash": ["c_nationkey"]}, rich), ir.exchange({"Hash": ["s_nationkey"]}, ir.scan("supplier")), how)


_SIDES = "(SELECT * FROM customer WHERE c_acctbal > 0) c {} JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey % 7 = s.s_suppkey % 7"


def _plan_join(how: str, sql: str) -> None:
    columns = ["c_custkey"] if how in ("left_semi", "left_anti") else ["c_custkey", "s_suppkey"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_plan(spark, _join_plan(how), {t: table(spark, sf_dir, t) for t in ("customer", "supplier")}).select(*columns)

    query(f"SELECT {', '.join(columns)} FROM {_SIDES.format(sql)}", f"plan_join_{how}")(run)


for _how, _words in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    _plan_join(_how, _words)


@query("SELECT c_mktsegment AS segment, COUNT(*) AS n, MIN(c_custkey) AS lo FROM customer GROUP BY c_mktsegment ORDER BY segment")
def group_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("lo")).orderBy(order_key("segment"))


@query("SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey")
def filter_sort_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey", "o_totalprice").orderBy(order_key("o_orderkey"))


@query("SELECT * FROM orders WHERE o_custkey = 7")
def select_star_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey = 7").select("*")


def _scan(name: str) -> None:
    query(f"SELECT * FROM {name}", f"scan_{name}")(lambda spark, sf_dir: table(spark, sf_dir, name))


for _name in TABLES:
    if _name != "embeddings":  # arrays don't compare by value everywhere: see scan_embeddings
        _scan(_name)


@query("SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS place, CAST(unnest(embedding) AS DOUBLE) AS component FROM embeddings")
def scan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("place", "component")).withColumn("component", F.col("component").cast("double"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey % 100 + 1 AS bucket, CAST(l_orderkey % 50 AS DOUBLE) AS remainder,
CASE WHEN l_quantity >= 25 THEN 'large' ELSE 'small' END AS size, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'open' END AS flag
FROM lineitem""")
def project_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") % 100 + 1).alias("bucket"),
        (F.col("l_orderkey") % 50).cast("double").alias("remainder"),
        F.when(F.col("l_quantity") >= 25, "large").otherwise("small").alias("size"),
        F.when(flag == "R", "returned").when(flag == "A", "accepted").otherwise("open").alias("flag"),
    )


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%S%'")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").like("%S%")).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def filter_date_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


@query("SELECT value, CAST(value % 50 AS DOUBLE) AS total FROM generate_series(1, 20000) AS s(value)")
def series_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.series(spark, 1, 20_000).select("value", (F.col("value") % 50).cast("double").alias("total"))


@query("SELECT 'UTC' AS value")
def settings_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.settings(spark, "spark.sql.session.timeZone").select("value")


@query("SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_partitioned_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides dealt out by key and hashed there; the customers are the side that is built."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").hint("shuffle_hash")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = operators.broadcast_side(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, MIN(l_linenumber) AS lo FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"n": ("count", F.lit(1)), "quantity": ("sum", F.col("l_quantity")), "lo": ("min", F.col("l_linenumber"))}
    return operators.two_phase(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], aggs).withColumn("quantity", money(F.col("quantity")))


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ORDERS)
def exchange_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.hash_exchange(_orders(spark, sf_dir), 8, "o_custkey")


@query(_ORDERS)
def exchange_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.round_robin_exchange(_orders(spark, sf_dir), 8)


@query("SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def exchange_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition, of a result that has a row per segment."""
    return operators.coalesce_exchange(group_count(spark, sf_dir))


@query(_ORDERS + " ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey")
def exchange_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.merge_exchange(_orders(spark, sf_dir), order_key("o_totalprice", True), order_key("o_orderkey"))


@query("SELECT CAST(0 AS BIGINT) AS split_keys")
def exchange_hash_colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.colocated(operators.hash_exchange(_orders(spark, sf_dir), 8, "o_custkey"), "o_custkey").agg(F.count("*").alias("split_keys"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def parquet_sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.write_parquet(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "ipc_round_trip")
def ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ipc_round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


# --- Plans as data ------------------------------------------------------------------------------

SPLITS = {"orders": 8, "customers": 2}
#: The example plan as JSON, and a query's description of six fragments and fifteen tasks.
EXAMPLE_PLAN = json.dumps(
    {"Sort": {"keys": ["revenue"], "input": {"Exchange": {"kind": "Coalesce", "input": {"Aggregate": {"mode": "Final", "group_by": ["segment"], "input": {"Exchange": {"kind": {"Hash": ["segment"]}, "input": {"Aggregate": {"mode": "Partial", "group_by": ["segment"], "input": {"Join": {"on": "o.cust_id = c.id", "left": {"Exchange": {"kind": {"Hash": ["cust_id"]}, "input": {"Filter": {"predicate": "order_date >= 2024-01-01", "input": {"Scan": {"table": "orders"}}}}}}, "right": {"Exchange": {"kind": {"Hash": ["id"]}, "input": {"Scan": {"table": "customers"}}}}}}}}}}}}}}}}
)
DESCRIPTION = [(0, 1, 4, []), (1, 1, 4, []), (2, 4, 4, [(1, True)]), (3, 4, 4, [(0, True), (2, True)]), (4, 4, 1, [(3, True)]), (5, 1, 1, [(4, False)])]


def example_fragments(spark: SparkSession) -> DataFrame:
    return fr.fragments_frame(spark, ir.loads(EXAMPLE_PLAN), 4, SPLITS)


def described(spark: SparkSession, rows: list[tuple] = DESCRIPTION) -> DataFrame:
    made = [("q-0", i, [], inputs, None if i == len(rows) - 1 else "hash", parts, n) for i, n, parts, inputs in rows]
    return spark.createDataFrame(made, fr.SCHEMA)


_DAG = "(VALUES (0, 'Filter,Scan', '', 'hash', 4, 8), (1, 'Scan', '', 'hash', 4, 2), (2, 'Aggregate,Join', '0,1', 'hash', 4, 4), (3, 'Aggregate', '2', 'coalesce', 1, 4), (4, 'Sort', '3', NULL, 1, 1)) f(fragment_id, operators, reads, output, output_partitions, tasks)"
_READS = "(VALUES (2, 0, true), (2, 1, true), (3, 2, true), (4, 3, false)) r(fragment_id, input_fragment, partitioned)"
_DREADS = "(VALUES (2, 1, true), (3, 0, true), (3, 2, true), (4, 3, true), (5, 4, false)) r(fragment_id, input_fragment, partitioned)"
_DDAG = "(VALUES (0, 1), (1, 1), (2, 4), (3, 4), (4, 4), (5, 1)) f(fragment_id, tasks)"


def _edges_sql(dag: str, reads: str) -> str:
    return f"""WITH f AS (SELECT * FROM {dag}), r AS (SELECT * FROM {reads})
SELECT r.fragment_id, CAST(c.p AS INTEGER) AS "partition", r.input_fragment, CAST(q.p AS INTEGER) AS producer_partition, CAST(CASE WHEN r.partitioned THEN c.p ELSE 0 END AS INTEGER) AS bucket
FROM r JOIN (SELECT fragment_id, unnest(range(tasks)) AS p FROM f) c USING (fragment_id)
JOIN (SELECT fragment_id AS input_fragment, unnest(range(tasks)) AS p FROM f) q USING (input_fragment)"""


@query(f"SELECT * FROM {_DAG}")
def fragment_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_fragments(spark).select("fragment_id", F.concat_ws(",", "operators").alias("operators"), F.concat_ws(",", F.transform("inputs.fragment_id", lambda i: i.cast("string"))).alias("reads"), "output", "output_partitions", "tasks")


@query(f'SELECT fragment_id, CAST(unnest(range(tasks)) AS INTEGER) AS "partition", output_partitions FROM {_DAG}')
def expand_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.tasks(example_fragments(spark)).drop("query_id")


@query(_edges_sql(_DAG, _READS))
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.edges(example_fragments(spark)).drop("query_id")


@query(_edges_sql(_DDAG, _DREADS))
def expand_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.edges(described(spark)).drop("query_id")


@query("SELECT fragment_id, CASE WHEN output IN ('hash', 'round_robin') THEN output_partitions ELSE 1 END AS buckets FROM " + _DAG)
def output_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.output_buckets(example_fragments(spark)).drop("query_id")


@query(f"""WITH f AS (SELECT * FROM {_DAG}), r AS (SELECT * FROM {_READS}) SELECT fragment_id FROM f WHERE fragment_id NOT IN (0)
AND NOT EXISTS (SELECT 1 FROM r WHERE r.fragment_id = f.fragment_id AND r.input_fragment NOT IN (0))""")
def ready_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.createDataFrame([("q-0", 0)], "query_id string, fragment_id int")
    return fr.ready_frame(example_fragments(spark), done).select("fragment_id")


def _done(spark: SparkSession) -> DataFrame:
    return tasks.tasks(example_fragments(spark)).where("fragment_id = 0 or (fragment_id = 1 and partition = 0)").select(*tasks.KEY)


@query(f"""WITH f AS (SELECT * FROM {_DAG}), r AS (SELECT * FROM {_READS}), t AS (SELECT fragment_id, unnest(range(tasks)) AS p FROM f),
d AS (SELECT * FROM t WHERE fragment_id = 0 OR (fragment_id = 1 AND p = 0))
SELECT fragment_id, CAST(p AS INTEGER) AS "partition" FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.fragment_id = t.fragment_id AND d.p = t.p)
AND NOT EXISTS (SELECT 1 FROM r JOIN t i ON i.fragment_id = r.input_fragment WHERE r.fragment_id = t.fragment_id AND NOT EXISTS (SELECT 1 FROM d WHERE d.fragment_id = i.fragment_id AND d.p = i.p))""")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.ready_tasks(example_fragments(spark), _done(spark)).drop("query_id")


@query("SELECT * FROM (VALUES (2, 1), (2, 2), (2, 3)) t(fragment_id, \"partition\")")
def dispatchable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After fragments 0 and 1, with task 0 of fragment 2 sent out."""
    phase = F.when(F.col("fragment_id") < 2, "DONE").when((F.col("fragment_id") == 2) & (F.col("partition") == 0), "DISPATCHED").otherwise("PENDING")
    return tasks.dispatchable(example_fragments(spark), tasks.tasks(example_fragments(spark)).select(*tasks.KEY, phase.alias("phase"))).drop("query_id")


@query(f"""SELECT *, 'w-' || CAST(producer_partition % 2 AS VARCHAR) AS worker_id FROM ({_edges_sql(_DAG, _READS)}) WHERE fragment_id = 2""")
def task_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tasks.tasks(example_fragments(spark)).where("fragment_id < 2").select(*tasks.KEY, F.concat(F.lit("w-"), (F.col("partition") % 2).cast("string")).alias("worker_id"))
    return tasks.task_inputs(example_fragments(spark), placed).drop("query_id")


def _variants() -> dict[str, list[list]]:
    """By name, a sound description and broken ones: (position, id, tasks, buckets, has a plan, inputs) of each fragment."""

    def base() -> list[list]:
        return [[i, i, n, p, True, list(r)] for i, n, p, r in DESCRIPTION]

    def changed(at: int, column: int, value) -> list[list]:
        rows = base()
        rows[at][column] = value
        return rows

    return {
        "fine": base(),
        "none": [[None, None, None, None, None, []]],
        "id": changed(2, 1, 7),
        "tasks": changed(1, 2, 0),
        "buckets": changed(0, 3, 0),
        "plan": changed(3, 4, False),
        "later": changed(2, 5, [(4, True)]),
        "itself": changed(2, 5, [(2, True)]),
        "width": changed(2, 2, 3),
        "single": changed(5, 5, [(3, False)]),
        "root": changed(5, 3, 2),
    }


@query("""SELECT * FROM (VALUES ('fine', NULL), ('none', 'no fragments'), ('id', 'has id 7'), ('tasks', 'no tasks'), ('buckets', 'zero output partitions'), ('plan', 'empty plan'),
('later', 'does not precede'), ('itself', 'does not precede'), ('width', 'writes 4 buckets'), ('single', 'reads only bucket 0'), ('root', 'root fragment')) t(query_id, needle)""")
def validate_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, *r) for name, own in _variants().items() for r in own]
    frame = spark.createDataFrame(rows, "query_id string, position int, fragment_id int, tasks int, output_partitions int, has_plan boolean, inputs array<struct<fragment_id:int,partitioned:boolean>>")
    needles = ("no fragments", "has id 7", "no tasks", "zero output partitions", "empty plan", "does not precede", "writes 4 buckets", "reads only bucket 0", "root fragment")
    found = F.coalesce(*(F.when(F.contains("error", F.lit(n)), F.lit(n)) for n in needles))
    return tasks.validate(frame).select("query_id", found.alias("needle"))


# --- Scheduling as data, over the events table as a log ------------------------------------------

_LOG = """SELECT CAST(user_id AS VARCHAR) AS query_id, event_id AS seq,
CASE event_id % 11 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SUCCEEDED' WHEN 3 THEN 'SUCCEEDED' WHEN 4 THEN 'QUEUED' ELSE 'RUNNING' END AS state FROM events"""


@query(f"""WITH e AS ({_LOG}), r AS (SELECT query_id, MIN(seq) AS running FROM e WHERE state = 'RUNNING' GROUP BY 1),
t AS (SELECT e.query_id, MIN(e.seq) AS at FROM e LEFT JOIN r USING (query_id) WHERE state IN ('FAILED', 'CANCELLED') OR (state = 'SUCCEEDED' AND seq > running) GROUP BY 1)
SELECT q.query_id, COALESCE(e.state, CASE WHEN r.running IS NOT NULL THEN 'RUNNING' ELSE 'QUEUED' END) AS state
FROM (SELECT DISTINCT query_id FROM e) q LEFT JOIN t USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN e ON e.query_id = t.query_id AND e.seq = t.at""")
def query_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a query's state changes."""
    k = F.col("event_id") % 11
    state = F.when(k == 0, "CANCELLED").when(k == 1, "FAILED").when(k.isin(2, 3), "SUCCEEDED").when(k == 4, "QUEUED").otherwise("RUNNING")
    return scheduling.query_states(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_id").alias("seq"), state.alias("state")))


# The events table as a log of tasks: a query per user, six tasks each; every 97th event is the loss of a worker.
_TASK_LOG = """SELECT CAST(user_id AS VARCHAR) AS query_id, CAST(event_id % 3 AS INTEGER) AS fragment_id, CAST(event_id % 2 AS INTEGER) AS "partition", event_id AS seq,
CASE event_id % 13 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'REVERT' WHEN 3 THEN 'REQUEUE' WHEN 4 THEN 'CANCEL' WHEN 5 THEN 'SUCCESS' ELSE 'DISPATCH' END AS event,
CASE WHEN event_id % 13 > 5 THEN 'w-' || CAST(event_id % 4 AS VARCHAR) END AS worker_id, CASE event_id % 13 WHEN 0 THEN 'message ' || CAST(event_id AS VARCHAR) END AS message FROM events WHERE event_id % 97 <> 0"""
_LOST = "SELECT 'w-' || CAST(event_id % 4 AS VARCHAR) AS worker_id, event_id AS seq FROM events WHERE event_id % 97 = 0"
_LOG_PHASES = f"""WITH RECURSIVE own AS ({_TASK_LOG}), lost AS ({_LOST}), sent AS (SELECT DISTINCT query_id, fragment_id, "partition", worker_id FROM own WHERE event = 'DISPATCH'),
every AS (SELECT * FROM own UNION ALL SELECT s.query_id, s.fragment_id, s."partition", l.seq, 'LOST', s.worker_id, NULL FROM sent s JOIN lost l USING (worker_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, fragment_id, "partition" ORDER BY seq) AS k FROM every),
fold AS (SELECT DISTINCT query_id, fragment_id, "partition", CAST(0 AS BIGINT) AS k, 'PENDING' AS phase, CAST(NULL AS VARCHAR) AS worker_id, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS BIGINT) AS ended FROM every
UNION ALL SELECT f.query_id, f.fragment_id, f."partition", n.k,
CASE WHEN f.phase = 'PENDING' AND n.event = 'DISPATCH' THEN 'DISPATCHED' WHEN f.phase = 'DISPATCHED' AND (n.event IN ('REVERT', 'REQUEUE') OR (n.event = 'LOST' AND n.worker_id = f.worker_id)) THEN 'PENDING'
WHEN f.phase = 'DISPATCHED' AND n.event = 'SUCCESS' THEN 'DONE' WHEN f.phase = 'DISPATCHED' AND n.event = 'FAILURE' THEN 'FAILED' WHEN f.phase IN ('PENDING', 'DISPATCHED') AND n.event = 'CANCEL' THEN 'CANCELLED' ELSE f.phase END,
CASE WHEN f.phase = 'PENDING' AND n.event = 'DISPATCH' THEN n.worker_id WHEN f.phase = 'DISPATCHED' AND (n.event IN ('REVERT', 'REQUEUE', 'FAILURE', 'CANCEL') OR (n.event = 'LOST' AND n.worker_id = f.worker_id)) THEN NULL ELSE f.worker_id END,
CASE WHEN f.phase = 'DISPATCHED' AND n.event = 'FAILURE' THEN n.message ELSE f.error_message END, CASE WHEN f.phase = 'DISPATCHED' AND n.event = 'FAILURE' THEN n.seq ELSE f.ended END
FROM fold f JOIN numbered n ON n.query_id = f.query_id AND n.fragment_id = f.fragment_id AND n."partition" = f."partition" AND n.k = f.k + 1),
phases AS (SELECT query_id, fragment_id, "partition", phase, worker_id, error_message, ended FROM fold QUALIFY row_number() OVER (PARTITION BY query_id, fragment_id, "partition" ORDER BY k DESC) = 1)"""


def _log_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, k = table(spark, sf_dir, "events"), F.col("event_id") % 13
    event = F.when(k == 0, "FAILURE").when(k.isin(1, 5), "SUCCESS").when(k == 2, "REVERT").when(k == 3, "REQUEUE").when(k == 4, "CANCEL").otherwise("DISPATCH")
    worker = F.concat(F.lit("w-"), (F.col("event_id") % 4).cast("string"))
    own = events.where("event_id % 97 <> 0").select(
        F.col("user_id").cast("string").alias("query_id"),
        (F.col("event_id") % 3).cast("int").alias("fragment_id"),
        (F.col("event_id") % 2).cast("int").alias("partition"),
        F.col("event_id").alias("seq"),
        event.alias("event"),
        F.when(k > 5, worker).alias("worker_id"),
        F.when(k == 0, F.concat(F.lit("message "), F.col("event_id").cast("string"))).alias("message"),
    )
    lost = events.where("event_id % 97 = 0").select(worker.alias("worker_id"), F.col("event_id").alias("seq"))
    return scheduling.task_phases(scheduling.with_lost_workers(own, lost))


@query(f"{_LOG_PHASES} SELECT * FROM phases")
def task_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after their events and the losses of workers."""
    return _log_phases(spark, sf_dir)


@query(f"""{_LOG_PHASES} SELECT query_id, CASE WHEN bool_or(phase = 'FAILED') THEN 'FAILED' WHEN bool_or(phase = 'CANCELLED') THEN 'CANCELLED' WHEN bool_and(phase = 'DONE') THEN 'SUCCEEDED'
WHEN bool_or(phase IN ('DISPATCHED', 'DONE')) THEN 'RUNNING' ELSE 'QUEUED' END AS state, arg_min(error_message, ended) FILTER (phase = 'FAILED') AS error_message FROM phases GROUP BY query_id""")
def query_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure of a task fails its query."""
    return scheduling.query_outcomes(_log_phases(spark, sf_dir))


@query("""SELECT 'w-' || CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR) AS worker_id, s_name AS address, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 5 END AS INTEGER) AS slots, CAST(0 AS INTEGER) AS in_flight FROM supplier""")
def register_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workers; every third tells no slots."""
    k = F.col("s_suppkey")
    return scheduling.registered(table(spark, sf_dir, "supplier").select(k.alias("seq"), F.col("s_name").alias("address"), F.when(k % 3 != 0, (k % 5).cast("int")).alias("slots")))


@query("""WITH RECURSIVE n AS (SELECT CAST(user_id AS VARCHAR) AS worker_id, event_id % 5 < 2 AS taken, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT worker_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS in_flight FROM n UNION ALL
SELECT f.worker_id, n.k, CASE WHEN n.taken THEN f.in_flight + 1 ELSE greatest(f.in_flight - 1, 0) END FROM f JOIN n ON n.worker_id = f.worker_id AND n.k = f.k + 1)
SELECT worker_id, in_flight FROM f QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY k DESC) = 1""")
def release_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as slots taken and freed."""
    event = F.when(F.col("event_id") % 5 < 2, "ACQUIRE").otherwise("RELEASE")
    return scheduling.slots_in_use(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("worker_id"), F.col("event_id").alias("seq"), event.alias("event")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS query_id, CAST(p AS INTEGER) AS "partition", 'w-' || CAST(p % 3 AS VARCHAR) AS worker_id FROM (SELECT s_suppkey, unnest(range(s_suppkey % 6 + 1)) AS p FROM supplier) WHERE s_suppkey % 4 <> 0 ORDER BY 1, 2""")
def ordered_root_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as queries of two fragments; every fourth has a task of the first still pending."""
    k = F.col("s_suppkey")
    inputs = F.expr("array(named_struct('fragment_id', 0, 'partitioned', true))")
    both = F.explode(F.array(F.struct(F.lit(0).alias("fragment_id"), F.lit(2).alias("tasks"), F.slice(inputs, 1, 0).alias("inputs")), F.struct(F.lit(1).alias("fragment_id"), (k % 6 + 1).cast("int").alias("tasks"), inputs.alias("inputs"))))
    frame = table(spark, sf_dir, "supplier").select(k.cast("string").alias("query_id"), both.alias("f")).select("query_id", "f.*").withColumn("output_partitions", F.lit(1))
    pending = (F.col("query_id").cast("long") % 4 == 0) & (F.col("fragment_id") == 0) & (F.col("partition") == 1)
    phases = tasks.tasks(frame).select(*tasks.KEY, F.when(pending, "PENDING").otherwise("DONE").alias("phase"), F.concat(F.lit("w-"), (F.col("partition") % 3).cast("string")).alias("worker_id"))
    return scheduling.root_outputs(frame, phases)


#: A log of two queries' tasks (fragment, partition, seq, event, worker, message).
TASK_LOG = [
    ("q-0", 0, 0, 1, "DISPATCH", "w-0", None), ("q-0", 0, 0, 2, "SUCCESS", None, None), ("q-0", 0, 0, 3, "FAILURE", None, "late"),
    ("q-0", 1, 0, 1, "DISPATCH", "w-1", None), ("q-0", 1, 0, 2, "REQUEUE", None, None), ("q-0", 1, 0, 3, "SUCCESS", None, None),
    ("q-0", 2, 0, 1, "DISPATCH", "w-0", None), ("q-0", 2, 0, 2, "DISPATCH", "w-1", None),
    ("q-0", 2, 1, 1, "DISPATCH", "w-1", None), ("q-0", 2, 1, 2, "REVERT", None, None), ("q-0", 2, 1, 3, "DISPATCH", "w-0", None), ("q-0", 2, 1, 4, "FAILURE", None, "disk full"), ("q-0", 2, 1, 5, "FAILURE", None, "again"),
    ("q-1", 0, 0, 1, "SUCCESS", None, None), ("q-1", 0, 0, 2, "CANCEL", None, None), ("q-1", 0, 0, 3, "DISPATCH", "w-0", None),
    ("q-1", 1, 0, 1, "DISPATCH", "w-0", None), ("q-1", 1, 0, 2, "SUCCESS", None, None), ("q-1", 1, 0, 3, "CANCEL", None, None),
]


def _phases(spark: SparkSession) -> DataFrame:
    return scheduling.task_phases(spark.createDataFrame(TASK_LOG, "query_id string, fragment_id int, partition int, seq int, event string, worker_id string, message string")).drop("ended")


_PHASES = """(VALUES ('q-0', 0, 0, 'DONE', 'w-0', NULL), ('q-0', 1, 0, 'PENDING', NULL, NULL), ('q-0', 2, 0, 'DISPATCHED', 'w-0', NULL), ('q-0', 2, 1, 'FAILED', NULL, 'disk full'),
('q-1', 0, 0, 'CANCELLED', NULL, NULL), ('q-1', 1, 0, 'DONE', 'w-0', NULL)) t(query_id, fragment_id, "partition", phase, worker_id, error_message)"""


@query(f"SELECT * FROM {_PHASES}")
def task_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark)


@query(f"""SELECT query_id, COUNT(*) AS tasks, COUNT(*) FILTER (phase = 'DONE') AS done, COUNT(*) FILTER (phase = 'FAILED') AS failed, COUNT(*) FILTER (phase = 'CANCELLED') AS cancelled,
COUNT(*) = COUNT(*) FILTER (phase = 'DONE') AS complete FROM {_PHASES} GROUP BY query_id""")
def query_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.progress(_phases(spark))


@query("""SELECT CAST(n AS INTEGER) AS n, worker_id, CAST(slot AS INTEGER) AS slot FROM (SELECT row_number() OVER (ORDER BY slot * 1.0 / slots, worker_id, slot) - 1 AS n, worker_id, slot
FROM (SELECT 's-' || CAST(s_suppkey AS VARCHAR) AS worker_id, s_suppkey % 4 + 1 AS slots, unnest(range(s_suppkey % 2, s_suppkey % 4 + 1)) AS slot FROM supplier)) WHERE n < 100""")
def assign_least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workers: one to four slots, one of them taken on every other worker."""
    k = F.col("s_suppkey")
    workers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), k.cast("string")).alias("worker_id"), (k % 4 + 1).cast("int").alias("slots"), (k % 2).cast("int").alias("in_flight"))
    return scheduling.assignments(workers, 100)


@query("SELECT CAST(user_id AS VARCHAR) AS worker_id, MAX(ts) AS last_heartbeat FROM events GROUP BY 1 HAVING MAX(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR")
def stale_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as heartbeats."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("worker_id"), "ts")
    return scheduling.stale_workers(beats, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), F.expr("INTERVAL 6 HOURS"))


_RUNS = "(VALUES ('q1', 1, 8.0::DOUBLE), ('q1', 2, 5.0::DOUBLE), ('q1', 4, 4.0::DOUBLE), ('q2', 2, 3.0::DOUBLE)) r(query, workers, seconds)"


@query(f"SELECT r.query, r.workers, r.seconds, a.seconds / r.seconds AS speedup, a.seconds / r.seconds / r.workers AS efficiency FROM {_RUNS} LEFT JOIN (SELECT * FROM {_RUNS} WHERE workers = 1) a ON a.query = r.query".replace("r(query, workers, seconds) WHERE", "r2(query, workers, seconds) WHERE"))
def scaling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling_efficiency(spark.createDataFrame([("q1", 1, 8.0), ("q1", 2, 5.0), ("q1", 4, 4.0), ("q2", 2, 3.0)], "query string, workers int, seconds double"))


@query()
def cut_spark_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's physical plan in fragments: Spark's own stages, so there is nothing to compare with in SQL."""
    return cut_plan(join_agg_sort(profiled(spark, "golden"), sf_dir)).select("fragment_id", F.concat_ws(",", "operators").alias("operators"), "output", "output_partitions", "tasks")


@query()
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage times of the flagship, run through the lifecycle: measurements, so there is nothing to compare with."""
    from .lifecycle import QueryManager
    from .metrics import stage_breakdown

    manager = QueryManager(spark)
    own = manager.submit(join_agg_sort(spark, sf_dir))
    manager.wait(own, 300)
    return stage_breakdown(manager.metrics(own))
