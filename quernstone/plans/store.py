"""Outputs of fragments' tasks, kept as buckets in the shared folder, and plans run fragment by fragment over them.

Queries run as one DataFrame, and Spark shuffles. This is the harness that shows what a
plan's own exchanges do: each task sees its own bucket of partitioned inputs and nothing
else, so a plan whose exchanges don't bring together what must meet gives other rows here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import NotExecutable, NotFound
from ..session import shared_folder
from ..streaming.ipc import to_chunks
from .compile import FUNCTIONS, Compiler
from .fragments import PARTITIONED, Fragment, fragment
from .ir import Node


class ShuffleStore:
    """Buckets by (query, fragment, task, bucket). An empty bucket is there and has no rows; one that no task has written is NotFound.

    A task's buckets are one write; its manifest follows, so a task that was lost on the way has written nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, *parts: object) -> str:
        return "/".join((self.folder, *(str(p) for p in parts)))

    def put(self, query_id: str, fragment_id: int, task: int, df: DataFrame, bucket: Column | None = None, buckets: int = 1) -> None:
        """Stores a task's rows by `bucket`, 0 to buckets - 1 (all in 0 where none is given). Each of Spark's tasks writes its own file per bucket: nothing is shuffled."""
        where = self._place(query_id, fragment_id, task)
        self._system.delete(self._path(where), True)
        # by position: a join's output may have two columns of one name
        numbered = df.select("*", (F.lit(0) if bucket is None else bucket).alias("_bucket")).toDF(*(f"c{i}" for i in range(len(df.columns))), "_bucket")
        numbered.write.partitionBy("_bucket").parquet(f"{where}/data")
        out = self._system.create(self._path(f"{where}/manifest.json"))
        out.writeBytes(json.dumps({"buckets": buckets, "schema": df.schema.jsonValue()}))
        out.close()

    def _manifest(self, *key: object) -> dict:
        path = self._path(self._place(*key, "manifest.json"))
        if not self._system.exists(path):
            raise NotFound(f"missing output {key}: the task has not run")
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._system.open(path), "UTF-8")
        return json.loads(text)

    def get(self, query_id: str, fragment_id: int, task: int, bucket: int) -> DataFrame:
        manifest = self._manifest(query_id, fragment_id, task)
        if not 0 <= bucket < manifest["buckets"]:
            raise NotFound(f"missing output {(query_id, fragment_id, task, bucket)}: the task has {manifest['buckets']} buckets")
        schema = StructType.fromJson(manifest["schema"])
        written = StructType.fromJson(manifest["schema"])
        for i, f in enumerate(written.fields):
            f.name = written.names[i] = f"c{i}"
        place = self._place(query_id, fragment_id, task, "data", f"_bucket={bucket}")
        found = self.spark.read.schema(written).parquet(place) if self._system.exists(self._path(place)) else self.spark.createDataFrame([], written)
        return found.toDF(*schema.names)

    def chunks(self, query_id: str, fragment_id: int, task: int, bucket: int) -> Iterator[bytes]:
        """The bucket as Arrow IPC chunks; an empty one has none."""
        return to_chunks(self.get(query_id, fragment_id, task, bucket))

    def buckets(self, *key: object) -> int:
        """Buckets stored, of all queries or below a key (query, fragment, task)."""
        top = self._path(self._place(*key))
        if not self._system.exists(top):
            return 0
        if self._system.exists(self._path(self._place(*key, "manifest.json"))):
            return self._manifest(*key)["buckets"]
        if len(key) == 3:
            return 0  # a task that was lost while it wrote
        return sum(self.buckets(*key, str(f.getPath().getName())) for f in self._system.listStatus(top))

    def remove_query(self, query_id: str) -> int:
        """Deletes a query's buckets and tells how many there were."""
        n = self.buckets(query_id)
        self._system.delete(self._path(self._place(query_id)), True)
        return n


#: How a Final makes one value of the states of its Partial; avg has two states.
_MERGED = {"count_star": F.sum, "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _settled(node: Node) -> Node:
    """The plan with the same aggs in a Final and its Partial, whichever has them."""
    node = Node(node.kind, node.fields, tuple(_settled(n) for n in node.inputs))
    if node.kind != "Aggregate" or node.fields["mode"] != "Final":
        return node
    path = [node.inputs[0]]
    while path[-1].kind == "Exchange":
        path.append(path[-1].inputs[0])
    if path[-1].kind != "Aggregate" or not (aggs := node.fields.get("aggs") or path[-1].fields.get("aggs")):
        return node
    for n in reversed(path):
        below = Node(n.kind, n.fields | ({"aggs": aggs} if n is path[-1] else {}), n.inputs if n is path[-1] else (below,))
    return Node(node.kind, node.fields | {"aggs": aggs}, (below,))


class TaskCompiler(Compiler):
    """A task of a fragment: RemoteRead is what the store has for the task, and an Aggregate is run by halves."""

    def __init__(self, store: ShuffleStore, query_id: str, found: list[Fragment], tasks: list[int], task: int, tables: dict[str, DataFrame] | None, partitions: int):
        super().__init__(store.spark, tables, partitions)
        self.store, self.query_id, self.found, self.tasks, self.task = store, query_id, found, tasks, task

    def _whole(self, node: Node) -> Node:
        """The node as it was before the plan was cut."""
        if node.kind == "RemoteRead":
            top = self.found[node.fields["fragment_id"]].root
            return Node("Exchange", top.fields, (self._whole(top.inputs[0]),))
        return Node(node.kind, node.fields, tuple(self._whole(n) for n in node.inputs))

    def _alias(self, node: Node, default: str) -> str:
        return super()._alias(self._whole(node), default)

    def _remoteread(self, node: Node) -> DataFrame:
        own = node.fields["fragment_id"]
        bucket = self.task if self.found[own].output in PARTITIONED else 0
        return reduce(DataFrame.union, [self.store.get(self.query_id, own, t, bucket) for t in range(self.tasks[own])])

    def _aggregate(self, node: Node) -> DataFrame:
        """Partial puts out states, Final merges them. avg has a sum and a count of doubles."""
        keys = node.fields["group_by"]
        partial = node if node.fields["mode"] == "Partial" else self._whole(node.inputs[0])
        while partial.kind == "Exchange":
            partial = partial.inputs[0]
        if partial.kind != "Aggregate" or partial.fields["mode"] != "Partial" or partial.fields["group_by"] != keys:
            raise NotExecutable("Aggregate: only Final over Partial with the same keys can be run")
        aggs = node.fields.get("aggs")
        if not aggs or (unknown := [a["fn"] for a in aggs if a.get("fn") not in FUNCTIONS]):
            raise NotExecutable(f"Aggregate: unknown function {unknown[0]}" if aggs else "Aggregate: no aggs")
        df, columns = self(node.inputs[0]), []
        for a in aggs:
            name, average = a["as"], a["fn"] == "avg"
            if node is partial:
                arg = F.expr(a["arg"]) if a.get("arg") else None
                columns += [F.sum(arg.cast("double")).alias(f"{name}.sum"), F.count(arg).alias(f"{name}.count")] if average else [FUNCTIONS[a["fn"]](arg).alias(name)]
            elif average:
                columns.append((F.sum(f"`{name}.sum`") / F.sum(f"`{name}.count`")).alias(name))
            else:
                columns.append(_MERGED[a["fn"]](name).cast(df.schema[name].dataType).alias(name))
        return self._checked(node, lambda: df.groupBy(*keys).agg(*columns))


def run_fragments(spark: SparkSession, plan: Node, tables: dict[str, DataFrame] | None = None, partitions: int = 4, store: ShuffleStore | None = None, query_id: str = "q-0") -> DataFrame:
    """Runs each task of each fragment, producers first, and returns the root's rows; they are read from the store, which the caller clears.

    A fragment that reads partitioned inputs has a task per bucket; every other one has one task, which scans its tables whole.
    """
    store, partitions, found, tasks = store or ShuffleStore(spark), max(1, partitions), fragment(_settled(plan)), []
    for f in found:
        split = any(found[i].output in PARTITIONED for i in f.inputs)
        if split and f.tables:
            raise NotExecutable(f"fragment {f.id} scans {f.tables[0]} beside a partitioned input")
        tasks.append(partitions if split else 1)
        for task in range(tasks[-1]):
            body = f.root if f.output is None else f.root.inputs[0]
            df, bucket = TaskCompiler(store, query_id, found, tasks, task, tables, partitions)(body), None
            if f.output == "hash":
                bucket = F.pmod(F.hash(*(F.expr(k) for k in f.root.exchange()[1])), F.lit(partitions))
            elif f.output == "round_robin":
                # each of Spark's tasks starts at another bucket, so that few rows are spread as well
                bucket = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() + task, F.lit(partitions)).cast("int")
            store.put(query_id, f.id, task, df, bucket, partitions if f.output in PARTITIONED else 1)
    return reduce(DataFrame.union, [store.get(query_id, found[-1].id, t, 0) for t in range(tasks[-1])])
