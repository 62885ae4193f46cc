"""Queries as things with a life: submit, status, metrics, fetch, cancel.

Spark schedules; this keeps the state that a client sees. A query runs in a thread of
its own under a job tag, so that cancelling it stops its jobs and nothing else. Results
are written to the shared folder and read from there file by file.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType, StructField, StructType

from .errors import EngineError, FailedPrecondition, InvalidArgument, NotFound
from .metrics import TASKS, task_rows
from .plans import ir
from .plans.compile import compile_plan
from .session import shared_folder
from .sql import prepared
from .streaming.ipc import encode_batch

QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELLED = "QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"
#: Where a state may go; what isn't listed is an end.
NEXT = {QUEUED: {RUNNING, FAILED, CANCELLED}, RUNNING: {SUCCEEDED, FAILED, CANCELLED}}

#: Rows of a file of a result, at most, which is what a fetch holds at once; rows of a chunk, at most.
FILE_ROWS, CHUNK_ROWS = 1_000_000, 65_536


@dataclass
class Query:
    id: str
    make: Callable[[], DataFrame]
    priority: int = 0
    state: str = QUEUED
    error_message: str = ""
    submitted: float = field(default_factory=time.time)
    result: str | None = None
    schema: StructType | None = None
    thread: threading.Thread | None = None
    ended: threading.Event = field(default_factory=threading.Event)


class QueryManager:
    """Submits queries (SQL text, a DataFrame, a plan node or its JSON) and answers for them. Ids are q-0, q-1, ... in order of submission."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, slots: int = 4):
        self.spark, self.tables = spark, tables or {}
        self._mark = uuid.uuid4().hex  # managers of one context don't share tags
        self._lock, self._slots, self._queries = threading.RLock(), threading.Semaphore(max(1, slots)), {}

    def submit(self, query: str | bytes | DataFrame | ir.Node | None = None, *, plan: str | bytes | None = None, priority: int = 0, timeout_ms: int = 0) -> str:
        """Accepts a query and returns its id at once. What can't be parsed or analysed, or both or neither of query and plan, is InvalidArgument."""
        if (query is None) == (plan is None):
            raise InvalidArgument("give a query or a plan, not both")
        make = self._prepared(plan if query is None else query, query is None)
        with self._lock:
            own = Query(f"q-{len(self._queries)}", make, priority)
            self._queries[own.id] = own
        own.thread = InheritableThread(target=self._run, args=(own,), daemon=True)
        own.thread.start()
        if timeout_ms > 0:
            timer = threading.Timer(timeout_ms / 1000, self._late, (own, timeout_ms))
            timer.daemon = True
            timer.start()
        return own.id

    def _prepared(self, query, is_plan: bool) -> Callable[[], DataFrame]:
        if isinstance(query, DataFrame):
            return lambda: query
        try:
            if isinstance(query, ir.Node) or is_plan:
                node = query if isinstance(query, ir.Node) else ir.loads(query)
                df = compile_plan(self.spark, node, self.tables)
                df.schema  # analysed now, so that mistakes show at once
            elif isinstance(query, str) and query.strip():
                return prepared(self.spark, query)
            else:
                raise InvalidArgument("empty query")
        except (AnalysisException, ParseException) as wrong:
            raise InvalidArgument(str(wrong).splitlines()[0]) from wrong
        return lambda: df

    def _tag(self, own: Query) -> str:
        return f"{self._mark}-{own.id}"

    def _to(self, own: Query, state: str) -> bool:
        with self._lock:
            if state not in NEXT.get(own.state, ()):
                return False
            own.state = state
            if state not in NEXT:
                own.ended.set()
            return True

    def _run(self, own: Query) -> None:
        with self._slots:
            if not self._to(own, RUNNING):
                return
            self.spark.sparkContext.setInterruptOnCancel(True)
            self.spark.sparkContext.addJobTag(self._tag(own))
            try:
                df = own.make()
                own.schema, own.result = df.schema, f"{shared_folder(self.spark)}/result-{self._mark}-{own.id}"
                # by position: a result may have two columns of one name; a column of nulls alone is written as text
                apart = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
                apart = apart.select(*(F.col(c).cast("string").alias(c) if kind == "void" else c for c, kind in apart.dtypes))
                apart.write.option("maxRecordsPerFile", FILE_ROWS).parquet(own.result)
                self._to(own, SUCCEEDED)
            except Exception as wrong:  # whatever ends the job: the state says which it was
                with self._lock:
                    if own.state == RUNNING:
                        own.error_message = str(wrong).splitlines()[0] if str(wrong) else type(wrong).__name__
                self._to(own, FAILED)
            finally:
                if self.spark.sparkContext._jsc is not None:  # else the session has been stopped under the query
                    self.spark.sparkContext.removeJobTag(self._tag(own))
                    if own.state != SUCCEEDED:
                        self._delete(own)

    def _stop(self, own: Query) -> None:
        """Cancels the query's jobs until its thread has ended: one may begin after the first call."""

        def run() -> None:
            while own.thread is not None and own.thread.is_alive():
                self.spark.sparkContext.cancelJobsWithTag(self._tag(own))
                own.thread.join(0.2)

        threading.Thread(target=run, daemon=True).start()

    def _files(self, own: Query) -> tuple[object, list[str]]:
        """The file system of the result and its data files in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(own.result)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [str(f.getPath().toString()) for f in system.listStatus(place)] if system.exists(place) else []
        return system, sorted(f for f in found if f.rpartition("/")[2].startswith("part-"))

    def _delete(self, own: Query) -> None:
        if own.result is not None:
            self._files(own)[0].delete(self.spark._jvm.org.apache.hadoop.fs.Path(own.result), True)

    def _late(self, own: Query, timeout_ms: int) -> None:
        with self._lock:
            if own.state in NEXT:
                own.error_message = f"took longer than {timeout_ms} ms"
                self._to(own, CANCELLED)
                self._stop(own)

    def _of(self, query_id: str) -> Query:
        with self._lock:
            if query_id not in self._queries:
                raise NotFound(f"no query {query_id}")
            return self._queries[query_id]

    def status(self, query_id: str) -> dict:
        """state, error_message (the first failure, else empty), and Spark's active jobs of the query."""
        own = self._of(query_id)
        active = set(self.spark.sparkContext.statusTracker().getActiveJobsIds())
        jobs = active & set(self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self._tag(own)))
        return {"query_id": own.id, "state": own.state, "error_message": own.error_message, "priority": own.priority, "active_jobs": sorted(jobs)}

    def wait(self, query_id: str, seconds: float | None = None) -> str:
        own = self._of(query_id)
        own.ended.wait(seconds)
        return own.state

    def metrics(self, query_id: str) -> DataFrame:
        """A row per task: when it ran, rows and bytes that it put out."""
        return self.spark.createDataFrame(task_rows(self.spark, query_id, self._tag(self._of(query_id))), TASKS)

    def fetch(self, query_id: str) -> Iterator[bytes]:
        """The result in order, as Arrow IPC chunks; only once the query has SUCCEEDED."""
        own = self._of(query_id)
        if own.state != SUCCEEDED:
            raise FailedPrecondition(f"{query_id} is {own.state}")
        return self._chunks(own)

    def _chunks(self, own: Query) -> Iterator[bytes]:
        written = StructType([StructField(f"c{i}", StringType() if isinstance(f.dataType, NullType) else f.dataType) for i, f in enumerate(own.schema)])
        for path in self._files(own)[1]:
            for batch in self.spark.read.schema(written).parquet(path).toArrow().rename_columns(own.schema.names).to_batches(CHUNK_ROWS):
                if batch.num_rows:
                    yield encode_batch(batch)

    def forget(self, query_id: str) -> None:
        """Deletes an ended query's result; it can't be fetched any more."""
        own = self._of(query_id)
        if own.state in NEXT:
            raise FailedPrecondition(f"{query_id} is {own.state}")
        self._delete(own)

    def cancel(self, query_id: str) -> None:
        """Ends a queued or running query and stops its jobs; one that has ended can't be cancelled."""
        own = self._of(query_id)
        if not self._to(own, CANCELLED):
            raise FailedPrecondition(f"{query_id} is {own.state}")
        self._stop(own)


__all__ = ["CANCELLED", "FAILED", "QUEUED", "RUNNING", "SUCCEEDED", "EngineError", "QueryManager"]
