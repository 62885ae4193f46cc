"""Scheduling as data: states replayed from event logs, workers chosen, silence noticed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["query_id", "fragment_id", "partition"]
#: Losses of workers meet tasks by chunks of 2 ** CHUNK_BITS numbers of the log, so that a chunk holds no more of them than that. FIRST stands for no number.
CHUNK_BITS, FIRST = 12, -(2**63)


def query_states(events: DataFrame) -> DataFrame:
    """Rows (query_id, state) after events (query_id, seq, state).

    Queries start QUEUED; FAILED and CANCELLED end them from QUEUED or RUNNING, SUCCEEDED only from
    RUNNING; what comes after an end, or isn't allowed, changes nothing. Minima per query are enough, so
    no query's log is sorted or gathered.
    """
    running = events.where("state = 'RUNNING'").groupBy("query_id").agg(F.min("seq").alias("running"))
    ends = events.join(running, "query_id", "left").where(F.col("state").isin("FAILED", "CANCELLED") | ((F.col("state") == "SUCCEEDED") & (F.col("seq") > F.col("running"))))
    ended = ends.groupBy("query_id").agg(F.min_by("state", "seq").alias("ended"))
    queries = events.groupBy("query_id").agg(F.max(F.col("state") == "RUNNING").alias("ran"))
    return queries.join(ended, "query_id", "left").select("query_id", F.coalesce("ended", F.when(F.col("ran"), "RUNNING"), F.lit("QUEUED")).alias("state"))


def with_lost_workers(events: DataFrame, lost: DataFrame) -> DataFrame:
    """The events of task_phases and, for each DISPATCH, one LOST event: the next row of `lost` (worker_id, seq) of its worker, if there is one. seq counts over all tasks, in whole numbers; a null one is before all.

    A worker's later losses can't change what that DISPATCH began: the next one ends it, unless something else
    did before. So there are fewer LOST events than others, however many workers are lost. The next loss is one of the DISPATCH's
    own chunk of 2 ** CHUNK_BITS numbers, or the first of a later chunk; only a row per worker and chunk is ordered.
    """
    at, chunk = F.coalesce(F.col("seq").cast("long"), F.lit(FIRST)), F.shiftright("at", CHUNK_BITS)
    sent = events.where("event = 'DISPATCH' and worker_id is not null").select(*KEY, "worker_id", at.alias("at")).withColumn("chunk", chunk)
    gone = lost.select("worker_id", at.alias("at")).withColumn("chunk", chunk)
    asked = sent.select("worker_id", "chunk").distinct().withColumn("at", F.lit(None).cast("long"))
    chunks = asked.unionByName(gone).groupBy("worker_id", "chunk").agg(F.collect_set("at").alias("own"), F.min("at").alias("first"))
    after = Window.partitionBy("worker_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("worker_id", "chunk", "own", F.min("first").over(after).alias("later")).where("size(own) > 0 or later is not null")
    following = F.coalesce(F.array_min(F.filter("own", lambda x: x >= F.col("at"))), F.col("later"))
    found = sent.join(chunks, ["worker_id", "chunk"]).select(*KEY, following.alias("seq"), "worker_id").where("seq is not null")
    seq = F.when(F.col("seq") != FIRST, F.col("seq")).cast(lost.schema["seq"].dataType)
    found = found.select(*KEY, seq.alias("seq"), F.lit("LOST").alias("event"), "worker_id", F.lit(None).cast("string").alias("message"))
    return events.select(*KEY, "seq", "event", "worker_id", "message").unionByName(found)


def task_phases(events: DataFrame) -> DataFrame:
    """Rows (KEY, phase, worker_id, error_message, ended) after events (KEY, seq, event, worker_id, message).

    DISPATCH takes a PENDING task to DISPATCHED; REVERT and REQUEUE take it back, and so does LOST
    if its worker is the task's; SUCCESS and FAILURE end a DISPATCHED one; CANCEL ends PENDING and
    DISPATCHED ones. All else is ignored. worker_id is kept while DISPATCHED and when DONE; ended is the seq of a
    failure. A task's log is folded in order; it is as long as its retries.
    """
    log = events.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "event", "worker_id", "message"))).alias("log"))
    none, never = F.lit(None).cast("string"), F.lit(None).cast(events.schema["seq"].dataType)

    def to(phase: str, worker: Column = none, message: Column = none, ended: Column = never) -> Column:
        return F.struct(F.lit(phase).alias("phase"), worker.alias("worker_id"), message.alias("error_message"), ended.alias("ended"))

    def step(now: Column, e: Column) -> Column:
        pending, out = now["phase"] == "PENDING", now["phase"] == "DISPATCHED"
        back = e["event"].isin("REVERT", "REQUEUE") | ((e["event"] == "LOST") & (e["worker_id"] == now["worker_id"]))
        return (
            F.when(pending & (e["event"] == "DISPATCH"), to("DISPATCHED", e["worker_id"]))
            .when(out & back, to("PENDING"))
            .when(out & (e["event"] == "SUCCESS"), to("DONE", now["worker_id"]))
            .when(out & (e["event"] == "FAILURE"), to("FAILED", message=e["message"], ended=e["seq"]))
            .when((pending | out) & (e["event"] == "CANCEL"), to("CANCELLED"))
            .otherwise(now)
        )

    return log.select(*KEY, F.aggregate("log", to("PENDING"), step).alias("s")).select(*KEY, "s.*")


def query_outcomes(phases: DataFrame) -> DataFrame:
    """Rows (query_id, state, error_message) from task_phases: FAILED with the first failure's message, else CANCELLED, SUCCEEDED if all are done, RUNNING if any was sent out, or QUEUED."""
    some = lambda *p: F.max(F.col("phase").isin(*p))
    failed = F.col("phase") == "FAILED"
    own = phases.groupBy("query_id").agg(F.min_by(F.when(failed, F.col("error_message")), F.when(failed, F.col("ended"))).alias("error_message"), some("FAILED").alias("f"), some("CANCELLED").alias("c"), some("PENDING", "DISPATCHED").alias("o"), some("DISPATCHED", "DONE").alias("r"))
    state = F.when(F.col("f"), "FAILED").when(F.col("c"), "CANCELLED").when(~F.col("o"), "SUCCEEDED").when(F.col("r"), "RUNNING").otherwise("QUEUED")
    return own.select("query_id", state.alias("state"), "error_message")


def registered(workers: DataFrame) -> DataFrame:
    """Rows (worker_id, address, slots, in_flight) for registrations (seq, address, slots): ids w-0, w-1, ... in their order, one slot where none are told.

    One row per worker of a cluster is numbered.
    """
    number = F.row_number().over(Window.orderBy("seq")) - 1
    return workers.select(F.concat(F.lit("w-"), number.cast("string")).alias("worker_id"), "address", F.coalesce("slots", F.lit(1)).alias("slots"), F.lit(0).alias("in_flight"))


def slots_in_use(events: DataFrame) -> DataFrame:
    """Rows (worker_id, in_flight) after events (worker_id, seq, event): ACQUIRE takes a slot, RELEASE frees one if any is taken.

    A count that never goes below zero is the running sum less its least value so far, or zero.
    """
    move = F.when(F.col("event") == "ACQUIRE", 1).when(F.col("event") == "RELEASE", -1).otherwise(0)
    summed = events.select("worker_id", "seq", F.sum(move).over(Window.partitionBy("worker_id").orderBy("seq")).alias("s"))
    return summed.groupBy("worker_id").agg((F.max_by("s", "seq") - F.least(F.min("s"), F.lit(0))).alias("in_flight"))


def assignments(workers: DataFrame, tasks: int) -> DataFrame:
    """Rows (n, worker_id, slot): the first `tasks` choices of the least loaded worker, without releases.

    Load is in_flight / slots, ties go to the lesser id as a string. The n-th choice is the n-th of all
    free slots ordered by the load before taking it, so no loop is needed. One row per free slot of the
    cluster is ordered, in parts that keep `tasks` rows each.
    """
    free = workers.where("in_flight < slots").select("worker_id", "slots", F.explode(F.sequence(F.col("in_flight"), F.col("slots") - 1)).alias("slot"))
    ordered = free.orderBy((F.col("slot").cast("double") / F.col("slots")).asc(), "worker_id", "slot").limit(tasks)
    number = F.row_number().over(Window.orderBy((F.col("slot").cast("double") / F.col("slots")).asc(), "worker_id", "slot")) - 1
    return ordered.select(number.cast("int").alias("n"), "worker_id", "slot")


def stale_workers(heartbeats: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """Rows (worker_id, last_heartbeat) of workers whose last heartbeat is older than the timeout, not just as old. `heartbeats`: worker_id, ts."""
    return heartbeats.groupBy("worker_id").agg(F.max("ts").alias("last_heartbeat")).where(F.col("last_heartbeat") < now - timeout)


def progress(phases: DataFrame) -> DataFrame:
    """Rows (query_id, tasks, done, failed, cancelled, complete): complete if all are done."""
    n = lambda p: F.count(F.when(F.col("phase") == p, 1))
    return phases.groupBy("query_id").agg(F.count("*").alias("tasks"), n("DONE").alias("done"), n("FAILED").alias("failed"), n("CANCELLED").alias("cancelled")).withColumn("complete", F.col("done") == F.col("tasks"))


def root_outputs(fragments: DataFrame, phases: DataFrame) -> DataFrame:
    """Rows (query_id, partition, worker_id) that hold the results of complete queries, in order: the tasks of the last fragment."""
    root = fragments.groupBy("query_id").agg(F.max("fragment_id").alias("fragment_id"))
    return phases.join(root, ["query_id", "fragment_id"]).join(progress(phases).where("complete").select("query_id"), "query_id", "left_semi").select("query_id", "partition", "worker_id").orderBy("query_id", "partition")
