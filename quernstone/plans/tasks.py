"""Tasks and the edges between them, derived from fragments by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["query_id", "fragment_id", "partition"]


def tasks(fragments: DataFrame) -> DataFrame:
    """Rows (query_id, fragment_id, partition, output_partitions): one per task."""
    return fragments.select("query_id", "fragment_id", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("partition"), "output_partitions")


def edges(fragments: DataFrame) -> DataFrame:
    """Rows (query_id, fragment_id, partition, input_fragment, producer_partition, bucket).

    A task of a partitioned input reads its own bucket of every producer task; of another, bucket 0.
    """
    reads = fragments.select("query_id", "fragment_id", "tasks", F.explode("inputs").alias("i")).select("query_id", "fragment_id", "tasks", F.col("i.fragment_id").alias("input_fragment"), "i.partitioned")
    producers = fragments.select("query_id", F.col("fragment_id").alias("input_fragment"), F.col("tasks").alias("producers"))
    each = reads.join(producers, ["query_id", "input_fragment"]).withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    each = each.withColumn("producer_partition", F.explode(F.sequence(F.lit(0), F.col("producers") - 1)))
    return each.select(*KEY, "input_fragment", "producer_partition", F.when(F.col("partitioned"), F.col("partition")).otherwise(0).alias("bucket"))


def ready_tasks(fragments: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks (KEY) of which every input fragment is done to its last task, dispatched before or not; done tasks aren't ready.

    A barrier per input fragment: counts per fragment are compared, never task by task.
    """
    finished = fragments.select("query_id", "fragment_id", "tasks").join(done.select(*KEY).distinct().groupBy("query_id", "fragment_id").agg(F.count("*").alias("n")), ["query_id", "fragment_id"]).where("n >= tasks")
    blocked = fragments.select("query_id", "fragment_id", F.explode("inputs.fragment_id").alias("i")).join(finished.select("query_id", F.col("fragment_id").alias("i")), ["query_id", "i"], "left_anti").select("query_id", "fragment_id").distinct()
    return tasks(fragments).select(*KEY).join(blocked, ["query_id", "fragment_id"], "left_anti").join(done.select(*KEY), KEY, "left_anti")


def dispatchable(fragments: DataFrame, phases: DataFrame) -> DataFrame:
    """Ready tasks that are still pending, of queries without a failed or cancelled task. `phases`: KEY and phase."""
    dead = phases.where(F.col("phase").isin("FAILED", "CANCELLED")).select("query_id").distinct()
    ready = ready_tasks(fragments, phases.where("phase = 'DONE'"))
    return ready.join(phases.where("phase = 'PENDING'").select(*KEY), KEY, "left_semi").join(dead, "query_id", "left_anti")


def task_inputs(fragments: DataFrame, placements: DataFrame) -> DataFrame:
    """Edges with the worker that holds each (placements: KEY, worker_id of finished tasks); only of tasks whose producers are all finished."""
    need = edges(fragments)
    at = placements.select("query_id", F.col("fragment_id").alias("input_fragment"), F.col("partition").alias("producer_partition"), "worker_id")
    located = need.join(at, ["query_id", "input_fragment", "producer_partition"], "left")
    unfinished = located.where(F.col("worker_id").isNull()).select(*KEY).distinct()
    return located.join(unfinished, KEY, "left_anti").select(*KEY, "input_fragment", "producer_partition", "bucket", "worker_id")


def validate(fragments: DataFrame) -> DataFrame:
    """Rows (query_id, error): the first rule that each query's description breaks, or null.

    `fragments` has position, fragment_id, tasks, output_partitions, inputs and has_plan (a query
    without fragments has one row with a null position). Rules go fragment by fragment, in this order
    within each; the root's rule comes last.
    """
    by = fragments.select("query_id", F.col("position").alias("fragment_id"), F.col("output_partitions").alias("buckets"))
    reads = fragments.select("query_id", "position", F.posexplode_outer("inputs").alias("k", "i")).select("query_id", "position", "k", F.col("i.fragment_id").alias("fragment_id"), F.col("i.partitioned").alias("partitioned"))
    last = fragments.groupBy("query_id").agg(F.max("position").alias("last"))
    joined = reads.join(by, ["query_id", "fragment_id"], "left").select("query_id", "position", "k", F.col("fragment_id").alias("reads"), "partitioned", "buckets")
    wide = fragments.join(joined, ["query_id", "position"], "left").join(last, "query_id", "left")
    own, pos, reads_ = F.col("fragment_id"), F.col("position"), F.col("reads")
    say = lambda text: F.format_string(text, pos, own, reads_, F.col("buckets"))
    broken = F.array(
        F.when(pos.isNull(), F.struct(F.lit(-1).alias("at"), F.lit(0).alias("rule"), F.lit(0).alias("k"), F.lit("no fragments").alias("error"))),
        *(
            F.when(test, F.struct(at.cast("int").alias("at"), F.lit(rule).alias("rule"), F.coalesce("k", F.lit(0)).cast("int").alias("k"), text.alias("error")))
            for rule, test, at, text in (
                (1, own != pos, pos, say("fragment at position %1$d has id %2$d")),
                (2, F.col("tasks") == 0, pos, say("fragment %1$d has no tasks")),
                (3, F.col("output_partitions") == 0, pos, say("fragment %1$d has zero output partitions")),
                (4, ~F.col("has_plan"), pos, say("fragment %1$d has an empty plan")),
                (5, reads_.isNotNull() & ((reads_ >= pos) | (reads_ < 0) | F.col("buckets").isNull()), pos, say("input %3$d of fragment %1$d does not precede it")),
                (6, F.col("partitioned") & (F.col("buckets") != F.col("tasks")), pos, say("fragment %3$d writes %4$d buckets, which isn't the number of tasks of fragment %1$d")),
                (6, ~F.col("partitioned") & (F.col("buckets") != 1), pos, say("fragment %1$d reads only bucket 0 of fragment %3$d, which writes %4$d")),
                (9, (pos == F.col("last")) & (F.col("output_partitions") != 1), F.col("last") + 1, say("the root fragment %1$d must write one bucket")),
            )
        ),
    )
    # within a fragment an input's own rules come before the next input's
    listed = wide.select("query_id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("b")).select("query_id", F.struct(F.col("b.at").alias("at"), F.when(F.col("b.rule").isin(5, 6), 5).otherwise(F.col("b.rule")).alias("rule"), F.col("b.k").alias("k"), F.col("b.rule").alias("sub"), F.col("b.error").alias("error")).alias("b"))
    first = listed.groupBy("query_id").agg(F.min("b").alias("b"))
    return fragments.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.col("b.error").alias("error"))
