"""What queries took: tasks and stages from Spark's status store, and how runtimes scale with workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks asked for at once.
PAGE = 10_000
TASKS = "query_id string, stage_id int, task_id long, start_unix_ms long, end_unix_ms long, output_rows long, output_bytes long"


def _tasks_of(spark: SparkSession, store, stage: int) -> list:
    """The tasks of a stage that succeeded, page by page over all attempts; of one partition the last."""
    v1, found = spark._jvm.org.apache.spark.status.api.v1, {}
    for attempt in range(store.lastStageAttempt(stage).attemptId() + 1):
        at = 0
        while (tasks := store.taskList(stage, attempt, at, PAGE, v1.TaskSorting.ID, spark._jvm.java.util.ArrayList())).size():
            for task in (tasks.apply(k) for k in range(tasks.size())):
                if task.status() == "SUCCESS" and not task.taskMetrics().isEmpty():
                    found[task.index()] = task
            at += PAGE
    return list(found.values())


def task_rows(spark: SparkSession, query_id: str, tag: str) -> list[tuple]:
    """TASKS rows of the jobs that ran under a job tag."""
    sc = spark.sparkContext._jsc.sc()
    store, rows = sc.statusStore(), []
    jobs, seen = store.jobsList(None), set()
    for k in range(jobs.size()):
        job = jobs.apply(k)
        if not job.jobTags().contains(tag):
            continue
        stages = job.stageIds()
        for s in range(stages.size()):
            stage = stages.apply(s)
            if stage in seen:
                continue
            seen.add(stage)
            for task in _tasks_of(spark, store, stage):
                m, start = task.taskMetrics().get(), task.launchTime().getTime()
                took = task.duration().get() if task.duration().isDefined() else m.executorRunTime()
                out, shuffled = m.outputMetrics(), m.shuffleWriteMetrics()
                rows.append((query_id, stage, task.taskId(), start, start + took, out.recordsWritten() + shuffled.recordsWritten(), out.bytesWritten() + shuffled.bytesWritten() or m.resultSize()))
    return rows


def stage_breakdown(tasks: DataFrame) -> DataFrame:
    """Rows (query_id, stage_id, tasks, wall_ms, work_ms, longest_ms, output_rows, output_bytes) from TASKS rows."""
    took = F.col("end_unix_ms") - F.col("start_unix_ms")
    return tasks.groupBy("query_id", "stage_id").agg(
        F.count("*").alias("tasks"),
        (F.max("end_unix_ms") - F.min("start_unix_ms")).alias("wall_ms"),
        F.sum(took).alias("work_ms"),
        F.max(took).alias("longest_ms"),
        F.sum("output_rows").alias("output_rows"),
        F.sum("output_bytes").alias("output_bytes"),
    )


def scaling_efficiency(runs: DataFrame) -> DataFrame:
    """Rows (query, workers, seconds, speedup, efficiency) from (query, workers, seconds): against the same query's run on one worker; null without one."""
    alone = runs.where("workers = 1").select("query", F.col("seconds").alias("alone"))
    speedup = F.col("alone") / F.col("seconds")
    return runs.join(alone, "query", "left").select("query", "workers", "seconds", speedup.alias("speedup"), (speedup / F.col("workers")).alias("efficiency"))


def serial_share(runs: DataFrame) -> DataFrame:
    """Rows (query, t_serial, t_parallel): the least-squares fit of seconds = t_serial + t_parallel / workers; null with one size only."""
    x = 1 / F.col("workers")
    s = runs.groupBy("query").agg(F.covar_pop(x, "seconds").alias("c"), F.var_pop(x).alias("v"), F.avg(x).alias("x"), F.avg("seconds").alias("y"))
    slope = F.when(F.col("v") > 0, F.col("c") / F.nullif("v", F.lit(0.0)))
    return s.select("query", (F.col("y") - slope * F.col("x")).alias("t_serial"), slope.alias("t_parallel"))
