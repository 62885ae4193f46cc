"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from .errors import FailedPrecondition

#: What every session needs for results that compare with other engines.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: "golden": a plan that doesn't change at run time, for the inspector and its tests.
#: "bench": adaptive execution, as on a cluster.
PROFILES = {
    "golden": {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4"},
    "bench": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"},
}


def session(master: str = "local[4]", profile: str = "bench", app: str = "quernstone", **conf: str) -> SparkSession:
    """A session on `master`; keyword settings use __ for the dots of Spark's names."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    settings = COMMON | PROFILES[profile] | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def profiled(spark: SparkSession, profile: str) -> SparkSession:
    """A sibling session (same context, own SQL settings) under a profile."""
    own = spark.newSession()
    for key, value in (COMMON | PROFILES[profile]).items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, and an error on a cluster."""
    if where := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise FailedPrecondition(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if not (own := _TEMPORARY.get(spark.sparkContext.applicationId)):
        own = _TEMPORARY[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
    return own


_TEMPORARY: dict[str, str] = {}


@atexit.register
def _remove_temporary() -> None:
    for folder in _TEMPORARY.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
