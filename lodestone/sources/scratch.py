"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Share of the driver's heap from which ease() acts.
TAKEN = 0.4

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the session runs in one process, a temporary folder of the application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            found = given.get()
        elif context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        else:
            found = _own_dirs.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return found.rstrip("/")


def ease(spark: SparkSession) -> None:
    """Have the driver hand back heap that plans took, for it would keep all that it may have; not while little of that is taken."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > TAKEN * runtime.maxMemory():
        jvm.java.lang.System.gc()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there: plans that use it stay small, and a lost executor costs no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    ease(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
