"""Tables written to the folder that all executors share: where a plan is cut, or read more than once."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster is an error,
    since executors there don't see each other's local folders."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: With this, shuffle files go as soon as the job that wrote them has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CALLS = threading.local()


def _under_way() -> list[list[str]]:
    """The paths that staged() wrote in each call of alone() that is under way in this thread, the innermost last."""
    if not hasattr(_CALLS, "paths"):
        _CALLS.paths = []
    return _CALLS.paths


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends at files that outlive an executor.

    The files are below <shared folder>/<application id>; that folder can go when the application has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for paths in _under_way()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make(), staged, of which nothing else stays on disk: shuffle files go after each step, and what make() staged is
    deleted at the end, as only its result reads that."""
    calls, before = _under_way(), spark.conf.get(_CLEANUP, None)
    calls.append([])
    spark.conf.set(_CLEANUP, "true")
    try:
        df = make()
        inner = calls[-1][:]
        out = staged(df, label)
        for path in inner:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    finally:
        paths = calls.pop()
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    for outer in calls[-1:]:
        outer.append(paths[-1])
    return out


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors (once an application; as spark-submit --py-files does), for functions that run
    in their Python workers."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).parent
        handle, name = tempfile.mkstemp(suffix=".zip", prefix=f"{package.name}-")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for x in sorted(package.rglob("*.py")):
                z.write(x, x.relative_to(package.parent))
        context.addPyFile(name)
        _SHIPPED.add(context.applicationId)
