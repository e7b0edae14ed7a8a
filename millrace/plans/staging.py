"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Sessions in which tables are being written: how many at once, and their setting before.
_lock = threading.Lock()
_writing: Counter[int] = Counter()
_before: dict[int, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables: the session's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own; on a
    cluster a machine-local folder would be invisible to the other executors, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _local_roots[context.applicationId]


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops the files of its shuffles when it ends, not when the driver's memory is next cleaned.

    A written table is read from its own files, so nothing asks for those shuffles again. The session's
    setting comes back when the last of several threads has left.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        if not _writing[session]:
            _before[session] = spark.conf.get(_DROP_SHUFFLES, "false")
            spark.conf.set(_DROP_SHUFFLES, "true")
        _writing[session] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[session] -= 1
            if not _writing[session]:
                spark.conf.set(_DROP_SHUFFLES, _before.pop(session))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing), freezes values that
    could differ between two evaluations, and gives the planner the true size of the table, so its
    choice between broadcast and shuffle rests on a measured size.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables, or of unions of them, that nothing reads any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
