"""Shared folder, lineage cuts, size-checked semi-joins and tidy Python tasks for the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys are broadcast only when their exact count is at most this (16 bytes each: 16 MB); beyond it a shuffle join runs.
BROADCAST_KEYS = 1_000_000
#: Most rows and bytes of an Arrow batch: texts are long, a task holds a batch several times over, and buffers of many MB
#: that come and go leave holes in the memory of processes that live long.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


#: Bytes of groups after which a worker gives memory back: small groups would pay more for that than for their work.
RELEASE_BYTES = 32 << 20
_seen = [0]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is set, a temporary folder serves a local master, as in tests; a cluster without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/kurvex-shared"
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES`` (never raises them)."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def stored_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, named after this application."""
    return f"{shared_dir(spark)}/kurvex-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = stored_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kurvex_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        path = getattr(df, "_kurvex_path", None)
        if path:
            _delete(df.sparkSession, path)


def restrict(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", limit: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` semi- or anti-joined with ``keys``; broadcast only behind a count, else shuffled."""
    keys = keys.select(on)
    if keys.limit(limit + 1).count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored; call it when no result that reads them is needed any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kurvex-{spark.sparkContext.applicationId}-*")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(p) or []:
        fs.delete(found.getPath(), True)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(run):
    """For the functions of mapInArrow, applyInArrow (key, table) and cogroups (left, right): what they have allocated is released at their end."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(found):
            try:
                yield from run(found)
            finally:
                release()

        return batches

    @functools.wraps(run)
    def group(first, second):
        try:
            return run(first, second)
        finally:
            _seen[0] += getattr(first, "nbytes", 0) + getattr(second, "nbytes", 0)
            if _seen[0] > RELEASE_BYTES:
                _seen[0] = 0
                release()

    return group
