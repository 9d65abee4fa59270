"""Shared folders, written tables and per-worker caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: The setting for the bytes of rows that go to Python at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, if that is unset, a folder of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage is cut and a lost executor costs nothing that was written."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets the session send at most 4 MB of rows to Python at once, unless it has a bound of its own: 10,000 long texts would fill an executor from both sides."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(4 << 20))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads again."""
    for table in tables:
        for file in {x.rpartition("/")[0] for x in table.inputFiles()}:
            _remove(table.sparkSession, file)


def trim() -> None:
    """Gives memory that is free back to the system, where it is asked for it: a Python worker serves other tasks after this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker does, across tasks."""
    module = sys.modules.setdefault("_quire_worker_cache", types.ModuleType("_quire_worker_cache"))
    return module.__dict__.setdefault("held", {})
