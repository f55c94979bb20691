"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut lineage by writing a small Parquet table and reading it back. The folder is
the one named by ``spark.checkpoint.dir``; one under the temporary folder is used only where that
setting is absent and the driver is the only machine (local mode and tests). A table outlives lost executors, unlike cached or
locally checkpointed blocks. Tables that are still needed when an operator returns, as its lazy
result reads them, are deleted when the application ends, or earlier by :func:`sweep`.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_LIVE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or in local mode a temporary one where none is set."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all machines share: executors must not write to disks of their own")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "goldlink")


def folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder in the shared one, deleted like the tables."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame returned by :func:`materialize` (no-op for others)."""
    path = getattr(df, "_scratch_path", None)
    if path is not None and _LIVE.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def tables() -> set[str]:
    """The tables that are there now."""
    return set(_LIVE)


def discard_since(before: set[str], keep: DataFrame | None = None) -> None:
    """Delete the tables written after :func:`tables` gave ``before``, except the one behind ``keep``."""
    kept = getattr(keep, "_scratch_path", None)
    for path in [p for p in _LIVE if p not in before and p != kept]:
        _delete(_LIVE.pop(path), path)


def sweep() -> None:
    """Delete all tables that are left; DataFrames that read them can no longer be used."""
    while _LIVE:
        path, spark = _LIVE.popitem()
        with contextlib.suppress(Py4JError, OSError, AttributeError, TypeError):  # the application may be gone already
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                _delete(spark, path)


atexit.register(sweep)
