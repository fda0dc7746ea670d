"""Shared-folder helpers: where intermediate tables may be written."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` decides; without it a temporary folder is made, in
    local mode only (driver and executors are one machine there).
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plainread-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written since the innermost ``recorded`` began.
_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``materialize`` writes meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]  # an outer one may hold equal paths


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes intermediate tables that no plan reads any more, and has Spark remove the shuffle files of
    finished work, which otherwise stay until the driver happens to collect garbage."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once, read back: cuts the lineage, keeps column pruning and file sizes.

    The table lies on shared storage, so a lost executor costs a re-read only.
    """
    path = new_path(df.sparkSession, name)
    for paths in _recorders:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on rows go to Python workers in Arrow batches of at most ``size`` bytes (or one row).

    The default bounds a batch by rows first, so with long texts a batch, its copy in the worker and
    the batch that comes back take much of an executor's memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, f"{size}b")
