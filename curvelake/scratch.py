"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under ``spark.checkpoint.dir``; inside ``passing`` it goes at the end of the block, or of the surrounding one if it is to be kept. Where that is unset, a temporary folder will do for a local master;
    elsewhere executors wouldn't see each other's files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/curvelake-scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step; False if the target is there already."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(path(target)) and fs.rename(path(source), path(target))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write ends, not whenever the driver's garbage is collected. What is
    written doesn't need them: it is read from its own files."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write ``df`` to ``path`` and read it back. Survives lost executors."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``write`` to a new path. Inside ``passing`` the table goes at its end, unless it is to be kept."""
    return write(df, folder(df.sparkSession, name, keep))


def collect_garbage(spark: SparkSession) -> None:
    """After a step of many jobs: the driver's JVM gives back what their plans, broadcasts and compiled classes held."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables and folders made inside are deleted at the end; one that is kept belongs to the surrounding block, if any.

    For callers this is the handle on all that a query writes: run the query and take its result inside the block, and nothing stays.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            discard(spark, path)
