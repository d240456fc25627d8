"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("assay_scope", default=None)


def _note(spark: SparkSession, path: str) -> None:
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := _scope.get()) is not None:
        own.append(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables and folders that are written inside are deleted at the end, also after an error: for work whose result is stored inside.

    Scopes may stand in one another and side by side in threads; each deletes its own.
    """
    own: list[str] = []
    before = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(before)
        forget(spark, *own)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="assay-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder, for files that tasks write themselves; forget() and forget_all() delete it."""
    path = f"{shared_dir(spark).rstrip('/')}/assay-{kind}-{uuid.uuid4().hex}"
    _note(spark, path)
    return path


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/assay-{uuid.uuid4().hex}"
    _note(spark, path)  # before it is there: what a failed job leaves goes too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: it is worked out once, and outlives lost executors."""
    return written(df)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing will read again."""
    kept = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in kept:
            kept.remove(path)


def forget_all(spark: SparkSession) -> None:
    """Delete all tables that this application has written by written() and durable(): for the end of a job, when its results are stored."""
    forget(spark, *_written.get(spark.sparkContext.applicationId, []))
