"""Shared folder for intermediate tables, taken from the session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_SCOPE: ContextVar[list[str] | None] = ContextVar("tables of the scope", default=None)


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    named = spark.conf.get(SETTING, None)
    if not named:
        raise ValueError(f"set {SETTING}, when the session is built, to a folder that all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: its rows are never computed again, also after lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``written`` makes inside, at the end: what is returned from here must be stored before."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            remove_folder(spark, path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave; nothing may read them any more."""
    for table in tables:
        remove_folder(table.sparkSession, table.written_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
