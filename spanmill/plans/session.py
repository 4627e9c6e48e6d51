"""Session and loader helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def default_data_dir(sf: str = "0.001") -> str:
    return os.environ.get("SPANMILL_DATA", f"/root/testdata/sf{sf}")


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def note(path: str) -> str:
    """A path that cleaned() is to delete, where one is open."""
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder within is deleted at the end: results are to be written or collected before.

    Operators delete what they don't need any more themselves; what their results are read from stays, as nobody else knows when they were.
    """
    mark = _noted.set([])
    try:
        yield
    finally:
        drop(spark, _noted.get())
        _noted.reset(mark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a local session without one, in a temporary folder.

    Executors of a cluster don't see a folder of the driver's machine: there, unset is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return note(f"{base.rstrip('/')}/spanmill-{name}-{uuid.uuid4().hex}")


def address(spark: SparkSession, path: str) -> str:
    """A path that means the same to Spark and to tasks that open files themselves: with the default file system's name, unless that is local."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return path if whole.startswith("file:") else whole


def many(rows: DataFrame) -> DataFrame:
    """rows that no join broadcasts: of rows made by explode() Spark reckons the size by the rows they were made of."""
    return rows.hint("merge")


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """rows, counted and dealt by key to tasks of about `each`: before a step that makes many rows of each, as a small file is one task's."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def cut(df: DataFrame, name: str = "cut", held: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder, and read again.

    This cuts lineage as a checkpoint does, and the size estimates of loops too. The path is appended
    to `held`, for drop() once nothing reads it any more.
    """
    spark = df.sparkSession
    df.write.parquet(path := shared_path(spark, name))
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, held: list[str]) -> None:
    """Delete what cut() wrote, and forget it."""
    for path in held:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()
