"""What the operators share: the folder all executors see, and cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.plans.session import note

#: Rows of a batch whose texts are Python objects at one time.
SLICE_ROWS = 64


def slices(batch: pa.RecordBatch | pa.Array, rows: int = SLICE_ROWS) -> Iterator:
    """A batch or column cut into views of few rows, so that a task holds few texts twice."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once however often use needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where unset, a temporary one of a local session.

    Executors of a cluster don't see a folder of the driver's machine: there, unset is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='spanmill-')}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stays there is deleted by session.cleaned(), where one is open."""
    return note(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later stages never recompute it.

    The path is appended to `held`, for delete() once nothing reads it any more.
    """
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder, and forget them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()
