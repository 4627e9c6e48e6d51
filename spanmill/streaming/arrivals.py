"""Slides that arrive: the same run operators over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.rle import overlap, span_sizes, text_to_spans


def read_masks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of id, predicted, expected from Parquet files that arrive in a folder."""
    return spark.readStream.schema("id STRING, predicted STRING, expected STRING").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scores(batch: DataFrame) -> DataFrame:
    """id, dice of the masks of one micro-batch; slides come whole, so batches need no state."""
    p, t = (text_to_spans(batch, c, ["id"]) for c in ("predicted", "expected"))
    joined = batch.select("id").join(span_sizes(p, ["id"], "p"), "id", "left").join(span_sizes(t, ["id"], "t"), "id", "left").join(overlap(p, t, ["id"]), "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("id", ((2 * n("n") + 1e-8) / (n("p") + n("t") + 1e-8)).alias("dice"))


def score_arrivals(masks: DataFrame, out: str, checkpoint: str):
    """Start a query that writes each batch's scores below `out`, one folder a batch: a batch that is done again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        scores(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return masks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
