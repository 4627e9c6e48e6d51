"""Running sums and numbers in an order, without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.plans.session import cut


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, for each name of sums, its running sum within keys up to and with a row, and all_NAME over the key.

    The order is to be total within a key. Rows are dealt to ranges of keys and order, so that a key
    with most of the rows spreads over many; sums per key and range, few rows, are added up apart,
    and windows run inside ranges only. Null keys are a key. The ranges are written, as they could differ if
    they were made twice.
    """
    parts = parts or max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = rows.withColumns({f"__v_{n}": c for n, c in sums.items()})
    ranged = cut(valued.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    named = [F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)]
    per = ranged.groupBy(*named, "__range").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    by = Window.partitionBy(*[f"__k_{i}" for i in range(len(keys))])
    upto = by.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*[f"__k_{i}" for i in range(len(keys))], F.col("__range").alias("__at"), *[F.sum(f"__s_{n}").over(upto).alias(f"__b_{n}") for n in sums], *[F.sum(f"__s_{n}").over(by).alias(f"all_{n}") for n in sums])
    on = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    own = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(before, on)
    done = joined.withColumns({n: F.sum(f"__v_{n}").over(own) + F.coalesce(f"__b_{n}", F.lit(0)) for n in sums})
    return done.select(*rows.columns, *sums, *[f"all_{n}" for n in sums])
