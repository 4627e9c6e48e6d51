"""Rasters as Parquet tables of chunks: a row per slide, group and tile with an array of values, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators import grid, rle
from spanmill.plans.session import many


def write_chunks(px: DataFrame, path: str, value: str, size: int = 512) -> None:
    """px (slide, grp, y, x, value) as chunks below path, partitioned by group. A chunk's pixels meet in one task."""
    at = px.select("slide", "grp", F.floor(F.col("y") / size).cast("long").alias("cy"), F.floor(F.col("x") / size).cast("long").alias("cx"), F.struct("y", "x", F.col(value).alias("v")).alias("p"))
    at.groupBy("slide", "grp", "cy", "cx").agg(F.sort_array(F.collect_list("p")).alias("px")).write.mode("overwrite").partitionBy("grp").parquet(path)


def read_window(spark: SparkSession, path: str, grp: str, slide: str | int, y0: int, x0: int, size: int, chunk: int = 512) -> DataFrame:
    """y, x, v of a window: only the chunks it touches are read, by partition and pushed filters."""
    near = (F.col("cy") >= y0 // chunk) & (F.col("cy") <= (y0 + size - 1) // chunk) & (F.col("cx") >= x0 // chunk) & (F.col("cx") <= (x0 + size - 1) // chunk)
    rows = spark.read.parquet(path).filter((F.col("grp") == grp) & (F.col("slide") == slide) & near).select(F.inline("px"))
    return rows.filter((F.col("y") >= y0) & (F.col("y") < y0 + size) & (F.col("x") >= x0) & (F.col("x") < x0 + size))


def stacked_bands(bands: list[DataFrame]) -> DataFrame:
    """slide, band, y, x, v of one-band tables, numbered from 0: a file that has its bands apart."""
    out = bands[0].withColumn("band", F.lit(0))
    for k, b in enumerate(bands[1:], 1):
        out = out.unionByName(b.withColumn("band", F.lit(k)))
    return out


def turned(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """px with y and x exchanged for slides whose pixels pass the height or width that sizes (slide, h, w) has."""
    far = px.groupBy("slide").agg(F.max("y").alias("__y"), F.max("x").alias("__x")).join(sizes, "slide")
    wrong = far.select("slide", ((F.col("__y") >= F.col("h")) | (F.col("__x") >= F.col("w"))).alias("__turn"))
    return many(px).join(wrong, "slide").select("slide", F.when(F.col("__turn"), F.col("x")).otherwise(F.col("y")).alias("y"), F.when(F.col("__turn"), F.col("y")).otherwise(F.col("x")).alias("x"), *[c for c in px.columns if c not in ("slide", "y", "x")])


def scaled(value: Column, most: Column | int) -> Column:
    """Value as a share of its type's or its map's maximum, as bytes 0 to 255."""
    return F.floor(F.try_divide(value * 255.0, F.lit(most) if isinstance(most, int) else most)).cast("int")


def checked_classes(px: DataFrame, cls: str, most: int) -> DataFrame:
    """px; reading it is an error where a class is outside 0 .. most - 1."""
    fine = F.col(cls).isNull() | ((F.col(cls) >= 0) & (F.col(cls) < most))
    return px.withColumn(cls, F.when(fine, F.col(cls)).otherwise(F.raise_error(F.concat(F.lit("class "), F.col(cls).cast("string"), F.lit(" is unknown"))).cast(px.schema[cls].dataType)))


def tile_names(slide: Column, number: Column) -> Column:
    """Member name of a tile in an archive of tiles."""
    return F.format_string("%s_%04d.png", slide, number)


def write_tiles(px: DataFrame, path: str, size: int, value: str = "val", mask: str = "mask") -> DataFrame:
    """Tiles of px below path, in files of ranges of slides: number, values row by row, the mask as a text (column by column); their statistics.

    Rows are in order of slide and number, so a slide's are found by the files' statistics; files grow with the tiles, not with the slides.

    Returns slide, ty, tx, name, masked, ratio, std of each tile, as grid.tile_stats() has them, and its rle.
    """
    keys = ["slide", "ty", "tx"]
    at = px.select("slide", F.floor(F.col("y") / size).cast("long").alias("ty"), F.floor(F.col("x") / size).cast("long").alias("tx"), (F.col("y") % size).cast("long").alias("dy"), (F.col("x") % size).cast("long").alias("dx"), value, mask)
    spans = rle.encode_spans(at.filter(F.col(mask) == 1).select(*keys, rle.to_pos(F.col("dy"), F.col("dx"), size).alias("pos")), keys)
    texts = rle.spans_to_text(spans, keys)
    named = grid.tile_stats(px, size, value, mask).join(texts, keys, "left").withColumn("name", F.format_string("%s_%04d_%04d", F.col("slide").cast("string"), F.col("ty"), F.col("tx")))
    rows = at.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dy", "dx", value))).alias("px"))
    rows.join(named.select(*keys, "name", "rle"), keys).repartitionByRange("slide").sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return named.select(*keys, "name", "masked", "ratio", "std", "rle")
