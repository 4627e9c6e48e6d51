"""Connected components of masks, on vertical runs instead of pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.operators import flood
from spanmill.operators.graph import connected
from spanmill.operators.groups import dealt, whole_groups
from spanmill.operators.rle import encode_spans
from spanmill.operators.scan import running
from spanmill.plans.session import cut, drop, many


def column_runs(mask: DataFrame) -> DataFrame:
    """slide, x, lo, hi: vertical runs of mask pixels (slide, y, x)."""
    return encode_spans(mask.select("slide", "x", "y"), ["slide", "x"], "y")


#: Columns whose runs are labelled in one task.
STRIP = 1024


def _touching(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs, sorted by x and lo, of neighbouring columns that overlap (or meet at corners)."""
    wide = int(hi.max()) + 2
    low, high = x * wide + lo, x * wide + hi
    # the runs of the next column that end after this one begins, and begin before it ends
    first = np.searchsorted(high, (x + 1) * wide + np.maximum(lo - slack, 0), "right")
    end = np.searchsorted(low, (x + 1) * wide + np.minimum(hi + slack, wide), "left")
    n = np.maximum(end - first, 0)
    a = np.repeat(np.arange(len(x)), n)
    return a, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))


def _least_of_part(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its connected part."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def label_runs(runs: DataFrame, connectivity: int = 4, strip: int = STRIP) -> DataFrame:
    """runs (slide, x, lo, hi) with label: the least run <x, lo> of their component within the slide.

    A run touches those of the next column that it overlaps (with 8-connectivity, also at corners).
    Strips of columns are labelled whole, many small ones at once; then only the components that touch across the
    borders of strips are joined, as a graph of labels.
    """
    slack = 1 if connectivity == 8 else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, group in whole_groups(batches, ["slide", "__strip"]):
            x, lo, hi = (own[c].to_numpy(dtype=np.int64) for c in ("x", "lo", "hi"))
            # strips side by side, a column free between them
            least = _least_of_part(len(own), *_touching(group * (strip + 1) + x % strip, lo, hi, slack))
            yield own.assign(lx=x[least], llo=lo[least])[["slide", "x", "lo", "hi", "lx", "llo"]]

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    strips = dealt(runs.select("slide", "x", "lo", "hi", F.floor(F.col("x") / strip).alias("__strip")), ["slide", "__strip"], ["x", "lo"])
    own = cut(strips.mapInPandas(run, f"slide {kinds['slide']}, x {kinds['x']}, lo {kinds['lo']}, hi {kinds['hi']}, lx {kinds['x']}, llo {kinds['lo']}"), "runs")
    node = F.struct("slide", "lx", "llo")
    left = own.filter(F.col("x") % strip == strip - 1).select("slide", "x", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), node.alias("a"))
    right = own.filter(F.col("x") % strip == 0).select("slide", (F.col("x") - 1).cast(kinds["x"]).alias("x"), "lo", "hi", node.alias("b"))
    across = left.join(right, ["slide", "x"]).filter((F.col("lo") < F.col("ahi") + slack) & (F.col("alo") < F.col("hi") + slack)).select("a", "b").distinct()
    held: list[str] = []
    links = cut(across, "across", held)
    label = F.struct(F.col("lx").alias("x"), F.col("llo").alias("lo"))
    if links.isEmpty():
        drop(runs.sparkSession, held)
        return own.select("slide", "x", "lo", "hi", label.alias("label"))
    parts = connected(links)
    drop(runs.sparkSession, held)
    joined = own.join(parts.select(F.col("node.slide").alias("slide"), F.col("node.lx").alias("lx"), F.col("node.llo").alias("llo"), "part"), ["slide", "lx", "llo"], "left")
    whole = F.struct(F.col("part.lx").alias("x"), F.col("part.llo").alias("lo"))
    return joined.select("slide", "x", "lo", "hi", F.when(F.col("part").isNull(), label).otherwise(whole).alias("label"))


def component_stats(labelled: DataFrame, min_pixel: int = 1) -> DataFrame:
    """slide, label, area, left, top, width, height, cy, cx of components of min_pixel or more pixels."""
    n = F.col("hi") - F.col("lo")
    out = labelled.groupBy("slide", "label").agg(
        F.sum(n).alias("area"), F.min("x").cast("long").alias("left"), F.min("lo").alias("top"), (F.max("x") - F.min("x") + 1).cast("long").alias("width"), (F.max("hi") - F.min("lo")).alias("height"),
        (F.sum((F.col("lo") + F.col("hi") - 1) * n / 2) / F.sum(n)).alias("cy"), (F.sum(F.col("x") * n) / F.sum(n)).alias("cx"),
    )
    return out.filter(F.col("area") >= min_pixel)


def without_border(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """labelled runs without the components that touch the border of their slide; sizes: slide, h, w."""
    met = labelled.join(sizes.select("slide", F.col("h").alias("__h"), F.col("w").alias("__w")), "slide")
    on = (F.col("x") == 0) | (F.col("lo") == 0) | (F.col("hi") == F.col("__h")) | (F.col("x") == F.col("__w") - 1)
    return labelled.join(met.filter(on).select("slide", "label").distinct(), ["slide", "label"], "left_anti")


def relabelled(labelled: DataFrame) -> DataFrame:
    """labelled runs with label 1 .. n within the slide, in the order of the labels they had."""
    ranked = running(labelled.select("slide", "label").distinct(), ["slide"], ["label"], {"number": F.lit(1).cast("long")})
    named = ranked.select(F.col("slide").alias("__s"), F.col("label").alias("__l"), "number")
    return labelled.join(many(named), (F.col("slide") == F.col("__s")) & (F.col("label") == F.col("__l"))).select("slide", "x", "lo", "hi", F.col("number").alias("label"))


def label_mask(mask: DataFrame, sizes: DataFrame, min_pixel: int = 1, exclude_border: bool = False, do_watershed: bool = False) -> DataFrame:
    """slide, x, lo, hi, label (1 .. n): 8-connected components of min_pixel or more pixels, those at the border left out if asked.

    do_watershed: components are split at their waists first, with markers as far apart as the radius of a disc of min_pixel.
    """
    found = label_runs(column_runs(mask), 8)
    if do_watershed:
        numbered = label_pixels(found).withColumn("label", F.xxhash64("label"))
        parts = flood.watershed(numbered, sizes, math.ceil(math.sqrt(min_pixel / math.pi)))
        spans = encode_spans(parts.select("slide", "part", "x", "y"), ["slide", "part", "x"], "y")
        # named as runs are: by the least run of each part
        least = spans.groupBy("slide", "part").agg(F.min(F.struct("x", "lo")).alias("label"))
        found = spans.join(many(least), ["slide", "part"]).select("slide", "x", "lo", "hi", "label")
    if exclude_border:
        found = without_border(found, sizes)
    if min_pixel > 1:
        found = found.join(many(component_stats(found, min_pixel).select("slide", "label")), ["slide", "label"], "left_semi")
    return relabelled(found)


def label_pixels(labelled: DataFrame) -> DataFrame:
    """slide, label, y, x of labelled runs."""
    return many(labelled.select("slide", "label", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("y"), "x"))
