"""Objects that touch, split at their waists: watersheds over images of any height, by strips of rows, and over many small images at once.

Markers are the pixels farthest from the background in a window; each floods from there, the farther pixels first. A pixel goes to
the marker whose way to it stays farthest from the background; of such ways to that which has gone fewest steps since its
nearest place to it, then to the least marker. So defined, what a strip finds depends on the others by its border rows only:
strips tell each other those, round by round, until none changes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.operators.distance import FAR, distances, least_parabolas
from spanmill.operators.groups import dealt, whole_groups
from spanmill.plans.session import cut, drop, many

#: Rows of a strip.
STRIP = 256
#: Places of an image that is taken whole, with others, if markers look no farther than NEAR; places and pixels taken at once.
SMALL, NEAR, AT_ONCE = 1 << 14, 8, 1 << 18
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def depths(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """pixels (slide, y, x, label) with depth: the square of the distance from the nearest pixel that isn't set.

    Outside the image (sizes: slide, h, w) there are none; where all of an image is set, depth is null. Of the pixels that aren't
    set only those next to set ones are made: one of them is the nearest.
    """
    set_ = pixels.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _AROUND if (a, b) != (0, 0)])
    next_to = set_.select("slide", "y", "x", F.explode(steps).alias("s")).select("slide", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).distinct()
    inside = next_to.join(sizes.select("slide", "h", "w"), "slide").filter("y >= 0 AND x >= 0 AND y < h AND x < w").select("slide", "y", "x")
    free = inside.join(many(set_), ["slide", "y", "x"], "left_anti").withColumn("label", F.lit(1))
    every = set_.withColumn("label", F.lit(0)).unionByName(free)
    near = distances(every, ["slide"]).select("slide", "y", "x", F.round(F.col("d1") * F.col("d1")).cast("long").alias("depth"))
    return pixels.join(many(near), ["slide", "y", "x"], "left")


def markers(deep: DataFrame, least: int) -> DataFrame:
    """slide, label, y, x of the pixels of greatest depth within `least` rows and columns in their component; of equal ones the first."""
    place = F.struct("depth", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    best = deep.select("slide", "label", "y", "x", place.alias("top"))
    reach = F.explode(F.sequence(F.lit(-least), F.lit(least))).alias("by")
    for axis in ("x", "y"):  # the greatest of a window is that of its rows' greatest
        moved = best.select("*", reach).withColumn(axis, F.col(axis) + F.col("by")).groupBy("slide", "label", "y", "x").agg(F.max("top").alias("top"))
        best = moved
    own = (F.col("y") == -F.col("top.y")) & (F.col("x") == -F.col("top.x"))
    return best.filter(own).select("slide", "label", "y", "x")


def flooded(y: np.ndarray, x: np.ndarray, level: np.ndarray, starts: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(level, steps, marker) of each pixel reached from the starts (level, steps, marker, y, x), which are pixels or offers to them."""
    height = dict(zip(zip(y.tolist(), x.tolist(), strict=True), level.tolist(), strict=True))
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    heap = list(starts)
    heapq.heapify(heap)
    while heap:
        cost, steps, marker, a, b = heapq.heappop(heap)
        if (a, b) in out:
            continue
        out[a, b] = (cost, steps, marker)
        for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
            if p in height and p not in out:
                own = height[p]
                heapq.heappush(heap, (own, 0, marker, *p) if own > cost else (cost, steps + 1, marker, *p))
    return out


def small_depths(image: np.ndarray, y: np.ndarray, x: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """depths() of pixels of some images, numbered by image; h and w of each image. 0 where nothing is free."""
    high, wide = max(int(h.max()), int(y.max()) + 1), max(int(w.max()), int(x.max()) + 1)
    free = (np.arange(high)[:, None] < h[:, None, None]) & (np.arange(wide) < w[:, None, None])
    free[image, y, x] = False
    rows = np.arange(high)[None, :, None]
    above = np.maximum.accumulate(np.where(free, rows, -(1 << 40)), axis=1)
    below = np.minimum.accumulate(np.where(free, rows, 1 << 40)[:, ::-1], axis=1)[:, ::-1]
    along = np.minimum(np.minimum(rows - above, below - rows).astype(float) ** 2, FAR)
    value = least_parabolas(along.reshape(-1, wide))[0].reshape(free.shape)[image, y, x]
    return np.where(value >= FAR, 0, value).astype(np.int64)


def small_basins(layer: np.ndarray, label: np.ndarray, y: np.ndarray, x: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """The marker of each pixel, by its place among them, as watershed() defines it; -1: none reaches it. Pixels of a layer are distinct.

    How far a way goes down and its steps are settled first, by rounds over the pixels that changed; for the marker only ways that are as good count then.
    """
    pad = max(least, 1)
    high, wide = int(y.max()) + 1 + 2 * pad, int(x.max()) + 1 + 2 * pad
    at = (layer * high + y + pad) * wide + x + pad
    place = np.full((int(layer.max()) + 1) * high * wide, -1, dtype=np.int64)
    place[at] = np.arange(len(at))

    def beside(a: int, b: int) -> np.ndarray:
        """Each pixel's neighbour of its label so many rows and columns away; -1: none."""
        q = place[at + a * wide + b]
        return np.where((q >= 0) & (label[q] == label), q, -1)

    top = np.ones(len(at), dtype=bool)
    for a in range(-least, least + 1):
        for b in range(-least, least + 1):
            q = beside(a, b)
            higher = depth[q] >= depth if (a, b) < (0, 0) else depth[q] > depth  # of equal ones the first
            top &= ~((q >= 0) & higher)
    around = [beside(*d) for d in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    own = np.unique(-depth, return_inverse=True)[1].ravel().astype(np.int64) << 32
    cost, marker = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), len(at))
    # markers in the order of rows, then columns
    order = np.lexsort((x, y, layer))
    rank = np.empty(len(at), dtype=np.int64)
    rank[order] = np.arange(len(at))
    starts = np.flatnonzero(top)
    cost[starts], marker[starts] = own[starts], rank[starts]

    def onward(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pixels, their neighbours, the cost of the ways on to those)."""
        q = np.concatenate([n[p] for n in around])
        p = np.tile(p, len(around))[q >= 0]
        q = q[q >= 0]
        return p, q, np.where(own[q] >> 32 > cost[p] >> 32, own[q], cost[p] + 1)

    now = starts
    while len(now):
        _, q, way = onward(now)
        better = way < cost[q]
        np.minimum.at(cost, q[better], way[better])
        now = np.unique(q[better])
    now = starts
    while len(now):
        p, q, way = onward(now)
        better = (way == cost[q]) & (marker[p] < marker[q])
        np.minimum.at(marker, q[better], marker[p[better]])
        now = np.unique(q[better])
    return np.where(marker < len(at), order[np.minimum(marker, len(at) - 1)], -1)


def small_watersheds(pixels: DataFrame, least: int) -> DataFrame:
    """watershed() of images (pixels: slide, label, y, x, h, w) of few places: a task takes whole ones, many at once, and no pixel is shuffled but once."""

    def basins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["__image", "label", "y", "x"])
        image, label, y, x, h, w = (pdf[c].to_numpy(dtype=np.int64) for c in ("__image", "label", "y", "x", "h", "w"))
        first = np.flatnonzero(np.diff(image, prepend=-1))
        depth = small_depths(image, y, x, h[first], w[first])
        layer = image
        if pdf.duplicated(["__image", "y", "x"]).any():  # components that lie on each other
            layer = pdf.groupby(["__image", "label"], sort=False).ngroup().to_numpy()
        found = np.full(len(image), -1)
        each = max(AT_ONCE // ((int(y.max()) + 1) * (int(x.max()) + 1)), 1)
        for k in range(0, int(layer.max()) + 1, each):
            own = np.flatnonzero((layer >= k) & (layer < k + each))
            to = small_basins(layer[own] - k, label[own], y[own], x[own], depth[own], least)
            found[own] = np.where(to >= 0, own[to], -1)
        return pdf.assign(part=(y[found] << 32) + x[found]).loc[found >= 0, ["slide", "label", "part", "y", "x"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        images, high, wide = 0, 1, 1
        for pdf, group in whole_groups(batches, ["slide"]):
            ends = np.searchsorted(group, np.arange(int(group[-1]) + 2))
            tall, broad = (np.maximum.reduceat(pdf[[a, b]].to_numpy(dtype=np.int64), ends[:-1], axis=0).max(axis=1) for a, b in (("h", "__y"), ("w", "__x")))
            a = 0
            for k in range(len(tall)):  # images side by side, as many as fit in places of the largest height and width
                if images and (images + 1) * max(high, int(tall[k])) * max(wide, int(broad[k])) > AT_ONCE:
                    own = pd.concat([*held, pdf.iloc[ends[a] : ends[k]].assign(__image=group[ends[a] : ends[k]] - a + images - (k - a))], ignore_index=True)
                    yield basins(own)
                    held, images, high, wide, a = [], 0, 1, 1, k
                images, high, wide = images + 1, max(high, int(tall[k])), max(wide, int(broad[k]))
            n = len(tall) - a
            held.append(pdf.iloc[ends[a] :].assign(__image=group[ends[a] :] - a + images - n))
        if held:
            yield basins(pd.concat(held, ignore_index=True))

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    placed = pixels.withColumns({"__y": F.col("y") + 1, "__x": F.col("x") + 1})
    return dealt(placed, ["slide"]).mapInPandas(run, f"slide {kinds['slide']}, label {kinds['label']}, part long, y long, x long")


def watershed(pixels: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """slide, label, part, y, x: components (slide, label, y, x; label any integer) split into the basins of their markers.

    part numbers the markers of a slide by rows, then columns, as y * 2^32 + x does. Flooding goes to the four neighbours. Components without
    depth, as of images wholly set, are one part. Images of one strip and up to SMALL places are taken whole by a task, many at once; of others a strip of rows is one task's at a time.
    """
    spark, held = pixels.sparkSession, []
    px = pixels.select("slide", "label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    if least > NEAR:
        return by_strips(px, sizes, least)
    ends = px.groupBy("slide").agg(F.max("y").alias("y"), F.max("x").alias("x")).join(many(sizes.select("slide", "h", "w").dropDuplicates(["slide"])), "slide", "left")
    places = F.greatest(F.col("h").cast("long"), F.col("y") + 1) * F.greatest(F.col("w").cast("long"), F.col("x") + 1)
    # an image without a size has no free pixels known: the strips deal with it
    sized = ends.select("slide", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), ((places <= SMALL) & (F.greatest(F.col("h").cast("long"), F.col("y") + 1) <= STRIP)).alias("small"))
    sized = cut(sized.withColumn("small", F.coalesce("small", F.lit(False)) & F.col("h").isNotNull() & F.col("w").isNotNull()), "sized", held)
    out = cut(small_watersheds(px.join(many(sized.filter("small").drop("small")), "slide"), least), "parts")
    large = sized.filter("NOT small").select("slide")
    if not large.isEmpty():
        out = out.unionByName(by_strips(px.join(many(large), "slide", "left_semi"), sizes, least))
    drop(spark, held)
    return out


def by_strips(pixels: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """watershed() of images of any size, by strips of rows."""
    spark, held = pixels.sparkSession, []
    deep = cut(depths(pixels.select("slide", "label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")), sizes).withColumn("depth", F.coalesce("depth", F.lit(0))), "depths", held)
    tops = markers(deep, least).withColumn("part", F.col("y") * F.lit(1 << 32) + F.col("x"))
    ground = cut(deep.join(many(tops), ["slide", "label", "y", "x"], "left").withColumn("strip", F.floor(F.col("y") / STRIP)), "ground", held)
    kinds = {f.name: f.dataType.simpleString() for f in ground.schema}

    def run(own: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        columns = ["slide", "label", "y", "x", "level", "steps", "part"]
        if own.empty:
            return pd.DataFrame(columns=columns)
        parts = []
        for label, px in own.groupby("label", sort=False):
            y, x, level = px["y"].to_numpy(), px["x"].to_numpy(), -px["depth"].to_numpy()
            first = px["part"].notna().to_numpy()
            starts = [(int(v), 0, int(p), int(a), int(b)) for v, p, a, b in zip(level[first], px["part"][first], y[first], x[first], strict=True)]
            height = {(int(a), int(b)): int(v) for a, b, v in zip(y, x, level, strict=True)}
            for o in offers[offers["label"] == label].itertuples(index=False):
                for a in (o.y - 1, o.y + 1):  # to the pixel of this strip below or above
                    if (v := height.get((a, o.x))) is not None:
                        starts.append((v, 0, o.part, a, o.x) if v > o.level else (o.level, o.steps + 1, o.part, a, o.x))
            found = flooded(y, x, level, starts)
            parts.append(pd.DataFrame([(own["slide"].iloc[0], label, a, b, *v) for (a, b), v in found.items()], columns=columns))
        return pd.concat(parts)

    schema = f"slide {kinds['slide']}, label {kinds['label']}, y long, x long, level long, steps long, part long"

    def flood(offers: DataFrame) -> DataFrame:
        # a border row is told to the strip on its other side
        told = offers.withColumn("strip", F.floor(F.col("y") / STRIP) + F.when(F.col("y") % STRIP == 0, -1).otherwise(1))
        return ground.groupBy("slide", "strip").cogroup(told.groupBy("slide", "strip")).applyInPandas(run, schema)

    border = (F.col("y") % STRIP == 0) | (F.col("y") % STRIP == STRIP - 1)
    now, past = flood(spark.createDataFrame([], schema)), []
    known: DataFrame | None = None
    while True:
        own: list[str] = []
        now = cut(now, "flood", own)
        rows = now.filter(border)
        changed = rows if known is None else rows.exceptAll(known)
        done = changed.isEmpty()
        drop(spark, past)
        if done:
            break
        known, past = cut(rows, "border", own), own
        now = flood(known)
    out = cut(now.select("slide", "label", "part", "y", "x"), "parts")
    drop(spark, own + held)
    return out
