"""Polygons as arrays of <x, y>, and rectangles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def area(ring: Column) -> Column:
    """Area of a closed ring by the shoelace rule."""
    crosses = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)) / 2


def centre(ring: Column) -> Column:
    """<x, y>: mean of the vertices, the closing one left out."""
    open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda k: F.aggregate(open_ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(open_ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a rectangle."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, by counting crossings."""
    crosses = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < F.coalesce(F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]), F.lit(0.0)) + a["x"]),
    )
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def fill(objects: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, y, lo, hi: for each pixel row the spans whose centres are inside the ring (even-odd), ends excluded.

    Crossings per row come from the edges; pairs of them, in order, are spans. No pixels are made.
    """
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = objects.select(*keys, F.explode(edges).alias("e")).select(*keys, *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]).filter("ay <> by")
    first, last = F.ceil(F.least("ay", "by") - 0.5).cast("long"), F.ceil(F.greatest("ay", "by") - 0.5).cast("long") - 1
    rows = e.withColumn("__f", first).withColumn("__l", last).filter("__f <= __l").withColumn("y", F.explode(F.sequence("__f", "__l")))
    x = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    crossings = rows.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(x)).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("c", 2 * i) - 0.5).cast("long").alias("lo"), F.ceil(F.get("c", 2 * i + 1) - 0.5).cast("long").alias("hi")))
    spans = crossings.filter(F.size("c") >= 2).select(*keys, "y", F.explode(pairs).alias("s"))
    return spans.select(*keys, "y", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")).filter("hi > lo")


def edge_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from the nearest edge of a closed ring."""

    def to(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.least(F.greatest(F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - a["x"] - t * dx, F.lit(2)) + F.pow(y - a["y"] - t * dy, F.lit(2)))

    return F.array_min(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), to))


def in_buffer(x: Column, y: Column, ring: Column, distance: float) -> Column:
    """Whether a point is in a ring widened by a distance (round corners): inside it, or as near to an edge."""
    return inside(x, y, ring) | (edge_distance(x, y, ring) <= distance)


def _crossings(p: np.ndarray, y: float) -> np.ndarray:
    """Where the edges of a closed ring cross a level, ascending."""
    a, b = p[:-1], p[1:]
    met = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[met], b[met]
    return np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))


def _overlap(p: np.ndarray, q: np.ndarray) -> float:
    """Area inside both rings (even-odd): between levels where vertices lie or edges meet, widths are linear in y."""
    p, q = (p, q) if len(p) > 3 and len(q) > 3 else (np.zeros((0, 2)), np.zeros((0, 2)))
    if not len(p):
        return 0.0
    a, b, c, d = p[:-1, None], p[1:, None], q[None, :-1], q[None, 1:]
    r, s = b - a, d - c
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((c - a)[..., 0] * s[..., 1] - (c - a)[..., 1] * s[..., 0]) / cross
        u = ((c - a)[..., 0] * r[..., 1] - (c - a)[..., 1] * r[..., 0]) / cross
        met = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        at = (a[..., 1] + t * r[..., 1])[met]
    levels = np.unique(np.concatenate([p[:, 1], q[:, 1], at]))
    levels = levels[(levels >= max(p[:, 1].min(), q[:, 1].min())) & (levels <= min(p[:, 1].max(), q[:, 1].max()))]
    total = 0.0
    for low, high in pairwise(levels):
        x, z = _crossings(p, (low + high) / 2).reshape(-1, 2), _crossings(q, (low + high) / 2).reshape(-1, 2)
        wide = np.minimum(x[:, None, 1], z[None, :, 1]) - np.maximum(x[:, None, 0], z[None, :, 0])
        total += (high - low) * np.maximum(wide, 0).sum()
    return float(total)


def overlaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """_overlap() of many pairs of closed rings [pair, vertex, 2], each side with as many vertices: level by level, all pairs at once."""
    a, b, c, d = p[:, :-1, None], p[:, 1:, None], q[:, None, :-1], q[:, None, 1:]
    r, s = b - a, d - c
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((c - a)[..., 0] * s[..., 1] - (c - a)[..., 1] * s[..., 0]) / cross
        u = ((c - a)[..., 0] * r[..., 1] - (c - a)[..., 1] * r[..., 0]) / cross
        met = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        at = np.where(met, a[..., 1] + t * r[..., 1], p[:, :1, None, 1])
    low, high = np.maximum(p[..., 1].min(axis=1), q[..., 1].min(axis=1)), np.minimum(p[..., 1].max(axis=1), q[..., 1].max(axis=1))
    levels = np.concatenate([p[..., 1], q[..., 1], at.reshape(len(p), -1)], axis=1)
    # levels beyond both rings' range have no height
    levels = np.sort(np.clip(levels, low[:, None], np.maximum(low, high)[:, None]), axis=1)
    total = np.zeros(len(p))
    for k in range(levels.shape[1] - 1):
        tall = levels[:, k + 1] - levels[:, k]
        own = np.flatnonzero(tall > 0)
        if len(own):
            y = (levels[own, k] + levels[own, k + 1]) / 2
            x, z = _crossed(p[own], y), _crossed(q[own], y)
            with np.errstate(invalid="ignore"):
                wide = np.minimum(x[:, 1::2, None], z[:, None, 1::2]) - np.maximum(x[:, 0::2, None], z[:, None, 0::2])
            total[own] += tall[own] * np.where(wide > 0, wide, 0).sum(axis=(1, 2))
    return total


def _crossed(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_crossings() of many rings, each at its own level; places that aren't used are infinite."""
    a, b = p[:, :-1], p[:, 1:]
    met = (a[..., 1] > y[:, None]) != (b[..., 1] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(met, a[..., 0] + (y[:, None] - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1]), np.inf)
    x = np.sort(x, axis=1)
    return x if x.shape[1] % 2 == 0 else np.concatenate([x, np.full((len(x), 1), np.inf)], axis=1)


#: Numbers of the tables that overlaps of some pairs are reckoned with.
PLACES = 1 << 20


def flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points [n, 2], first point of each ring, number of its points) of an Arrow array of rings; a null has none."""
    n = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    own = rings.flatten()
    points = np.stack([own.field("x").to_numpy(zero_copy_only=False), own.field("y").to_numpy(zero_copy_only=False)], axis=1).astype(float) if len(own) else np.zeros((0, 2))
    return points, np.cumsum(n) - n, n


def _alike(a: pa.Array, b: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, rings of a, rings of b) of pairs with as many vertices, more than `least`; some pairs at once."""
    (p, first, n), (q, begin, m) = flat(a), flat(b)
    for size in np.unique(np.stack([n, m], axis=1), axis=0) if len(a) else []:
        if size.min() > least:
            own = np.flatnonzero((n == size[0]) & (m == size[1]))
            some = max(PLACES // int(size[0] * size[1] * 4), 1)
            for k in range(0, len(own), some):
                at = own[k : k + some]
                yield at, p[first[at, None] + np.arange(size[0])], q[begin[at, None] + np.arange(size[1])]


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact area inside both of two closed rings, whatever their form (inside is even-odd); null where either is null."""
    out = np.zeros(len(a))
    for own, p, q in _alike(a, b, 3):
        out[own] = overlaps(p, q)
    missing = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return pa.array(out, mask=missing)


def shared_pixels(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pixels inside both rings of many pairs of closed rings [pair, vertex, 2], each side with as many vertices: the rows of all pairs, some at once.

    A row's spans are those of fill(); edges with a coordinate that isn't a number are left out.
    """
    low, high = (lambda r, f=f: np.nan_to_num(np.ceil(f.reduce(r[..., 1], axis=1) - 0.5)) for f in (np.fmin, np.fmax))
    first = np.maximum(low(p), low(q))
    rows = np.maximum(np.minimum(high(p), high(q)) - first, 0).astype(np.int64)
    ends = np.cumsum(rows)
    some = max(PLACES // (p.shape[1] * q.shape[1]), 1)
    total = np.zeros(len(p), np.int64)
    for k in range(0, int(ends[-1]) if len(ends) else 0, some):
        row = np.arange(k, min(k + some, ends[-1]))
        own = np.searchsorted(ends, row, side="right")
        y = first[own] + (row - ends[own] + rows[own]) + 0.5
        (alo, ahi), (blo, bhi) = _spans(p[own], y), _spans(q[own], y)
        with np.errstate(invalid="ignore"):
            wide = np.minimum(ahi[:, :, None], bhi[:, None]) - np.maximum(alo[:, :, None], blo[:, None])
        total += np.bincount(own, np.where(wide > 0, wide, 0).sum(axis=(1, 2)), len(p)).astype(np.int64)
    return total


def _spans(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pixels and ends of the spans of many rings, each at its own level; those that aren't there begin at infinity."""
    x = np.ceil(_crossed(p, y) - 0.5)
    lo, hi = x[:, 0::2], x[:, 1::2]
    return np.where(np.isinf(hi), np.inf, lo), hi


@F.arrow_udf(T.LongType())
def overlap_pixels(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pixels whose centres are inside both of two closed rings (even-odd), exact on integer rectangles; 0 where either is null."""
    out = np.zeros(len(a), np.int64)
    for own, p, q in _alike(a, b, 1):
        out[own] = shared_pixels(p, q)
    return pa.array(out)
