"""Contours, watershed and other per-component kernels. Each task holds one component at a time."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.operators.groups import dealt, whole_groups
from spanmill.plans.session import many

#: Which sides of a 2 x 2 cell a contour joins, by the corners set (top left 8, top right 4, bottom right 2, bottom left 1).
SIDES = {1: "lb", 2: "br", 3: "lr", 4: "rt", 5: "rt lb", 6: "bt", 7: "lt", 8: "tl", 9: "tb", 10: "tl br", 11: "tr", 12: "rl", 13: "rb", 14: "bl"}

#: Figures whose contours a task keeps, and pixels of the boxes of those kept.
KNOWN, SMALL = 20_000, 1024


def rings(mask: np.ndarray, level: float = 0.8) -> list[np.ndarray]:
    """Closed contours (y, x) of a 0/1 array at a level, by marching squares with linear interpolation."""
    m = np.pad(mask.astype(float), 1)
    cases = (m[:-1, :-1] > level) * 8 + (m[:-1, 1:] > level) * 4 + (m[1:, 1:] > level) * 2 + (m[1:, :-1] > level) * 1
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}

    def crossing(y: int, x: int, side: str) -> tuple[float, float]:
        (ay, ax), (by, bx) = {"t": ((y, x), (y, x + 1)), "b": ((y + 1, x), (y + 1, x + 1)), "l": ((y, x), (y + 1, x)), "r": ((y, x + 1), (y + 1, x + 1))}[side]
        f = (level - m[ay, ax]) / (m[by, bx] - m[ay, ax])
        return (ay + f * (by - ay) - 1, ax + f * (bx - ax) - 1)

    for y, x in np.argwhere((cases > 0) & (cases < 15)):
        for pair in SIDES[int(cases[y, x])].split():
            after.setdefault(crossing(y, x, pair[0]), []).append(crossing(y, x, pair[1]))
    out = []
    while after:
        start = at = next(iter(after))
        ring = [start]
        while at in after:
            nxt = after[at].pop()
            if not after[at]:
                del after[at]
            ring.append(nxt)
            at = nxt
            if at == start:
                break
        out.append(np.array(ring))
    return out


def _by_component(pixels: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel's rows for the pixels (slide, label, y, x) of each component. Components are many and small, so a task
    streams through its own, one after another, instead of a group each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, at = [], None
        for pdf in batches:
            out = []
            for key, part in pdf.groupby("__key", sort=False):
                if at not in (None, key):
                    out.append(kernel(pd.concat(parts) if len(parts) > 1 else parts[0]))
                    parts = []
                parts.append(part)
                at = key
            if out:
                yield pd.concat(out)
        if parts:
            yield kernel(pd.concat(parts))

    keyed = pixels.select("slide", "label", "y", "x", F.to_json(F.struct("slide", "label")).alias("__key"))
    # small rows, much work: a number of partitions that isn't coalesced
    return keyed.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key").sortWithinPartitions("__key").mapInPandas(run, schema)


def contours(pixels: DataFrame, level: float = 0.8, xy: bool = True) -> DataFrame:
    """slide, label, ring of the outer contour of each component (slide, label, y, x), coordinates truncated.

    xy: points as <x, y>; else the reference's other order, rows first.
    """

    def outer(mask: np.ndarray) -> np.ndarray:
        return max(rings(mask, level), key=lambda r: (np.ptp(r[:, 0]) * np.ptp(r[:, 1]), len(r)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, np.ndarray] = {}  # equal figures are followed once, wherever they lie
        for pdf, group in whole_groups(batches, ["__key"]):
            ys, xs = (pdf[c].to_numpy(dtype=np.int64) for c in "yx")
            first = np.flatnonzero(np.diff(group, prepend=-1))
            low = [np.minimum.reduceat(v, first) for v in (ys, xs)]
            sides = [np.maximum.reduceat(v, first) - v0 + 1 for v, v0 in zip((ys, xs), low, strict=True)]
            out = []
            for a, b, y0, x0, h, w in zip(first, [*first[1:], len(pdf)], *low, *sides, strict=True):
                mask = np.zeros((h, w), dtype=np.uint8)
                mask[ys[a:b] - y0, xs[a:b] - x0] = 1
                if (ring := known.get(key := (h, w, mask.tobytes()))) is None:
                    ring = outer(mask)
                    if h * w <= SMALL and len(known) < KNOWN:
                        known[key] = ring
                place = np.trunc(ring + (y0, x0)) + 0.0
                out.append([{"x": p, "y": q} for p, q in (place[:, ::-1] if xy else place).tolist()])
            yield pdf.iloc[first][["slide", "label"]].assign(ring=out)

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    keyed = dealt(pixels.select("slide", "label", "y", "x", F.to_json(F.struct("slide", "label")).alias("__key")), ["__key"])
    return keyed.mapInPandas(run, f"slide {kinds['slide']}, label {kinds['label']}, ring array<struct<x:double,y:double>>")


def border_distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set pixel from the nearest unset one: along columns by two sweeps, then across them."""
    d = np.where(np.pad(mask, 1), 1 << 20, 0).astype(np.int64)
    for y in range(1, d.shape[0] - 1):
        d[y] = np.minimum(d[y], d[y - 1] + 1)
    for y in range(d.shape[0] - 2, 0, -1):
        d[y] = np.minimum(d[y], d[y + 1] + 1)
    square = d * d
    out = square.copy()
    for k in range(1, d.shape[1]):
        if k * k >= out.max():  # no column so far off is nearer
            break
        out[:, k:] = np.minimum(out[:, k:], square[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], square[:, k:] + k * k)
    return np.sqrt(out[1:-1, 1:-1])


def split(mask: np.ndarray, least: int) -> np.ndarray:
    """Labels from 1 of the basins around the maxima of the border distance that are `least` apart, in steps.

    A pixel is compared with the maxima of the cells around it only; a cell of side `least` holds few.
    """
    d = border_distance(mask)
    peaks: list[tuple[int, int]] = []
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    side = max(least, 1)
    for y, x in sorted(map(tuple, np.argwhere(mask)), key=lambda p: (-d[p], p)):
        near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((y // side + a, x // side + b), ()))
        if all(abs(y - a) + abs(x - b) >= least for a, b in near):
            peaks.append((y, x))
            cells.setdefault((y // side, x // side), []).append((y, x))
    out = np.zeros(mask.shape, dtype=np.int64)
    heap = [(-d[p], k, *p) for k, p in enumerate(peaks, 1)]
    heapq.heapify(heap)
    while heap:
        _, k, y, x = heapq.heappop(heap)
        if out[y, x]:
            continue
        out[y, x] = k
        for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                heapq.heappush(heap, (-d[a, b], k, a, b))
    return out


def watershed(pixels: DataFrame, least: int = 10) -> DataFrame:
    """slide, label, part, y, x: components (slide, label, y, x) split at their waists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        mask = np.zeros((pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1), dtype=bool)
        mask[pdf["y"] - y0, pdf["x"] - x0] = True
        return pdf.assign(part=split(mask, least)[pdf["y"] - y0, pdf["x"] - x0])[["slide", "label", "part", "y", "x"]]

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    return _by_component(pixels, run, f"slide {kinds['slide']}, label {kinds['label']}, part long, y {kinds['y']}, x {kinds['x']}")


def ridge(labels: DataFrame) -> DataFrame:
    """slide, y, x, label (0: background) with the pixels between touching instances made background."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    near = labels.filter("label > 0").select("slide", "y", "x", F.col("label").alias("other"), steps)
    near = near.select("slide", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "other").groupBy("slide", "y", "x").agg(F.max("other").alias("hi"), F.min("other").alias("lo"))
    touching = (F.col("label") > 0) & ((F.col("hi") > F.col("label")) | (F.col("lo") < F.col("label")))
    return labels.join(many(near), ["slide", "y", "x"], "left").select("slide", "y", "x", F.when(touching, F.lit(0)).otherwise(F.col("label")).alias("label"))
