"""Watersheds over strips against one flood of the whole image."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import components, flood


def pixels_of(spark, mask, label=None):
    rows = [("s", int(label[y, x]) if label is not None else 1, int(y), int(x)) for y, x in np.argwhere(mask)]
    return spark.createDataFrame(rows, "slide string, label long, y long, x long")


def sizes_of(spark, mask):
    return spark.createDataFrame([("s", *mask.shape)], "slide string, h int, w int")


def whole(mask, least):
    """{(y, x): marker} by the definition, without strips; one component."""
    free = np.argwhere(~mask)
    at = np.argwhere(mask)
    depth = {tuple(p): int(((free - p) ** 2).sum(axis=1).min()) for p in at.tolist()}
    tops = [p for p, d in depth.items() if (d, -p[0], -p[1]) == max((depth[q], -q[0], -q[1]) for q in ((p[0] + a, p[1] + b) for a in range(-least, least + 1) for b in range(-least, least + 1)) if q in depth)]
    heap = [(-depth[p], 0, p[0] * 2**32 + p[1], *p) for p in tops]
    heapq.heapify(heap)
    out = {}
    while heap:
        cost, steps, marker, a, b = heapq.heappop(heap)
        if (a, b) not in out:
            out[a, b] = marker
            for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if p in depth and p not in out:
                    heapq.heappush(heap, (-depth[p], 0, marker, *p) if -depth[p] > cost else (cost, steps + 1, marker, *p))
    return out


def discs(h, w, *at):
    yy, xx = np.mgrid[:h, :w]
    return np.any([(yy - y) ** 2 + (xx - x) ** 2 <= r * r for y, x, r in at], axis=0)


@pytest.mark.parametrize("strip", [5, 16, 256])
def test_strips_find_what_one_flood_does(spark, monkeypatch, strip):
    monkeypatch.setattr(flood, "STRIP", strip)
    mask = discs(60, 40, (14, 14, 9), (27, 18, 8), (44, 20, 10), (31, 31, 5))
    mask[20:24, 14:17] = False  # a hole
    got = {(r.y, r.x): r.part for r in flood.watershed(pixels_of(spark, mask), sizes_of(spark, mask), 3).collect()}
    assert got == whole(mask, 3) and len(set(got.values())) > 2


def test_two_discs_are_two_labels(spark, monkeypatch):
    """A component of several strips."""
    monkeypatch.setattr(flood, "STRIP", 8)
    mask = discs(64, 40, (16, 20, 11), (36, 20, 12))
    px = pixels_of(spark, mask).drop("label")
    one = components.label_mask(px, sizes_of(spark, mask), 15)
    assert {r.label for r in one.collect()} == {1}
    two = components.label_mask(px, sizes_of(spark, mask), 150, do_watershed=True)
    area = {r.label: r.n for r in two.groupBy("label").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert set(area) == {1, 2} and sum(area.values()) == mask.sum() and all(n > 300 for n in area.values())


def test_components_apart_and_images_wholly_set(spark):
    mask = np.zeros((12, 30), dtype=bool)
    mask[2:9, 2:8] = mask[2:9, 9:15] = True
    label = np.where(np.arange(30) < 8, 1, 2) * mask
    got = flood.watershed(pixels_of(spark, mask, label), sizes_of(spark, mask), 4)
    assert got.select("label", "part").distinct().count() == 2 and got.count() == mask.sum()
    full = np.ones((6, 7), dtype=bool)
    assert flood.watershed(pixels_of(spark, full), sizes_of(spark, full), 10).select("part").distinct().count() == 1
    assert flood.watershed(pixels_of(spark, np.zeros((3, 3), dtype=bool)), sizes_of(spark, full), 2).count() == 0


def test_small_images_are_flooded_together(spark, monkeypatch):
    """Images of many sizes, in batches cut anywhere, against one flood of each and against strips; no group of pixels for each image."""
    rng = np.random.default_rng(11)
    masks = {s: rng.random(rng.integers(3, 40, 2)) < rng.choice([0.6, 0.85, 0.95]) for s in range(25)}
    for m in masks.values():
        m[0, 0] = False
    rows = [(s, 7, int(y), int(x)) for s, m in masks.items() for y, x in np.argwhere(m)]
    px = spark.createDataFrame(rows + rows[:9], "slide long, label long, y long, x long")
    sizes = spark.createDataFrame([(s, *m.shape) for s, m in masks.items()], "slide long, h int, w int")
    want = {(s, *p, part) for s, m in masks.items() for p, part in whole(m, 2).items()}
    found = lambda rows: [(r.slide, r.y, r.x, r.part) for r in rows.collect()]
    by_strips = found(flood.by_strips(px, sizes, 2))
    assert set(by_strips) == want and len(by_strips) == len(want)
    monkeypatch.setattr(flood, "by_strips", None)  # small images don't go there
    for at_once in (flood.AT_ONCE, 3000):
        monkeypatch.setattr(flood, "AT_ONCE", at_once)
        got = found(flood.watershed(px, sizes, 2))
        assert set(got) == want and len(got) == len(want)


def test_small_and_large_images_and_components_on_each_other(spark, monkeypatch):
    """An image over SMALL, one without a size, and two components that share pixels."""
    monkeypatch.setattr(flood, "SMALL", 600)
    mask = discs(20, 28, (9, 8, 6), (10, 18, 7))
    large = discs(40, 40, (14, 14, 9), (27, 24, 9))
    two = [("two", k, int(y), int(x)) for k in (1, 2) for y, x in np.argwhere(mask) if (x < 16) == (k == 1) or 12 < x < 20]
    rows = [(s, 1, int(y), int(x)) for s, m in (("small", mask), ("large", large), ("unsized", mask)) for y, x in np.argwhere(m)] + two
    px = spark.createDataFrame(rows, "slide string, label long, y long, x long")
    sizes = spark.createDataFrame([("small", 20, 28), ("large", 40, 40), ("two", 20, 28)], "slide string, h int, w int")
    same = lambda rows: sorted(tuple(r) for r in rows.collect())
    got = same(flood.watershed(px, sizes, 3))
    assert got == same(flood.by_strips(px, sizes, 3)) and len(got) == len(rows)
    assert {r[0] for r in got} == {"small", "large", "unsized", "two"} and len({r[2] for r in got if r[0] == "large"}) == 2
