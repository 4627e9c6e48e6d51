"""Contours, watershed, weights, augmentation, samplers and chunked rasters on small shapes."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import augment, components, contours, distance, geometry
from spanmill.sources import chunks


def frame(spark, mask, label=1):
    return spark.createDataFrame([("s", label, int(y), int(x)) for y, x in np.argwhere(mask)], "slide string, label int, y long, x long")


def test_contour_of_a_rectangle(spark):
    mask = np.zeros((12, 12), bool)
    mask[3:8, 2:10] = True
    r = contours.contours(frame(spark, mask)).withColumn("a", geometry.area(F.col("ring"))).first()
    assert r["ring"][0] == r["ring"][-1]
    xs, ys = [p["x"] for p in r["ring"]], [p["y"] for p in r["ring"]]
    assert (min(xs), max(xs), min(ys), max(ys)) == (1, 9, 2, 7) and 28 <= r["a"] <= 45


def test_rings_have_inner_ones_too():
    mask = np.ones((7, 7))
    mask[3, 3] = 0
    assert len(contours.rings(mask)) == 2 and contours.rings(np.zeros((3, 3))) == []


def test_watershed_splits_touching_discs(spark):
    yy, xx = np.mgrid[:30, :50]
    mask = ((yy - 15) ** 2 + (xx - 15) ** 2 <= 81) | ((yy - 15) ** 2 + (xx - 32) ** 2 <= 81)
    parts = contours.watershed(frame(spark, mask)).groupBy("part").count().collect()
    assert len(parts) == 2 and sum(r["count"] for r in parts) == mask.sum()


def test_ridge_and_weights(spark):
    px = spark.createDataFrame([("s", 0, x, 1 if x < 3 else 2 if x < 6 else 0) for x in range(12)] + [("s", 0, 12, 3)], "slide string, y long, x long, label int")
    got = {r["x"]: r["label"] for r in contours.ridge(px).collect()}
    assert got[2] == 0 and got[3] == 0 and got[1] == 1 and got[5] == 2 and got[12] == 3
    w = {r["x"]: r["weight"] for r in distance.distance_weights(px, 10.0, 5.0, 10.0, 0.1).collect()}
    assert w[0] == 1 and w[8] == pytest.approx(0.1 + 10 * np.exp(-((3 + 4) ** 2) / 50) + 0.9 * sum(np.exp(-d * d / 200) for d in (3, 4, 6)))


def image(spark, n=8):
    return spark.createDataFrame([(s, y, x, y * n + x + 1) for s in ("a", "b") for y in range(n) for x in range(n)], "slide string, y long, x long, v long")


def test_half_turn_is_its_own_inverse(spark):
    px = image(spark)
    field = augment.rotation(px.select("slide", "y", "x"), 180, F.lit(3.5), F.lit(3.5))
    once = augment.remap(px, field, "v")
    assert {(r["y"], r["x"]): r["v"] for r in once.filter("slide = 'a'").collect()} == {(y, x): (7 - y) * 8 + 7 - x + 1 for y in range(8) for x in range(8)}
    assert sorted(map(tuple, augment.remap(once, field, "v").collect())) == sorted(map(tuple, px.collect()))
    assert augment.wave(px.select("slide", "y", "x"), 1, 2.0, 8.0).agg(F.max(F.abs("dy"))).first()[0] <= 2.0


def test_mixing_of_items(spark):
    px = image(spark).withColumn("v", F.when(F.col("slide") == "a", 0).otherwise(10))
    pairs = augment.partners(px.select("slide"), "slide", 3)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b"), ("b", "a")}
    assert {round(r["v"], 9) for r in augment.mixup(px, pairs, "v", 0.7).filter("slide = 'a'").collect()} == {3.0}
    assert augment.cutmix(px, pairs, "v", (0, 2, 0, 3)).filter("slide = 'a' AND v = 10").count() == 6
    assert augment.cutout(px, "v", (0, 2, 0, 3)).filter("slide = 'b' AND v = 0").count() == 6


def test_light_spots(spark):
    rows = [("a", y, x, 250 if 2 <= y < 6 and 2 <= x < 6 or (y, x) == (0, 9) else 10) for y in range(10) for x in range(10)]
    px = spark.createDataFrame(rows, "slide string, y long, x long, v int")
    assert augment.light_spots(px, "v", 200, 0.5).first()["spot"] == 16
    assert augment.light_spots(px, "v", 200, 0.1).first()["spot"] is None


def test_samplers(spark):
    ring = [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    objs = spark.createDataFrame([(k, ring) for k in range(20)], "id int, ring array<struct<x:double,y:double>>")
    points = augment.point_in_polygon(objs, "id", 5).collect()
    assert len(points) == 20 and all(p["x"] >= 0 and p["y"] >= 0 and p["x"] + p["y"] <= 8 for p in points)
    slides = spark.createDataFrame([("s", 200, 200)], "slide string, h int, w int")
    objects = spark.createDataFrame([("s", x, y, x + 10, y + 10) for x in range(0, 100, 10) for y in range(0, 200, 10)], "slide string, x0 int, y0 int, x1 int, y1 int")
    p = augment.background_points(slides, objects, 40, 9).first()
    assert p["x"] >= 120 or p is not None
    images = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0)], "id string, area double")
    n = Counter(r["id"] for r in augment.proportional_draws(images, "id", "area", 2000, 1).collect())
    assert sum(n.values()) == 2000 and "b" not in n and n["c"] / 2000 == pytest.approx(0.75, abs=0.05)
    sizes = [r["count"] for r in augment.hashed_folds(spark.range(53), "id", 5, 7).groupBy("fold").count().collect()]
    assert sorted(sizes) == [10, 10, 11, 11, 11]


def test_accepted_tiles(spark):
    rows = [("s", t, 0, dy, dx, 16, int(t == 0 and dy == 8 and dx == 8)) for t in range(2) for dy in range(16) for dx in range(16)]
    px = spark.createDataFrame(rows, "slide string, ty int, tx int, dy int, dx int, size int, mask int")
    assert [r["ty"] for r in augment.accept_tiles(px, 2, 1.0, 1).collect()] == [0]
    assert augment.accept_tiles(px, 2, -1.0, 1).count() == 2


def test_outliers(spark):
    rng = random.Random(1)
    train = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(5, 2)) for _ in range(500)], "a double, b double")
    rows = spark.createDataFrame([(0.0, 5.0), (9.0, 5.0)], "a double, b double")
    near, far = (r["ood"] for r in augment.ood_scores(train, rows, ["a", "b"]).orderBy("a").collect())
    assert near < 0.1 < 30 < far


def test_chunked_raster(spark, tmp_path):
    px = image(spark, 20).withColumn("grp", F.lit("labels"))
    chunks.write_chunks(px, str(tmp_path / "c"), "v", 8)
    got = {(r["y"], r["x"]): r["v"] for r in chunks.read_window(spark, str(tmp_path / "c"), "labels", "a", 5, 6, 7, 8).collect()}
    assert got == {(y, x): y * 20 + x + 1 for y in range(5, 12) for x in range(6, 13)}


def test_raster_helpers(spark):
    px = spark.createDataFrame([("a", 9, 1, 5), ("b", 1, 2, 6)], "slide string, y long, x long, v int")
    sizes = spark.createDataFrame([("a", 5, 10), ("b", 5, 10)], "slide string, h int, w int")
    assert {r["slide"]: (r["y"], r["x"]) for r in chunks.turned(px, sizes).collect()} == {"a": (1, 9), "b": (1, 2)}
    assert chunks.stacked_bands([px, px, px]).groupBy("band").count().count() == 3
    assert chunks.checked_classes(px, "v", 7).count() == 2
    with pytest.raises(Exception, match="class 6 is unknown"):
        chunks.checked_classes(px, "v", 6).collect()
    assert px.select(chunks.tile_names(F.col("slide"), F.lit(7))).first()[0] == "a_0007.png"
    assert px.select(chunks.scaled(F.col("v"), 5)).first()[0] == 255


def test_border_distance_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.8
        out = [(y, x) for y in range(-1, mask.shape[0] + 1) for x in range(-1, mask.shape[1] + 1) if not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x])]
        want = np.zeros(mask.shape)
        for y, x in np.argwhere(mask):
            want[y, x] = min(((y - a) ** 2 + (x - b) ** 2) ** 0.5 for a, b in out)
        assert np.allclose(contours.border_distance(mask), want)


def test_least_of_part():
    rng = np.random.default_rng(5)
    for n in (1, 5, 80):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        want = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b, strict=True):
                want[i] = want[j] = min(want[i], want[j])
        assert components._least_of_part(n, a, b).tolist() == want



def test_elastic_fields_are_smooth_and_repeat(spark):
    places = spark.range(60 * 60).select(F.lit("a").alias("slide"), F.floor(F.col("id") / 60).alias("y"), (F.col("id") % 60).alias("x"), F.lit(60).alias("h"), F.lit(60).alias("w"))
    grid = {}
    for seed in (1, 1, 2):
        rows = augment.elastic(places, 15, 4.0, seed).collect()
        field = np.zeros((2, 60, 60))
        for r in rows:
            field[:, r["y"], r["x"]] = r["fy"] - r["y"], r["fx"] - r["x"]
        grid.setdefault(seed, []).append(field)
    assert (grid[1][0] == grid[1][1]).all() and np.abs(grid[1][0] - grid[2][0]).max() > 1
    assert 0.5 < grid[1][0].std() < 4 and np.abs(np.diff(grid[1][0], axis=1)).max() < 1.5
    # also across the cells of the lattice: second differences stay as small as within
    second = np.abs(np.diff(grid[1][0], n=2, axis=1)).max(axis=(0, 2))
    assert second[13:16].max() < 2 * second.max()
    plain = augment.elastic(places, 15, 0.0, 1, degrees=90.0, vertical=True).filter("y = 10 AND x = 7").first()
    assert (plain["fy"], plain["fx"]) == (pytest.approx(29.5 - (7 - 29.5)), pytest.approx(29.5 - (10 - 29.5)))
