"""Exact distances against all pairs, and measures built on them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import distance


@pytest.mark.parametrize("seed", range(8))
def test_least_parabolas(seed, monkeypatch):
    monkeypatch.setattr(distance, "PLACES", 50)
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 400, (5, [1, 2, 3, 17, 64, 65, 100, 31][seed])).astype(float)
    f[rng.random(f.shape) < 0.6] = distance.FAR
    x = np.arange(f.shape[1])
    every = f[:, None, :] + (x[:, None] - x[None, :]) ** 2
    value, where = distance.least_parabolas(f)
    assert (value == every.min(axis=2)).all()
    assert (np.take_along_axis(every, where[:, :, None], axis=2)[:, :, 0] == value).all()


def image(seed, h, w, n):
    rng = np.random.default_rng(seed)
    out = np.zeros((h, w), dtype=int)
    for k in range(1, n + 1):
        y, x = rng.integers(0, h), rng.integers(0, w)
        out[y : y + rng.integers(1, 6), x : x + rng.integers(1, 6)] = k
    return out


def by_definition(img):
    """[label] -> distances of all pixels."""
    at = np.stack(np.mgrid[: img.shape[0], : img.shape[1]], axis=-1)
    return {k: np.sqrt(((at[:, :, None] - np.argwhere(img == k)[None, None]) ** 2).sum(axis=-1).min(axis=-1)) for k in np.unique(img) if k}


@pytest.mark.parametrize("h,w,n", [(97, 40, 9), (70, 33, 1), (40, 20, 0), (33, 64, 30)])
def test_distances_over_strips(spark, h, w, n):
    """Objects far beyond a pixel's strip are its nearest: no radius."""
    img = image(n, h, w, n)
    df = spark.createDataFrame([("s", y, x, int(v) if v else None) for (y, x), v in np.ndenumerate(img)], "slide string, y int, x int, label int")
    got = {(r.y, r.x): (r.d1, r.d2, r.near) for r in distance.distances(df, ["slide"], 4.0).collect()}
    every = by_definition(img)
    assert len(got) == h * w
    for (y, x), (d1, d2, near) in got.items():
        own = sorted(d[y, x] for d in every.values())
        assert d1 == (pytest.approx(own[0]) if own else None) and d2 == (pytest.approx(own[1]) if len(own) > 1 else None)
        assert near == pytest.approx(sum(np.exp(-d * d / 32) for d in own), abs=1e-9)


def test_weights_by_definition(spark):
    """Two classes, ridges, ignored pixels, a slide without objects."""
    img = image(3, 50, 30, 8)
    cls = np.where(img % 2 == 1, "odd", "even")
    rows = [(s, y, x, int(v) if s == "a" else 0, str(cls[y, x]), bool(v) and (y + x) % 7 > 0, (y * x) % 11 == 10) for s in "ab" for (y, x), v in np.ndenumerate(img)]
    df = spark.createDataFrame(rows, "slide string, y int, x int, label int, cls string, ground boolean, ignored boolean")
    got = {(r.slide, r.y, r.x): (r.weight, r.chance) for r in distance.distance_weights(df, 10.0, 5.0, 3.0, 0.2, "cls", "ground", "ignored").collect()}
    every = by_definition(img)
    assert len(got) == len(rows)
    for s, y, x, _, _, ground, ignored in rows:
        want, near = 0.2, 0.0
        if s == "a":
            for odd in (0, 1):
                own = sorted(d[y, x] for k, d in every.items() if k % 2 == odd)
                want += 10 * np.exp(-((own[0] + own[1]) ** 2) / 50)
                near += sum(np.exp(-d * d / 18) for d in own)
        want = 0 if ignored else 1 if ground and s == "a" else want + 0.8 * near
        if s == "b" and ground and not ignored:
            want = 1
        assert got[s, y, x] == (pytest.approx(want), 0 if ignored else 1 if ground else 0.2)


def test_hausdorff_by_all_pairs(spark):
    rng = np.random.default_rng(5)
    points = {s: [sorted({tuple(p) for p in rng.integers(0, size, (n, 2)).tolist()}) for n in (40, 60)] for s, size in (("a", 80), ("b", 500))}
    make = lambda k: spark.createDataFrame([(s, *p) for s, two in points.items() for p in two[k]], "slide string, y long, x long")
    a, b = make(0), make(1)
    got = {r.slide: r.distance for r in distance.directed_hausdorff(a, b, ["slide"]).collect()}
    for s, (p, q) in points.items():
        assert got[s] == pytest.approx(np.sqrt(((np.array(p)[:, None] - np.array(q)[None]) ** 2).sum(-1)).min(axis=1).max())
    alone = distance.directed_hausdorff(a, b.filter("slide = 'a'"), ["slide"]).collect()
    assert {r.slide: r.distance is None for r in alone} == {"a": False, "b": True}


def test_hausdorff_of_many_points(spark):
    """10^5 points a side: all pairs would be 10^10."""
    began = time.time()
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("slide"), (F.col("id") * 7919 % 1000).alias("y"), (F.floor(F.col("id") / 100)).alias("x"))
    b = a.select("slide", F.when(F.col("x") < 990, F.col("y")).otherwise(0).alias("y"), "x")
    plan = distance.directed_hausdorff(a, b, ["slide"])
    got = plan.first().distance
    assert time.time() - began < 120
    at, goal = (np.array([tuple(r) for r in df.select("y", "x").collect()]) for df in (a, b))
    moved = at[at[:, 1] >= 990]  # the others are b's points too
    assert got == pytest.approx(np.sqrt(max(((goal - p) ** 2).sum(axis=1).min() for p in moved)))
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def row_runs(spark, masks):
    out = []
    for s, mask in masks.items():
        for y, row in enumerate(mask):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], row, [0]))))
            out += [(s, y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return spark.createDataFrame(out, "slide string, y long, lo long, hi long")


def test_row_hausdorff_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(distance, "TRIED", 2)
    rng = np.random.default_rng(4)
    a = {s: (rng.random((n, 30)) < p).astype(int) for s, n, p in (("a", 60, 0.3), ("b", 7, 0.9), ("c", 20, 0.0), ("same", 9, 0.5))}
    b = {s: (rng.random(m.shape) < 0.4).astype(int) for s, m in a.items()}
    b["same"] = a["same"][::-1]
    heights = spark.createDataFrame([(s, len(m)) for s, m in a.items()], "slide string, h int")
    got = {r.slide: r.distance for r in distance.row_hausdorff(row_runs(spark, a), row_runs(spark, b), heights, ["slide"]).collect()}
    for s in a:
        assert got[s] == pytest.approx(np.sqrt(np.abs(a[s][:, None] - b[s][None]).sum(-1).min(axis=1).max()))
    assert got["same"] == 0


def test_row_hausdorff_of_many_rows(spark):
    """10^5 rows a side: all but a few are settled by their neighbours, and no round compares all pairs."""
    n = 100_000
    rows = spark.range(n).select(F.lit("s").alias("slide"), F.col("id").alias("y"), (F.col("id") % 5000).alias("lo"), (F.col("id") % 5000 + 1 + F.floor(F.col("id") / 5000)).alias("hi"))
    moved = rows.withColumn("hi", F.when(F.col("y") == 77_777, F.col("hi") + 400).otherwise(F.col("hi")))
    heights = spark.createDataFrame([("s", n)], "slide string, h int")
    began = time.time()
    assert distance.row_hausdorff(moved, rows, heights, ["slide"]).first().distance == pytest.approx(np.sqrt(396))
    assert distance.row_hausdorff(rows, moved, heights, ["slide"]).first().distance == pytest.approx(1)
    assert time.time() - began < 240


def test_strips_of_many_images_are_taken_together(spark):
    """Small images share a batch, each with its own objects, sizes and number of strips; one call each made tens of ms a strip."""
    images = {s: image(s, 20 + s * 5 % 41, 15 + s * 7 % 30, s % 5) for s in range(12)}
    rows = [(s, y, x, int(v)) for s, img in images.items() for (y, x), v in np.ndenumerate(img)]
    made = distance.distances(spark.createDataFrame(rows, "slide long, y int, x int, label int"), ["slide"], 2.0)
    assert "CoGroup" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert len(got) == len(rows)
    every = {s: by_definition(img) for s, img in images.items()}
    for r in got:
        own = sorted(d[r.y, r.x] for d in every[r.slide].values())
        assert r.d1 == (pytest.approx(own[0]) if own else None) and r.d2 == (pytest.approx(own[1]) if len(own) > 1 else None)
        assert r.near == pytest.approx(sum(np.exp(-d * d / 8) for d in own), abs=1e-9)


def test_row_hausdorff_broadcasts_no_rows(spark, monkeypatch):
    """What rounds write is few bytes, so that joins would send it to the driver and every executor."""
    plans, cut = [], distance.cut

    def watched(df, name="cut", held=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, held)

    monkeypatch.setattr(distance, "cut", watched)
    rng = np.random.default_rng(9)
    a = {f"s{k}": (rng.random((20, 15)) < 0.4).astype(int) for k in range(6)}
    b = {s: (rng.random(m.shape) < 0.5).astype(int) for s, m in a.items()}
    heights = spark.createDataFrame([(s, len(m)) for s, m in a.items()], "slide string, h int")
    got = {r.slide: r.distance for r in distance.row_hausdorff(row_runs(spark, a), row_runs(spark, b), heights, ["slide"]).collect()}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    for s in a:
        assert got[s] == pytest.approx(np.sqrt(np.abs(a[s][:, None] - b[s][None]).sum(-1).min(axis=1).max()))
