"""Overlaps, unions and buffers of rings against areas counted point by point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import regions


def even_odd(points, ring):
    a, b = ring[:-1], ring[1:]
    x, y = points[:, 0, None], points[:, 1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum(axis=1) % 2 == 1


def star(rng, n, centre, size):
    """A concave ring: a point at a random distance in each of n directions."""
    t = np.sort(rng.random(n)) * 2 * np.pi
    r = size * (0.3 + 0.7 * rng.random(n))
    p = np.stack([np.cos(t) * r, np.sin(t) * r], axis=1) + centre
    return np.concatenate([p, p[:1]])


def area(rings):
    return sum(regions.signed_area(r) for r in rings)


GRID = np.stack(np.meshgrid(np.arange(-20, 120, 0.5) + 0.21, np.arange(-20, 120, 0.5) + 0.13), axis=-1).reshape(-1, 2)


@pytest.mark.parametrize("seed", range(12))
def test_clips_by_counting(seed):
    rng = np.random.default_rng(seed)
    p, q = star(rng, rng.integers(3, 25), (50, 50), 45), star(rng, rng.integers(3, 25), rng.uniform(30, 70, 2), 40)
    if seed % 4 == 0:  # shared edges and corners
        p, q = np.round(p / 20) * 20, np.round(q / 20) * 20
    if seed % 4 == 1:  # one that crosses itself
        p = p[[*rng.permutation(len(p) - 1), 0]]
        p[-1] = p[0]
    m, n = even_odd(GRID, p), even_odd(GRID, q)
    for how, inside in (("overlap", m & n), ("union", m | n), ("difference", m & ~n)):
        got = regions.combined([[p], [q]], regions.RULES[how])
        assert area(got) == pytest.approx(inside.sum() / 4, abs=12 + 0.01 * inside.sum() / 4)
        hit = np.zeros(len(GRID), dtype=int)
        for r in got:
            assert (r[0] == r[-1]).all()
            hit += even_odd(GRID, r)
        assert (hit % 2 == inside).mean() > 0.999
    # what is in either is what is in one, in the other, less what is in both
    whole = {h: area(regions.combined([[p], [q]], r)) for h, r in regions.RULES.items()}
    assert whole["difference"] + whole["overlap"] == pytest.approx(area(regions.combined([[p]], lambda k: k % 2 != 0)))
    assert whole["union"] == pytest.approx(whole["difference"] + area(regions.combined([[q]], lambda k: k % 2 != 0)))


def edge_distances(points, ring):
    a, d = ring[:-1], ring[1:] - ring[:-1]
    t = np.clip(((points[:, None] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-12), 0, 1)
    return np.sqrt(((points[:, None] - a - t[..., None] * d) ** 2).sum(-1)).min(axis=1)


@pytest.mark.parametrize("seed", range(8))
def test_buffers_by_counting(seed):
    rng = np.random.default_rng(seed)
    p = star(rng, rng.integers(3, 20), (50, 50), 40)
    if seed % 2:
        p = p[::-1]
    got = regions.widened(p, 7.0)
    inside = even_odd(GRID, p) | (edge_distances(GRID, p) <= 7.0)
    hit = sum(even_odd(GRID, r).astype(int) for r in got) % 2 == 1
    assert (hit == inside).mean() > 0.997
    assert area(got) == pytest.approx(inside.sum() / 4, rel=0.01)


def test_buffer_of_a_ring_with_a_gap():
    """A ring that nearly closes: widened, it has a hole; wide enough, it has none."""
    p = np.array([(0, 0), (60, 0), (60, 40), (32, 40), (32, 30), (50, 30), (50, 10), (10, 10), (10, 30), (28, 30), (28, 40), (0, 40), (0, 0)], dtype=float)
    assert sorted(regions.signed_area(r) > 0 for r in regions.widened(p, 3.0)) == [False, True]
    assert [regions.signed_area(r) > 0 for r in regions.widened(p, 11.0)] == [True]


def test_columns(spark):
    square = lambda x, y, s: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    rows = [(1, square(0, 0, 10), square(5, 5, 10)), (2, square(0, 0, 10), square(20, 0, 5)), (3, square(0, 0, 10), None), (4, square(0, 0, 10), square(2, 2, 3)), (5, [], square(0, 0, 1)), (6, square(0, 0, 4), square(4, 0, 4))]
    df = spark.createDataFrame(rows, "id int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    made = {how: {r.id: (r.n, r.area) for r in df.select("id", regions.clip(F.col("a"), F.col("b"), how).alias("r")).select("id", F.size("r").alias("n"), regions.rings_area(F.col("r")).alias("area")).collect()} for how in regions.RULES}
    assert made["overlap"] == {1: (1, pytest.approx(25)), 2: (0, 0), 3: (None, None), 4: (1, pytest.approx(9)), 5: (0, 0), 6: (0, 0)}
    assert made["union"] == {1: (1, pytest.approx(175)), 2: (2, pytest.approx(125)), 3: (None, None), 4: (1, pytest.approx(100)), 5: (1, pytest.approx(1)), 6: (1, pytest.approx(32))}
    assert made["difference"][4] == (2, pytest.approx(91)) and made["difference"][6] == (1, pytest.approx(16))
    wide = df.filter("id = 1").select(regions.rings_area(regions.buffer(F.col("a"), 2.0)).alias("w"), regions.rings_area(regions.buffer(F.col("a"), 0.0)).alias("same")).first()
    assert wide.w == pytest.approx(100 + 80 + 64 / 2 * 4 * np.sin(2 * np.pi / 64)) and wide.same == pytest.approx(100)
