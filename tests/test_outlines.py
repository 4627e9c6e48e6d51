"""All contours against contours followed pixel by pixel."""

import numpy as np
import pytest

from spanmill.operators import contours, outlines


def runs_of(spark, masks):
    rows = []
    for s, m in masks.items():
        for x in range(m.shape[1]):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], m[:, x], [0]))))
            rows += [(s, x, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return spark.createDataFrame(rows, "slide string, x int, lo int, hi int")


def canonical(ring):
    """A ring without its last point, begun at its least one."""
    own = [tuple(map(float, p)) for p in ring[:-1]]
    k = own.index(min(own))
    return tuple(own[k:] + own[:k])


@pytest.mark.parametrize("strip", [3, 7, 256])
def test_every_ring(spark, monkeypatch, strip):
    monkeypatch.setattr(outlines, "STRIP", strip)
    rng = np.random.default_rng(strip)
    yy, xx = np.mgrid[:40, :50]
    donut = (((yy - 20) ** 2 + (xx - 25) ** 2 <= 300) & ((yy - 20) ** 2 + (xx - 25) ** 2 > 60)).astype(int)
    masks = {"donut": donut, "noise": (rng.random((25, 31)) < 0.5).astype(int), "one": np.ones((1, 1), dtype=int), "full": np.ones((5, 40), dtype=int), "corners": np.eye(9, dtype=int), "comb": np.array([[1] * 21, [1, 0] * 10 + [1], [1, 0] * 10 + [1]])}
    got = outlines.all_contours(runs_of(spark, masks), whole=False).collect()
    for s, m in masks.items():
        want = sorted(canonical(r) for r in contours.rings(m))
        mine = [[(p.y, p.x) for p in r.points] for r in got if r.slide == s]
        assert all(r[0] == r[-1] for r in mine)
        rounded = lambda rings: sorted(tuple((round(a, 6), round(b, 6)) for a, b in r) for r in rings)
        assert rounded(canonical(r) for r in mine) == rounded(want)
    # a hole has a ring of its own, in the other direction; corners don't join
    area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r.points, r.points[1:], strict=False))
    assert sorted(area(r) > 0 for r in got if r.slide == "donut") == [False, True]
    assert sum(r.slide == "corners" for r in got) == 9


def test_whole_numbers_and_nothing(spark):
    got = outlines.all_contours(runs_of(spark, {"s": np.ones((2, 2), dtype=int)})).first()
    assert {(p.x, p.y) for p in got.points} <= {(x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)} and len(got.points) == 9
    assert outlines.all_contours(runs_of(spark, {"s": np.zeros((2, 2), dtype=int)})).count() == 0
