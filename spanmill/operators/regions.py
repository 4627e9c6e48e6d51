"""Polygons put together: overlaps, unions, differences and buffers of rings, as rings again.

All edges are cut where they meet, and a piece is kept where one of its sides is within the result and the other is not. Kept
pieces, with the inside to their left, are joined to rings. A polygon is one row, its vertices an array; rows come in batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.operators.geometry import flat

RINGS = "array<array<struct<x: double, y: double>>>"
#: Points nearer than this share of a figure's extent are one, and sides are looked at from so far off.
SAME = 1e-9
#: Segments of a quarter of a circle.
QUARTER = 16


def winding(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often closed rings of edges a to b go round each point, counterclockwise."""
    out = np.zeros(len(points), dtype=np.int64)
    for at in range(0, len(points), max((1 << 20) // max(len(a), 1), 1)):
        own = slice(at, at + max((1 << 20) // max(len(a), 1), 1))
        x, y = points[own, 0, None], points[own, 1, None]
        up, down = (a[:, 1] <= y) & (b[:, 1] > y), (a[:, 1] > y) & (b[:, 1] <= y)
        left = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (x - a[:, 0]) * (b[:, 1] - a[:, 1])
        out[own] = (up & (left > 0)).sum(axis=1) - (down & (left < 0)).sum(axis=1)
    return out


def _cut(a: np.ndarray, b: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges a to b cut where they cross, and where an end lies on another edge."""
    r = b - a
    n = len(a)
    edge, share = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
    for at in range(0, n, max((1 << 20) // max(n, 1), 1)):
        i = slice(at, at + max((1 << 20) // max(n, 1), 1))
        d = a[None] - a[i, None]
        cross = r[i, None, 0] * r[None, :, 1] - r[i, None, 1] * r[None, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (d[..., 0] * r[None, :, 1] - d[..., 1] * r[None, :, 0]) / cross
            u = (d[..., 0] * r[i, None, 1] - d[..., 1] * r[i, None, 0]) / cross
            met = (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
            k, _ = np.nonzero(met)
            edge.append(k + at)
            share.append(t[met])
            # ends on the edge: collinear edges and those that only touch
            length = (r[i] ** 2).sum(axis=1)[:, None]
            s = (d * r[i, None]).sum(axis=-1) / length
            off = np.abs(d[..., 0] * r[i, None, 1] - d[..., 1] * r[i, None, 0]) / np.sqrt(length)
        on = (off <= near) & (s > 0) & (s < 1)
        k, _ = np.nonzero(on)
        edge.append(k + at)
        share.append(s[on])
    edge, share = np.concatenate(edge), np.concatenate(share)
    order = np.lexsort((share, edge))
    edge, share = edge[order], share[order]
    point = a[edge] + share[:, None] * r[edge]
    point[share == 1] = b[edge[share == 1]]
    point = np.round(point / near) * near
    same = edge[1:] == edge[:-1]
    p, q = point[:-1][same], point[1:][same]
    kept = (p != q).any(axis=1)
    return p[kept], q[kept]


def combined(figures: list[list[np.ndarray]], rule: Callable[..., np.ndarray]) -> list[np.ndarray]:
    """Closed rings around where rule(winding numbers of each figure's rings) holds: outer ones counterclockwise, holes clockwise."""
    closed = [[r for r in rings if len(r) > 3] for rings in figures]
    edges = [(np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])) if rings else (np.zeros((0, 2)), np.zeros((0, 2))) for rings in closed]
    a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    moves = (a != b).any(axis=1)
    if not moves.any():
        return []
    near = max(float(np.ptp(a, axis=0).max()), float(np.abs(a).max()), 1e-300) * SAME
    p, q = _cut(a[moves], b[moves], near)
    if not len(p):
        return []
    # each piece once, whatever its direction
    swap = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    p, q = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
    pieces = np.unique(np.concatenate([p, q], axis=1), axis=0)
    p, q = pieces[:, :2], pieces[:, 2:]
    along = q - p
    length = np.sqrt((along**2).sum(axis=1))[:, None]
    # a side is looked at from a point as near as the piece is short
    off = np.stack([-along[:, 1], along[:, 0]], axis=1) / length * np.minimum(near * 50, length / 50)
    middle = (p + q) / 2
    left = rule(*[winding(middle + off, *e) for e in edges])
    right = rule(*[winding(middle - off, *e) for e in edges])
    begin = np.concatenate([p[left & ~right], q[right & ~left]])
    end = np.concatenate([q[left & ~right], p[right & ~left]])
    return _joined(begin, end)


def _joined(begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Rings of pieces; where several go on from a point, the one most to the left is next, so rings that touch stay apart."""
    onward: dict[tuple[float, float], list[int]] = {}
    begins, ends = list(map(tuple, begin.tolist())), list(map(tuple, end.tolist()))
    for k, at in enumerate(begins):
        onward.setdefault(at, []).append(k)
    angle = np.arctan2(end[:, 1] - begin[:, 1], end[:, 0] - begin[:, 0])
    used, out = np.zeros(len(begins), dtype=bool), []
    for start in range(len(begins)):
        ring, k = [], start
        while not used[k]:
            used[k] = True
            ring.append(begins[k])
            free = [j for j in onward.get(ends[k], []) if not used[j]]
            if not free:
                break
            k = max(free, key=lambda j: (angle[j] - angle[k] + np.pi) % (2 * np.pi)) if len(free) > 1 else free[0]
        if len(ring) > 2 and ends[k] == ring[0]:
            out.append(np.array([*ring, ring[0]]))
    return out


def signed_area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    return float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum() / 2)


def offset(ring: np.ndarray, distance: float, quarter: int = QUARTER) -> np.ndarray:
    """A counterclockwise ring's edges moved outwards, joined by arcs, back to the vertex where it turns inwards: it may cross itself."""
    keep = np.concatenate(([True], (ring[1:-1] != ring[:-2]).any(axis=1))) & (ring[:-1] != ring[-1]).any(axis=1)
    v = np.concatenate([ring[:1], ring[:-1][keep]]) if not keep[0] else ring[:-1][keep]
    d = np.roll(v, -1, axis=0) - v
    turn = np.arctan2(-d[:, 0], d[:, 1])  # the direction outwards of each edge
    normal = np.stack([np.cos(turn), np.sin(turn)], axis=1) * distance
    out = []
    for k in range(len(v)):
        by = (turn[k] - turn[k - 1] + np.pi) % (2 * np.pi) - np.pi
        before, after = v[k] + normal[k - 1], v[k] + normal[k]
        if by > 0:
            steps = max(int(np.ceil(by / (np.pi / 2) * quarter - 1e-9)), 1)
            arc = turn[k - 1] + by * np.arange(1, steps) / steps
            out += [before, *(v[k] + distance * np.stack([np.cos(arc), np.sin(arc)], axis=1)), after]
        else:
            out += [before, v[k], after]
    return np.array([*out, out[0]])


def widened(ring: np.ndarray, distance: float, quarter: int = QUARTER) -> list[np.ndarray]:
    """Rings of all points within a ring or no further from it than the distance."""
    whole = combined([[ring]], lambda n: n != 0)
    if distance <= 0:
        return whole
    # to the right of a hole's way is the hole: it becomes narrower
    return combined([[offset(r, distance, quarter) for r in whole]], lambda n: n > 0)


#: Figures whose rings a worker keeps, so that equal ones, wherever they lie, are cut once.
KNOWN = 1 << 14
_known: dict[bytes, list[np.ndarray]] = {}


def _figures(sides: list[pa.Array], kind: str, f: Callable[[list[np.ndarray]], list[np.ndarray]]) -> pa.Array:
    """f's rings for each row's rings, one of each side; null where one is null. f sees them from the first point of the first, and the rings are put back."""
    parts = [flat(s) for s in sides]
    missing = np.zeros(len(sides[0]), dtype=bool)
    for s in sides:
        missing |= pc.is_null(s).to_numpy(zero_copy_only=False)
    made, origin = [], np.zeros((len(missing), 2))
    for k in range(len(missing)):
        if missing[k]:
            made.append([])
            continue
        own = [points[first[k] : first[k] + n[k]] for points, first, n in parts]
        if len(own[0]):
            origin[k] = own[0][0]
        near = [v - origin[k] for v in own]
        name = b"|".join([kind.encode(), *[v.tobytes() for v in near]])
        if (rings := _known.get(name)) is None:
            if len(_known) >= KNOWN:
                _known.clear()
            rings = _known[name] = f(near)
        made.append(rings)
    count = np.array([len(r) for r in made], dtype=np.int64)
    every = [r for rings in made for r in rings]
    size = np.array([len(r) for r in every], dtype=np.int64)
    points = np.concatenate(every) + np.repeat(np.repeat(origin, count, axis=0), size, axis=0) if every else np.zeros((0, 2))
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    vertices = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(ends(count), pa.ListArray.from_arrays(ends(size), vertices), mask=pa.array(missing))


RULES: dict[str, Callable[..., np.ndarray]] = {
    "overlap": lambda m, n: (m % 2 != 0) & (n % 2 != 0),
    "union": lambda m, n: (m % 2 != 0) | (n % 2 != 0),
    "difference": lambda m, n: (m % 2 != 0) & (n % 2 == 0),
}


def clip(a: Column, b: Column, how: str = "overlap") -> Column:
    """Rings of the overlap, union or difference of two closed rings (inside is even-odd), which may be concave or cross themselves.

    An array of closed rings, outer ones counterclockwise, holes clockwise; empty where nothing is left, null where either is null.
    """
    @F.arrow_udf(RINGS)
    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        return _figures([p, q], how, lambda v: combined([[v[0]], [v[1]]], RULES[how]))

    return run(a, b)


def buffer(ring: Column, distance: float, quarter: int = QUARTER) -> Column:
    """Rings of a closed ring widened by a distance (0 or less: as it is), corners round in `quarter` segments a quarter turn; null for null."""

    @F.arrow_udf(RINGS)
    def run(p: pa.Array) -> pa.Array:
        return _figures([p], f"{distance} {quarter}", lambda v: widened(v[0], distance, quarter))

    return run(ring)


def rings_area(rings: Column) -> Column:
    """Area of rings as clip() and buffer() give them: holes count against it."""

    def own(ring: Column) -> Column:
        pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.aggregate(pairs, F.lit(0.0), lambda s, c: s + c) / 2

    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + own(r))
