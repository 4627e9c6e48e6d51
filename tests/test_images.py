"""Masks as images in archives: what is written comes back, and what is read is checked."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from spanmill.sources import images


def runs_of(name, grid):
    out = []
    for y, row in enumerate(grid):
        edges = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(row)], strict=True):
            if row[a]:
                out.append((name, y, a, b, int(row[a])))
    return out


def pictures():
    rng = np.random.default_rng(1)
    noise = (rng.random((40, 33)) < 0.3) * rng.integers(1, 256, (40, 33))
    wide = np.zeros((3, 2000), dtype=int)
    wide[1, 500:1500] = 255
    return {"noise": noise.astype(int), "wide": wide, "nothing": np.zeros((5, 4), dtype=int), "sélide": np.full((1, 1), 7), "tall": np.eye(300, 2, dtype=int) * 9}


@pytest.mark.parametrize("archives,size", [(1, 1 << 16), (3, 50)])
def test_images_come_back(spark, tmp_path, monkeypatch, archives, size):
    monkeypatch.setattr(images, "CHUNK", size)
    held = pictures()
    runs = spark.createDataFrame([r for n, g in held.items() for r in runs_of(n, g)] + [("other", 0, 0, 1, 1)], "name string, y int, lo int, hi int, v int")
    sizes = spark.createDataFrame([(n, *g.shape) for n, g in held.items()], "name string, h int, w int")
    images.write_masks(runs, sizes, str(tmp_path / "out"), archives)
    got = {tuple(r) for r in images.read_masks(spark, str(tmp_path / "out")).collect()}
    want = {(n, *held[n].shape, y, a, b, v) for n, g in held.items() for _, y, a, b, v in runs_of(n, g)}
    assert got == want | {("nothing", 5, 4, None, None, None, None)}
    # other programs can read the archives: sizes, checksums and names are right
    files = list((tmp_path / "out").glob("*.zip"))
    assert 1 <= len(files) <= archives and not list((tmp_path / "out").glob(".masks*"))
    members = []
    for f in files:
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            members += z.namelist()
    assert sorted(members) == sorted(f"{n}.png" for n in held)


def test_errors_leave_nothing(spark, tmp_path):
    sizes = spark.createDataFrame([("a", 4, 4), ("b", 4, 4)], "name string, h int, w int")
    for bad in ((4, 0, 1, 1), (0, 2, 5, 1), (0, 2, 2, 1), (0, 0, 1, 0)):
        runs = spark.createDataFrame([("a", 0, 0, 2, 3), ("b", *bad)], "name string, y int, lo int, hi int, v int")
        with pytest.raises(Exception, match="runs outside"):
            images.write_masks(runs, sizes, str(tmp_path / "out"), 2)
    assert not list((tmp_path / "out").glob("masks*"))


def filtered(grid, kinds):
    """A PNG of which each row is filtered in one of the five ways."""
    h, w = grid.shape
    raw, above = b"", np.zeros(w, dtype=int)
    for y in range(h):
        line, left = grid[y].astype(int), np.concatenate(([0], grid[y, :-1])).astype(int)
        corner = np.concatenate(([0], above[:-1]))
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kinds[y]]
        raw += bytes([kinds[y]]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    return images.SIGNATURE + images.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + images.chunk(b"tEXt", b"a\0b") + images.chunk(b"IDAT", zlib.compress(raw)) + images.chunk(b"IEND", b"")


def test_filters_and_depths():
    rng = random.Random(3)
    grid = np.array([[rng.randrange(256) for _ in range(17)] for _ in range(25)])
    rows = list(images.png_rows(io.BytesIO(filtered(grid, [k % 5 for k in range(25)]))))
    assert (np.array([r[3] for r in rows]) == grid).all() and [r[2] for r in rows] == list(range(25))
    bits = images.SIGNATURE + images.chunk(b"IHDR", struct.pack(">IIBBBBB", 10, 2, 1, 0, 0, 0, 0)) + images.chunk(b"IDAT", zlib.compress(b"\0\xf0\x40\0\x00\x80")) + images.chunk(b"IEND", b"")
    assert [r[3].tolist() for r in images.png_rows(io.BytesIO(bits))] == [[1, 1, 1, 1, 0, 0, 0, 0, 0, 1], [0] * 8 + [1, 0]]
    for wrong, what in ((b"nothing of that kind", "no PNG"), (bits[:-20] + b"\0" + bits[-19:], "damaged"), (bits.replace(b"\n\0\0\0\2\1\0", b"\n\0\0\0\2\1\2"), "damaged")):
        with pytest.raises(Exception, match=what):
            list(images.png_rows(io.BytesIO(wrong)))
