"""TIFF files: codecs, directories, windows, and that only the tiles met are read."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.queries.base import r2d
from spanmill.sources import tiff
from tests.compare import DATA


@pytest.mark.parametrize("seed", range(6))
def test_lzw(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abc\x00\xff") if seed % 2 else rng.getrandbits(8) for _ in range([0, 1, 2, 5000, 40000, 90000][seed]))
    assert tiff.lzw_decoded(tiff.lzw_encoded(data)) == data
    assert tiff.lzw_decoded(tiff.lzw_encoded(b"aaaa" * 9000)) == b"aaaa" * 9000


def test_lzw_known_codes():
    # codes of nine bits: clear, 7, 258, 8, 8, 258, 6, 6, end
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    data = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert tiff.lzw_decoded(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encoded(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def classic(order, grid, strips=None, bits=8, planar=1, compression=1, signed=False, pages=1):
    """A classic TIFF in strips, written by hand; grid [row, column, sample]."""
    h, w, n = grid.shape
    rows = strips or h
    kind = np.dtype(f"{order}{'i' if signed else 'u'}{max(bits // 8, 1)}")

    def raw(part):
        if bits == 1:
            return np.packbits(part[:, :, 0].astype(np.uint8), axis=1).tobytes()
        return np.ascontiguousarray(part).astype(kind).tobytes()

    planes = [grid] if planar == 1 else [grid[:, :, k : k + 1] for k in range(n)]
    parts = [raw(p[y : y + rows]) for p in planes for y in range(0, h, rows)]
    if compression == 5:
        parts = [tiff.lzw_encoded(p) for p in parts]
    body, at = b"", 8
    offsets = []
    for p in parts:
        offsets.append(at + len(body))
        body += p + b"\0" * (len(p) % 2)
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [bits] * n), 259: ("H", [compression]), 262: ("H", [1]), 273: ("I", offsets), 277: ("H", [n]), 278: ("I", [rows]), 279: ("I", [len(p) for p in parts]), 284: ("H", [planar]), 339: ("H", [2 if signed else 1] * n)}
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at + len(body)) + body
    for k in range(pages):
        here = len(out)
        apart, entries = b"", b""
        place = here + 2 + 12 * len(tags) + 4
        for tag, (form, v) in sorted(tags.items()):
            own = struct.pack(f"{order}{len(v)}{form}", *v)
            if len(own) > 4:
                own, apart = struct.pack(order + "I", place + len(apart)), apart + own
            entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(v)) + own.ljust(4, b"\0")
        after = place + len(apart) if k < pages - 1 else 0
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", after) + apart
    return out


@pytest.mark.parametrize("order,strips,bits,planar,compression,samples", [("<", 7, 8, 1, 1, 3), (">", 5, 16, 1, 5, 2), ("<", None, 8, 2, 5, 3), (">", 4, 1, 1, 1, 1), ("<", 6, 32, 1, 1, 1)])
def test_files_in_strips(spark, tmp_path, order, strips, bits, planar, compression, samples):
    rng = np.random.default_rng(1)
    signed = bits == 32
    grid = rng.integers(-5 if signed else 0, 2 if bits == 1 else 200, (23, 19, samples))
    (tmp_path / "a.tif").write_bytes(classic(order, grid, strips, bits, planar, compression, signed))
    got = {(r.band, r.y, r.x): r.v for r in tiff.tiff_pixels(tiff.read_tiff(spark, str(tmp_path / "a.tif"), 4, 2, 11, 12)).collect()}
    assert got == {(b, y, x): grid[y, x, b] for b in range(samples) for y in range(4, 15) for x in range(2, 14)}


def test_pages_as_bands_and_places(spark, tmp_path):
    grid = np.arange(20).reshape(4, 5, 1)
    (tmp_path / "three.tif").write_bytes(classic("<", grid, pages=3))
    (tmp_path / "rgb.tiff").write_bytes(classic("<", np.repeat(grid, 3, axis=2)))
    tiles = tiff.read_tiff(spark, str(tmp_path))
    pages = tiff.tiff_pages(tiles.select("path").distinct())
    assert sorted((r.page, r.samples, r.height, r.width, r.pixel_x) for r in pages.collect()) == [(0, 1, 4, 5, None), (0, 3, 4, 5, None), (1, 1, 4, 5, None), (2, 1, 4, 5, None)]
    got = sorted((r.path.rsplit("/", 1)[1], r.layer) for r in tiff.layers(tiles, pages).collect())
    assert got == [(name, k) for name in ("rgb.tiff", "three.tif") for k in range(3)]
    assert tiff.read_tiff(spark, str(tmp_path), page=2).count() == 1


@pytest.mark.parametrize("compression,predictor,bits", [("none", False, 8), ("deflate", True, 16), ("lzw", True, 8), ("deflate", False, 1)])
def test_written_files_come_back(spark, tmp_path, compression, predictor, bits):
    px = r2d(spark, DATA).filter("slide < 4").select("slide", "y", "x", F.col("mask" if bits == 1 else "val").alias("v"), "val")
    made = tiff.write_tiffs(px, str(tmp_path / "out"), ["v"], tile=16, bits=bits, compression=compression, predictor=predictor).collect()
    assert sorted(r.name for r in made) == ["0", "1", "2", "3"] and all(r.tiles == 4 for r in made)
    # small files are read together, in one partition or in one each as asked for
    assert tiff.read_tiff(spark, str(tmp_path / "out")).rdd.getNumPartitions() == 1
    assert tiff.read_tiff(spark, str(tmp_path / "out"), partition_bytes=70_000).rdd.getNumPartitions() == 4
    read = tiff.tiff_pixels(tiff.read_tiff(spark, str(tmp_path / "out")))
    got = sorted((int(r.path.rsplit("/", 1)[1][:-4]), r.y, r.x, r.v) for r in read.collect())
    assert got == sorted((r.slide, r.y, r.x, r.v) for r in px.collect())
    assert not list((tmp_path / "out").glob(".*"))


def test_missing_pixels_are_zero_and_repeats_count_once(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 0, 9), ("a", 40, 3, 7), ("a", 1, 1, None)], "slide string, y long, x long, v int")
    tiff.write_tiffs(px, str(tmp_path / "out"), ["v"], tile=16)
    got = {(r.y, r.x): r.v for r in tiff.tiff_pixels(tiff.read_tiff(spark, str(tmp_path / "out"))).collect()}
    assert len(got) == 41 * 4 and {k: v for k, v in got.items() if v} == {(0, 0): 9, (40, 3): 7}
    assert tiff.write_tiffs(px.limit(0), str(tmp_path / "none"), ["v"]).count() == 0


def test_only_the_tiles_met_are_read(spark, tmp_path, monkeypatch):
    """A window of a file of 1,024 tiles reads four of them, and what it plans from is the directory."""
    px = spark.range(512 * 512).select(F.lit("s").alias("slide"), F.floor(F.col("id") / 512).alias("y"), (F.col("id") % 512).alias("x"), (F.xxhash64("id") % 128 + 127).alias("v"))
    made = tiff.write_tiffs(px, str(tmp_path / "out"), ["v"], tile=16, compression="none").first()
    assert made.tiles == 1024 and made.bytes > 512 * 512

    reads = []

    class Counted:
        def __init__(self, path):
            self.f = open(path, "rb")

        def read_at(self, n, at):
            self.f.seek(at)
            reads.append((at, n))
            return self.f.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(tiff, "opened", Counted)
    reader = tiff.TiffReader({"path": made.path, "y0": "30", "x0": "40", "height": "10", "width": "10", "partitionbytes": "300"})
    parts = reader.partitions()
    planned = sum(n for _, n in reads)
    assert planned < 24_000 and sum(len(p.tiles) for p in parts) == 4 and len(parts) == 4
    reads.clear()
    rows = [b for p in parts for b in reader.read(p)]
    assert sum(n for _, n in reads) == 4 * 256 and sum(r["height"][0].as_py() * r["width"][0].as_py() for r in rows) == 100
    # neighbouring tiles are one partition where they fit
    assert len(tiff.TiffReader({"path": made.path, "y0": "0", "height": "16"}).partitions()) == 1
    assert tiff.TiffReader({"path": made.path, "y0": "600"}).partitions() == []
    monkeypatch.undo()
    assert tiff.read_tiff(spark, made.path, y0=600).count() == 0


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no image at all, but sixteen bytes")
    with pytest.raises(Exception, match="no TIFF file"):
        tiff.read_tiff(spark, str(tmp_path / "x.tif")).count()
    (tmp_path / "y.tif").write_bytes(classic("<", np.zeros((3, 3, 1)), compression=7))
    with pytest.raises(Exception, match="compression 7"):
        tiff.read_tiff(spark, str(tmp_path / "y.tif")).count()
