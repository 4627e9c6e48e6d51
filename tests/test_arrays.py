"""Chunked array stores: round trips, layout, windows, missing chunks."""

import json
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.queries.base import r2d
from spanmill.sources import arrays
from tests.compare import DATA


def cells_of(spark, grids):
    return spark.createDataFrame([(n, y, x, float(v)) for n, g in grids.items() for (y, x), v in np.ndenumerate(g)], "array string, y long, x long, v double")


@pytest.mark.parametrize("kind,chunk,packed", [("|u1", 7, True), ("<i4", (5, 16), False), ("<f8", (64, 3), True)])
def test_round_trip(spark, tmp_path, kind, chunk, packed):
    """Chunk grids that don't divide the arrays."""
    px = r2d(spark, DATA).filter("slide < 3").select(F.concat(F.lit("labels/s"), "slide").alias("array"), "y", "x", F.col("val").alias("v"))
    made = {r.array: (r.height, r.width) for r in arrays.write_arrays(px, str(tmp_path / "store"), chunk, kind, packed=packed).collect()}
    assert made == {"labels/s0": (20, 20), "labels/s1": (21, 21), "labels/s2": (22, 22)}
    got = sorted(map(tuple, arrays.array_cells(arrays.read_arrays(spark, str(tmp_path / "store"))).collect()))
    assert got == sorted(tuple(r) for r in px.collect())


def test_layout_on_disk(spark, tmp_path):
    grid = np.zeros((5, 9))
    grid[4, 8] = 3
    grid[0, 0] = 1
    made = arrays.write_arrays(cells_of(spark, {"a": grid}), str(tmp_path), 4, "<i2", packed=True).first()
    assert made.chunks == 2  # the other four hold nothing but the fill value
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == [".zarray", "0.0", "1.2"]
    assert json.loads((tmp_path / ".zgroup").read_text()) == {"zarr_format": 2}
    meta = json.loads((tmp_path / "a" / ".zarray").read_text())
    assert (meta["shape"], meta["chunks"], meta["dtype"], meta["fill_value"]) == ([5, 9], [4, 4], "<i2", 0)
    chunk = np.frombuffer(zlib.decompress((tmp_path / "a" / "1.2").read_bytes()), "<i2").reshape(4, 4)
    assert chunk[0, 0] == 3 and chunk.sum() == 3


def test_missing_chunks_have_the_fill_value(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 0, 6.0), ("a", 9, 9, None)], "array string, y long, x long, v double")
    arrays.write_arrays(cells, str(tmp_path), 4, "<f4", fill=-1)
    got = {(r.y, r.x): r.v for r in arrays.array_cells(arrays.read_arrays(spark, str(tmp_path))).collect()}
    assert len(got) == 100 and got.pop((0, 0)) == 6 and set(got.values()) == {-1}


def test_given_shapes(spark, tmp_path):
    shapes = spark.createDataFrame([("a", 6, 6), ("empty", 3, 2)], "array string, height long, width long")
    cells = spark.createDataFrame([("a", 1, 1, 5.0)], "array string, y long, x long, v double")
    arrays.write_arrays(cells, str(tmp_path / "s"), 4, shapes=shapes)
    got = arrays.array_cells(arrays.read_arrays(spark, str(tmp_path / "s"))).groupBy("array").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect())) == [("a", 36, 5.0), ("empty", 6, 0.0)]
    with pytest.raises(Exception, match="cells outside"):
        arrays.write_arrays(cells.withColumn("y", F.lit(6)), str(tmp_path / "t"), 4, shapes=shapes)
    assert not list((tmp_path / "t").rglob(".zarray"))  # what failed can't be read as whole


def test_windows_read_the_chunks_they_meet(spark, tmp_path, monkeypatch):
    grid = np.arange(2500).reshape(50, 50) + 1
    arrays.write_arrays(cells_of(spark, {"a": grid, "b/c": grid * 2}), str(tmp_path), 8, "<i4")
    rows = arrays.read_arrays(spark, str(tmp_path), "b/c", 6, 30, 12, 5).collect()
    assert {(r.cy, r.cx) for r in rows} == {(y, x) for y in range(3) for x in (3, 4)}
    got = {(r.y, r.x): r.v for r in arrays.array_cells(arrays.read_arrays(spark, str(tmp_path), "b/c", 6, 30, 12, 5)).collect()}
    assert got == {(y, x): 2.0 * grid[y, x] for y in range(6, 18) for x in range(30, 35)}
    seen = []
    whole = arrays._read
    monkeypatch.setattr(arrays, "_read", lambda fs, p: (seen.append(p), whole(fs, p))[1])
    reader = arrays.ArrayReader({"path": str(tmp_path), "array": "a", "y0": "0", "height": "8", "width": "9", "partitionbytes": "1"})
    parts = reader.partitions()
    assert len(parts) == 2 and all(p.rsplit("/", 1)[1] in (".zarray", ".zgroup") for p in seen)
    seen.clear()
    assert sum(len(b) for p in parts for b in reader.read(p)) == 2 and [p.rsplit("/", 1)[1] for p in seen] == ["0.0", "0.1"]
    assert arrays.read_arrays(spark, str(tmp_path), y0=60).count() == 0


def test_other_layouts(spark, tmp_path):
    """One dimension, columns first, another separator, zstd and gzip; what can't be read says so."""
    import gzip

    import zstandard

    def put(name, meta, chunks):
        (tmp_path / name).mkdir()
        (tmp_path / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "order": "C", "filters": None, "fill_value": None, "compressor": None, **meta}))
        for k, v in chunks.items():
            (tmp_path / name / k).parent.mkdir(exist_ok=True)
            (tmp_path / name / k).write_bytes(v)

    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    line = np.arange(6, dtype="<f4")
    put("line", {"shape": [5], "chunks": [3], "dtype": "<f4", "compressor": {"id": "zstd"}}, {"0": zstandard.compress(line[:3].tobytes()), "1": zstandard.compress(line[3:].tobytes())})
    grid = np.arange(4, dtype=">i2").reshape(2, 2)
    put("grid", {"shape": [2, 2], "chunks": [2, 2], "dtype": ">i2", "order": "F", "dimension_separator": "/", "compressor": {"id": "gzip"}}, {"0/0": gzip.compress(grid.tobytes(order="F"))})
    got = sorted(map(tuple, arrays.array_cells(arrays.read_arrays(spark, str(tmp_path))).collect()))
    assert got == [("grid", 0, 0, 0.0), ("grid", 0, 1, 1.0), ("grid", 1, 0, 2.0), ("grid", 1, 1, 3.0)] + [("line", 0, k, float(k)) for k in range(5)]
    put("bad", {"shape": [2, 2], "chunks": [2, 2], "dtype": "|u1", "compressor": {"id": "blosc"}}, {})
    with pytest.raises(Exception, match="compressor blosc"):
        arrays.read_arrays(spark, str(tmp_path), "bad").count()
    with pytest.raises(Exception, match="neither an array nor a group"):
        arrays.read_arrays(spark, str(tmp_path / "line" / "x")).count()


def test_many_small_arrays(spark, tmp_path, monkeypatch):
    """The metadata of a group's arrays are read some at one time, and listed by name all the same."""
    cells = spark.range(200).selectExpr("concat('g/a', id) AS array", "id % 2 AS y", "0L AS x", "id + 1 AS v")
    arrays.write_arrays(cells.coalesce(1), str(tmp_path / "s"), chunk=4).count()
    now, most, parsed = [], [], arrays.Layout.parsed

    def slow(text):
        now.append(1)
        most.append(len(now))
        time.sleep(0.01)
        now.pop()
        return parsed(text)

    monkeypatch.setattr(arrays.Layout, "parsed", slow)
    names = [n for n, _ in arrays.arrays_at(*arrays._store(str(tmp_path / "s")))]
    assert names == sorted(f"g/a{k}" for k in range(200)) and 1 < max(most) <= arrays.READERS
    assert arrays.array_cells(arrays.read_arrays(spark, str(tmp_path / "s"))).filter("v > 0").count() == 200
