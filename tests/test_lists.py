"""Paired lists, label files, logs of growing columns, tiles: edge cases."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanmill.operators import cohort, grid, sampling
from spanmill.sources import files


def test_lists_of_one_length_are_paired(spark):
    of = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = cohort.paired(of(["b", None, "a"], "x"), of(["2", "3", "1"], "y"), "x", "y").orderBy("number").collect()
    assert [tuple(r) for r in got] == [(None, "1", 0), ("a", "2", 1), ("b", "3", 2)]
    assert cohort.paired(of([], "x"), of([], "y"), "x", "y").count() == 0
    with pytest.raises(ValueError, match="2 rows to pair with 1"):
        cohort.paired(of(["a", "b"], "x"), of(["1"], "y"), "x", "y")


def test_numbering_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 7)
    rows = spark.range(100).select((F.col("id") % 50).alias("k"), F.lit("x").alias("__v"))
    got = sampling.numbered(rows, ["k"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(100)) and [r["k"] for r in got] == [k // 2 for k in range(100)]
    assert sampling.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_capped_without_a_limit_keeps_all(spark):
    rows = spark.range(30).select((F.col("id") % 2).alias("g"), "id")
    assert {(r["g"], r["id"], r["k"]) for r in cohort.capped(rows, ["g"], ["id"]).collect()} == {(i % 2, i, i // 2 + 1) for i in range(30)}
    assert cohort.capped(rows, ["g"], ["id"], 3).count() == 6


def test_logs_take_new_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_run(spark.createDataFrame([(1, 0.5)], "run int, loss double"), path)
    files.append_run(spark.createDataFrame([(2, "x")], "run int, note string"), path)
    assert {(r["run"], r["loss"], r["note"]) for r in files.read_runs(spark, path).collect()} == {(1, 0.5, None), (2, None, "x")}
    files.append_run(spark.createDataFrame([(3, "y")], "run int, loss string"), path)
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)merge"):
        files.read_runs(spark, path).collect()


def test_wide_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("name,aeroplane,bird\na, 1,-1\nb,0,\n")
    got = {tuple(r) for r in files.read_wide_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {("a", "aeroplane", 1), ("a", "bird", -1), ("b", "aeroplane", 0), ("b", "bird", None)}


def test_tiles_are_padded_and_joined(spark):
    px = spark.createDataFrame([("s", y, x, 5, 4, y * 4 + x) for y in range(5) for x in range(4)] * 2, "slide string, y int, x int, h int, w int, v int")
    tiles = grid.cut_tiles(px, 3, "v", -1)
    held = {(r["ty"], r["tx"]): list(r["tile"]) for r in tiles.collect()}
    assert held[(0, 0)] == [0, 1, 2, 4, 5, 6, 8, 9, 10] and held[(1, 1)] == [15, -1, -1, 19, -1, -1, -1, -1, -1]
    assert {(r["y"], r["x"], r["v"]) for r in grid.join_tiles(tiles, 3, "v").collect()} == {(y, x, y * 4 + x) for y in range(5) for x in range(4)}
    assert grid.join_tiles(tiles.limit(0), 3, "v").count() == 0
    with pytest.raises(PySparkException, match="a tile has 4 values"):
        grid.join_tiles(tiles.withColumn("tile", F.slice("tile", 1, 4)), 3, "v").collect()
