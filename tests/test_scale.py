"""What grows with the tables: how rows are dealt to tasks, and joins that don't send pixels to every executor."""

import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.operators import augment, geometry, regions, tta
from spanmill.queries import QUERIES
from spanmill.queries.base import r2d, rects
from spanmill.sources import chunks
from tests.compare import DATA

PIXELS = "cutmix_cutout elastic_deformation group_zscore_clip instance_ridge label_pair_iou mixup_pixels raster_ingest remap_bilinear remap_nearest remap_wave resize_bilinear resize_nearest rle_encode_resized"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PIXELS.split())
def test_pixels_are_not_broadcast(spark, name):
    lines = _plan(QUERIES[name](spark, DATA)).splitlines()
    depth = [next(i for i, c in enumerate(x) if c.isalpha() or c == "*") for x in lines if x.strip()]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            assert not any("Generate " in x for x in lines[k:below])


def test_rasters_of_one_file_are_many_tasks(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("s_suppkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert r2d(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_variants_are_looked_up(spark):
    px = spark.range(6).select(F.lit(1).alias("slide"), F.floor(F.col("id") / 3).alias("y"), (F.col("id") % 3).alias("x"), F.lit(2).alias("h"), F.lit(3).alias("w"))
    every = (tta.HFLIP, tta.VFLIP, tta.ROT90)
    there = tta.augmented(px, every)
    back = tta.deaugmented(there, every)
    assert "CASE WHEN" not in _plan(back)
    assert sorted(back.select("tta", "y", "x", "h", "w").collect()) == [(t, y, x, 2, 3) for t in range(16) for y in range(2) for x in range(3)]
    # variant 1 is a quarter turn counterclockwise: the top right corner comes to the top left
    assert there.filter("tta = 1 AND y = 0 AND x = 0").count() == 1
    assert {(r.h, r.w) for r in there.filter("tta = 1").collect()} == {(3, 2)}


def test_files_of_tiles_are_not_as_many_as_slides(spark, tmp_path):
    px = spark.range(40 * 16).select(F.floor(F.col("id") / 16).alias("slide"), (F.floor(F.col("id") / 4) % 4).alias("y"), (F.col("id") % 4).alias("x"), F.lit(7).alias("val"), F.lit(1).alias("mask"))
    chunks.write_tiles(px, str(tmp_path / "tiles"), 2)
    assert len(list(pathlib.Path(tmp_path / "tiles").rglob("*.parquet"))) < 40
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 40 * 4


def test_objects_of_one_file_are_many_tasks(spark, tmp_path):
    rows = spark.range(9000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert rects(spark, str(tmp_path)).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("name", ["containment_counts", "distance_bounded_join", "polygon_buffer_contains"])
def test_pairs_are_made_by_cells_dealt_to_all_tasks(spark, name):
    plan = _plan(QUERIES[name](spark, DATA))
    assert "BroadcastExchange" not in plan and plan.count("REPARTITION_BY_NUM") >= 2


def test_overlaps_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (7, 5), (6, 9)):
        close = lambda v: np.concatenate([v, v[:, :1]], axis=1)
        p, q = (close(np.round(rng.random((200, k - 1, 2)) * 8, 1 if k < 7 else 0)) for k in (n, m))
        want = [geometry._overlap(a, b) for a, b in zip(p, q, strict=True)]
        assert np.allclose(geometry.overlaps(p, q), want, atol=1e-9)
        assert max(want) > 1


def test_later_tries_are_made_in_batches(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (9, 0), (0, 1), (0, 0))])
    got = augment.point_in_polygon(spark.range(40).select("id", ring.alias("ring")), "id", 3, 7)
    assert "Exchange" not in _plan(got)
    at = lambda s, i: augment.unit(3 + s, "id", i)
    tries = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("id", "i", (9 * at(0, F.col("i"))).alias("x"), at(1, F.col("i")).alias("y"))
    first = {r["id"]: (r["p"]["x"], r["p"]["y"]) for r in tries.filter("x + 9 * y < 9").groupBy("id").agg(F.min(F.struct("i", "x", "y")).alias("p")).collect()}
    assert {r["id"]: (r.x, r.y) for r in got.collect()} == {k: first.get(k, (3.0, 1 / 3)) for k in range(40)}


def test_equal_figures_are_cut_once():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    moved = lambda by: [{"x": x + by, "y": y - 2.0 * by} for x, y in square]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    a = pa.array([moved(k) for k in range(5)] + [None], kind)
    calls = []
    got = regions._figures([a, a], "once", lambda v: calls.append(1) or [v[0]]).to_pylist()
    assert len(calls) == 1 and got == [[moved(k)] for k in range(5)] + [None]


def test_objects_of_a_tile_index_are_many_tasks(spark):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES["tile_index_rows"](spark, DATA))


def test_shared_pixels_are_those_of_the_spans(spark):
    rng = np.random.default_rng(7)
    close = lambda v: [*v, v[0]]
    rings = [close([tuple(c) for c in np.round(rng.random((n, 2)) * 30, d).tolist()]) for n in (3, 4, 6) for d in (0, 1) for _ in range(6)]
    objects = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id long, ring array<struct<x: double, y: double>>")
    inside = {}
    for r in geometry.fill(objects, ["id"]).collect():
        inside.setdefault(r["id"], set()).update((r["y"], x) for x in range(r["lo"], r["hi"]))
    a, b = (objects.select(F.col("id").alias(c), F.col("ring").alias(f"{c}_ring")) for c in "ab")
    got = a.crossJoin(b).select("a", "b", geometry.overlap_pixels("a_ring", "b_ring").alias("n")).collect()
    assert len(got) == len(rings) ** 2 and sum(r["n"] > 0 for r in got) > 300
    assert all(r["n"] == len(inside.get(r["a"], set()) & inside.get(r["b"], set())) for r in got)


def test_rings_without_pixels_share_none(spark):
    rows = [("[]", "square"), (None, "square"), ("gap", "square"), ("gap", "gap"), ("square", "square")]
    ring = {"[]": [], None: None, "square": [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)], "gap": [(None, None)] * 4}
    pairs = spark.createDataFrame([(ring[a], ring[b]) for a, b in rows], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    assert [r[0] for r in pairs.select(geometry.overlap_pixels("a", "b")).collect()] == [0, 0, 0, 0, 9]


def test_pairs_are_not_shuffled_to_be_filled(spark):
    assert _plan(QUERIES["polygon_intersection"](spark, DATA)).count("Exchange") <= 6  # two sides, by object and by cell


def test_deformed_places_meet_pixels_by_block_without_joins(spark):
    h, w = 2 * augment.BLOCK + 9, augment.BLOCK + 1
    places = spark.range(2 * h * w).select(F.when(F.col("id") < h * w, "a").otherwise("b").alias("slide"), F.floor(F.col("id") % (h * w) / w).alias("y"), (F.col("id") % w).alias("x"), F.lit(h).alias("h"), F.lit(w).alias("w"))
    at = augment.elastic(places, 8, 30.0, 7, degrees=20.0, horizontal=True)
    assert "Join" not in _plan(at)
    px = places.withColumn("val", (F.col("y") * 31 + F.col("x") * 17 + F.ascii("slide")) % 256).filter("y % 50 > 0 AND NOT (slide = 'b' AND y > 20)")
    got = augment.sampled_reflected(px.unionByName(px.filter("x = 3")), at, "val")
    assert "Join" not in _plan(got)
    image = {(r.slide, r.y, r.x): r.val * (2 if r.x == 3 else 1) for r in px.collect()}
    back = lambda k, n: min(k % (2 * n), 2 * n - 1 - k % (2 * n))
    want = {}
    for r in at.collect():
        y, x = int(np.floor(r.fy)), int(np.floor(r.fx))
        four = [((r.slide, back(y + a, h), back(x + b, w)), abs(1 - a - (r.fy - y)) * abs(1 - b - (r.fx - x))) for a in (0, 1) for b in (0, 1)]
        if any(p in image for p, _ in four):
            want[r.slide, r.y, r.x] = sum(u * image.get(p, 0) for p, u in four)
    found = {(r.slide, r.y, r.x): r.val for r in got.collect()}
    assert 0 < len(want) < 2 * h * w and found.keys() == want.keys()
    assert all(abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_a_tile_index_is_written_in_runs(spark, tmp_path, monkeypatch):
    """Rows are slides times objects: as runs of the same objects for slide after slide they take little room."""
    import duckdb

    from spanmill.operators import sampling
    from spanmill.queries import SQL

    monkeypatch.setattr(sampling, "TOGETHER", 500, raising=False)
    for name, kind, key, n in (("supplier", "s", "suppkey", 400), ("customer", "c", "custkey", 9000)):
        rows = spark.range(n).select((F.col("id") * 7).alias(f"{kind}_{key}"), F.when(F.col("id") % 100 > 0, F.xxhash64("id", F.lit(kind)) % 3).cast("int").alias(f"{kind}_nationkey"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables are that don't fit
    try:
        index = QUERIES["tile_index_rows"](spark, str(tmp_path))
        assert "hashpartitioning(slide" not in _plan(index)  # nothing deals out the rows made
        index.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    con = duckdb.connect()
    for name in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {SQL['tile_index_rows']}")
    con.execute(f"CREATE VIEW got AS SELECT slide, obj, draw, placed FROM '{tmp_path}/out/*.parquet'")
    n = con.execute("SELECT count(*) FROM got").fetchone()[0]
    assert n == con.execute("SELECT count(*) FROM want").fetchone()[0] > 500_000
    assert not con.execute("(SELECT * FROM want EXCEPT ALL SELECT * FROM got) UNION ALL (SELECT * FROM got EXCEPT ALL SELECT * FROM want)").fetchall()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * n


def test_centres_of_equal_objects_are_looked_at_once(spark, tmp_path, monkeypatch):
    """40 times 60 objects of two boxes, in lists of 7: the test of a pair of them is made for lists, not for each two."""
    import duckdb

    from spanmill.operators import match
    from spanmill.queries import SQL, places

    monkeypatch.setattr(match, "MEMBERS", 7, raising=False)
    keys = [k * 9000 + 2 for k in range(40)] + [k * 9000 + 1813 for k in range(60)] + list(range(40, 90))
    spark.createDataFrame([(k, 1) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    looked, pairs = [], match.box_pairs
    monkeypatch.setattr(places.match, "box_pairs", lambda *a: looked.append(pairs(*a)) or looked[-1])
    got = sorted((r.a, r.b) for r in QUERIES["polygon_buffer_contains"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(con.execute(SQL["polygon_buffer_contains"]).fetchall())
    assert len(got) >= 2400 and looked[0].count() < 200
