"""Whole slides: image files and array stores, and measures of masks that need no window of all pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import components, outlines, rle
from spanmill.plans.session import shared_path
from spanmill.queries.base import R2D, Registry, r2d
from spanmill.sources import arrays, files, images, tiff

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


@query(f"WITH {R2D} SELECT slide, CAST(k AS INT) AS band, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE k WHEN 0 THEN val WHEN 1 THEN mask * 255 ELSE (val * 7 + slide) % 256 END AS INT) AS v FROM r2d, range(3) AS b(k) WHERE y >= 5 AND y < 18 AND x >= 14 AND x < 40")
def tiff_window(spark, sf):
    """Rasters written as tiled files of three bands, and a window of each file read back from the tiles it meets."""
    px = r2d(spark, sf).select("slide", "y", "x", F.col("val").alias("red"), (F.col("mask") * 255).alias("green"), ((F.col("val") * 7 + F.col("slide")) % 256).alias("blue"))
    tiff.write_tiffs(px, path := shared_path(spark, "tiff"), ["red", "green", "blue"], tile=16, compression="lzw", predictor=True)
    read = tiff.tiff_pixels(tiff.read_tiff(spark, path, y0=5, x0=14, height=13, width=26))
    return read.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("slide"), "band", "y", "x", "v")


@query(f"WITH {R2D} SELECT 'labels/s' || slide AS array, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN slide % 3 = 0 AND y >= 14 THEN 0 ELSE val END AS DOUBLE) AS v FROM r2d WHERE y >= 4 AND x >= 10 AND x < 21 UNION ALL SELECT 'masks/s' || slide, CAST(y AS BIGINT), CAST(x AS BIGINT), CAST(mask AS DOUBLE) FROM r2d WHERE y >= 4 AND x >= 10 AND x < 21")
def array_store_window(spark, sf):
    """Rasters and masks written as groups of chunked arrays, some chunks left out, and a window of all of them read back."""
    px = r2d(spark, sf)
    name = lambda group: F.concat(F.lit(f"{group}/s"), F.col("slide").cast("string")).alias("array")
    labels = px.filter((F.col("slide") % 3 != 0) | (F.col("y") < 14)).select(name("labels"), "y", "x", F.col("val").alias("v"))
    cells = labels.unionByName(px.select(name("masks"), "y", "x", F.col("mask").alias("v")))
    sizes = px.select("slide", "h", "w").distinct()
    shapes = sizes.select(name("labels"), F.col("h").alias("height"), F.col("w").alias("width")).unionByName(sizes.select(name("masks"), F.col("h").alias("height"), F.col("w").alias("width")))
    arrays.write_arrays(cells, path := shared_path(spark, "arrays"), chunk=(7, 9), shapes=shapes)
    return arrays.array_cells(arrays.read_arrays(spark, path, y0=4, x0=10, width=11))


#: Every contour walked from its least crossing; crossings are numbered by row, column and whether they lie on a row (0) or a column (1).
_WALK = f"""WITH RECURSIVE {R2D},
  g AS (SELECT slide, cy, cx FROM (SELECT DISTINCT slide, h, w FROM r2d), range(-1, 27) AS a(cy), range(-1, 25) AS b(cx) WHERE cy < h AND cx < w),
  c AS (SELECT g.*, coalesce(tl.mask, 0) * 8 + coalesce(tr.mask, 0) * 4 + coalesce(br.mask, 0) * 2 + coalesce(bl.mask, 0) AS k FROM g
    LEFT JOIN r2d tl ON tl.slide = g.slide AND tl.y = cy AND tl.x = cx LEFT JOIN r2d tr ON tr.slide = g.slide AND tr.y = cy AND tr.x = cx + 1
    LEFT JOIN r2d br ON br.slide = g.slide AND br.y = cy + 1 AND br.x = cx + 1 LEFT JOIN r2d bl ON bl.slide = g.slide AND bl.y = cy + 1 AND bl.x = cx),
  ways(k, f, t) AS (VALUES (1, 'l', 'b'), (2, 'b', 'r'), (3, 'l', 'r'), (4, 'r', 't'), (5, 'r', 't'), (5, 'l', 'b'), (6, 'b', 't'), (7, 'l', 't'),
    (8, 't', 'l'), (9, 't', 'b'), (10, 't', 'l'), (10, 'b', 'r'), (11, 't', 'r'), (12, 'r', 'l'), (13, 'r', 'b'), (14, 'b', 'l')),
  s AS (SELECT slide, ((cy + 1 + CASE f WHEN 'b' THEN 1 ELSE 0 END) * 1000 + cx + 1 + CASE f WHEN 'r' THEN 1 ELSE 0 END) * 2 + CASE WHEN f IN ('l', 'r') THEN 1 ELSE 0 END AS f,
    ((cy + 1 + CASE t WHEN 'b' THEN 1 ELSE 0 END) * 1000 + cx + 1 + CASE t WHEN 'r' THEN 1 ELSE 0 END) * 2 + CASE WHEN t IN ('l', 'r') THEN 1 ELSE 0 END AS t FROM c JOIN ways USING (k)),
  walk(slide, root, place, n) AS (SELECT slide, f, t, CAST(1 AS BIGINT) FROM s WHERE t > f
    UNION ALL SELECT w.slide, w.root, s.t, w.n + 1 FROM walk w JOIN s ON s.slide = w.slide AND s.f = w.place WHERE w.place <> w.root AND s.t >= w.root),
  p AS (SELECT w.slide, w.root, w.place, w.n FROM walk w JOIN (SELECT slide, root FROM walk WHERE place = root) r ON r.slide = w.slide AND r.root = w.root
    UNION ALL SELECT slide, root, root, 0 FROM walk WHERE place = root),
  q AS (SELECT slide, root, n, greatest(place // 2 % 1000 - 1, 0) AS x, greatest(place // 2 // 1000 - 1, 0) AS y FROM p)"""


def _rings(spark, sf):
    return outlines.all_contours(components.column_runs(r2d(spark, sf).filter("mask = 1")))


@query(_WALK + " SELECT slide, CAST(count(*) AS BIGINT) AS points, string_agg(x || ',' || y, ' ' ORDER BY n) AS ring FROM q GROUP BY slide, root")
def contours_all(spark, sf):
    """All contours of each mask, point by point, holes too."""
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), " ")
    return _rings(spark, sf).select("slide", F.size("points").cast("long").alias("points"), text.alias("ring"))


@query(_WALK + " SELECT CAST(min(x) AS BIGINT) AS x0, CAST(max(x) AS BIGINT) AS x1, CAST(min(y) AS BIGINT) AS y0, CAST(max(y) AS BIGINT) AS y1, CAST(count(*) AS BIGINT) AS points FROM q GROUP BY slide, root")
def contour_features(spark, sf):
    """All contours written as lists of features, one each, and read feature by feature."""
    texts = files.geojson_text(_rings(spark, sf).withColumnRenamed("points", "contour"), ["slide"], ring="contour")
    texts.select("geojson").write.text(path := shared_path(spark, "contours"))
    ring = F.get("parts", F.lit(0))
    end = lambda f, k: f(F.transform(ring, lambda p: p[k])).cast("long")
    read = files.read_geojson_lines(spark, path)
    return read.select(end(F.array_min, "x").alias("x0"), end(F.array_max, "x").alias("x1"), end(F.array_min, "y").alias("y0"), end(F.array_max, "y").alias("y1"), F.size(ring).cast("long").alias("points"))


@query(f"WITH {R2D}, m AS (SELECT *, CASE WHEN mask = 1 AND y % 9 > 0 THEN 1 + val % 3 ELSE 0 END AS v FROM r2d), g AS (SELECT *, x - row_number() OVER (PARTITION BY slide, y, v ORDER BY x) AS g FROM m WHERE v > 0) SELECT 's' || slide AS name, h, w, CAST(y AS INT) AS y, CAST(min(x) AS INT) AS lo, CAST(max(x) + 1 AS INT) AS hi, CAST(v AS INT) AS v FROM g GROUP BY slide, h, w, y, v, g")
def mask_images(spark, sf):
    """Masks of three classes written as images into archives, and read back as runs."""
    px = r2d(spark, sf).withColumn("v", F.when((F.col("mask") == 1) & (F.col("y") % 9 > 0), 1 + F.col("val") % 3).otherwise(0)).withColumn("name", F.concat(F.lit("s"), F.col("slide").cast("string")))
    runs = rle.encode_spans(px.filter("v > 0").select("name", "y", "v", "x"), ["name", "y", "v"], "x")
    images.write_masks(runs, px.select("name", "h", "w").distinct(), path := shared_path(spark, "images"), archives=4)
    return images.read_masks(spark, path).filter("y IS NOT NULL")
