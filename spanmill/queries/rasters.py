"""Rasters: halos, slices, pasting, resizing, augmentation, labels, weights, losses near edges, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import augment, components, contours, distance, grid, match, metrics, rle, tta
from spanmill.plans.session import shared_path
from spanmill.queries.base import R2D, Registry, hashed_unit, r2d, rnd
from spanmill.queries.tiles import _SLIDES, _STATS, _components_sql, _t, slides
from spanmill.sources import chunks

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query

_PLACES = "CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"


def _places(df, *columns):
    return df.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *columns)


@query(f"WITH {_SLIDES}, n AS (SELECT *, h // 8 + 1 AS ny, w // 8 + 1 AS nx FROM slides) SELECT slide, ty, tx, least(ty * 8, h) AS y0, least(ty * 8 + 8, h) AS y1, least(tx * 8, w) AS x0, least(tx * 8 + 8, w) AS x1, greatest(ty * 8 - 2, 0) AS qy0, least(ty * 8 + 10, h) AS qy1, greatest(tx * 8 - 2, 0) AS qx0, least(tx * 8 + 10, w) AS qx1 FROM n, range(9) AS a(ty), range(9) AS b(tx) WHERE ty < ny AND tx < nx")
def grid_halo(spark, sf):
    return _t(grid.grid_halo(slides(spark, sf), 12, 2), "y0", "y1", "x0", "x1", "qy0", "qy1", "qx0", "qx1")


@query(f"WITH {_SLIDES} SELECT slide, ty, tx, CAST(floor((ty + 0.5) * 8) AS BIGINT) AS cy, CAST(floor((tx + 0.5) * 8) AS BIGINT) AS cx, ty * 8 AS y0, least(ty * 8 + 8, h) AS y1, tx * 8 AS x0, least(tx * 8 + 8, w) AS x1, least(ty * 8 + 8, h) - ty * 8 AS iy, least(tx * 8 + 8, w) - tx * 8 AS ix FROM slides, range(9) AS a(ty), range(9) AS b(tx) WHERE ty * 8 < h AND tx * 8 < w")
def grid_slices(spark, sf):
    return _t(grid.grid_slices(slides(spark, sf), 12, 4), "cy", "cx", "y0", "y1", "x0", "x1", "iy", "ix")


@query(f"WITH {R2D} SELECT r.slide, CAST(r.y AS BIGINT) AS y, CAST(r.x AS BIGINT) AS x, CAST(coalesce(b.val, r.val) AS BIGINT) AS val FROM r2d r LEFT JOIN r2d b ON b.slide = r.slide AND b.y = r.y - 18 + 2 AND b.x = r.x + 2 + 3 AND r.y BETWEEN 18 AND 23 AND r.x + 2 BETWEEN 0 AND 5")
def block_paste(spark, sf):
    """A block cropped at (2, 3) and pasted at (18, -2): what passes the border is cut off."""
    px = r2d(spark, sf)
    block = grid.crop(px, F.lit(2), F.lit(3), 6).select("slide", "y", "x", "val")
    return _places(grid.paste(px.select("slide", "y", "x", "val"), block, F.lit(18), F.lit(-2), "val"), F.col("val").cast("long").alias("val"))


_REDUCED = f"WITH {R2D}, rr AS (SELECT slide, y // 2 AS y, x // 2 AS x, avg(val) AS val, any_value((h + 1) // 2) AS h, any_value((w + 1) // 2) AS w FROM r2d GROUP BY 1, 2, 3), t AS (SELECT slide, ty, tx, least(ty * 3, h - 4) AS y0, least(tx * 3, w - 4) AS x0 FROM (SELECT DISTINCT slide, h, w FROM rr), range(9) AS a(ty), range(9) AS b(tx) WHERE ty * 3 < h AND tx * 3 < w), p AS (SELECT r.slide, r.y, r.x, v AS tta, CASE WHEN least(r.y - y0 + 1, 4 - (r.y - y0), r.x - x0 + 1, 4 - (r.x - x0)) = 2 THEN 1e0 ELSE 0.001e0 END AS wt, r.val / 255.0 * (1 + (ty + tx) % 3 / 10.0 + v / 7.0) AS p FROM rr r JOIN t ON r.slide = t.slide AND r.y BETWEEN y0 AND y0 + 3 AND r.x BETWEEN x0 AND x0 + 3, range(3) AS k(v))"


@query(_REDUCED + f" SELECT slide, {_PLACES}, round(sum(p * wt) / sum(wt), 6) AS p FROM p GROUP BY 1, 2, 3")
def stitch_reduced_tta(spark, sf):
    """Predictions of overlapping tiles and three variants at half resolution."""
    half = grid.downscale_area(r2d(spark, sf), 2, "val").join(slides(spark, sf), "slide")
    sized = half.withColumn("h", F.floor((F.col("h") + 1) / 2)).withColumn("w", F.floor((F.col("w") + 1) / 2))
    tiled = grid.covering_tiles(sized, 4, 3).withColumn("tta", F.explode(F.sequence(F.lit(0), F.lit(2))))
    predicted = tiled.withColumn("p", F.col("val") / 255.0 * (1 + (F.col("ty") + F.col("tx")) % 3 / 10.0 + F.col("tta") / 7.0))
    return _places(grid.stitch_variants(predicted, grid.pyramid_weight(F.col("dy"), F.col("dx"), 4), "tta"), rnd(F.col("p")).alias("p"))


@query(f"WITH {_SLIDES}, {R2D}, o AS (SELECT slide, y, x, CAST(floor(y * h / 10.0) AS BIGINT) AS sy, CAST(floor(x * w / 12.0) AS BIGINT) AS sx FROM slides, range(10) AS a(y), range(12) AS b(x)) SELECT o.slide, o.y, o.x, CAST(val AS BIGINT) AS val FROM o JOIN r2d r ON r.slide = o.slide AND r.y = sy AND r.x = sx")
def resize_nearest(spark, sf):
    return grid.resize_nearest(r2d(spark, sf), slides(spark, sf), 10, 12, "val").withColumn("val", F.col("val").cast("long"))


_LINEAR = f"WITH {_SLIDES}, {R2D}, o AS (SELECT slide, y, x, least(greatest((y + 0.5) * h / 10.0 - 0.5, 0), h - 1.0) AS fy, least(greatest((x + 0.5) * w / 12.0 - 0.5, 0), w - 1.0) AS fx FROM slides, range(10) AS a(y), range(12) AS b(x)), f AS (SELECT *, CAST(floor(fy) AS BIGINT) + dy AS sy, CAST(floor(fx) AS BIGINT) + dx AS sx, abs(1 - dy - (fy - floor(fy))) * abs(1 - dx - (fx - floor(fx))) AS wt FROM o, range(2) AS c(dy), range(2) AS d(dx))"


@query(_LINEAR + " SELECT f.slide, f.y, f.x, round(sum(wt * coalesce(val, 0)), 6) AS val FROM f LEFT JOIN r2d r ON r.slide = f.slide AND r.y = sy AND r.x = sx GROUP BY 1, 2, 3")
def resize_bilinear(spark, sf):
    return grid.resize_bilinear(r2d(spark, sf), slides(spark, sf), 10, 12, "val").withColumn("val", rnd(F.col("val")))


@query(f"WITH {R2D} SELECT slide, y // 8 AS ty, x // 8 AS tx, count(*) FILTER (WHERE val > 40) <= 20 OR sum(val) <= 20 AS background FROM r2d GROUP BY 1, 2, 3")
def tile_background(spark, sf):
    tiles = r2d(spark, sf).groupBy("slide", F.floor(F.col("y") / 8).cast("long").alias("ty"), F.floor(F.col("x") / 8).cast("long").alias("tx"))
    sums = tiles.agg(F.count_if(F.col("val") > 40).alias("bright"), F.sum("val").alias("total"))
    return sums.select("slide", "ty", "tx", grid.is_background(F.col("bright"), F.col("total"), 20).alias("background"))


@query(_STATS + f" SELECT slide, ty, tx, (mean < 10 OR (mean > 205 AND std < 20) OR dark > 6.4) AND {hashed_unit(5, 'slide', 'ty', 'tx')} > 0.05 AS rejected FROM s")
def tile_rejection(spark, sf):
    """Dark tiles go, but for one in twenty, chosen by a hash."""
    s = grid.tile_stats(r2d(spark, sf), 8)
    return s.select("slide", "ty", "tx", grid.is_rejected(F.col("mean"), F.col("std"), F.col("dark"), F.lit(64), augment.unit(5, "slide", "ty", "tx")).alias("rejected"))


@query(f"WITH {R2D}, v AS (SELECT slide, y, x, val, f * 4 + r AS tta, CASE r WHEN 0 THEN y WHEN 1 THEN w - 1 - CASE WHEN f = 1 THEN w - 1 - x ELSE x END WHEN 2 THEN h - 1 - y ELSE CASE WHEN f = 1 THEN w - 1 - x ELSE x END END AS ay FROM r2d, range(2) AS a(f), range(4) AS b(r)), p AS (SELECT *, val * (1 + ay / 50.0 + tta / 10.0) AS p FROM v) SELECT slide, {_PLACES}, round(avg(p), 6) AS mean, round(max(p), 6) AS max, round(stddev_samp(p), 6) AS std FROM p GROUP BY 1, 2, 3")
def tta_d4_merge(spark, sf):
    """The eight transforms of the square: a prediction that depends on the place in each, taken back and merged."""
    own = tta.augmented(r2d(spark, sf), tta.D4).withColumn("p", F.col("val") * (1 + F.col("y") / 50.0 + F.col("tta") / 10.0))
    return tta.merged(own, tta.D4, "p").select("slide", "y", "x", *[rnd(F.col(c)).alias(c) for c in ("mean", "max", "std")])


@query(f"WITH {R2D} SELECT slide, v AS tta, {_PLACES}, CAST(val AS BIGINT) AS val FROM r2d, range(16) AS k(v)")
def tta_inverse_is_identity(spark, sf):
    """Both flips and all quarter turns, there and back: every variant is the image again."""
    all_of = (tta.HFLIP, tta.VFLIP, tta.ROT90)
    return _places(tta.deaugmented(tta.augmented(r2d(spark, sf), all_of), all_of), F.col("tta").cast("long").alias("tta"), F.col("val").cast("long").alias("val"))


@query(_components_sql(True).split(", s AS (")[0] + ", z AS (SELECT DISTINCT slide, h, w FROM r2d), e2 AS (SELECT l.slide, label, count(*) AS area, bool_or(k // 100 = 0 OR k % 100 = 0 OR k // 100 = w - 1 OR k % 100 = h - 1) AS edge FROM l JOIN z USING (slide) GROUP BY 1, 2) SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY label) AS label, area FROM e2 WHERE NOT edge AND area >= 3")
def label_mask_cleared(spark, sf):
    """8-connected components of three pixels or more, none at the border, numbered from 1."""
    labelled = components.label_mask(r2d(spark, sf).filter("mask = 1"), slides(spark, sf), 3, True)
    return labelled.groupBy("slide", "label").agg(F.sum(F.col("hi") - F.col("lo")).alias("area"))


@query(_components_sql(False, "slide, row_number() OVER (PARTITION BY slide ORDER BY label) AS label, CAST(greatest(lft - 1, 0) AS BIGINT) AS x0, CAST(lft + width - 1 AS BIGINT) AS x1, CAST(greatest(top - 1, 0) AS BIGINT) AS y0, CAST(top + height - 1 AS BIGINT) AS y1"))
def contour_boxes(spark, sf):
    """The boxes of the contours of 4-connected components, coordinates truncated."""
    runs = components.relabelled(components.label_runs(components.column_runs(r2d(spark, sf).filter("mask = 1")), 4))
    rings = contours.contours(components.label_pixels(runs))
    end = lambda f, k: f(F.transform("ring", lambda p: p[k])).cast("long")
    return rings.select("slide", "label", end(F.array_min, "x").alias("x0"), end(F.array_max, "x").alias("x1"), end(F.array_min, "y").alias("y0"), end(F.array_max, "y").alias("y1"))


_LABELS = f"WITH {R2D}, l AS (SELECT slide, y, x, CASE WHEN mask = 1 THEN 1 + val % 3 ELSE 0 END AS label FROM r2d)"


@query(_LABELS + f", n AS (SELECT a.slide, a.y, a.x, bool_or(b.label > 0 AND b.label <> a.label) AS touching FROM l a JOIN l b ON a.slide = b.slide AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3) SELECT slide, {_PLACES}, CAST(CASE WHEN label > 0 AND touching THEN 0 ELSE label END AS BIGINT) AS label FROM l JOIN n USING (slide, y, x)")
def instance_ridge(spark, sf):
    """Background between touching instances."""
    labels = r2d(spark, sf).withColumn("label", F.when(F.col("mask") == 1, 1 + F.col("val") % 3).otherwise(0))
    return _places(contours.ridge(labels), F.col("label").cast("long").alias("label"))


_SPOTS = f"WITH {R2D}, l AS (SELECT slide, y, x, CASE WHEN val < 6 THEN val + 1 ELSE 0 END AS label FROM r2d)"


@query(_SPOTS + """, d AS (SELECT a.slide, a.y, a.x, b.label % 2 AS cls, b.label, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM l a JOIN l b ON a.slide = b.slide AND b.label > 0 GROUP BY 1, 2, 3, 4, 5),
  k AS (SELECT *, row_number() OVER (PARTITION BY slide, y, x, cls ORDER BY d) AS k FROM d),
  c AS (SELECT slide, y, x, cls, sum(CASE WHEN k <= 2 THEN d END) AS s, count(*) AS n, sum(exp(-d * d / 50)) AS near FROM k GROUP BY 1, 2, 3, 4),
  t AS (SELECT slide, y, x, sum(CASE WHEN n > 1 THEN 10 * exp(-(s * s) / 18) ELSE 0 END) AS border, sum(near) AS near FROM c GROUP BY 1, 2, 3)
SELECT l.slide, CAST(l.y AS BIGINT) AS y, CAST(l.x AS BIGINT) AS x, round(CASE WHEN (l.y + l.x) % 23 = 5 THEN 0 WHEN l.label > 0 THEN 1 ELSE 0.1 + coalesce(border, 0) + 0.9 * coalesce(near, 0) END, 6) AS weight,
  CASE WHEN (l.y + l.x) % 23 = 5 THEN 0.0 WHEN l.label > 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS chance FROM l LEFT JOIN t USING (slide, y, x)""")
def distance_weights(spark, sf):
    """Weights by the nearest two objects of each of two classes, at any range; some pixels ignored."""
    label = F.when(F.col("val") < 6, F.col("val") + 1).otherwise(0)
    labels = r2d(spark, sf).withColumn("label", label).withColumn("cls", F.col("label") % 2).withColumn("ignored", (F.col("y") + F.col("x")) % 23 == 5)
    return distance.distance_weights(labels, 10.0, 3.0, 5.0, cls="cls", ignored="ignored").withColumn("weight", rnd(F.col("weight")))


@query(_SPOTS + ", a AS (SELECT slide, y, x FROM l WHERE label % 2 = 1), b AS (SELECT slide, y, x FROM l WHERE label > 0 AND label % 2 = 0) SELECT slide, round(max(d), 6) AS distance FROM (SELECT a.slide, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM a LEFT JOIN b ON a.slide = b.slide GROUP BY 1, 2, 3) GROUP BY slide")
def hausdorff_pixels(spark, sf):
    """The directed Hausdorff distance between two sets of pixels of each slide."""
    px = r2d(spark, sf).filter("val < 6").select("slide", "y", "x", "val")
    far = distance.directed_hausdorff(px.filter("val % 2 = 0"), px.filter("val % 2 = 1"), ["slide"])
    return far.select("slide", rnd(F.col("distance")).alias("distance"))


@query(f"WITH {R2D}, a AS (SELECT slide, y, x, mask AS v FROM r2d), b AS (SELECT slide, y, x, CASE WHEN (val + slide) % 9 < 4 AND y % 6 > 0 THEN 1 ELSE 0 END AS v FROM r2d), d AS (SELECT a.slide, a.y, b.y AS other, sum(abs(a.v - b.v)) AS d FROM a JOIN b ON a.slide = b.slide AND a.x = b.x GROUP BY 1, 2, 3) SELECT slide, round(sqrt(max(d)), 6) AS distance FROM (SELECT slide, y, min(d) AS d FROM d GROUP BY 1, 2) GROUP BY slide")
def hausdorff_rows(spark, sf):
    """The directed Hausdorff distance between two masks of each slide, their rows taken as points."""
    px = r2d(spark, sf)
    runs = lambda own: rle.encode_spans(own.select("slide", "y", "x"), ["slide", "y"], "x")
    other = px.filter(((F.col("val") + F.col("slide")) % 9 < 4) & (F.col("y") % 6 > 0))
    far = distance.row_hausdorff(runs(px.filter("mask = 1")), runs(other), slides(spark, sf), ["slide"])
    return far.select("slide", rnd(F.col("distance")).alias("distance"))


@query()
def label_mask_watershed(spark, sf):
    """Labelled masks whose components are split at their waists; an iteration, so without SQL: tests compare it with one flood of a whole image."""
    px = r2d(spark, sf)
    labelled = components.label_mask(px.filter("val % 5 > 0"), slides(spark, sf), 12, do_watershed=True)
    return labelled.groupBy("slide", "label").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("area"))


@query(f"WITH {R2D} SELECT slide, {_PLACES}, CAST(k AS INT) AS cls, CAST(val % 4 = k AS INT) AS hot FROM r2d, range(4) AS r(k)")
def one_hot_planes(spark, sf):
    return _places(grid.one_hot(r2d(spark, sf).withColumn("label", F.col("val") % 4), "label", 4), "cls", "hot")


@query(f"WITH {R2D} SELECT a.slide, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, CAST(b.val AS BIGINT) AS turned, CAST(c.val AS BIGINT) AS mirrored FROM r2d a JOIN r2d b ON b.slide = a.slide AND b.y = a.h - 1 - a.y AND b.x = a.w - 1 - a.x JOIN r2d c ON c.slide = a.slide AND c.y = a.y AND c.x = a.w - 1 - a.x")
def remap_nearest(spark, sf):
    """A half turn about the centre and a mirror image, by displacement fields."""
    px = r2d(spark, sf)
    turned = augment.remap(px, augment.rotation(px, 180.0, (F.col("h") - 1) / 2, (F.col("w") - 1) / 2), "val").withColumnRenamed("val", "turned")
    mirrored = augment.remap(px, augment.mirror(px), "val").withColumnRenamed("val", "mirrored")
    return _places(turned.join(mirrored, ["slide", "y", "x"]), F.col("turned").cast("long").alias("turned"), F.col("mirrored").cast("long").alias("mirrored"))


@query(f"WITH {R2D} SELECT a.slide, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, round(sum(CASE WHEN b.y = a.y THEN 0.5 ELSE 0.5 END * CASE WHEN b.x = a.x THEN 0.75 ELSE 0.25 END * b.val), 6) AS val FROM r2d a JOIN r2d b ON b.slide = a.slide AND b.y - a.y BETWEEN 0 AND 1 AND b.x - a.x BETWEEN 0 AND 1 GROUP BY 1, 2, 3")
def remap_bilinear(spark, sf):
    px = r2d(spark, sf)
    return _places(augment.remap_bilinear(px, px.withColumn("dy", F.lit(0.5)).withColumn("dx", F.lit(0.25)), "val"), rnd(F.col("val")).alias("val"))


_OPEN = f"WITH {R2D}, a AS (SELECT slide, y, x, min(val) OVER (PARTITION BY slide, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM r2d), b AS (SELECT slide, y, x, min(v) OVER (PARTITION BY slide, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM a), c AS (SELECT slide, y, x, max(v) OVER (PARTITION BY slide, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM b), d AS (SELECT slide, max(v) OVER (PARTITION BY slide, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM c)"


@query(_OPEN + " SELECT slide, CASE WHEN count(*) FILTER (WHERE v > 60) <= 0.2 * count(*) THEN count(*) FILTER (WHERE v > 60) END AS spot FROM d GROUP BY slide")
def light_spots(spark, sf):
    return augment.light_spots(r2d(spark, sf), "val", 60, 0.2)


_PARTNERS = f"WITH {R2D}, i AS (SELECT s_suppkey AS slide, row_number() OVER (ORDER BY {hashed_unit(4, 's_suppkey')}, s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier), q AS (SELECT a.slide, b.slide AS partner FROM i a JOIN i b ON b.k = (a.k + 1) % a.n)"


@query(_PARTNERS + " SELECT r.slide, CAST(r.y AS BIGINT) AS y, CAST(r.x AS BIGINT) AS x, round(0.7 * r.val + 0.3 * o.val, 6) AS mixed FROM r2d r JOIN q USING (slide) JOIN r2d o ON o.slide = partner AND o.y = r.y AND o.x = r.x")
def mixup_pixels(spark, sf):
    px = r2d(spark, sf)
    mixed = augment.mixup(px, augment.partners(slides(spark, sf), "slide", 4), "val", 0.7)
    return _places(mixed, rnd(F.col("val")).alias("mixed"))


@query(_PARTNERS + " SELECT r.slide, CAST(r.y AS BIGINT) AS y, CAST(r.x AS BIGINT) AS x, CAST(CASE WHEN r.y BETWEEN 3 AND 8 AND r.x BETWEEN 2 AND 7 THEN o.val ELSE r.val END AS BIGINT) AS mixed, CAST(CASE WHEN r.y BETWEEN 3 AND 8 AND r.x BETWEEN 2 AND 7 THEN 0 ELSE r.val END AS BIGINT) AS cut FROM r2d r JOIN q USING (slide) LEFT JOIN r2d o ON o.slide = partner AND o.y = r.y AND o.x = r.x")
def cutmix_cutout(spark, sf):
    px, box = r2d(spark, sf), (3, 9, 2, 8)
    mixed = augment.cutmix(px, augment.partners(slides(spark, sf), "slide", 4), "val", box).withColumnRenamed("val", "mixed")
    cut = augment.cutout(px, "val", box).select("slide", "y", "x", F.col("val").alias("cut"))
    return _places(mixed.join(cut, ["slide", "y", "x"]), F.col("mixed").cast("long").alias("mixed"), F.col("cut").cast("long").alias("cut"))


_EDGE = f"WITH {R2D}, a AS (SELECT slide, y, x, mask AS t, (val - 128) / 64.0 AS l, sum(mask) OVER (PARTITION BY slide, y ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s FROM r2d), b AS (SELECT *, t - sum(s) OVER (PARTITION BY slide, x ORDER BY y RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 225.0 AS d FROM a), c AS (SELECT slide, greatest(l, 0) - l * t + ln(1 + exp(-abs(l))) AS e, CAST(d < -1e-4 AS INT) AS u, CAST(d > 1e-4 AS INT) AS o FROM b)"


@query(_EDGE + " SELECT slide, round(CASE WHEN sum(u) > 0 AND sum(o) > 0 THEN sum((1 + u + o) * e) / sum(1 + u + o) ELSE 0 END, 6) AS single, round(CASE WHEN sum(u) > 0 AND sum(o) > 0 THEN sum((1 + 2 * u + o) * e) / sum(1 + 2 * u + o) ELSE 0 END, 6) AS double, round(CASE WHEN sum(u) > 0 AND sum(o) > 0 THEN sum((u + o) * e) / sum(u + o) ELSE 0 END, 6) AS edge FROM c GROUP BY slide")
def edge_loss(spark, sf):
    px = r2d(spark, sf).withColumn("logit", (F.col("val") - 128) / 64.0)
    own = [metrics.edge_loss(px, "logit", "mask", m).select("slide", rnd(F.col("loss")).alias(m)) for m in ("single", "double", "edge")]
    return own[0].join(own[1], "slide").join(own[2], "slide")


@query(f"WITH {R2D} SELECT {_PLACES}, CAST(val AS BIGINT) AS v FROM r2d WHERE slide = 1 AND y BETWEEN 5 AND 13 AND x BETWEEN 6 AND 14")
def chunk_window(spark, sf):
    """Rasters written as chunks by group, and a window read back from the chunks it touches."""
    path = shared_path(spark, "chunks")
    px = r2d(spark, sf)
    chunks.write_chunks(px.select("slide", F.lit("val").alias("grp"), "y", "x", F.col("val").alias("v")).unionByName(px.select("slide", F.lit("mask").alias("grp"), "y", "x", F.col("mask").alias("v"))), path, "v", 8)
    return chunks.read_window(spark, path, "val", 1, 5, 6, 9, 8).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


@query(f"WITH {R2D} SELECT slide, CAST(k AS BIGINT) AS band, CAST(CASE WHEN slide % 2 = 0 AND h = w THEN x ELSE y END AS BIGINT) AS y, CAST(CASE WHEN slide % 2 = 0 AND h = w THEN y ELSE x END AS BIGINT) AS x, CAST(floor(val * (k + 1) % 200 * 255.0 / 199) AS BIGINT) AS v, CAST(mask AS BIGINT) AS cls, format('{{}}_{{:04d}}.png', slide, y // 8 * 4 + x // 8) AS tile FROM r2d, range(2) AS r(k)")
def raster_ingest(spark, sf):
    """Bands kept apart and stacked, axes repaired by the sizes known, values scaled, classes checked, tiles named."""
    px = r2d(spark, sf)
    wrong = F.col("slide") % 2 == 0  # these come with their axes exchanged
    tile = chunks.tile_names(F.col("slide").cast("string"), (F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 8)).cast("int"))
    bands = [px.select("slide", F.when(wrong, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(wrong, F.col("y")).otherwise(F.col("x")).alias("x"), (F.col("val") * (k + 1) % 200).alias("v"), F.col("mask").alias("cls"), tile.alias("tile")) for k in (0, 1)]
    whole = chunks.checked_classes(chunks.turned(chunks.stacked_bands(bands), slides(spark, sf)), "cls", 2)
    return _places(whole, F.col("band").cast("long").alias("band"), chunks.scaled(F.col("v"), 199).cast("long").alias("v"), F.col("cls").cast("long").alias("cls"), "tile")


@query(f"WITH {R2D}, p AS (SELECT slide, val // 64 AS a, (val + 32) // 64 % 4 AS b FROM r2d WHERE mask = 1), i AS (SELECT slide, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3), na AS (SELECT slide, a, count(*) AS na FROM p GROUP BY 1, 2), nb AS (SELECT slide, b, count(*) AS nb FROM p GROUP BY 1, 2) SELECT slide, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, round(n / CAST(na + nb - n AS DOUBLE), 6) AS iou FROM i JOIN na USING (slide, a) JOIN nb USING (slide, b)")
def label_pair_iou(spark, sf):
    """IoU of all pairs of labels that share pixels."""
    px = r2d(spark, sf).filter("mask = 1")
    runs = lambda label: rle.encode_spans(px.withColumn("label", label.cast("int")), ["slide", "x", "label"], "y")
    pairs = match.label_iou(runs(F.floor(F.col("val") / 64)), runs(F.floor((F.col("val") + 32) / 64) % 4))
    return pairs.select("slide", "a", "b", rnd(F.col("iou")).alias("iou"))


def _texts(spark, sf):
    """Masks of the rasters as texts, column by column."""
    px = r2d(spark, sf).filter("mask = 1")
    spans = rle.encode_spans(px.select("slide", rle.to_pos(F.col("y"), F.col("x"), F.col("h")).alias("pos")), ["slide"])
    return rle.spans_to_text(spans, ["slide"])


@query(f"WITH {R2D} SELECT slide, {_PLACES}, CAST(255 AS INT) AS value FROM r2d WHERE mask = 1")
def rle_decode_yx(spark, sf):
    """Texts in column-major order decoded to rows and columns, 255 where set."""
    sized = rle.positions(rle.text_to_spans(_texts(spark, sf), "rle", ["slide"]), ["slide"]).join(slides(spark, sf), "slide")
    at = rle.to_yx(F.col("pos"), F.col("h"))
    return sized.select("slide", at["y"].alias("y"), at["x"].alias("x"), F.lit(255).alias("value"))


@query(f"WITH {_SLIDES}, {R2D}, o AS (SELECT slide, x * 10 + y AS pos, CAST(floor(y * h / 10.0) AS BIGINT) AS sy, CAST(floor(x * w / 12.0) AS BIGINT) AS sx FROM slides, range(10) AS a(y), range(12) AS b(x)), p AS (SELECT o.slide, pos, pos - row_number() OVER (PARTITION BY o.slide ORDER BY pos) AS g FROM o JOIN r2d r ON r.slide = o.slide AND r.y = sy AND r.x = sx WHERE mask = 1), runs AS (SELECT slide, min(pos) AS lo, count(*) AS n FROM p GROUP BY slide, g) SELECT slide, CASE WHEN sum(n) <= 44 THEN '' ELSE string_agg(lo + 1 || ' ' || n, ' ' ORDER BY lo) END AS rle FROM runs GROUP BY slide")
def rle_encode_resized(spark, sf):
    """Masks resized to 10 x 12, encoded, small ones empty."""
    small = grid.resize_nearest(r2d(spark, sf), slides(spark, sf), 10, 12, "mask").filter("mask = 1")
    return rle.encode_resized(small, ["slide"], 10, 44)


@query(_components_sql(False))
def rle_table_objects(spark, sf):
    """A table of RLE texts to objects: vertical runs from the spans, components, their boxes; no pixels in between."""
    spans = rle.text_to_spans(_texts(spark, sf), "rle", ["slide"]).join(slides(spark, sf), "slide")
    runs = rle.column_spans(spans, ["slide"], F.col("h"))
    stats = components.component_stats(components.label_runs(runs, 4))
    return stats.select("slide", F.col("area").cast("long").alias("area"), F.col("left").alias("lft"), F.col("top").cast("long").alias("top"), "width", F.col("height").cast("long").alias("height"), rnd(F.col("cy")).alias("cy"), rnd(F.col("cx")).alias("cx"))


def _spline(t: str) -> str:
    return f"list_value((1 - {t}) ** 3 / 6, (3 * {t} ** 3 - 6 * {t} ** 2 + 4) / 6, (3 * (1 - {t}) ** 3 - 6 * (1 - {t}) ** 2 + 4) / 6, {t} ** 3 / 6)"


def _normal(seed: int) -> str:
    return f"sqrt(-2 * ln(1 - {hashed_unit(seed, 'slide', 'i', 'j')})) * cos(2 * pi() * {hashed_unit(seed + 1, 'slide', 'i', 'j')})"


@query(f"""WITH {R2D}, n AS (SELECT slide, i, j, 1.5e0 * {_normal(21)} AS ny, 1.5e0 * {_normal(23)} AS nx FROM (SELECT DISTINCT slide FROM r2d), range(-1, 6) AS a(i), range(-1, 6) AS b(j)),
  p AS (SELECT *, {_spline('(y / 8e0 - y // 8)')} AS sy, {_spline('(x / 8e0 - x // 8)')} AS sx FROM r2d),
  d AS (SELECT p.slide, p.y, p.x, any_value(h) AS h, any_value(w) AS w, sum(sy[i - y // 8 + 2] * sx[j - x // 8 + 2] * ny) AS dy, sum(sy[i - y // 8 + 2] * sx[j - x // 8 + 2] * nx) AS dx
    FROM p JOIN n ON n.slide = p.slide AND i BETWEEN y // 8 - 1 AND y // 8 + 2 AND j BETWEEN x // 8 - 1 AND x // 8 + 2 GROUP BY 1, 2, 3),
  f AS (SELECT slide, y, x, h, w, (h - 1) / 2e0 + (y - (h - 1) / 2e0) * cos(radians(20)) + (x - (w - 1) / 2e0) * sin(radians(20)) + dy AS fy,
    (w - 1) / 2e0 - ((x - (w - 1) / 2e0) * cos(radians(20)) - (y - (h - 1) / 2e0) * sin(radians(20))) + dx AS fx FROM d),
  q AS (SELECT slide, y, x, (CASE a WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE b WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS wt,
    ((CAST(floor(fy) AS BIGINT) + a) % (2 * h) + 2 * h) % (2 * h) AS my, ((CAST(floor(fx) AS BIGINT) + b) % (2 * w) + 2 * w) % (2 * w) AS mx, h, w FROM f, range(2) AS u(a), range(2) AS v(b))
SELECT q.slide, CAST(q.y AS BIGINT) AS y, CAST(q.x AS BIGINT) AS x, round(sum(wt * r.val), 3) AS val FROM q JOIN r2d r ON r.slide = q.slide AND r.y = least(my, 2 * q.h - 1 - my) AND r.x = least(mx, 2 * q.w - 1 - mx) GROUP BY 1, 2, 3""")
def elastic_deformation(spark, sf):
    """Rasters turned by 20 degrees, mirrored and displaced by splines over hashed nodes, in one field; edges reflect."""
    px = r2d(spark, sf)
    field = augment.elastic(px.select("slide", "y", "x", "h", "w"), 8, 1.5, 21, degrees=20.0, horizontal=True)
    return _places(augment.sampled_reflected(px, field, "val"), F.round("val", 3).alias("val"))


@query(f"WITH {R2D}, f AS (SELECT slide, y, x, y + 1.5 * sin(x * (2 * pi() / 9) + 2 * pi() * {hashed_unit(3, 'slide')}) AS fy, x + 1.5 * sin(y * (2 * pi() / 9) + 2 * pi() * {hashed_unit(4, 'slide')}) AS fx FROM r2d) SELECT f.slide, CAST(f.y AS BIGINT) AS y, CAST(f.x AS BIGINT) AS x, round(coalesce(sum((1 - abs(fy - b.y)) * (1 - abs(fx - b.x)) * b.val), 0), 4) AS val FROM f LEFT JOIN r2d b ON b.slide = f.slide AND abs(fy - b.y) < 1 AND abs(fx - b.x) < 1 GROUP BY 1, 2, 3")
def remap_wave(spark, sf):
    """A smooth displacement of its own for each slide, linear between pixels."""
    px = r2d(spark, sf)
    return _places(augment.remap_bilinear(px, augment.wave(px, 3, 1.5, 9.0), "val"), F.round("val", 4).alias("val"))


@query(_STATS + ", m AS (SELECT slide, y // 8 AS ty, x // 8 AS tx, x % 8 * 8 + y % 8 AS pos FROM r2d WHERE mask = 1), g AS (SELECT *, pos - row_number() OVER (PARTITION BY slide, ty, tx ORDER BY pos) AS g FROM m), r AS (SELECT slide, ty, tx, min(pos) AS lo, count(*) AS n FROM g GROUP BY slide, ty, tx, g), t AS (SELECT slide, ty, tx, string_agg(lo + 1 || ' ' || n, ' ' ORDER BY lo) AS rle FROM r GROUP BY 1, 2, 3) SELECT s.slide, s.ty, s.tx, format('{}_{:04d}_{:04d}', s.slide, s.ty, s.tx) AS name, masked, round(masked / 64.0, 6) AS ratio, round(std, 6) AS std, rle, n AS pixels FROM s LEFT JOIN t USING (slide, ty, tx)")
def tile_writer(spark, sf):
    """Tiles written with their masks, their statistics, and how many pixels each file row holds when it is read."""
    stats = chunks.write_tiles(r2d(spark, sf), path := shared_path(spark, "tiles"), 8)
    read = spark.read.parquet(path).select("slide", "ty", "tx", F.size("px").cast("long").alias("pixels"))
    own = stats.withColumn("ratio", rnd(F.col("ratio"))).withColumn("std", rnd(F.col("std")))
    return own.join(read.withColumn("slide", F.col("slide").cast("long")), ["slide", "ty", "tx"])
