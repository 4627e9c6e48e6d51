"""Rasters: grids, tile statistics, stitching, test-time augmentation, components, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanmill.operators import components, ensemble, grid, pixels, tta
from spanmill.queries.base import R2D, Registry, r2d, rnd

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query

_SLIDES = "slides AS (SELECT s_suppkey AS slide, 20 + s_suppkey % 7 AS h, 20 + s_suppkey % 5 AS w FROM supplier)"


def slides(spark, sf):
    from spanmill.plans.session import table

    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("slide"), (20 + k % 7).cast("long").alias("h"), (20 + k % 5).cast("long").alias("w"))


def _t(df, *columns):
    return df.select("slide", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), *columns)


_BOX = ("y0", "y1", "x0", "x1")


@query(f"WITH {_SLIDES}, n AS (SELECT *, h // 8 + 1 AS ny, w // 8 + 1 AS nx FROM slides) SELECT slide, ty, tx, least(ty * 8, h) AS y0, least(ty * 8 + 8, h) AS y1, least(tx * 8, w) AS x0, least(tx * 8 + 8, w) AS x1 FROM n, range(9) AS a(ty), range(9) AS b(tx) WHERE ty < ny AND tx < nx")
def grid_padded(spark, sf):
    return _t(grid.grid_padded(slides(spark, sf), 8), *_BOX)


@query(f"WITH {_SLIDES}, n AS (SELECT *, h // 8 + 1 - CASE WHEN h % 8 < 4 THEN 1 ELSE 0 END AS ny, w // 8 + 1 - CASE WHEN w % 8 < 4 THEN 1 ELSE 0 END AS nx FROM slides) SELECT slide, ty, tx, least(ty * 8 + 4, h) AS y0, least(ty * 8 + 12, h) AS y1, least(tx * 8 + 4, w) AS x0, least(tx * 8 + 12, w) AS x1 FROM n, range(9) AS a(ty), range(9) AS b(tx) WHERE ty < ny AND tx < nx")
def grid_shifted(spark, sf):
    return _t(grid.grid_padded(slides(spark, sf), 8, 4), *_BOX)


@query(f"WITH {_SLIDES}, n AS (SELECT *, (8 - h % 8) % 8 AS py, (8 - w % 8) % 8 AS px FROM slides) SELECT slide, ty, tx, CAST(floor(-py / 2.0) + ty * 8 AS BIGINT) AS y0, CAST(floor(-py / 2.0) + ty * 8 + 8 AS BIGINT) AS y1, CAST(floor(-px / 2.0) + tx * 8 AS BIGINT) AS x0, CAST(floor(-px / 2.0) + tx * 8 + 8 AS BIGINT) AS x1 FROM n, range(9) AS a(ty), range(9) AS b(tx) WHERE ty < (h + py) // 8 AND tx < (w + px) // 8")
def grid_centred(spark, sf):
    return _t(grid.grid_centred(slides(spark, sf), 8), *_BOX)


@query(f"WITH {_SLIDES} SELECT slide, ty, tx, ty * 8 AS y0, least(ty * 8 + 8, h) AS y1, tx * 8 AS x0, least(tx * 8 + 8, w) AS x1 FROM slides, range(9) AS a(ty), range(9) AS b(tx) WHERE ty * 8 < h AND tx * 8 < w")
def grid_ceil(spark, sf):
    return _t(grid.grid_ceil(slides(spark, sf), 8), *_BOX)


@query(f"WITH {_SLIDES} SELECT slide, ty, tx, least(ty * 5, h - 8) AS y0, least(ty * 5, h - 8) + 8 AS y1, least(tx * 5, w - 8) AS x0, least(tx * 5, w - 8) + 8 AS x1 FROM slides, range(9) AS a(ty), range(9) AS b(tx) WHERE ty * 5 < h AND tx * 5 < w")
def grid_clamped(spark, sf):
    return _t(grid.grid_clamped(slides(spark, sf), 8, 5), *_BOX)


@query(f"WITH {_SLIDES}, n AS (SELECT *, CAST(floor(h / 6.0) + 1 AS BIGINT) AS ny, CAST(floor(w / 6.0) + 1 AS BIGINT) AS nx FROM slides) SELECT slide, ty, tx, CAST(trunc(4.0 + (h - 8) * ty / CAST(ny - 1 AS DOUBLE)) AS BIGINT) AS cy, CAST(trunc(4.0 + (w - 8) * tx / CAST(nx - 1 AS DOUBLE)) AS BIGINT) AS cx FROM n, range(9) AS a(ty), range(9) AS b(tx) WHERE ty < ny AND tx < nx")
def grid_linspace(spark, sf):
    return _t(grid.grid_linspace(slides(spark, sf), 8, 0.75), "cy", "cx")


_STATS = f"WITH {R2D}, s AS (SELECT slide, y // 8 AS ty, x // 8 AS tx, CAST(sum(mask) AS BIGINT) AS masked, sum(val) / 64.0 AS mean, sqrt(greatest(sum(val * val) / 64.0 - power(sum(val) / 64.0, 2), 0)) AS std, count(*) FILTER (WHERE val < 40) AS dark, count(*) AS n FROM r2d GROUP BY ALL)"


@query(_STATS + " SELECT slide, ty, tx, masked, round(masked / 64.0, 6) AS ratio, round(std, 6) AS std, round(mean, 6) AS mean, CAST(least(round_even(masked / 64.0 * 20, 0), 4) AS BIGINT) AS binned, masked > 0 AS is_masked FROM s WHERE std > 10 AND NOT (mean < 10 OR (mean > 205 AND std < 20) OR dark > 0.5 * n)")
def tile_stats_filtered(spark, sf):
    s = grid.tile_stats(r2d(spark, sf), 8)
    kept = s.filter("std > 10 AND NOT (mean < 10 OR (mean > 205 AND std < 20) OR dark > 0.5 * n)")
    return kept.select("slide", "ty", "tx", "masked", rnd(F.col("ratio")).alias("ratio"), rnd(F.col("std")).alias("std"), rnd(F.col("mean")).alias("mean"), F.least(F.bround(F.col("ratio") * 20).cast("long"), F.lit(4).cast("long")).alias("binned"), (F.col("masked") > 0).alias("is_masked"))


@query(_STATS + ", b AS (SELECT CAST(least(round_even(masked / 64.0 * 20, 0), 4) AS BIGINT) AS binned, count(*) AS n FROM s GROUP BY 1) SELECT binned, n, (SELECT min(n) FROM b) AS least, CAST((SELECT trunc(avg(n)) FROM b) AS BIGINT) AS mean FROM b")
def balanced_counts(spark, sf):
    b = grid.tile_stats(r2d(spark, sf), 8).groupBy(F.least(F.bround(F.col("ratio") * 20).cast("long"), F.lit(4).cast("long")).alias("binned")).agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy()  # one row per bin, five at most
    return b.select("binned", "n", F.min("n").over(over).alias("least"), F.avg("n").over(over).cast("long").alias("mean"))


@query(f"WITH {R2D} SELECT slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(val AS BIGINT) AS val FROM r2d")
def stitch_disjoint(spark, sf):
    """Cut into padded tiles, put together again, padding cropped: every pixel comes back, and no other."""
    tiles = grid.cut_tiles(r2d(spark, sf), 8, "val")
    whole = grid.join_tiles(tiles, 8, "val")
    return whole.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("val").cast("long").alias("val"))


@query(f"WITH {R2D}, s AS (SELECT DISTINCT slide, h, w FROM r2d) SELECT s.slide, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(sum(coalesce(val, 0)) AS BIGINT) AS total, CAST(count(val) AS BIGINT) AS filled, CAST(64 AS BIGINT) AS n FROM s JOIN range(4) AS a(ty) ON ty * 8 < h JOIN range(4) AS b(tx) ON tx * 8 < w CROSS JOIN range(8) AS c(dy) CROSS JOIN range(8) AS d(dx) LEFT JOIN r2d r ON r.slide = s.slide AND r.y = ty * 8 + dy AND r.x = tx * 8 + dx GROUP BY 1, 2, 3")
def padded_tiles(spark, sf):
    """The tiles themselves: sums, values of the image, and padding."""
    tiles = grid.cut_tiles(r2d(spark, sf), 8, "val", -1)
    sums = F.aggregate(F.filter("tile", lambda v: v >= 0), F.lit(0).cast("long"), lambda s, v: s + v)
    return tiles.select("slide", "ty", "tx", sums.alias("total"), F.size(F.filter("tile", lambda v: v >= 0)).cast("long").alias("filled"), F.size("tile").cast("long").alias("n"))


_TILES = f"WITH {R2D}, t AS (SELECT slide, ty, tx, least(ty * 5, h - 8) AS y0, least(tx * 5, w - 8) AS x0 FROM (SELECT DISTINCT slide, h, w FROM r2d), range(9) AS a(ty), range(9) AS b(tx) WHERE ty * 5 < h AND tx * 5 < w), p AS (SELECT r.slide, r.y, r.x, r.y - y0 AS dy, r.x - x0 AS dx, r.val / 255.0 * (1 + (ty + tx) % 3 / 10.0) AS p FROM r2d r JOIN t ON r.slide = t.slide AND r.y BETWEEN y0 AND y0 + 7 AND r.x BETWEEN x0 AND x0 + 7)"


def _predicted(spark, sf):
    """Pixels of overlapping tiles, with each tile's own prediction."""
    px = grid.covering_tiles(r2d(spark, sf), 8, 5)
    return px.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "dy", "dx", (F.col("val") / 255.0 * (1 + (F.col("ty") + F.col("tx")) % 3 / 10.0)).alias("p"))


@query(_TILES + ", e AS (SELECT *, ((least(dy + 1, 8 - dy, dx + 1, 8 - dx) / 4e0) ** 2 - 0.0625e0 + 1e-6) / (0.9375e0 + 1e-6) AS v FROM p), w AS (SELECT *, round(least(greatest(CASE WHEN v > 0.8e0 THEN 1e0 ELSE v END / 0.8e0, 1e-3), 1e0), 3) AS w FROM e) SELECT slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(p * w) / sum(w), 6) AS p FROM w GROUP BY ALL")
def stitch_weighted(spark, sf):
    """Overlapping tiles' predictions, weighted less towards the tiles' borders."""
    return grid.stitch(_predicted(spark, sf), grid.pyramid_weight(F.col("dy"), F.col("dx"), 8, 2.0, 0.8)).withColumn("p", rnd(F.col("p")))


@query(_TILES + ", w AS (SELECT *, exp(-((dy - 3.5) ** 2 + (dx - 3.5) ** 2) / 2) AS w FROM p) SELECT slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(p * w) / sum(w), 6) AS p FROM w GROUP BY ALL")
def stitch_gaussian(spark, sf):
    return grid.stitch(_predicted(spark, sf), grid.gaussian_weight(F.col("dy"), F.col("dx"), 8)).withColumn("p", rnd(F.col("p")))


@query(f"WITH {R2D} SELECT slide, CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, round(avg(val), 6) AS val FROM r2d GROUP BY 1, 2, 3")
def downscale_area(spark, sf):
    return grid.downscale_area(r2d(spark, sf), 4, "val").withColumn("val", rnd(F.col("val")))


@query(f"WITH {R2D} SELECT slide, CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, CAST(val AS BIGINT) AS val FROM r2d WHERE y % 4 = 0 AND x % 4 = 0")
def downscale_nearest(spark, sf):
    return grid.downscale_nearest(r2d(spark, sf), 4, "val").withColumn("val", F.col("val").cast("long"))


@query(f"WITH {R2D}, f AS (SELECT slide, y, x, val FROM r2d UNION ALL SELECT slide, h - 1 - y, x, val FROM r2d UNION ALL SELECT slide, y, w - 1 - x, val FROM r2d UNION ALL SELECT slide, h - 1 - y, w - 1 - x, val FROM r2d) SELECT slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(avg(val), 6) AS p FROM f GROUP BY 1, 2, 3")
def tta_flip_mean(spark, sf):
    """Every flip of both axes, turned back, and their mean: one pass over the pixels and one grouping."""
    flips = (tta.VFLIP, tta.HFLIP)
    # the flipped image as it stands is what is averaged, so places are not taken back
    return tta.augmented(r2d(spark, sf), flips).groupBy("slide", "y", "x").agg(rnd(F.avg("val")).alias("p"))


@query(f"WITH {R2D}, b AS (SELECT slide, y // 10 AS by, x // 10 AS bx, avg(ln(1 + exp(val / 255.0))) AS e FROM r2d WHERE y < h // 10 * 10 AND x < w // 10 * 10 GROUP BY 1, 2, 3) SELECT slide, round(max(e), 6) AS energy FROM b GROUP BY slide")
def energy_pool_max(spark, sf):
    """Energy ln(1 + exp(v)) of two logits 0 and v, pooled over full 10 x 10 windows, then the maximum."""
    return ensemble.pooled_max(r2d(spark, sf), F.log1p(F.exp(F.col("val") / 255.0)), 10).select("slide", rnd(F.col("most")).alias("energy"))


@query(f"WITH {R2D}, q AS (SELECT slide, val / CAST(sum(val) OVER (PARTITION BY slide) AS DOUBLE) AS q FROM r2d) SELECT slide, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END), 6) AS entropy FROM q GROUP BY slide")
def map_entropy(spark, sf):
    return ensemble.map_entropy(r2d(spark, sf), ["slide"], "val").withColumn("entropy", rnd(F.col("entropy")))


@query(f"WITH {R2D} SELECT slide, CAST(c AS BIGINT) AS channel, round(avg((val / 255.0 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1]), 6) AS z, round(stddev_pop((val / 255.0 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1]), 6) AS sd FROM r2d, range(3) AS r(c) GROUP BY 1, 2")
def channel_normalise(spark, sf):
    px = r2d(spark, sf).select("slide", "val", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    z = pixels.normalised(F.col("val") / 255.0, F.col("channel"))
    return px.groupBy("slide", F.col("channel").cast("long").alias("channel")).agg(rnd(F.avg(z)).alias("z"), rnd(F.stddev_pop(z)).alias("sd"))


@query(f"WITH {R2D}, s AS (SELECT slide, avg(val) AS m, stddev_pop(val) AS s FROM r2d GROUP BY slide) SELECT r.slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(greatest(least((val - m) / (2 * s), 5), -5), 6) AS z FROM r2d r JOIN s USING (slide)")
def group_zscore_clip(spark, sf):
    return pixels.fitted_zscore(r2d(spark, sf), ["slide"], "val").select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), rnd(F.col("z")).alias("z"))


@query(f"WITH {R2D} SELECT slide, CAST(CASE WHEN sum(CASE WHEN y < 3 AND x < slide % 4 THEN mask ELSE 0 END) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM r2d GROUP BY slide")
def nonempty_label(spark, sf):
    return pixels.nonempty(r2d(spark, sf), ["slide"], F.when((F.col("y") < 3) & (F.col("x") < F.col("slide") % 4), F.col("mask")).otherwise(0))


_PDF = f"WITH {R2D}, p AS (SELECT slide, y * 25 + x AS pos, CASE WHEN y = 0 THEN 0 WHEN mask = 1 THEN 1.0 ELSE 0.1 END AS p FROM r2d), c AS (SELECT slide, pos, CAST(sum(p) OVER (PARTITION BY slide ORDER BY pos ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(p) OVER (PARTITION BY slide) AS DOUBLE) AS cdf FROM p)"


def _cdf(spark, sf):
    px = r2d(spark, sf).withColumn("pos", (F.col("y") * 25 + F.col("x")).cast("long"))
    return grid.sampling_cdf(px, F.when(F.col("y") == 0, 0.0).when(F.col("mask") == 1, 1.0).otherwise(0.1), ["slide"], ["pos"])


@query(_PDF + " SELECT slide, CAST(pos AS BIGINT) AS pos, round(cdf, 6) AS cdf FROM c")
def sampling_cdf(spark, sf):
    return _cdf(spark, sf).select("slide", "pos", rnd(F.col("cdf")).alias("cdf"))


@query(_PDF + " SELECT slide, CAST(min(CASE WHEN cdf > (slide * 7 % 10) / 10.0 + 0.0371 THEN pos END) AS BIGINT) AS pos FROM c GROUP BY slide")
def inverse_cdf_pick(spark, sf):
    return grid.pick(_cdf(spark, sf), ["slide"], "pos", (F.col("slide") * 7 % 10) / 10.0 + 0.0371)


@query(f"WITH {R2D}, c AS (SELECT slide, (y // 7) % 3 AS cls, count(*) AS n FROM r2d GROUP BY 1, 2) SELECT r.slide, CAST((y // 7) % 3 AS BIGINT) AS cls, round(sum(CASE WHEN mask = 1 THEN 0 ELSE [0.1, 0.7, 0.2][(y // 7) % 3 + 1] / n END), 6) AS p FROM r2d r JOIN c ON c.slide = r.slide AND c.cls = (y // 7) % 3 GROUP BY 1, 2")
def region_prior_pdf(spark, sf):
    """Each region shares its prior among its pixels; annotated pixels then get 0."""
    own = pixels.region_prior(r2d(spark, sf), ["slide"], F.floor(F.col("y") / 7) % 3, [0.1, 0.7, 0.2], F.col("mask") == 0)
    return own.withColumn("p", rnd(F.col("p")))


@query(f"WITH {R2D} SELECT slide, CAST(k AS BIGINT) AS cls, CAST(sum(CASE WHEN val % 4 = k THEN 1 ELSE 0 END) AS BIGINT) AS n FROM r2d, range(4) AS r(k) GROUP BY 1, 2")
def one_hot_labels(spark, sf):
    """Counts of the one-hot planes of a label image."""
    hot = grid.one_hot(r2d(spark, sf).withColumn("label", F.col("val") % 4), "label", 4)
    return hot.groupBy("slide", F.col("cls").cast("long").alias("cls")).agg(F.sum("hot").cast("long").alias("n"))


@query(f"WITH {R2D} SELECT slide, round(avg(CASE WHEN mx = 0 THEN 0 ELSE 255.0 * (mx - mn) / mx END), 6) AS saturation, round(avg(0.299 * val + 0.587 * g + 0.144 * b), 6) AS gray FROM (SELECT slide, val, val * 3 % 256 AS g, val * 7 % 256 AS b, greatest(val, val * 3 % 256, val * 7 % 256) AS mx, least(val, val * 3 % 256, val * 7 % 256) AS mn FROM r2d) GROUP BY slide")
def hsv_gray_projection(spark, sf):
    rgb = F.col("val"), F.col("val") * 3 % 256, F.col("val") * 7 % 256
    return r2d(spark, sf).groupBy("slide").agg(rnd(F.avg(pixels.saturation(*rgb))).alias("saturation"), rnd(F.avg(pixels.gray(*rgb))).alias("gray"))


@query(f"WITH {R2D} SELECT slide, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN mask = 1 THEN 255 ELSE val END AS BIGINT) AS r, CAST(CASE WHEN (y + x) % 5 = 0 THEN 255 ELSE val END AS BIGINT) AS g, CAST(val AS BIGINT) AS b FROM r2d")
def overlay_projection(spark, sf):
    v, on = F.col("val"), (F.col("mask") == 1, (F.col("y") + F.col("x")) % 5 == 0)
    return r2d(spark, sf).select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), pixels.overlaid(v, on[0]).cast("long").alias("r"), pixels.overlaid(v, on[1]).cast("long").alias("g"), v.cast("long").alias("b"))


@query(f"WITH {R2D}, s AS (SELECT slide, avg(val / 255.0) AS m, avg(val / 255.0 * val / 255.0) AS q, stddev_pop(val / 255.0) AS s, var_pop(val / 255.0) AS v FROM r2d GROUP BY slide) SELECT round(avg(m), 6) AS mean, round(sqrt(avg(q) - avg(m) ** 2), 6) AS std, round(avg(s), 6) AS mean_std, round(sqrt(avg(v)), 6) AS root_var, round(avg(CASE WHEN slide % 4 = 0 THEN m END), 6) AS step_mean, round(avg(CASE WHEN slide % 4 = 0 THEN s END), 6) AS step_std FROM s")
def streaming_moments(spark, sf):
    """Dataset moments in four ways: streaming moments, mean of deviations, root of mean variance, every fourth image."""
    m = pixels.moments(r2d(spark, sf), "slide", F.col("val") / 255.0)
    return m.select(*[rnd(F.col(c)).alias(c) for c in m.columns])


@query(f"WITH {R2D} SELECT slide, CAST(val // 32 AS BIGINT) AS bin, count(*) AS n FROM r2d GROUP BY 1, 2")
def fixed_range_histogram(spark, sf):
    return r2d(spark, sf).groupBy("slide", F.floor(F.col("val") / 32).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {R2D} SELECT slide, CAST(y - (h - 12) // 2 AS BIGINT) AS y, CAST(x - (w - 12) // 2 AS BIGINT) AS x, CAST(val AS BIGINT) AS val FROM r2d WHERE y >= (h - 12) // 2 AND y < (h - 12) // 2 + 12 AND x >= (w - 12) // 2 AND x < (w - 12) // 2 + 12")
def centre_crop(spark, sf):
    out = grid.crop(r2d(spark, sf), F.floor((F.col("h") - 12) / 2), F.floor((F.col("w") - 12) / 2), 12)
    return out.select("slide", "y", "x", F.col("val").cast("long").alias("val"))


@query(f"WITH {R2D} SELECT s.s_suppkey AS slide, a.y, b.x, coalesce(CAST(r.val AS BIGINT), 0) AS val FROM supplier s CROSS JOIN range(-3, 5) AS a(y) CROSS JOIN range(-3, 5) AS b(x) LEFT JOIN r2d r ON r.slide = s.s_suppkey AND r.y = a.y AND r.x = b.x")
def boundless_window(spark, sf):
    px = r2d(spark, sf)
    return grid.boundless(slides(spark, sf), px, -3, -3, 8, "val").select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("val").cast("long").alias("val"))


@query(f"WITH {R2D} SELECT slide, CAST(count(*) FILTER (WHERE val <> 0) AS BIGINT) AS nonzero, count(*) = 0 AS empty FROM r2d WHERE mask = 1 GROUP BY slide")
def nonzero_count(spark, sf):
    return r2d(spark, sf).filter("mask = 1").groupBy("slide").agg(F.count_if(F.col("val") != 0).alias("nonzero"), (F.count(F.lit(1)) == 0).alias("empty"))


_BOXES = "slide, area, CAST(lft AS BIGINT) AS lft, CAST(top AS BIGINT) AS top, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, cy, cx"


def _components_sql(diagonal: bool, columns: str = _BOXES) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"WITH RECURSIVE {R2D}, p AS (SELECT slide, y, x, x * 100 + y AS k FROM r2d WHERE mask = 1), e AS (SELECT a.slide, a.k, b.k AS j FROM p a JOIN p b ON a.slide = b.slide AND {near}), r AS (SELECT slide, k, k AS root FROM p UNION SELECT r.slide, e.j, r.root FROM r JOIN e ON e.slide = r.slide AND e.k = r.k), l AS (SELECT slide, k, min(root) AS label FROM r GROUP BY slide, k), s AS (SELECT slide, label, count(*) AS area, min(k // 100) AS lft, min(k % 100) AS top, max(k // 100) - min(k // 100) + 1 AS width, max(k % 100) - min(k % 100) + 1 AS height, round(avg(k % 100), 6) AS cy, round(avg(k // 100), 6) AS cx FROM l GROUP BY slide, label) SELECT {columns} FROM s"


def _components(spark, sf, connectivity):
    runs = components.column_runs(r2d(spark, sf).filter("mask = 1"))
    stats = components.component_stats(components.label_runs(runs, connectivity))
    return stats.select("slide", F.col("area").cast("long").alias("area"), F.col("left").alias("lft"), F.col("top").cast("long").alias("top"), "width", F.col("height").cast("long").alias("height"), rnd(F.col("cy")).alias("cy"), rnd(F.col("cx")).alias("cx"))


@query(_components_sql(False))
def components_4(spark, sf):
    return _components(spark, sf, 4)


@query(_components_sql(True))
def components_8(spark, sf):
    return _components(spark, sf, 8)
