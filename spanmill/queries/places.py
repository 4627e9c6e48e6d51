"""Places and samples: polygons, crops, samplers, draws, splits; losses and tables of ensembles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanmill.operators import augment, cohort, ensemble, geometry, match, metrics, regions, rle, sampling
from spanmill.plans.session import table
from spanmill.queries.base import CLS, LOG, M1D, PROB, R2D, RECTS, Registry, cls, hashed_unit, m1d, prob, r2d, rects, rnd, runs_log
from spanmill.queries.masks import _BCE, _lovasz_sql
from spanmill.queries.objects import _SIDES, _pairs

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


def _rings(spark, sf):
    return rects(spark, sf).select("id", "grp", "slide", geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


@query(_SIDES + " SELECT a, b, round(inter * 0.37 * 0.37, 6) AS inter FROM p")
def polygon_overlap_exact(spark, sf):
    """Overlaps of polygons whose corners lie between pixels."""
    ring = geometry.rectangle(*[F.col(c) * 0.37 for c in ("x0", "y0", "x1", "y1")])
    return _pairs(spark, sf, ring=ring).select("a", "b", rnd(geometry.overlap_area("a_ring", "b_ring")).alias("inter"))


def _bent(x0, y0, x1, y1):
    """The closed ring of a rectangle without its last quarter."""
    xm, ym = (x0 + x1) / 2.0, (y0 + y1) / 2.0
    corners = ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


_BENT = f"WITH {RECTS}, r AS (SELECT *, (x0 + x1) / 2e0 AS xm, (y0 + y1) / 2e0 AS ym, (x1 - x0) * (y1 - y0) * 0.75e0 AS area FROM rects)"


@query(_BENT + " SELECT id, round(area + 2.5e0 * 2 * (x1 - x0 + y1 - y0) - 6.25e0 + 5 * 8 * 6.25e0 * sin(pi() / 32), 4) AS area, CAST(1 AS BIGINT) AS rings FROM r")
def polygon_buffers(spark, sf):
    """Concave polygons widened by 2.5, with round corners."""
    wide = rects(spark, sf).select("id", regions.buffer(_bent(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 2.5).alias("wide"))
    return wide.select("id", F.round(regions.rings_area(F.col("wide")), 4).alias("area"), F.size("wide").cast("long").alias("rings"))


@query(_BENT + """, p AS (SELECT a.id AS a, b.id AS b, a.area AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.ym, b.y1) - greatest(a.y0, b.y0), 0) + greatest(least(a.xm, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.ym, b.y0), 0) AS o
  FROM r a JOIN r b ON a.slide = b.slide AND a.grp = 'A' AND b.grp = 'B' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT a, b, round(o, 4) AS overlap, round(aa + ab - o, 4) AS both, round(aa - o, 4) AS rest FROM p""")
def polygon_clips(spark, sf):
    """Concave polygons of A cut by those of B: areas of the rings of overlap, union and difference."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    pairs = _pairs(spark, sf, bent=_bent(*box), ring=geometry.rectangle(*box))
    size = lambda how: F.round(regions.rings_area(regions.clip(F.col("a_bent"), F.col("b_ring"), how)), 4)
    return pairs.select("a", "b", size("overlap").alias("overlap"), size("union").alias("both"), size("difference").alias("rest"))


@query(f"WITH {RECTS}, b AS (SELECT slide, id, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM rects WHERE grp = 'B') SELECT a.id AS a, b.id AS b FROM rects a JOIN b USING (slide) WHERE grp = 'A' AND sqrt(greatest(a.x0 - x, 0, x - a.x1) ** 2 + greatest(a.y0 - y, 0, y - a.y1) ** 2) <= 15.03")
def polygon_buffer_contains(spark, sf):
    """Centres of B's objects inside A's objects widened by 15.03.

    Of objects of one box or centre one is looked at; pairs of objects are made of what holds for it.
    """
    r = rects(spark, sf).withColumns({"x": (F.col("x0") + F.col("x1")) / 2.0, "y": (F.col("y0") + F.col("y1")) / 2.0})
    boxes = match.members(r.filter("grp = 'A'"), ["slide", "x0", "y0", "x1", "y1"], "id")
    centres = match.members(r.filter("grp = 'B'"), ["slide", "x", "y"], "id")
    wide = boxes.select("slide", "members", (F.col("x0") - 16).alias("x0"), (F.col("y0") - 16).alias("y0"), (F.col("x1") + 16).alias("x1"), (F.col("y1") + 16).alias("y1"), geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    points = centres.select("slide", "members", "x", "y", F.floor("x").alias("x0"), F.floor("y").alias("y0"), (F.floor("x") + 1).alias("x1"), (F.floor("y") + 1).alias("y1"))
    near = match.box_pairs(wide, points, 128, ["slide"])
    return near.filter(geometry.in_buffer(F.col("b_x"), F.col("b_y"), F.col("a_ring"), 15.03)).select("b_members", F.explode("a_members").alias("a")).select("a", F.explode("b_members").alias("b"))


@query(f"WITH {RECTS} SELECT slide, id FROM rects WHERE abs((x0 + x1) / 2.0 - 500) + abs((y0 + y1) / 2.0 - 500) < 499.75 QUALIFY row_number() OVER (PARTITION BY slide ORDER BY id) <= 20")
def centroid_in_polygon_capped(spark, sf):
    """At most 20 objects of a slide whose centre is in a region: the cap is the operator."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    region = F.array(corner(500, 0.25), corner(999.75, 500), corner(500, 999.75), corner(0.25, 500), corner(500, 0.25))
    centre = rects(spark, sf).select("slide", "id", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    inside = centre.filter(geometry.inside(F.col("x"), F.col("y"), region))
    return inside.withColumn("k", F.row_number().over(Window.partitionBy("slide").orderBy("id"))).filter("k <= 20").select("slide", "id")


@query(f"WITH {RECTS}, c AS (SELECT id, CAST(round_even((x0 + x1) / 2.0, 0) AS BIGINT) - 32 AS x0, CAST(round_even((y0 + y1) / 2.0, 0) AS BIGINT) - 32 AS y0 FROM rects) SELECT id, y0, y0 + 64 AS y1, x0, x0 + 64 AS x1 FROM c")
def object_crops(spark, sf):
    return augment.object_crops(_rings(spark, sf), 64).select("id", "y0", "y1", "x0", "x1")


@query(f"WITH {RECTS}, k AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY id) AS k, count(*) OVER (PARTITION BY slide) AS n FROM rects), d AS (SELECT slide, CAST(draw AS INT) AS draw, n, slide || '|' || draw AS d FROM (SELECT DISTINCT slide, n FROM k), range(3) AS r(draw)) SELECT d.slide, draw, id, CAST(floor(x0 + (x1 - x0) * {hashed_unit(11, 'd', '0')}) AS BIGINT) - 8 AS x0, CAST(floor(y0 + (y1 - y0) * {hashed_unit(12, 'd', '0')}) AS BIGINT) - 8 AS y0 FROM d JOIN k ON k.slide = d.slide AND k = CAST(floor({hashed_unit(11, 'd.slide', 'draw')} * d.n) AS BIGINT) + 1")
def polygon_crops(spark, sf):
    """Windows at pseudorandom points of pseudorandom polygons of each slide."""
    return augment.polygon_crops(_rings(spark, sf), "slide", "id", 3, 16, 11)


@query(f"WITH {RECTS}, r AS (SELECT id, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, x0, x1, y0, y1 FROM rects), t AS (SELECT id, i, cx, cy, x0, x1, y0, y1, x0 + (x1 - x0) * {hashed_unit(21, 'id', 'i')} AS x, y0 + (y1 - y0) * {hashed_unit(22, 'id', 'i')} AS y FROM r, range(50) AS a(i)), f AS (SELECT id, arg_min(x, i) AS x, arg_min(y, i) AS y FROM t WHERE abs(x - cx) / ((x1 - x0) / 2.0) + abs(y - cy) / ((y1 - y0) / 2.0) < 1 GROUP BY id) SELECT r.id, round(coalesce(x, cx), 6) AS x, round(coalesce(y, cy), 6) AS y FROM r LEFT JOIN f USING (id)")
def point_in_polygon(spark, sf):
    """The first pseudorandom point that is inside, of rhombs in the objects' boxes."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    ring = F.array(corner(cx, F.col("y0")), corner(F.col("x1"), cy), corner(cx, F.col("y1")), corner(F.col("x0"), cy), corner(cx, F.col("y0")))
    return augment.point_in_polygon(rects(spark, sf).select("id", ring.alias("ring")), "id", 21).select("id", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@query(f"WITH {RECTS}, t AS (SELECT slide, i, CAST(floor({hashed_unit(3, 'slide', 'i')} * 880) AS BIGINT) AS y0, CAST(floor({hashed_unit(4, 'slide', 'i')} * 880) AS BIGINT) AS x0 FROM (SELECT DISTINCT slide FROM rects), range(200) AS a(i)), n AS (SELECT t.slide, i, any_value(t.x0) AS x0, any_value(t.y0) AS y0, count(r.id) AS n FROM t LEFT JOIN rects r ON r.slide = t.slide AND r.x0 < t.x0 + 120 AND t.x0 < r.x1 AND r.y0 < t.y0 + 120 AND t.y0 < r.y1 GROUP BY 1, 2) SELECT slide, arg_min(x0, i) + 60 AS x, arg_min(y0, i) + 60 AS y FROM n WHERE n <= i // 25 * 25 GROUP BY slide")
def background_points(spark, sf):
    """The first window without objects; more are allowed after each 25 failures."""
    r = rects(spark, sf)
    sized = r.select("slide").distinct().withColumn("h", F.lit(1000)).withColumn("w", F.lit(1000))
    return augment.background_points(sized, r.select("slide", "x0", "y0", "x1", "y1"), 120, 3)


@query(f"WITH {R2D}, t AS (SELECT slide, y // 8 AS ty, x // 8 AS tx, max(CASE WHEN abs(y % 8 - 4) <= 1 AND abs(x % 8 - 4) <= 1 THEN mask ELSE 0 END) AS hit FROM r2d GROUP BY 1, 2, 3) SELECT slide, ty, tx FROM t WHERE hit > 0 OR {hashed_unit(6, 'slide', 'ty', 'tx')} > 0.7")
def accepted_tiles(spark, sf):
    px = r2d(spark, sf).select("slide", F.floor(F.col("y") / 8).cast("long").alias("ty"), F.floor(F.col("x") / 8).cast("long").alias("tx"), (F.col("y") % 8).alias("dy"), (F.col("x") % 8).alias("dx"), F.lit(8).alias("size"), "mask")
    return augment.accept_tiles(px, 1, 0.7, 6)


@query(f"WITH w AS (SELECT s_suppkey AS slide, (20 + s_suppkey % 7) * (20 + s_suppkey % 5) * 1.0 AS w FROM supplier), e AS (SELECT slide, sum(w) OVER (ORDER BY slide) AS hi, w, sum(w) OVER () AS n FROM w), d AS (SELECT i AS draw, {hashed_unit(8, 'i')} AS u FROM range(500) AS r(i)) SELECT draw, slide FROM d JOIN e ON u >= (hi - w) / n AND u < hi / n")
def proportional_draws(spark, sf):
    """Images drawn with probability by area."""
    k = F.col("s_suppkey")
    images = table(spark, sf, "supplier").select(k.alias("slide"), ((20 + k % 7) * (20 + k % 5)).alias("area"))
    return augment.proportional_draws(images, "slide", "area", 500, 8)


@query(f"SELECT c_custkey, (row_number() OVER (ORDER BY {hashed_unit(9, 'c_custkey')}, c_custkey) - 1) % 5 AS fold FROM customer")
def shuffled_folds(spark, sf):
    return augment.hashed_folds(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 5, 9).select("c_custkey", "fold")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {hashed_unit(10, 'c_custkey')}, c_custkey) <= CAST(floor((SELECT count(*) FROM customer) * 0.2) AS BIGINT) AS held FROM customer")
def percent_split(spark, sf):
    return sampling.percent_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.2, 10)


@query(f"WITH k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), d AS (SELECT DISTINCT c_mktsegment, n, CAST(i AS INT) AS draw FROM k, range(200) AS r(i)) SELECT d.c_mktsegment, draw, c_custkey FROM d JOIN k ON k.c_mktsegment = d.c_mktsegment AND k = CAST(floor({hashed_unit(7, 'd.c_mktsegment', 'draw')} * d.n) AS BIGINT) + 1")
def balanced_sample_rows(spark, sf):
    """Draws with replacement, as many for each class."""
    return sampling.balanced_draws(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 200, 7)


@query(f"SELECT c_custkey FROM customer ORDER BY {hashed_unit(42, 'c_custkey')}, c_custkey LIMIT 100")
def seeded_subset_rows(spark, sf):
    return sampling.exact_subset(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 100, 42)


@query(f"WITH {LOG}, p AS (SELECT run, epoch, (epoch - 1) / CAST(count(*) OVER (PARTITION BY run) AS DOUBLE) AS p FROM log) SELECT run, epoch, round(CASE WHEN p >= 0.75 THEN 1e-3 * power(1e-3, (p - 0.75) / 0.25) WHEN p >= 0.25 THEN 1e-3 ELSE 1e-5 + (1 + cos(pi() * (1 - p / 0.25))) * (1e-3 - 1e-5) / 2 END, 9) AS lr FROM p")
def lr_piecewise(spark, sf):
    """Schedules one after another over a run's epochs: cosine up, constant, exponential down."""
    parts = [(0.25, sampling.cosine_to(1e-5, 1e-3)), (0.5, sampling.constant(1e-3)), (0.25, sampling.exponential_to(1e-3, 1e-6))]
    log = runs_log(spark, sf)
    placed = log.join(log.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run").withColumn("p", (F.col("epoch") - 1) / F.col("n"))
    return placed.select("run", "epoch", rnd(sampling.combined(F.col("p"), parts), 9).alias("lr"))


@query(f"WITH {PROB}, m AS (SELECT vec // 2 AS file, pos, 'model_' || vec % 2 AS model, p FROM prob) SELECT file, pos, model, round(p, 6) AS p FROM m UNION ALL SELECT file, pos, 'ensemble', round(avg(p), 6) FROM m GROUP BY 1, 2")
def ensemble_results(spark, sf):
    """Each model's results and the ensemble's, every file with all models."""
    p = prob(spark, sf).withColumn("file", F.floor(F.col("vec") / 2).cast("long"))
    models = [p.filter(F.col("vec") % 2 == k).select("file", "pos", "p") for k in (0, 1)]
    return ensemble.results_with_ensemble(models, ["file", "pos"], "file", "p").withColumn("p", rnd(F.col("p")))


_FOCAL = f"power(1 - CASE WHEN truth = 1 THEN 1 / (1 + exp(-logit)) ELSE 1 - 1 / (1 + exp(-logit)) END, 2) * {_BCE}"


@query(f"WITH {M1D}, l AS (SELECT slide, pos, {_FOCAL} AS f FROM m1d) SELECT 'mean' AS reduction, slide AS key, round(avg(f), 6) AS loss FROM l GROUP BY slide UNION ALL SELECT 'sum', slide, round(sum(f), 6) FROM l GROUP BY slide UNION ALL SELECT 'batchwise_mean', pos, round(sum(f), 6) FROM l GROUP BY pos")
def focal_reductions(spark, sf):
    px = m1d(spark, sf)
    own = [metrics.focal_loss(px, ["slide"], "logit", "truth", 2.0, how).select(F.lit(how).alias("reduction"), F.col("pos" if how == "batchwise_mean" else "slide").alias("key"), rnd(F.col("loss")).alias("loss")) for how in ("mean", "sum", "batchwise_mean")]
    return own[0].unionByName(own[1]).unionByName(own[2])


@query(f"WITH {M1D} SELECT slide, round(avg(greatest(logit, 0) - logit * score + ln(1 + exp(-abs(logit)))), 6) AS loss FROM m1d WHERE NOT pred = 1 GROUP BY slide")
def soft_bce(spark, sf):
    """Against soft truth, without the items to ignore."""
    return metrics.soft_bce(m1d(spark, sf), ["slide"], "logit", "score", F.col("pred") == 1).select("slide", rnd(F.col("loss")).alias("loss"))


@query(f"WITH {PROB}, s AS (SELECT vec, any_value(grp) AS grp, ln(sum(exp(p))) AS z FROM prob GROUP BY vec), l AS (SELECT (1 + s.vec % 3) * (z - p) AS l FROM s JOIN prob ON prob.vec = s.vec AND pos = s.grp) SELECT round(avg(l), 6) AS mean, round(sum(l), 4) AS sum FROM l")
def weighted_cross_entropy(spark, sf):
    p = prob(spark, sf)
    items = p.groupBy("vec").agg(F.first("grp").alias("truth")).withColumn("weight", 1 + F.col("vec") % 3)
    mean, total = (metrics.weighted_cross_entropy(p, items, "vec", "pos", "p", "truth", "weight", how) for how in ("mean", "sum"))
    return mean.select(rnd(F.col("loss")).alias("mean")).join(total.select(F.round("loss", 4).alias("sum")))


_HINGE = _lovasz_sql("greatest(e, 0)", digits=None)
#: Negated logits against negated truth have the same errors, with the classes exchanged.
_TURNED = _lovasz_sql("greatest(e, 0)", truth="1 - truth", digits=None)


@query(f"WITH a AS ({_HINGE}), b AS ({_TURNED}) SELECT slide, round((a.loss + b.loss) / 2, 6) AS loss FROM a JOIN b USING (slide)")
def lovasz_symmetric(spark, sf):
    return metrics.lovasz_symmetric(m1d(spark, sf), ["slide"], "logit", "truth", "pos").select("slide", rnd(F.col("loss")).alias("loss"))


@query(f"WITH h AS ({_HINGE}), {M1D}, n AS (SELECT slide FROM m1d GROUP BY slide HAVING sum(truth) <> 0) SELECT round((SELECT avg({_BCE}) FROM m1d JOIN n USING (slide)) + (SELECT avg(loss) FROM h JOIN n USING (slide)), 6) AS loss, (SELECT count(*) FROM n) AS items")
def nonempty_lovasz_bce(spark, sf):
    return metrics.nonempty_lovasz_bce(m1d(spark, sf), ["slide"], "logit", "truth", "pos").select(rnd(F.col("loss")).alias("loss"), "items")


@query(f"WITH {M1D} SELECT slide, pos, CAST(truth + 2 * pred AS BIGINT) AS added, CAST(CASE WHEN pred = 1 THEN 2 ELSE 1 END AS BIGINT) AS last FROM m1d WHERE truth + pred > 0")
def class_masks_combined(spark, sf):
    """Two class masks in one: codes added, and later classes over earlier ones."""
    px = m1d(spark, sf)
    masks = px.filter("truth = 1").select("slide", "pos", F.lit(1).alias("c")).unionByName(px.filter("pred = 1").select("slide", "pos", F.lit(2).alias("c")))
    return rle.combine_additive(masks, ["slide", "pos"], "c", "added").join(rle.combine_last(masks, ["slide", "pos"], "c", "last"), ["slide", "pos"])


@query(f"WITH {CLS}, s AS (SELECT avg(score) AS ms, stddev_pop(score) AS ss, avg(truth) AS mt, stddev_pop(truth) AS st FROM cls WHERE doc_id % 2 = 0) SELECT doc_id, round((coalesce(power((score - ms) / nullif(ss, 0), 2), 0) + coalesce(power((truth - mt) / nullif(st, 0), 2), 0)) / 2, 6) AS ood FROM cls, s")
def ood_zscore(spark, sf):
    rows = cls(spark, sf)
    return augment.ood_scores(rows.filter("doc_id % 2 = 0"), rows, ["score", "truth"]).select("doc_id", rnd(F.col("ood")).alias("ood"))


@query(f"WITH {M1D} SELECT slide, pos, round(1 / (1 + exp(-logit)), 6) AS p FROM m1d")
def predict_hook(spark, sf):
    """A user's model over batches."""

    def model(pdf):
        import numpy as np

        return pdf.assign(p=1 / (1 + np.exp(-pdf["logit"])))[["slide", "pos", "p"]]

    return match.predict(m1d(spark, sf).select("slide", "pos", "logit"), model, "slide long, pos long, p double").withColumn("p", rnd(F.col("p")))


@query("SELECT 'img_' || c_custkey AS stem, c_custkey % 3 IN (0, 1) AS loose, c_custkey % 3 = 0 AS exact FROM customer")
def stems_and_class_names(spark, sf):
    """File names up to the first dot; a class by its name in any case, and as it is written."""
    name = F.when(F.col("c_custkey") % 3 == 0, "Cortex").when(F.col("c_custkey") % 3 == 1, "cortex").otherwise(F.lit(None))
    return table(spark, sf, "customer").select(cohort.stem(F.concat(F.lit("img_"), "c_custkey", F.lit(".ome.tiff"))).alias("stem"), cohort.is_named(name, "Cortex", False).alias("loose"), cohort.is_named(name, "Cortex").alias("exact"))


@query("SELECT 'i' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '.tif' AS image, 'i' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '_mask.png' AS mask FROM supplier WHERE s_suppkey % 3 <> 2")
def image_mask_names(spark, sf):
    """Images and masks of one stem; the masks' suffix is inferred. Some masks are missing, others have another suffix."""
    stem = F.concat(F.lit("i"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))
    names = table(spark, sf, "supplier")
    masks = names.filter("s_suppkey % 3 <> 2").select(F.concat(stem, F.lit("_mask.png")).alias("mask")).unionByName(names.select(F.concat(stem, F.lit("_weights.png")).alias("mask")))
    return cohort.suffix_join(names.select(F.concat(stem, F.lit(".tif")).alias("image")), masks, "image", "mask").select("image", "mask")
