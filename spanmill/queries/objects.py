"""Objects: polygons, spatial joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import components, geometry, match, pixels
from spanmill.plans.session import cut, drop, many
from spanmill.queries.base import M1D, R2D, RECTS, Registry, m1d, r2d, rects, rnd

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query

_SIDES_PARTS = f"{RECTS}, a AS (SELECT * FROM rects WHERE grp = 'A'), b AS (SELECT * FROM rects WHERE grp = 'B'), p AS (SELECT a.slide, a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM a JOIN b ON a.slide = b.slide AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"
_SIDES = f"WITH {_SIDES_PARTS}"


def _pairs(spark, sf, **rings):
    """Pairs whose boxes overlap, with rings of a's and b's (columns of the objects) where given."""
    return _pairs_of(rects(spark, sf).withColumns(rings), rings)


def _pairs_of(r, rings=()):
    size = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    met = match.box_pairs(r.filter("grp = 'A'"), r.filter("grp = 'B'"), 128, ["slide"])
    return met.select("slide", F.col("a_id").alias("a"), F.col("b_id").alias("b"), match.overlap_area().alias("inter"), size("a").alias("aa"), size("b").alias("ab"), *[f"{p}_{c}" for c in rings for p in "ab"])


@query(_SIDES + " SELECT slide, a, b, inter FROM p WHERE inter >= 0.3 * aa")
def containment_pairs(spark, sf):
    return _pairs(spark, sf).filter("inter >= 0.3 * aa").select("slide", "a", "b", "inter")


@query(_SIDES + " SELECT slide, count(*) AS pairs, count(DISTINCT a) AS objects FROM p WHERE inter >= 0.3 * aa GROUP BY slide")
def containment_counts(spark, sf):
    return _pairs(spark, sf).filter("inter >= 0.3 * aa").groupBy("slide").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("objects"))


@query(_SIDES + " SELECT a, b, round(2.0 * inter / (aa + ab), 6) AS dice, round(inter / CAST(aa AS DOUBLE), 6) AS precision, round(inter / CAST(ab AS DOUBLE), 6) AS recall FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY 2.0 * inter / (aa + ab) DESC, b) = 1")
def best_match(spark, sf):
    scored = _pairs(spark, sf).withColumn("dice", 2.0 * F.col("inter") / (F.col("aa") + F.col("ab")))
    return match.best_match(scored, "a", "b", "dice").select("a", "b", rnd(F.col("dice")).alias("dice"), rnd(F.col("inter") / F.col("aa")).alias("precision"), rnd(F.col("inter") / F.col("ab")).alias("recall"))


@query(f"WITH {RECTS} SELECT id FROM rects r WHERE grp = 'A' AND EXISTS (SELECT 1 FROM rects b WHERE b.grp = 'B' AND b.slide = r.slide AND r.x0 < b.x1 AND b.x0 < r.x1 AND r.y0 < b.y1 AND b.y0 < r.y1)")
def spatial_semi_join(spark, sf):
    """A's objects that any of B's overlaps."""
    r = rects(spark, sf)
    return match.overlapping(r.filter("grp = 'A'"), r.filter("grp = 'B'"), 128, ["slide"]).select("id")


@query(f"WITH {RECTS}, c AS (SELECT slide, grp, id, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM rects) SELECT a.id AS a, b.id AS b, round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 3) AS d2 FROM c a JOIN c b ON a.slide = b.slide AND a.grp = 'A' AND b.grp = 'B' WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 10000")
def distance_bounded_join(spark, sf):
    c = rects(spark, sf).select("slide", "grp", "id", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    near = match.near_pairs(c.filter("grp = 'A'"), c.filter("grp = 'B'"), 100, ["slide"])
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)), 3).alias("d2"))


_GREEDY = """, d AS (SELECT slide, a, b, 2.0 * inter / (aa + ab) AS dice FROM p),
  c AS (SELECT slide, a, row_number() OVER (PARTITION BY slide ORDER BY a) AS k, list({'b': b, 'd': dice} ORDER BY dice DESC, b) AS cands FROM d GROUP BY slide, a),
  g AS (SELECT slide, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS dice FROM (SELECT DISTINCT slide FROM d)
    UNION ALL SELECT slide, k, CASE WHEN f.d >= 0.2 THEN list_append(taken, f.b) ELSE taken END, a, CASE WHEN f.d >= 0.2 THEN f.b END, CASE WHEN f.d >= 0.2 THEN f.d END
      FROM (SELECT c.slide, c.k, g.taken, c.a, list_filter(c.cands, lambda x: NOT list_contains(g.taken, x.b))[1] AS f FROM g JOIN c ON c.slide = g.slide AND c.k = g.k + 1)),
  m AS (SELECT a, b, dice FROM g WHERE b IS NOT NULL)
  SELECT r.id AS a, m.b, round(dice, 6) AS dice, CASE WHEN dice >= 0.999 THEN 'same' WHEN dice >= 0.2 THEN 'revised' ELSE 'added' END AS kind FROM rects r LEFT JOIN m ON m.a = r.id WHERE grp = 'A'
  UNION ALL SELECT NULL, id, NULL, 'deleted' FROM rects WHERE grp = 'B' AND id NOT IN (SELECT b FROM m)"""


@query(f"WITH RECURSIVE {_SIDES_PARTS}{_GREEDY}")
def object_match_greedy(spark, sf):
    """Greedy matching in order of A, with A's unmatched and B's leftover objects."""
    r = rects(spark, sf)
    objects = cut(match.kinds(r.filter("slide IS NOT NULL"), ["slide", "grp"]), "objects", held := [])
    scored = _pairs_of(objects.filter("id = kind").dropDuplicates(["slide", "id"])).withColumn("dice", 2.0 * F.col("inter") / (F.col("aa") + F.col("ab")))
    side = lambda grp, c: objects.filter(F.col("grp") == grp).select("slide", "kind", F.col("id").alias(c))
    taken = match.greedy_match_kinds(scored.withColumnsRenamed({"a": "a_kind", "b": "b_kind"}), side("A", "a"), side("B", "b"), "slide", "a", "b", "dice", 0.2)
    drop(spark, held)
    a = r.filter("grp = 'A'").select(F.col("id").alias("a")).join(many(taken.select("a", "b", "dice")), "a", "left")
    left = r.filter("grp = 'B'").select(F.col("id").alias("b")).join(many(taken.select("b")), "b", "left_anti")
    kind = match.classify(F.coalesce("dice", F.lit(0.0)), 0.2)
    return a.select("a", "b", rnd(F.col("dice")).alias("dice"), kind.alias("kind")).unionByName(left.select(F.lit(None).cast("long").alias("a"), "b", F.lit(None).cast("double").alias("dice"), F.lit("deleted").alias("kind")))


@query(f"WITH {RECTS} SELECT id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM rects")
def polygon_area_centre(spark, sf):
    ring = geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    r = rects(spark, sf).select("id", ring.alias("ring")).withColumn("c", geometry.centre(F.col("ring")))
    return r.select("id", geometry.area(F.col("ring")).alias("area"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query(f"WITH {RECTS} SELECT id, CAST(sum((x1 - x0)) AS BIGINT) AS pixels, CAST(y1 - y0 AS BIGINT) AS rows FROM rects, range(70) AS r(k) WHERE k < y1 - y0 GROUP BY id, y1 - y0")
def polygon_fill(spark, sf):
    ring = geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return geometry.fill(rects(spark, sf).select("id", ring.alias("ring")), ["id"]).groupBy("id").agg(F.sum(F.col("hi") - F.col("lo")).alias("pixels"), F.count(F.lit(1)).alias("rows"))


#: Rectangles with a notch from the lower side to the middle: concave, with slanted edges.
_NOTCHED = f"""WITH {RECTS}, n AS (SELECT id, x0, y0, x1, y1, (x0 + x1) / 2e0 AS mx, (y0 + y1) / 2e0 AS my FROM rects),
  r AS (SELECT n.*, y0 + k AS y FROM n, range(70) AS r(k) WHERE k < y1 - y0),
  f AS (SELECT id, CASE WHEN y + 0.5e0 < my THEN x1 - x0 ELSE ceil(mx + (y + 0.5e0 - my) * (x0 - mx) / (y1 - my) - 0.5e0) - x0 + x1 - ceil(x1 + (y + 0.5e0 - y1) * (mx - x1) / (my - y1) - 0.5e0) END AS c FROM r)"""


@query(_NOTCHED + ", s AS (SELECT id, CAST(sum(c) AS BIGINT) AS pixels FROM f GROUP BY id) SELECT id, pixels, 0.75e0 * (x1 - x0) * (y1 - y0) AS area, round((2 * x0 + 2 * x1 + mx) / 5, 6) AS cx, round((2 * y0 + 2 * y1 + my) / 5, 6) AS cy FROM n JOIN s USING (id)")
def notched_polygons(spark, sf):
    """Pixels, area and centre of concave polygons."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p((x0 + x1) / 2, (y0 + y1) / 2), p(x0, y1), p(x0, y0))
    objects = rects(spark, sf).select("id", ring.alias("ring"))
    pixels_ = geometry.fill(objects, ["id"]).groupBy("id").agg(F.sum(F.col("hi") - F.col("lo")).alias("pixels"))
    c = geometry.centre(F.col("ring"))
    return objects.join(pixels_, "id").select("id", "pixels", geometry.area(F.col("ring")).alias("area"), rnd(c["x"]).alias("cx"), rnd(c["y"]).alias("cy"))


@query(_SIDES + " SELECT a, b, CAST(inter AS BIGINT) AS inter FROM p")
def polygon_intersection(spark, sf):
    ring = geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return _pairs(spark, sf, ring=ring).select("a", "b", geometry.overlap_pixels("a_ring", "b_ring").alias("inter"))


@query(f"WITH {RECTS} SELECT id, slide, x0 AS min_x, y0 AS min_y, CAST(5 AS BIGINT) AS vertices FROM rects")
def geojson_roundtrip(spark, sf):
    """Objects written as GeoJSON and parsed again, one document per slide."""
    from spanmill.sources import files

    ring = geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    texts = files.geojson_text(rects(spark, sf).select("slide", "id", ring.alias("ring")), ["slide", "id"])
    kind = "array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    points = F.get(F.get(F.from_json("geojson", kind), F.lit(0))["geometry"]["coordinates"], F.lit(0))
    read = texts.select("id", "slide", points.alias("p"))
    low = lambda k: F.array_min(F.transform("p", lambda q: F.get(q, F.lit(k)))).cast("long")
    return read.select("id", "slide", low(0).alias("min_x"), low(1).alias("min_y"), F.size("p").cast("long").alias("vertices"))


@query(f"WITH {RECTS}, m AS (SELECT avg((x1 - x0) * (y1 - y0)) / 50 AS least FROM rects WHERE grp = 'A') SELECT slide, grp, count(*) AS n FROM rects, m WHERE (x1 - x0) * (y1 - y0) > least GROUP BY 1, 2")
def min_size_vs_average(spark, sf):
    """A threshold from group A's mean area for both groups."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    r = rects(spark, sf)
    least = r.filter("grp = 'A'").agg((F.avg(size) / 50).alias("least")).scalar()
    return r.filter(size > least).groupBy("slide", "grp").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECTS} SELECT slide, CAST(sum(CASE WHEN grp = 'A' THEN 1 ELSE 0 END) - sum(CASE WHEN grp = 'B' THEN 1 ELSE 0 END) AS BIGINT) AS missed, count(*) AS n FROM rects GROUP BY slide")
def count_difference(spark, sf):
    n = lambda g: F.count_if(F.col("grp") == g)
    return rects(spark, sf).groupBy("slide").agg((n("A") - n("B")).alias("missed"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {R2D} SELECT slide, CAST(sum(mask) AS BIGINT) AS pixels FROM r2d WHERE y >= slide % 5 AND y < slide % 5 + 12 AND x >= slide % 3 AND x < slide % 3 + 9 GROUP BY slide")
def raster_in_region(spark, sf):
    """Mask pixels inside a polygon, from the polygon's spans."""
    px = r2d(spark, sf)
    y, x = F.col("slide") % 5, F.col("slide") % 3
    regions = px.select("slide").distinct().select("slide", geometry.rectangle(x, y, x + 9, y + 12).alias("ring"))
    spans = geometry.fill(regions, ["slide"])
    met = px.withColumn("y", F.col("y").cast("long")).join(spans, ["slide", "y"]).filter("x >= lo AND x < hi")
    return met.groupBy("slide").agg(F.sum("mask").cast("long").alias("pixels"))


@query(f"WITH {M1D} SELECT slide, pos, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS on_, CASE WHEN max(score) OVER (PARTITION BY slide) > 0.999 THEN round(score, 6) ELSE 0 END AS gated FROM m1d")
def binarise_gate(spark, sf):
    """Strict threshold, and a gate that zeroes a slide where no score passes."""
    px = pixels.gated(m1d(spark, sf), ["slide"], "score", 0.999)
    return px.select("slide", "pos", F.when(F.col("score") > 0.5, 1).otherwise(0).alias("on_"), rnd(F.col("gated")).alias("gated"))


@query(f"WITH {RECTS}, s AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'FC' ELSE 'G' END AS cls FROM rects), k AS (SELECT unnest([true, true, false, false]) AS add_fc, unnest([true, false, true, false]) AS only_fc) SELECT add_fc, only_fc, count(*) AS n FROM s, k WHERE (add_fc OR cls <> 'FC') AND (NOT only_fc OR cls = 'FC') GROUP BY 1, 2")
def class_switches(spark, sf):
    counts = pixels.class_counts(rects(spark, sf), F.when(F.col("id") % 3 == 0, "FC").otherwise("G"), "FC")
    return counts.select(F.col("add").alias("add_fc"), F.col("only").alias("only_fc"), "n")


@query()
def roi_match_metrics(spark, sf):
    """Recall, precision and F1 of objects matched one to one at IoU over .3, labels by 8-connected components."""
    px = r2d(spark, sf)
    shifted = px.filter((F.col("mask") == 1) & (F.col("x") + 1 < F.col("w"))).withColumn("x", F.col("x") + 1)
    labelled = [components.label_runs(components.column_runs(m), 8) for m in (px.filter("mask = 1"), shifted)]
    return match.roi_measures(*labelled, 0.3).select("slide", "tp", *[rnd(F.col(c)).alias(c) for c in ("recall", "precision", "f1")])
