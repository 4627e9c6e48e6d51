"""Masks as runs, and mask metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators import metrics, rle
from spanmill.queries.base import CLS, M1D, PROB, R2D, Registry, cls, m1d, prob, r2d, rnd

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query

_RUNS = """runs AS (SELECT slide, min(pos) AS lo, max(pos) + 1 AS hi FROM (SELECT slide, pos, pos - row_number() OVER (PARTITION BY slide ORDER BY pos) AS g FROM {rows} WHERE {where}) GROUP BY slide, g)"""


def _text(where: str) -> str:
    return f"WITH {M1D}, {_RUNS.format(rows='m1d', where=where)}"


@query(_text("truth = 1") + " SELECT slide, string_agg(lo + 1 || ' ' || hi - lo, ' ' ORDER BY lo) AS rle FROM runs GROUP BY slide")
def rle_encode(spark, sf):
    return rle.spans_to_text(rle.encode_spans(m1d(spark, sf).filter("truth = 1"), ["slide"]), ["slide"])


@query(f"WITH {M1D}, g AS (SELECT slide, v > 50 AS high, pos, pos - row_number() OVER (PARTITION BY slide, v > 50 ORDER BY pos) AS g FROM m1d WHERE truth = 1), runs AS (SELECT slide, high, min(pos) AS lo, max(pos) + 1 AS hi FROM g GROUP BY slide, high, g), t AS (SELECT slide, CASE WHEN high THEN 2 ELSE 1 END AS cls, string_agg(lo + 1 || ' ' || hi - lo, ' ' ORDER BY lo) AS rle FROM runs GROUP BY ALL) SELECT s.slide, CAST(c.cls AS INT) AS cls, rle FROM (SELECT DISTINCT slide FROM m1d) s CROSS JOIN (SELECT unnest([1, 2]) AS cls) c LEFT JOIN t ON t.slide = s.slide AND t.cls = c.cls")
def rle_encode_per_class(spark, sf):
    px = m1d(spark, sf).withColumn("cls", F.when(F.col("v") > 50, 2).otherwise(1))
    every = px.select("slide").distinct().select("slide", F.explode(F.array(F.lit(1), F.lit(2))).alias("cls"))
    return every.join(rle.spans_to_text(rle.encode_spans(px.filter("truth = 1"), ["slide", "cls"]), ["slide", "cls"]), ["slide", "cls"], "left")


@query(f"WITH {M1D}, n AS (SELECT *, count(*) OVER (PARTITION BY slide) AS n FROM m1d), {_RUNS.format(rows='n', where='truth = 1 AND pos > 0 AND pos < n - 1')} SELECT slide, string_agg(lo + 1 || ' ' || hi - lo, ' ' ORDER BY lo) AS rle FROM runs GROUP BY slide")
def rle_encode_lossy_border(spark, sf):
    px = m1d(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("slide")))
    return rle.spans_to_text(rle.encode_spans(rle.lossy_positions(px.filter("truth = 1"), ["slide"], "n"), ["slide"]), ["slide"])


@query(_text("truth = 1") + " SELECT slide, CASE WHEN sum(hi - lo) <= 26 THEN '' ELSE string_agg(lo + 1 || ' ' || hi - lo, ' ' ORDER BY lo) END AS rle FROM runs GROUP BY slide")
def rle_small_mask_suppressed(spark, sf):
    return rle.suppress_small(rle.encode_spans(m1d(spark, sf).filter("truth = 1"), ["slide"]), ["slide"], 26)


@query(_text("truth = 1") + " SELECT slide, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM runs")
def rle_decode_runs(spark, sf):
    return rle.text_to_spans(rle_encode(spark, sf), "rle", ["slide"])


@query(f"WITH {M1D} SELECT slide, pos FROM m1d WHERE truth = 1")
def rle_decode_positions(spark, sf):
    return rle.positions(rle_decode_runs(spark, sf), ["slide"])


_SUMS = f"WITH {M1D}, s AS (SELECT slide, CAST(sum(pred * truth) AS DOUBLE) AS i, CAST(sum(pred) AS DOUBLE) AS p, CAST(sum(truth) AS DOUBLE) AS t FROM m1d GROUP BY slide)"


@query(_SUMS + " SELECT slide, round((2 * i + 1e-8) / (p + t + 1e-8), 6) AS dice FROM s")
def rle_overlap_dice(spark, sf):
    """Encode both masks as text, decode them to spans, and take Dice from the overlap of spans."""
    which = F.explode(F.filter(F.array(F.when(F.col("pred") == 1, "pred"), F.when(F.col("truth") == 1, "truth")), lambda c: c.isNotNull())).alias("mask")
    px = m1d(spark, sf)
    texts = rle.spans_to_text(rle.encode_spans(px.select("slide", "pos", which), ["slide", "mask"]), ["slide", "mask"])
    sums = rle.mask_sums(rle.text_to_spans(texts, "rle", ["slide", "mask"]), ["slide"], "mask", "pred", "truth")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return px.select("slide").distinct().join(sums, "slide", "left").select("slide", rnd(metrics.dice_eps(zero("inter"), zero("p"), zero("t"))).alias("dice"))


def _sums(spark, sf) -> DataFrame:
    return metrics.overlap_sums(m1d(spark, sf), ["slide"], F.col("pred"), F.col("truth"))


@query(_SUMS + ", z AS (SELECT slide, CASE WHEN p <= 12 THEN 0 ELSE i END AS i0, CASE WHEN p <= 12 THEN 0 ELSE p END AS p0, i, p, t FROM s) SELECT slide, round((2 * i + 1e-8) / (p + t + 1e-8), 6) AS dice_eps8, round((2 * i + 1e-6) / (p + t + 1e-6), 6) AS dice_eps6, round(2 * i / nullif(p + t, 0), 6) AS dice_or_null, round(CASE WHEN p0 = 0 AND t = 0 THEN 1 ELSE 2 * i0 / (p0 + t + 1e-12) END, 6) AS dice_small FROM z")
def dice_variants(spark, sf):
    i, p, t = F.col("inter"), F.col("p"), F.col("t")
    return _sums(spark, sf).select("slide", rnd(metrics.dice_eps(i, p, t)).alias("dice_eps8"), rnd(metrics.dice_eps(i, p, t, 1e-6)).alias("dice_eps6"), rnd(metrics.dice_or_null(i, p, t)).alias("dice_or_null"), rnd(metrics.dice_small(i, p, t, 12)).alias("dice_small"))


@query(_SUMS + " SELECT round(2 * sum(i) / nullif(sum(p) + sum(t), 0), 6) AS micro, round(avg((2 * i + 1e-8) / (p + t + 1e-8)), 6) AS batch_mean, round(avg(coalesce(i / nullif(p + t - i, 0), 1)) * 100, 6) AS mean_iou FROM s")
def dice_micro_and_batch(spark, sf):
    i, p, t = F.col("inter"), F.col("p"), F.col("t")
    return _sums(spark, sf).agg(rnd(metrics.dice_or_null(F.sum(i), F.sum(p), F.sum(t))).alias("micro"), rnd(F.avg(metrics.dice_eps(i, p, t))).alias("batch_mean"), rnd(F.avg(F.coalesce(metrics.iou_or_null(i, p, t), F.lit(1.0))) * 100).alias("mean_iou"))


@query(f"WITH {M1D} SELECT slide, round(2 * sum(score * truth) / nullif(sum(score + truth), 0), 6) AS soft_dice, round(1 - (2 * sum(score * truth) + 1) / (sum(score) + sum(truth) + 1), 6) AS dice_loss FROM m1d GROUP BY slide")
def dice_soft(spark, sf):
    s, t = F.col("score"), F.col("truth")
    return m1d(spark, sf).groupBy("slide").agg(rnd(F.try_divide(2 * F.sum(s * t), F.sum(s + t))).alias("soft_dice"), rnd(metrics.dice_loss(s, t)).alias("dice_loss"))


@query(f"WITH {CLS}, c AS (SELECT lang, sum(pred * truth) AS tp, sum(pred * (1 - truth)) AS fp, sum((1 - pred) * truth) AS fn, sum((1 - pred) * (1 - truth)) AS tn FROM cls GROUP BY lang), r AS (SELECT *, tp / (tp + fp + 1e-7) AS p, tp / (tp + fn + 1e-7) AS r FROM c) SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-7), 6) AS f1 FROM r")
def precision_recall_f1(spark, sf):
    out = metrics.precision_recall_f1(metrics.confusion(cls(spark, sf), ["lang"], F.col("pred"), F.col("truth")))
    return out.select("lang", "tp", "fp", "fn", "tn", *[rnd(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {CLS} SELECT source, round(100 * coalesce(sum(CASE WHEN pred = 1 AND truth = 1 AND second = 0 THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN second = 0 AND (pred = 1 OR truth = 1) THEN 1 ELSE 0 END) AS DOUBLE), 0), 1), 6) AS iou FROM cls GROUP BY source")
def iou_binary_ignore(spark, sf):
    """Items that the second rater marks are ignored; an empty union counts 1."""
    kept = F.col("second") == 0
    n = lambda c: F.sum(F.when(kept & c, 1).otherwise(0))
    both, either = (F.col("pred") == 1) & (F.col("truth") == 1), (F.col("pred") == 1) | (F.col("truth") == 1)
    return cls(spark, sf).groupBy("source").agg(rnd(100 * F.coalesce(F.try_divide(n(both), n(either)), F.lit(1.0))).alias("iou"))


@query("WITH a AS (SELECT l_returnflag AS p, l_linestatus AS t FROM lineitem), k AS (SELECT unnest(['A', 'F', 'N', 'O', 'R']) AS cls) SELECT cls, round(100 * coalesce(CAST(sum(CASE WHEN p = cls AND t = cls THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN p = cls OR t = cls THEN 1 ELSE 0 END), 0), 1), 6) AS iou FROM a, k GROUP BY cls")
def iou_per_class(spark, sf):
    from spanmill.plans.session import table

    c = metrics.class_overlap(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", list("AFNOR"))
    return c.select("cls", rnd(100 * F.coalesce(metrics.iou_or_null(F.col("inter"), F.col("p"), F.col("t")), F.lit(1.0))).alias("iou"))


@query(f"WITH {M1D} SELECT slide, round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(pred * truth) / nullif(CAST(sum(greatest(pred, truth)) AS DOUBLE), 0), 6) AS jaccard FROM m1d GROUP BY slide")
def pixel_accuracy_jaccard(spark, sf):
    p, t = F.col("pred"), F.col("truth")
    return m1d(spark, sf).groupBy("slide").agg(rnd(F.avg(F.when(p == t, 1.0).otherwise(0.0))).alias("accuracy"), rnd(F.try_divide(F.sum(p * t), F.sum(F.greatest(p, t)))).alias("jaccard"))


_THR = [round(0.2 + 0.05 * k, 2) for k in range(11)]
_SWEEP = f"WITH {CLS}, thr AS (SELECT unnest({_THR}::DOUBLE[]) AS thr), s AS (SELECT lang, thr, CAST(sum(CASE WHEN score > thr THEN truth ELSE 0 END) AS DOUBLE) AS i, CAST(sum(CASE WHEN score > thr THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(truth) AS DOUBLE) AS t FROM cls, thr GROUP BY lang, thr), d AS (SELECT lang, thr, 2 * i / nullif(p + t, 0) AS dice FROM s)"


def _sweep(spark, sf) -> DataFrame:
    s = metrics.threshold_sums(cls(spark, sf), ["lang"], F.col("score"), F.col("truth"), _THR)
    return s.select("lang", "thr", metrics.dice_or_null(F.col("inter"), F.col("p"), F.col("t")).alias("dice"))


@query(_SWEEP + " SELECT lang, thr, round(dice, 6) AS dice FROM d")
def threshold_sweep(spark, sf):
    return _sweep(spark, sf).select("lang", "thr", rnd(F.col("dice")).alias("dice"))


@query(_SWEEP + " SELECT lang, thr, round(dice, 6) AS dice FROM (SELECT lang, thr, coalesce(dice, 0) AS dice, row_number() OVER (PARTITION BY lang ORDER BY coalesce(dice, 0) DESC, thr) AS k FROM d) WHERE k = 1")
def threshold_sweep_best(spark, sf):
    return metrics.best_threshold(_sweep(spark, sf), ["lang"]).select("lang", "thr", rnd(F.col("dice")).alias("dice"))


@query(_SWEEP + " SELECT thr, round(dice, 6) AS dice FROM (SELECT thr, sum(coalesce(dice, 0)) AS dice FROM d GROUP BY thr) ORDER BY dice DESC, thr LIMIT 1")
def threshold_common_best(spark, sf):
    totals = _sweep(spark, sf).groupBy("thr").agg(F.sum(F.coalesce("dice", F.lit(0.0))).alias("dice"))
    return metrics.best_threshold(totals, []).select("thr", rnd(F.col("dice")).alias("dice"))


@query(f"WITH {CLS}, r AS (SELECT lang, truth, row_number() OVER w AS k, sum(truth) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS h FROM cls WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id)) SELECT lang, round(avg(CASE WHEN truth = 1 THEN h / CAST(k AS DOUBLE) END), 6) AS ap FROM r GROUP BY lang")
def average_precision(spark, sf):
    return metrics.average_precision(cls(spark, sf), ["lang"], "score", "truth", "doc_id").select("lang", rnd(F.col("ap")).alias("ap"))


@query(f"WITH {PROB}, k AS (SELECT vec, any_value(grp) AS grp, list(pos ORDER BY p DESC, pos)[1:5] AS top FROM prob GROUP BY vec) SELECT round(100 * avg(CASE WHEN top[1] = grp THEN 1.0 ELSE 0.0 END), 6) AS top1, round(100 * avg(CASE WHEN list_contains(top, grp) THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM k")
def topk_accuracy(spark, sf):
    return metrics.top_k(prob(spark, sf), "vec", "pos", "p", "grp").select(rnd(F.col("top1")).alias("top1"), rnd(F.col("top5")).alias("top5"))


def _lovasz_sql(shape: str, truth: str = "truth", digits: int | None = 6) -> str:
    loss = f"sum({shape} * dj)"
    return f"WITH {M1D}, e AS (SELECT slide, pos, CAST({truth} AS DOUBLE) AS t, 1 - logit * (2 * truth - 1) AS e FROM m1d), c AS (SELECT *, sum(t) OVER (PARTITION BY slide) AS n, sum(t) OVER w AS ct, sum(1 - t) OVER w AS cn FROM e WINDOW w AS (PARTITION BY slide ORDER BY e DESC, pos ROWS UNBOUNDED PRECEDING)), j AS (SELECT *, 1 - (n - ct) / (n + cn) AS j FROM c), d AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY slide ORDER BY e DESC, pos), 0) AS dj FROM j) SELECT slide, {loss if digits is None else f'round({loss}, {digits})'} AS loss FROM d GROUP BY slide"


@query(_lovasz_sql("greatest(e, 0)"))
def lovasz_hinge(spark, sf):
    return metrics.lovasz_hinge(m1d(spark, sf), ["slide"], "logit", "truth", "pos").select("slide", rnd(F.col("loss")).alias("loss"))


@query(_lovasz_sql("CASE WHEN e > 0 THEN e + 1 ELSE exp(e) END"))
def lovasz_hinge_elu(spark, sf):
    return metrics.lovasz_hinge(m1d(spark, sf), ["slide"], "logit", "truth", "pos", "elu").select("slide", rnd(F.col("loss")).alias("loss"))


_BCE = "(greatest(logit, 0) - logit * truth + ln(1 + exp(-abs(logit))))"


@query(f"WITH {M1D}, l AS (SELECT slide, truth, {_BCE} AS bce, power(1 - CASE WHEN truth = 1 THEN 1 / (1 + exp(-logit)) ELSE 1 - 1 / (1 + exp(-logit)) END, 2) * {_BCE} AS focal FROM m1d) SELECT slide, round(avg(bce), 6) AS bce, round(sum(bce), 6) AS bce_sum, round(avg(focal), 6) AS focal, round(avg(bce) * 0.7 + avg(focal) * 0.3, 6) AS joint FROM l GROUP BY slide")
def focal_bce(spark, sf):
    bce, focal = metrics.stable_bce(F.col("logit"), F.col("truth")), metrics.focal(F.col("logit"), F.col("truth"))
    return m1d(spark, sf).groupBy("slide").agg(rnd(F.avg(bce)).alias("bce"), rnd(F.sum(bce)).alias("bce_sum"), rnd(F.avg(focal)).alias("focal"), rnd(metrics.joint_loss((0.7, F.avg(bce)), (0.3, F.avg(focal)))).alias("joint"))


@query(f"WITH {M1D}, s AS (SELECT slide, avg({_BCE}) AS bce FROM m1d GROUP BY slide HAVING sum(pred) <> 0) SELECT round(avg(bce), 6) AS loss, count(*) AS items FROM s")
def nonempty_loss(spark, sf):
    per = m1d(spark, sf).groupBy("slide").agg(F.avg(metrics.stable_bce(F.col("logit"), F.col("truth"))).alias("bce"), F.sum("pred").alias("p")).filter("p <> 0")
    return per.agg(rnd(F.avg("bce")).alias("loss"), F.count(F.lit(1)).alias("items"))


@query(f"WITH {CLS}, s AS (SELECT lang, 2.0 * sum(pred * truth) / nullif(sum(pred + truth), 0) AS dice, count(*) AS n FROM cls GROUP BY lang) SELECT round(sum(dice * n) / sum(n), 6) AS weighted, round(avg(dice), 6) AS plain FROM s")
def weighted_epoch_metric(spark, sf):
    per = cls(spark, sf).groupBy("lang").agg(F.try_divide(2.0 * F.sum(F.col("pred") * F.col("truth")), F.sum(F.col("pred") + F.col("truth"))).alias("dice"), F.count(F.lit(1)).alias("n"))
    return per.agg(rnd(F.sum(F.col("dice") * F.col("n")) / F.sum("n")).alias("weighted"), rnd(F.avg("dice")).alias("plain"))


@query(f"WITH {CLS}, s AS (SELECT source, CASE WHEN sum(second) = 0 THEN NULL ELSE sum(second * score) / sum(second) END AS v FROM cls GROUP BY source) SELECT round(coalesce(avg(v), 0), 6) AS mean, round(coalesce(avg(CASE WHEN v > 1e9 THEN v END), 0), 6) AS empty_mean FROM s")
def nan_mean(spark, sf):
    per = cls(spark, sf).groupBy("source").agg(F.try_divide(F.sum(F.col("second") * F.col("score")), F.sum("second")).alias("v"))
    return per.agg(rnd(metrics.mean_or(F.col("v"))).alias("mean"), rnd(metrics.mean_or(F.when(F.col("v") > 1e9, F.col("v")))).alias("empty_mean"))


_BOX = 15


@query(f"WITH {R2D}, p AS (SELECT r.slide, r.y, r.x, r.val, avg(q.val) AS box FROM r2d r JOIN r2d q ON q.slide = r.slide AND abs(q.y - r.y) <= 7 AND abs(q.x - r.x) <= 7 GROUP BY ALL) SELECT slide, round(avg(abs(val - box)), 6) AS edge FROM p GROUP BY slide")
def edge_box_mean(spark, sf):
    """Mean distance from the 15 x 15 box mean around each pixel, by two separable window sums."""
    px = r2d(spark, sf)
    along = Window.partitionBy("slide", "y").orderBy("x").rangeBetween(-(_BOX // 2), _BOX // 2)
    down = Window.partitionBy("slide", "x").orderBy("y").rangeBetween(-(_BOX // 2), _BOX // 2)
    rows = px.select("slide", "y", "x", "val", F.sum("val").over(along).alias("s"), F.count(F.lit(1)).over(along).alias("n"))
    box = rows.select("slide", "val", (F.sum("s").over(down) / F.sum("n").over(down)).alias("box"))
    return box.groupBy("slide").agg(rnd(F.avg(F.abs(F.col("val") - F.col("box")))).alias("edge"))


@query(f"WITH {PROB}, b AS (SELECT vec, any_value(grp) AS grp, arg_max(pos, p) AS top FROM prob GROUP BY vec), s AS (SELECT k, CAST(sum(CASE WHEN top = k AND grp = k THEN 1 ELSE 0 END) AS DOUBLE) AS i, sum(CASE WHEN top = k THEN 1 ELSE 0 END) AS p, sum(CASE WHEN grp = k THEN 1 ELSE 0 END) AS t FROM b, range(64) AS r(k) GROUP BY k) SELECT CAST(k AS BIGINT) AS cls, round(2 * i / nullif(p + t, 0), 6) AS dice, round(i / nullif(p + t - i, 0), 6) AS iou FROM s")
def micro_argmax_dice(spark, sf):
    top = prob(spark, sf).groupBy("vec").agg(F.first("grp").alias("grp"), F.max(F.struct("p", (-F.col("pos")).alias("m"))).alias("b")).select("grp", (-F.col("b.m")).alias("top"))
    c = metrics.class_overlap(top, "top", "grp", list(range(64)))
    i, p, t = F.col("inter"), F.col("p"), F.col("t")
    return c.select(F.col("cls").cast("long").alias("cls"), rnd(metrics.dice_or_null(i, p, t)).alias("dice"), rnd(metrics.iou_or_null(i, p, t)).alias("iou"))
