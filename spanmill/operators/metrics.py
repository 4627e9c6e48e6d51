"""Mask metrics as aggregations. Rules for empty masks differ by metric and are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators.scan import running


def overlap_sums(px: DataFrame, keys: list[str], pred: Column, truth: Column) -> DataFrame:
    """keys, inter, p, t: sums over positions of pred * truth, pred and truth."""
    return px.groupBy(*keys).agg(F.sum(pred * truth).cast("double").alias("inter"), F.sum(pred).cast("double").alias("p"), F.sum(truth).cast("double").alias("t"))


def dice_eps(inter: Column, p: Column, t: Column, eps: float = 1e-8) -> Column:
    """Dice with eps above and below: 1 for two empty masks."""
    return (2 * inter + eps) / (p + t + eps)


def dice_or_null(inter: Column, p: Column, t: Column) -> Column:
    """Dice, null for two empty masks."""
    return F.try_divide(2 * inter, p + t)


def dice_small(inter: Column, p: Column, t: Column, small: int) -> Column:
    """Dice where a prediction of `small` or less counts as empty; 1 if both are empty."""
    p0, i0 = F.when(p <= small, 0.0).otherwise(p), F.when(p <= small, 0.0).otherwise(inter)
    return F.when((p0 == 0) & (t == 0), 1.0).otherwise(2 * i0 / (p0 + t + 1e-12))


def iou_or_null(inter: Column, p: Column, t: Column) -> Column:
    return F.try_divide(inter, p + t - inter)


def confusion(rows: DataFrame, keys: list[str], pred: Column, truth: Column) -> DataFrame:
    """keys, tp, fp, fn, tn of 0/1 columns."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    one = F.lit(1)
    return rows.groupBy(*keys).agg(
        n((pred == one) & (truth == one)).alias("tp"), n((pred == one) & (truth != one)).alias("fp"), n((pred != one) & (truth == one)).alias("fn"), n((pred != one) & (truth != one)).alias("tn")
    )


def precision_recall_f1(c: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Precision, recall and F1 of tp, fp, fn, with eps in each denominator."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return c.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * precision * recall / (precision + recall + eps))


def threshold_sums(px: DataFrame, keys: list[str], score: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """keys, thr, inter, p, t for every threshold, from one pass over the rows: the few thresholds are exploded
    only after the scores are binned by how many thresholds they exceed."""
    grid = F.array(*[F.lit(x) for x in thresholds])
    bins = px.select(*keys, F.size(F.filter(grid, lambda x: score > x)).alias("__k"), truth.alias("__t")).groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("__n"), F.sum("__t").alias("__pos"))
    spread = bins.select(*keys, "__k", "__n", "__pos", F.posexplode(grid).alias("__i", "thr"))
    above = F.col("__k") > F.col("__i")
    return spread.groupBy(*keys, "thr").agg(F.sum(F.when(above, F.col("__pos")).otherwise(0)).cast("double").alias("inter"), F.sum(F.when(above, F.col("__n")).otherwise(0)).cast("double").alias("p"), F.sum("__pos").cast("double").alias("t"))


def best_threshold(scored: DataFrame, keys: list[str], score: str = "dice") -> DataFrame:
    """keys, thr, score of the best threshold; of equal ones the lowest. A null score counts as 0."""
    best = F.max(F.struct(F.coalesce(score, F.lit(0.0)).alias("s"), (-F.col("thr")).alias("m"))).alias("b")
    out = scored.groupBy(*keys).agg(best) if keys else scored.agg(best)
    return out.select(*keys, (-F.col("b.m")).alias("thr"), F.col("b.s").alias(score))


def average_precision(rows: DataFrame, keys: list[str], score: str, truth: str, order: str) -> DataFrame:
    """keys, ap: mean over the positives of the precision at their rank; by score descending, then `order`."""
    ranked = running(rows.select(*keys, F.col(score).alias("__s"), F.col(truth).alias("__t"), order), keys, [F.desc("__s"), order], {"rank": F.lit(1).cast("long"), "hits": F.col("__t").cast("long")})
    return ranked.groupBy(*keys).agg(F.avg(F.when(F.col("__t") == 1, F.col("hits") / F.col("rank"))).alias("ap"))


def lovasz_hinge(rows: DataFrame, keys: list[str], logit: str, truth: str, order: str, activation: str = "relu") -> DataFrame:
    """keys, loss: Lovasz hinge of logits against 0/1 truth, by errors descending, then `order`.

    activation: relu, or elu (e + 1 above 0, exp(e) below). The Jaccard loss before a row follows from
    the sums without it. A key without positives has the largest of its terms.
    """
    error = rows.select(*keys, order, F.col(truth).cast("double").alias("__t"), (1 - F.col(logit) * (2 * F.col(truth) - 1)).alias("__e"))
    placed = running(error, keys, [F.desc("__e"), order], {"pos": F.col("__t"), "neg": 1 - F.col("__t")})
    loss = lambda pos, neg: 1 - (F.col("all_pos") - pos) / (F.col("all_pos") + neg)
    before_pos, before_neg = F.col("pos") - F.col("__t"), F.col("neg") - (1 - F.col("__t"))
    step = loss(F.col("pos"), F.col("neg")) - F.when(before_pos + before_neg == 0, 0.0).otherwise(loss(before_pos, before_neg))
    shaped = F.greatest(F.col("__e"), F.lit(0.0)) if activation == "relu" else F.when(F.col("__e") > 0, F.col("__e") + 1).otherwise(F.exp("__e"))
    return placed.withColumn("__term", shaped * step).groupBy(*keys).agg(F.sum("__term").alias("loss"))


def lovasz_symmetric(rows: DataFrame, keys: list[str], logit: str, truth: str, order: str, activation: str = "relu") -> DataFrame:
    """keys, loss: mean of the Lovasz hinge and that of the negated logits against the negated truth."""
    turned = rows.withColumn(logit, -F.col(logit)).withColumn(truth, 1 - F.col(truth))
    both = lovasz_hinge(rows, keys, logit, truth, order, activation).unionByName(lovasz_hinge(turned, keys, logit, truth, order, activation))
    return both.groupBy(*keys).agg(F.avg("loss").alias("loss"))


def stable_bce(logit: Column, truth: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))


def focal(logit: Column, truth: Column, gamma: float = 2.0) -> Column:
    """Focal loss of a logit; there is no alpha term."""
    p = 1 / (1 + F.exp(-logit))
    pt = F.when(truth == 1, p).otherwise(1 - p)
    return F.pow(1 - pt, F.lit(gamma)) * stable_bce(logit, truth)


def mean_or(value: Column, empty: float = 0.0) -> Column:
    """Mean without NaN and null; `empty` if nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(empty))


def focal_loss(rows: DataFrame, keys: list[str], logit: str, truth: str, gamma: float = 2.0, reduction: str = "mean", order: str = "pos") -> DataFrame:
    """Focal loss reduced to its mean or sum per key, to a sum over items per position (batchwise_mean), or not at all (none)."""
    loss = focal(F.col(logit), F.col(truth), gamma)
    if reduction == "none":
        return rows.withColumn("loss", loss)
    if reduction == "batchwise_mean":
        return rows.groupBy(order).agg(F.sum(loss).alias("loss"))
    return rows.groupBy(*keys).agg((F.avg(loss) if reduction == "mean" else F.sum(loss)).alias("loss"))


def soft_bce(rows: DataFrame, keys: list[str], logit: str, truth: str, ignore: Column | None = None) -> DataFrame:
    """keys, loss: mean of the stable BCE against truth of any value from 0 to 1, without the items to ignore."""
    kept = rows if ignore is None else rows.filter(~ignore)
    return kept.groupBy(*keys).agg(F.avg(stable_bce(F.col(logit), F.col(truth))).alias("loss"))


def weighted_cross_entropy(logits: DataFrame, items: DataFrame, item: str, cls: str, logit: str, truth: str, weight: str, reduction: str = "mean") -> DataFrame:
    """loss: cross entropy of softmax logits (item, cls, logit) against items (item, truth, weight), weighted, as a mean or sum
    over items; with reduction none, item and loss."""
    top = logits.groupBy(item).agg(F.max(logit).alias("__m"))
    sums = logits.join(top, item).groupBy(item, "__m").agg(F.sum(F.exp(F.col(logit) - F.col("__m"))).alias("__s"))
    own = items.select(item, F.col(truth).alias(cls), weight).join(logits.select(item, cls, logit), [item, cls]).join(sums, item)
    each = own.select(item, (F.col(weight) * (F.ln("__s") + F.col("__m") - F.col(logit))).alias("loss"))
    if reduction == "none":
        return each
    return each.agg((F.avg("loss") if reduction == "mean" else F.sum("loss")).alias("loss"))


def dice_loss(p: Column, t: Column, smooth: float = 1.0) -> Column:
    """1 minus the smoothed Dice of probabilities and truth, as an aggregate."""
    return 1 - (2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)


def joint_loss(*terms: tuple[float, Column]) -> Column:
    """The weighted sum of losses."""
    total = terms[0][0] * terms[0][1]
    for weight, loss in terms[1:]:
        total = total + weight * loss
    return total


def nonempty_lovasz_bce(rows: DataFrame, keys: list[str], logit: str, truth: str, order: str) -> DataFrame:
    """loss, items: mean BCE over all pixels of the items with any truth plus the mean of their Lovasz hinges; 0 without such items."""
    some = rows.groupBy(*keys).agg(F.sum(truth).alias("__n")).filter("__n <> 0").select(*keys)
    kept = rows.join(some, keys, "left_semi")
    bce = kept.agg(F.avg(stable_bce(F.col(logit), F.col(truth))).alias("bce"))
    hinge = lovasz_hinge(kept, keys, logit, truth, order).agg(F.avg("loss").alias("hinge"), F.count(F.lit(1)).alias("items"))
    return bce.join(hinge).select((F.coalesce("bce", F.lit(0.0)) + F.coalesce("hinge", F.lit(0.0))).alias("loss"), "items")  # a row each


#: Side of the box whose mean an edge is told by.
EDGE_BOX = 15


def edge_loss(px: DataFrame, logit: str, truth: str, mode: str = "single", threshold: float = 1e-4) -> DataFrame:
    """slide, loss: BCE of pixels (slide, y, x) in which those near edges count again; 0 without edges of both kinds.

    An edge is where the truth is over, or under, the mean of the box around it (zeros outside) by more
    than the threshold. single: all pixels, then both kinds; double: those under twice; edge: edges only.
    """
    half = EDGE_BOX // 2
    along = Window.partitionBy("slide", "y").orderBy("x").rangeBetween(-half, half)
    down = Window.partitionBy("slide", "x").orderBy("y").rangeBetween(-half, half)
    box = px.withColumn("__s", F.sum(truth).over(along)).withColumn("__d", F.col(truth) - F.sum("__s").over(down) / float(EDGE_BOX * EDGE_BOX))
    under, over = (F.col("__d") < -threshold).cast("int"), (F.col("__d") > threshold).cast("int")
    weight = {"single": 1 + under + over, "double": 1 + 2 * under + over, "edge": under + over}[mode]
    bce = stable_bce(F.col(logit), F.col(truth))
    sums = box.groupBy("slide").agg((F.sum(weight * bce) / F.sum(weight)).alias("loss"), F.sum(under).alias("__u"), F.sum(over).alias("__o"))
    return sums.select("slide", F.when((F.col("__u") > 0) & (F.col("__o") > 0), F.col("loss")).otherwise(0.0).alias("loss"))


def top_k(rows: DataFrame, item: str, cls: str, score: str, truth: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row of percentages top1, top5 ...: how many items have their truth among the k classes of highest score (ties: least class)."""
    most = max(ks)
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), (-F.col(cls)).alias("m"))))), 1, most)
    top = rows.groupBy(item).agg(F.first(truth).alias("__t"), F.transform(best, lambda s: -s["m"]).alias("__top"))
    return top.agg(*[(100 * F.avg(F.array_contains(F.slice("__top", 1, k), F.col("__t")).cast("double"))).alias(f"top{k}") for k in ks])


def class_overlap(rows: DataFrame, pred: str, truth: str, classes: list) -> DataFrame:
    """cls, inter, p, t of each class over all rows: pairs are counted once, then spread to the classes."""
    counts = rows.groupBy(F.col(pred).alias("__p"), F.col(truth).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    spread = counts.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    n = lambda c: F.sum(F.when(c, F.col("__n")).otherwise(0)).cast("double")
    p, t = F.col("__p") == F.col("cls"), F.col("__t") == F.col("cls")
    return spread.groupBy("cls").agg(n(p & t).alias("inter"), n(p).alias("p"), n(t).alias("t"))
