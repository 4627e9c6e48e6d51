"""Ensembling, voting and consensus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.plans.session import cut, drop


def merge(pred: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """keys and the mean, maximum and sample deviation of stacked predictions."""
    return pred.groupBy(*keys).agg(F.avg(p).alias("mean"), F.max(p).alias("max"), F.stddev_samp(p).alias("std"))


def argmax(pred: DataFrame, keys: list[str], cls: str, p: str) -> DataFrame:
    """keys, cls, p of the largest p; of equal ones the least cls."""
    return pred.groupBy(*keys).agg(F.max(F.struct(F.col(p).alias("p"), (-F.col(cls)).alias("c"))).alias("b")).select(*keys, (-F.col("b.c")).alias(cls), F.col("b.p").alias(p))


def softmax(pred: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """pred with softmax within keys; the maximum is taken off first."""
    over = Window.partitionBy(*keys)
    shifted = pred.withColumn("__e", F.exp(F.col(logit) - F.max(logit).over(over)))
    return shifted.withColumn("softmax", F.col("__e") / F.sum("__e").over(over)).drop("__e")


def energy(logits: Column, temperature: float = 1.0) -> Column:
    """T * log of the sum of exp(logit / T) of an array."""
    top = F.array_max(logits)
    return top + temperature * F.log(F.aggregate(F.transform(logits, lambda x: F.exp((x - top) / temperature)), F.lit(0.0), lambda a, x: a + x))


def majority(votes: DataFrame, keys: list[str], label: str, undecided: str) -> DataFrame:
    """keys, label: the label with most votes; where several tie, `undecided`."""
    counts = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", label)).alias("hi"), F.max("n").alias("n"), F.collect_list("n").alias("all"))
    ties = F.size(F.filter("all", lambda n: n == F.col("n")))
    return best.select(*keys, F.when(ties > 1, F.lit(undecided)).otherwise(F.col(f"hi.{label}")).alias(label))


def agreement(votes: DataFrame, consensus: DataFrame, keys: list[str], by: list[str], label: str, target: str) -> DataFrame:
    """by (expert, file), iou: IoU of the `target` items of votes with the consensus's (keys, label); null where neither has any."""
    joined = votes.join(consensus.select(*keys, F.col(label).alias("__c")), keys)
    a, b = F.col(label) == target, F.col("__c") == target
    return joined.groupBy(*by).agg(F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("iou"))


def ema(log: DataFrame, keys: list[str], order: str, value: str, decay: float) -> DataFrame:
    """log with ema: d * ema + (1 - d) * value, beginning with the first value; decay is over 0 and under 1.

    In closed form within blocks of rows short enough that d^-n stays finite (1e100); a block takes
    over the last value of the one before it. What comes from further back weighs 1e-100 and less,
    which is below the precision of a double. A run is one key; all its rows are one task.
    """
    block = max(1, int(230 / -math.log(decay)))
    by = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(by) - 1
    numbered = log.withColumn("__b", F.floor(i / block)).withColumn("__k", (i % block).cast("double"))
    first = (F.col("__b") == 0) & (F.col("__k") == 0)
    term = F.when(first, F.col(value)).otherwise((1 - decay) * F.col(value)) * F.pow(F.lit(decay), -F.col("__k"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.withColumn("__s", F.sum(term).over(inside) * F.pow(F.lit(decay), F.col("__k")))
    along = Window.partitionBy(*keys).orderBy("__b")
    last = F.when(F.col("__k") == block - 1, F.col("__s"))
    carried = lambda n: F.coalesce(F.max(last).over(along.rangeBetween(-n, -n)), F.lit(0.0))
    over = carried(1) + F.pow(F.lit(decay), F.lit(block)) * carried(2)
    return summed.withColumn("ema", F.col("__s") + F.pow(F.lit(decay), F.col("__k") + 1) * over).drop("__b", "__k", "__s")


#: What a sensitivity or specificity may be at least, and at most from 1.
LEAST_RATE = 1e-7


def staple(votes: DataFrame, keys: list[str], expert: str, vote: str, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """keys, weight: probability that an item is foreground, by simultaneous truth and performance estimation.

    Expectation maximisation of experts' sensitivity and specificity, from .99 each. Items with the same votes of the
    same experts behave alike, so items are counted by vote pattern once, and a round is an aggregation of the written
    patterns, however many there are: a row per expert comes back, and no task has all patterns. Each
    item's weight then follows from its own votes, without a join. The prior is the share of
    positive votes; where all votes are alike, it is the weight. Null votes and votes of no expert are left out.
    """
    told = votes.filter(F.col(vote).isNotNull() & F.col(expert).isNotNull())
    patterns = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(expert).cast("string").alias("e"), F.col(vote).cast("int").alias("v")))).alias("pattern"))
    held: list[str] = []
    counted = cut(patterns.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns", held)
    single = counted.select("pattern", "n", F.explode("pattern").alias("x"))
    prior = single.agg(F.sum(F.when(F.col("x.v") == 1, F.col("n")).otherwise(0.0)) / F.sum("n")).first()[0] or 0.0
    if prior in (0.0, 1.0):
        drop(votes.sparkSession, held)
        return patterns.select(*keys, F.lit(float(prior)).alias("weight"))
    rates = {r["e"]: (0.99, 0.99) for r in single.select("x.e").distinct().collect()}
    for _ in range(rounds):
        each = counted.select("pattern", "n", _foreground(rates, prior).alias("w")).select("n", "w", F.explode("pattern").alias("x"))
        yes, fore, back = F.col("x.v") == 1, F.col("n") * F.col("w"), F.col("n") * (1 - F.col("w"))
        share = lambda hit, of: F.greatest(F.least(F.coalesce(F.try_divide(F.sum(F.when(hit, of).otherwise(0.0)), F.sum(of)), F.lit(0.99)), F.lit(1 - LEAST_RATE)), F.lit(LEAST_RATE))
        new = {r["e"]: (r["p"], r["q"]) for r in each.groupBy("x.e").agg(share(yes, fore).alias("p"), share(~yes, back).alias("q")).collect()}
        moved = max(abs(x - y) for e in new for x, y in zip(new[e], rates[e], strict=True))
        rates = new
        if moved < tolerance:
            break
    drop(votes.sparkSession, held)
    return patterns.select(*keys, _foreground(rates, prior).alias("weight"))


def _foreground(rates: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability that an item with a pattern is foreground; rates of experts are two small literal maps."""
    p, q = (F.create_map(*[F.lit(x) for e, r in rates.items() for x in (e, r[k])]) for k in (0, 1))
    total = lambda yes, no: F.aggregate("pattern", F.lit(0.0), lambda a, x: a + F.ln(F.when(x["v"] == 1, yes(x)).otherwise(no(x))))
    fore = F.lit(math.log(prior)) + total(lambda x: F.element_at(p, x["e"]), lambda x: 1 - F.element_at(p, x["e"]))
    back = F.lit(math.log(1 - prior)) + total(lambda x: 1 - F.element_at(q, x["e"]), lambda x: F.element_at(q, x["e"]))
    return 1 / (1 + F.exp(back - fore))


def results_with_ensemble(models: list[DataFrame], keys: list[str], file: str, value: str, name: str = "ensemble") -> DataFrame:
    """keys, model, value of each model's results and of their mean; each file must have the rows of all models.

    models: tables of keys (file among them) and value; a file that some model lacks, or has twice, is
    an error when the result is read.
    """
    own = [m.select(*keys, F.lit(k).alias("__k"), value) for k, m in enumerate(models)]
    every = own[0]
    for m in own[1:]:
        every = every.unionByName(m)
    counted = every.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__n"), F.count_distinct("__k").alias("__m"))
    wrong = (F.col("__n") != len(models)) | (F.col("__m") != len(models))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("predictions and models don't match: "), F.col(file).cast("string")))).otherwise(F.col(value))
    return every.select(*keys, F.concat(F.lit("model_"), F.col("__k").cast("string")).alias("model"), value).unionByName(counted.select(*keys, F.lit(name).alias("model"), checked.alias(value)))


def map_entropy(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, entropy of values normalised to 1: ln(S) - sum(v ln v) / S, one grouping and no window."""
    v = F.col(value).cast("double")
    return px.groupBy(*keys).agg((F.ln(F.sum(v)) - F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)) / F.sum(v)).alias("entropy"))


def pooled_max(px: DataFrame, value: Column, window: int) -> DataFrame:
    """slide, most: the largest mean of a value over full square windows of pixels (slide, y, x, h, w)."""
    full = px.filter((F.col("y") < F.floor(F.col("h") / window) * window) & (F.col("x") < F.floor(F.col("w") / window) * window))
    pooled = full.groupBy("slide", F.floor(F.col("y") / window), F.floor(F.col("x") / window)).agg(F.avg(value).alias("e"))
    return pooled.groupBy("slide").agg(F.max("e").alias("most"))
