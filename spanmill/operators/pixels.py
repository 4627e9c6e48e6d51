"""Projections and filters of pixel tables: normalisation, colours, gates, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.plans.session import many

# Mean and deviation of the three channels, and the weights of gray.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
GRAY = (0.299, 0.587, 0.144)


def normalised(value: Column, channel: Column, back: bool = False) -> Column:
    """A channel's value less its mean, by its deviation; or the way back."""
    mean, std = (F.get(F.array(*[F.lit(x) for x in own]), channel.cast("int")) for own in (CHANNEL_MEAN, CHANNEL_STD))
    return value * std + mean if back else (value - mean) / std


def fitted_zscore(px: DataFrame, keys: list[str], value: str, times: float = 2.0, most: float = 5.0, name: str = "z") -> DataFrame:
    """px with z: the value less its key's mean by `times` its deviation, clipped to +- most; null where a key is constant."""
    fit = px.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.try_divide(F.col(value) - F.col("__m"), times * F.col("__s"))
    return many(px).join(fit, keys).withColumn(name, F.greatest(F.least(z, F.lit(most)), F.lit(-most))).drop("__m", "__s")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation from 0 to 255."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(hi == 0, 0.0).otherwise(255.0 * (hi - lo) / hi)


def gray(r: Column, g: Column, b: Column) -> Column:
    return GRAY[0] * r + GRAY[1] * g + GRAY[2] * b


def overlaid(value: Column, on: Column) -> Column:
    """A channel of an overlay: full where a mask is on."""
    return F.when(on, 255).otherwise(value)


def gated(px: DataFrame, keys: list[str], score: str, threshold: float, name: str = "gated") -> DataFrame:
    """px with the score, 0 for a whole key none of whose scores is over the threshold."""
    top = px.groupBy(*keys).agg((F.max(score) > threshold).alias("__open"))
    return many(px).join(top, keys).withColumn(name, F.when(F.col("__open"), F.col(score)).otherwise(0.0)).drop("__open")


def nonempty(px: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """keys, label: 1.0 where a mask has any pixel, else 0.0."""
    return px.groupBy(*keys).agg((F.sum(mask) > 0).cast("double").alias("label"))


def region_prior(px: DataFrame, keys: list[str], cls: Column, prior: list[float], free: Column) -> DataFrame:
    """keys, cls, p: each class's prior shared among its pixels, summed over those that are free (annotated ones get 0)."""
    per = px.groupBy(*keys, cls.cast("long").alias("cls")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(free).alias("__free"))
    own = F.get(F.array(*[F.lit(p) for p in prior]), F.col("cls").cast("int"))
    return per.select(*keys, "cls", (own * F.col("__free") / F.col("__n")).alias("p"))


def moments(px: DataFrame, image: str, value: Column, every: int = 4) -> DataFrame:
    """One row: dataset mean and deviation by streaming moments, the mean of deviations, the root of mean variances, and both of every n-th image."""
    own = px.groupBy(image).agg(F.avg(value).alias("m"), F.avg(value * value).alias("q"), F.stddev_pop(value).alias("s"), F.var_pop(value).alias("v"))
    step = F.col(image) % every == 0
    return own.agg(
        F.avg("m").alias("mean"), F.sqrt(F.avg("q") - F.pow(F.avg("m"), F.lit(2))).alias("std"), F.avg("s").alias("mean_std"), F.sqrt(F.avg("v")).alias("root_var"),
        F.avg(F.when(step, F.col("m"))).alias("step_mean"), F.avg(F.when(step, F.col("s"))).alias("step_std"),
    )


def class_counts(rows: DataFrame, cls: Column, special: str, name: str = "n") -> DataFrame:
    """add, only, n for each setting of two switches: whether the special class is let in, and whether it alone is."""
    counts = rows.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("__n"))
    switches = F.explode(F.array(*[F.struct(F.lit(a).alias("add"), F.lit(b).alias("only")) for a in (True, False) for b in (True, False)])).alias("k")
    spread = counts.select("cls", "__n", switches).select("cls", "__n", "k.add", "k.only")
    own = F.col("cls") == special
    return spread.filter((F.col("add") | ~own) & (~F.col("only") | own)).groupBy("add", "only").agg(F.sum("__n").alias(name))
