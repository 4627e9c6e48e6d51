"""Cohort statistics and table operators over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators.sampling import numbered
from spanmill.operators.scan import running


def frequencies(rows: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """by, c, n: how often each non-null category stands."""
    return rows.filter(F.col(c).isNotNull()).groupBy(*(by or []), c).agg(F.count(F.lit(1)).alias("n"))


def modes(rows: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """by, c, n of the most frequent categories, all that tie. Ranks categories, not rows."""
    counts = frequencies(rows, c, by)
    most = counts.groupBy(*(by or [])).agg(F.max("n").alias("n")) if by else counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(most) if not by else most, [*(by or []), "n"], "left_semi").select(*(by or []), c, "n")


def summary(c: str, digits: int = 2) -> list[Column]:
    """mean (half-even), min, max, range of a column."""
    return [F.bround(F.avg(c), digits).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range")]


def histogram(rows: DataFrame, c: str, bins: int = 5) -> DataFrame:
    """bin (from 1), n: equal-width bins between minimum and maximum, the last closed on the right."""
    ends = rows.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    counted = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))  # the ends join values, not rows
    binned = counted.join(F.broadcast(ends)).select(F.least(F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("long") + 1, F.lit(bins).cast("long")).alias("bin"), "n")
    return binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.sum("n").alias("n"))


def looked_up(rows: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """rows with dim's value by key; a key that the dimension lacks is an error when it is read."""
    joined = rows.join(dim.select(key, F.col(value).alias("__v")), key, "left")
    checked = F.when(F.col("__v").isNull(), F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))).otherwise(F.col("__v"))
    return joined.withColumn(value, checked).drop("__v")


def template_update(template: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """template with the values that results has by key; rows of results without template row are left out."""
    new = results.select(key, F.col(value).alias("__new"))
    return template.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def replicate(rows: DataFrame, rate: int, name: str = "copy") -> DataFrame:
    """Each row `rate` times, numbered from 0; no shuffle."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(rate - 1))))


def nearest_rank(rows: DataFrame, keys: list[str], c: str, percents: list[int]) -> DataFrame:
    """keys, p, value: element number int(n p / 100) from 0 of the sorted values, the last for p of 100.

    By numbers over ranges, so no list of a group is built and no group is one task. Equal values
    may be numbered in any order.
    """
    ranked = running(rows.filter(F.col(c).isNotNull()).select(*keys, F.col(c).alias("value")), keys, ["value"], {"k": F.lit(1).cast("long")})
    place = lambda p: F.least(F.floor(F.col("all_k") * p / 100), F.col("all_k") - 1)
    # the few rows wanted first, so that no other is multiplied
    few = ranked.filter(_any([F.col("k") - 1 == place(F.lit(p)) for p in percents])) if percents else ranked.limit(0)
    wanted = few.select("*", F.explode(F.array(*[F.lit(p) for p in percents]).cast("array<int>")).alias("p"))
    return wanted.filter(F.col("k") - 1 == place(F.col("p"))).select(*keys, F.col("p").cast("long").alias("p"), "value")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def is_named(name: Column, wanted: str, exact: bool = True) -> Column:
    """Whether a class has a name, in any case if not exact; a null name has none."""
    return F.coalesce(name == wanted if exact else F.lower(name) == wanted.lower(), F.lit(False))


def stem(name: Column) -> Column:
    """A file name up to its first dot."""
    return F.substring_index(name, ".", 1)


def suffix_join(images: DataFrame, masks: DataFrame, image: str, mask: str) -> DataFrame:
    """images with the mask of the same stem: the suffix that masks have is inferred from the first image's first match.

    First by name; no match of the first image is an error.
    """
    first = images.agg(F.min(stem(F.col(image)))).first()[0]
    match = masks.filter(F.col(mask).startswith(first)).agg(F.min(mask)).first()[0] if first is not None else None
    if first is not None and match is None:
        raise FileNotFoundError(f"{first} has no mask")
    return images.join(masks, F.concat(stem(F.col(image)), F.lit((match or "")[len(first or "") :])) == F.col(mask))


def paired(a: DataFrame, b: DataFrame, by_a: str, by_b: str) -> DataFrame:
    """by_a, by_b, number: the rows of two lists, each in its own order, side by side; lists of different lengths are an error.

    Numbers come from ranges of each order, so no task has a list. Nulls come first.
    """
    left, right = numbered(a.select(by_a), [by_a], "number"), numbered(b.select(by_b), [by_b], "number")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows to pair with {m}")
    return left.join(right, "number").select(by_a, by_b, "number")


def quantiles(rows: DataFrame, keys: list[str], c: str, shares: list[float]) -> DataFrame:
    """keys, q1, q2 ...: quantiles of non-null values, linear between neighbours, by numbers over ranges: no task has a group's values."""
    ranked = running(rows.filter(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("__v")), keys, ["__v"], {"__k": F.lit(1).cast("long")})
    span = F.col("all___k") - 1
    few = ranked.filter(_any([(F.col("__k") - 1 == f(span * F.lit(p))) for p in shares for f in (F.floor, F.ceil)]))
    wanted = few.withColumn("__q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares, 1)])))
    at, k = (F.col("all___k") - 1) * F.col("__q.p"), F.col("__k") - 1
    near = wanted.filter((k == F.floor(at)) | (k == F.ceil(at)))
    low, high = F.max(F.when(k == F.floor(at), F.col("__v"))), F.max(F.when(k == F.ceil(at), F.col("__v")))
    found = near.groupBy(*keys, F.col("__q.i").alias("__i")).agg((low + (high - low) * F.max(at - F.floor(at))).alias("v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("v"))).alias(f"q{i}") for i in range(1, len(shares) + 1)])


def regression(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """keys, slope, intercept, r2 of least squares."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def density(rows: DataFrame, keys: list[str], area: Column, micron: float) -> DataFrame:
    """keys, n, per_mm2: objects per square millimetre of their own area, given the microns of a pixel's side."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("__a")).select(*keys, "n", (F.col("n") / (F.col("__a") * micron * micron) * 1e6).alias("per_mm2"))


def pair_or_last(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, parts, value: the sum where a key has exactly two rows, else the value of the last one."""
    last = F.max(F.struct(order, value))[value]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.when(F.count(F.lit(1)) == 2, F.sum(value)).otherwise(last).alias(value))


def with_grand_mean(groups: DataFrame, name: str, value: str, n: str, label: str = "AVE") -> DataFrame:
    """groups (name, value, n) and a row of the mean value and the total n."""
    return groups.select(name, value, n).unionByName(groups.agg(F.lit(label).alias(name), F.avg(value).alias(value), F.sum(n).alias(n)))


def capped(rows: DataFrame, keys: list[str], order: list[str], n: int | None = None, name: str = "k") -> DataFrame:
    """rows with their number from 1 within keys, the first n of each: Spark keeps n per key and task before it shuffles.

    Without n no row goes, and numbers come from ranges, so that no key is one task.
    """
    if n is None:
        return running(rows, keys, order, {name: F.lit(1).cast("long")}).drop(f"all_{name}")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def rates(rows: DataFrame, keys: list[str], value: str, ts: str, order: str) -> DataFrame:
    """keys, per_second (total by the time between the first and last row), total, mean, last."""
    micros = lambda f: F.unix_micros(f(F.col(ts).cast("timestamp")))
    total = F.sum(value)
    return rows.groupBy(*keys).agg((total / ((micros(F.max) - micros(F.min)) / 1e6)).alias("per_second"), total.alias("total"), F.avg(value).alias("mean"), F.max(F.struct(order, value))[value].alias("last"))
