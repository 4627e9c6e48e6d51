"""Exact Euclidean distances from objects, over images of any size, without a radius.

Objects are vertical runs. A column's runs are dealt to strips of rows: to each strip those that meet it and, above and
below, the nearest ones of two different labels; whatever lies beyond can be neither the nearest nor the second object
of any pixel of the strip. A strip then takes the distances along its columns, and along each row the least of the
parabolas that the columns put up, by halving: the column that is nearest to a place is not left of that nearest to
a place left of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators.groups import dealt, whole_groups
from spanmill.operators.rle import encode_spans
from spanmill.plans.session import cut, drop, many

#: Rows of a strip, and places whose parabolas are compared at once.
STRIP, PLACES = 32, 1 << 20
#: The squared distance of what isn't there.
FAR = 1e15
#: exp(-d^2 / 2 s^2) is 0 in single precision beyond so many s.
VANISHES = 14.5


def least_parabolas(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least f[row, c] + (x - c)^2, that c) for each row and place x."""
    rows, width = f.shape
    value, where = np.empty_like(f), np.zeros(f.shape, dtype=np.int64)
    step = 1 << max(width - 1, 1).bit_length()
    while step >= 1:
        xs = np.arange(0, width, step) if step == 1 << max(width - 1, 1).bit_length() else np.arange(step, width, 2 * step)
        if len(xs):
            low = where[:, xs - step] if xs[0] else np.zeros((rows, len(xs)), dtype=np.int64)
            after = xs + step
            high = np.where(after < width, where[:, np.minimum(after, width - 1)], width - 1) if xs[0] else np.full((rows, len(xs)), width - 1)
            _scan(f, xs, low, high, value, where)
        step //= 2
    return value, where


def _scan(f: np.ndarray, xs: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, where: np.ndarray) -> None:
    """Fill value and where at places xs from the columns low to high of each, some at a time."""
    count = (high - low + 1).ravel()
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")), at + 1)
        n = count[at:end]
        first = np.cumsum(n) - n
        row, k = np.divmod(np.arange(at, end), len(xs))
        column = np.arange(n.sum()) - np.repeat(first - low.ravel()[at:end], n)
        cost = f[np.repeat(row, n), column] + (np.repeat(xs[k], n) - column).astype(float) ** 2
        least = np.minimum.reduceat(cost, first)
        hits = np.flatnonzero(cost == np.repeat(least, n))
        own = np.searchsorted(hits, first)  # the leftmost of each
        value[row, xs[k]], where[row, xs[k]] = least, column[hits[own]]
        at = end


def _by_label(y0: np.ndarray, rows: int, image: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(images, columns, labels, squared distances [entry, row]) of each label of each column of each image from a strip's rows."""
    order = np.lexsort((label, x, image))
    image, x, lo, hi, label = (v[order] for v in (image, x, lo, hi, label))
    y = y0[image][:, None] + np.arange(rows)
    d = np.maximum(np.maximum(lo[:, None] - y, y - hi[:, None] + 1), 0).astype(float) ** 2
    begins = np.flatnonzero(np.concatenate(([True], (image[1:] != image[:-1]) | (x[1:] != x[:-1]) | (label[1:] != label[:-1]))))
    return image[begins], x[begins], label[begins], np.minimum.reduceat(d, begins, axis=0)


def two_nearest(y0: np.ndarray, rows: int, width: int, image: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances [image, row, x] of strips' pixels from the nearest label and from the nearest other one; FAR or more: there is none.

    Strips of so many rows and columns at once begin at y0 of each; image says whose strip a run is. Each two labels differ in a bit
    of their numbers: the second is the least over all bits of the nearest whose bit is not as the first's.
    """
    far = np.full((len(y0), rows, width), FAR)
    if not len(x):
        return far, far.copy()
    image, column, label, d = _by_label(y0, rows, image, x, lo, hi, label)
    # labels numbered within their image
    pairs, number = np.unique(np.stack([image, label]), axis=1, return_inverse=True)
    number = number.ravel() - np.searchsorted(pairs[0], image)

    def grid(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of some entries in each column, and its label's number."""
        f, who = far.copy(), np.zeros(far.shape, dtype=np.int64)
        # entries are by image, column and label: the k-th of each column at once
        at = image[own] * width + column[own]
        begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(at)]))))
        for k in range(int(rank.max(initial=-1)) + 1):
            e = own[rank == k]
            g, c = image[e], column[e]
            nearer = d[e] < f[g, :, c]
            f[g, :, c] = np.where(nearer, d[e], f[g, :, c])
            who[g, :, c] = np.where(nearer, number[e][:, None], who[g, :, c])
        return f.reshape(-1, width), who.reshape(-1, width)

    f, who = grid(np.arange(len(column)))
    first, at = least_parabolas(f)
    nearest = np.take_along_axis(who, at, axis=1)
    second = np.full(f.shape, FAR)
    for b in range(int(number.max(initial=0)).bit_length()):
        for bit in (0, 1):
            other = np.flatnonzero((number >> b & 1) == bit)
            if len(other):
                value, _ = least_parabolas(grid(other)[0])
                second = np.where(nearest >> b & 1 != bit, np.minimum(second, value), second)
    return first.reshape(far.shape), second.reshape(far.shape)


def closeness(y0: np.ndarray, rows: int, width: int, image: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, label: np.ndarray, sigma: float) -> np.ndarray:
    """[image, row, x]: sum over labels of exp(-d^2 / 2 sigma^2)."""
    out = np.zeros((len(y0), rows, width))
    if not len(x):
        return out
    image, column, label, d = _by_label(y0, rows, image, x, lo, hi, label)
    reach = math.ceil(VANISHES * sigma)
    order = np.lexsort((column, label, image))
    image, column, label, d = image[order], column[order], label[order], d[order]
    begins = np.flatnonzero(np.concatenate(([True], (image[1:] != image[:-1]) | (label[1:] != label[:-1]))))
    ends = np.append(begins[1:], len(image))
    left, right = np.maximum(column[begins] - reach, 0), np.minimum(column[ends - 1] + reach + 1, width)
    a = 0
    while a < len(begins):  # so many labels at once as fit
        wide = int((right - left)[a])
        b = a + 1
        while b < len(begins) and (b + 1 - a) * rows * max(wide, int(right[b] - left[b])) <= PLACES:
            wide, b = max(wide, int(right[b] - left[b])), b + 1
        own = slice(begins[a], ends[b - 1])
        which = np.repeat(np.arange(b - a), (ends - begins)[a:b])
        f = np.full((b - a, rows, wide), FAR)
        f[which, :, column[own] - left[a:b][which]] = d[own]
        value = np.exp(-least_parabolas(f.reshape(-1, wide))[0].reshape(f.shape) / (2 * sigma * sigma))
        k, j = np.nonzero(np.arange(wide) < (right - left)[a:b][:, None])
        np.add.at(out, (image[begins[a:b]][k], slice(None), left[a:b][k] + j), value[k, :, j])
        a = b
    return out


def _dealt(columns: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, strip, x, lo, hi, label: a column's runs (rows: keys, x, h, runs by place) as the strips need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            ends = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            flat = runs.flatten()
            los, his, labels = (flat.field(k).to_numpy() for k in ("lo", "hi", "label"))
            high = batch.column("h").to_numpy()
            low = np.flatnonzero(high <= STRIP)  # columns of one strip have all their runs in it
            n = np.diff(ends)
            column = [np.repeat(low, n[low])]
            own = [np.arange(len(column[0])) + np.repeat(ends[low] - (np.cumsum(n[low]) - n[low]), n[low])]
            strip = [np.zeros(len(column[0]), dtype=np.int64)]
            for c in np.flatnonzero(high > STRIP):
                part = slice(ends[c], ends[c + 1])
                for s, held in enumerate(_near_strips(los[part], his[part], labels[part], int(high[c]), reach)):
                    column.append(np.full(len(held), c))
                    own.append(held + ends[c])
                    strip.append(np.full(len(held), s))
            at, own = np.concatenate(column), np.concatenate(own)
            values = [np.concatenate(strip), batch.column("x").to_numpy()[at], los[own], his[own], labels[own]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), *(pa.array(v, pa.int64()) for v in values)], names=[*keys, "strip", "x", "lo", "hi", "label"])

    kinds = {f.name: f.dataType.simpleString() for f in columns.schema}
    many_tasks = columns.repartition(int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "x")
    return many_tasks.mapInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, strip long, x long, lo long, hi long, label long")


def _near_strips(lo: np.ndarray, hi: np.ndarray, label: np.ndarray, h: int, reach: int) -> Iterator[np.ndarray]:
    """For each strip of a column of height h which of its runs the strip needs."""
    n = len(lo)
    # of each run the nearest of another label before and after it; -1 and n: none
    changes = np.concatenate(([True], label[1:] != label[:-1]))
    block = np.cumsum(changes) - 1
    begins = np.append(np.flatnonzero(changes), n)
    before, after = begins[block] - 1, begins[block + 1]
    for s in range(-(-h // STRIP)):
        y0, y1 = s * STRIP, (s + 1) * STRIP
        a, b = int(np.searchsorted(hi, y0, "right")), int(np.searchsorted(lo, y1, "left"))
        own = set(range(int(np.searchsorted(hi, y0 - reach, "right")), int(np.searchsorted(lo, y1 + reach, "left"))))
        if a:
            own |= {a - 1, int(before[a - 1])}
        if b < n:
            own |= {b, int(after[b])}
        yield np.array(sorted(own - {-1, n}), dtype=np.int64)


def distances(labels: DataFrame, keys: list[str], sigma: float | None = None) -> DataFrame:
    """keys, y, x, d1, d2, near of all pixels (keys, y, x, label; 0 or null: no object): how far the nearest object is, and the nearest other one.

    Distances are exact at any range, 0 within an object; without one (or two) they are null. near is the sum over all objects of
    exp(-d^2 / 2 sigma^2), where sigma is given; terms that are 0 in single precision may be left out. y and x are from 0. A strip of
    rows of one key is one task's, whatever the image's size, and small ones are taken together; a column's runs are another's.
    """
    px = labels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("label"))
    runs = encode_spans(px.filter("label <> 0"), [*keys, "label", "x"], "y")
    heights = px.groupBy(*keys).agg((F.max("y") + 1).alias("h"))
    columns = runs.groupBy(*keys, "x").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "label"))).alias("runs")).join(heights, keys)
    runs_near = _dealt(columns, keys, math.ceil(VANISHES * sigma) if sigma else 0)

    by = [*keys, "strip"]

    def strips(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """Rows of some strips, numbered by group: pixels (lo is null) and the runs that they need."""
        is_px = pdf["lo"].isna().to_numpy()
        y, x, owner = pdf["y"].to_numpy()[is_px].astype(np.int64), pdf["x"].to_numpy(dtype=np.int64)[is_px], group[is_px]
        near = [pdf[c].to_numpy()[~is_px].astype(np.int64) for c in ("x", "lo", "hi", "label")]
        n = int(group[-1]) + 1
        y0 = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(y0, owner, y)
        held = np.isin(group[~is_px], owner)  # else rows that no pixel has
        parts = [group[~is_px][held], *(v[held] for v in near)]
        rows = int((y - y0[owner]).max(initial=0)) + 1
        width = int(max(x.max(initial=0), parts[1].max(initial=0))) + 1
        first, second = two_nearest(y0, rows, width, *parts)
        closer = closeness(y0, rows, width, *parts, sigma) if sigma else np.zeros(first.shape)
        at = (owner, y - y0[owner], x)
        root = lambda d: pd.array(np.sqrt(d), dtype="Float64")
        out = pdf.loc[is_px, keys].assign(y=y, x=x, d1=root(first[at]), d2=root(second[at]), near=closer[at])
        out.loc[first[at] >= FAR, "d1"] = pd.NA
        out.loc[second[at] >= FAR, "d2"] = pd.NA
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, by):
            width = np.zeros(int(group[-1]) + 1, dtype=np.int64)
            np.maximum.at(width, group, pdf["x"].to_numpy(dtype=np.int64) + 1)
            a = 0
            while a < len(width):  # strips of like widths, as many as fit
                b, wide = a + 1, width[a]
                while b < len(width) and (b + 1 - a) * STRIP * max(wide, width[b]) <= PLACES and width[b] <= 2 * wide:
                    wide, b = max(wide, width[b]), b + 1
                low, high = np.searchsorted(group, [a, b])
                if pdf["lo"].iloc[low:high].isna().any():
                    yield strips(pdf.iloc[low:high].reset_index(drop=True), group[low:high] - a)
                a = b

    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    none = [F.lit(None).cast("long").alias(c) for c in ("lo", "hi", "label")]
    places = px.select(*by[:-1], F.floor(F.col("y") / STRIP).cast("long").alias("strip"), "y", "x", *none)
    needed = runs_near.select(*by, F.lit(None).cast("long").alias("y"), "x", "lo", "hi", "label")
    return dealt(places.unionByName(needed), by).mapInPandas(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, y long, x long, d1 double, d2 double, near double")


def distance_weights(labels: DataFrame, weight: float = 10.0, sigma: float = 10.0, foreground: float = 10.0, background: float = 0.1, cls: str | None = None, ground: str | None = None, ignored: str | None = None) -> DataFrame:
    """slide, y, x, weight, chance of pixels (slide, y, x, label: an object's number, 0 or null: none).

    Objects weigh 1. Elsewhere the background rate, for each class weight * exp(-(d1 + d2)^2 / 2 sigma^2) of the distances
    from its nearest two objects (nothing where there is but one), and what is left to 1 of the rate times the sum over all objects of
    exp(-d^2 / 2 foreground^2). chance is 1 on objects, else the rate. cls names a column of classes (of an object's pixels; null: one class for all);
    ground a boolean column that says which pixels count as objects, where ridges between them don't; ignored one of pixels that
    weigh 0 and have no chance. Null in either is as false, but for ground then the label decides.
    """
    px = labels.withColumn("label", F.coalesce(F.col("label").cast("long"), F.lit(0)))
    one = F.coalesce(F.col(cls).cast("string"), F.lit("")) if cls else F.lit("")
    classes = px.filter("label <> 0").select("slide", one.alias("__class")).distinct()
    own = px.select("slide", "y", "x", "label", one.alias("__own")).join(classes, "slide")
    own = own.select("slide", "__class", "y", "x", F.when(F.col("__own") == F.col("__class"), F.col("label")).otherwise(0).alias("label"))
    far = distances(own, ["slide", "__class"], foreground)
    border = F.coalesce(weight * F.exp(-F.pow(F.col("d1") + F.col("d2"), F.lit(2)) / (2 * sigma * sigma)), F.lit(0.0))
    sums = far.groupBy("slide", "y", "x").agg(F.sum(border).alias("__border"), F.sum("near").alias("__near"))
    held = F.coalesce(F.col(ground), F.col("label") != 0) if ground else F.col("label") != 0
    out = F.coalesce(F.col(ignored), F.lit(False)) if ignored else F.lit(False)
    every = px.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), held.alias("__held"), out.alias("__out")).join(many(sums), ["slide", "y", "x"], "left")

    def where(object_: Column | float, free: Column | float) -> Column:
        return F.when(F.col("__out"), F.lit(0.0)).when(F.col("__held"), object_).otherwise(free)

    total = F.lit(background) + F.coalesce("__border", F.lit(0.0)) + (1 - background) * F.coalesce("__near", F.lit(0.0))
    return every.select("slide", "y", "x", where(F.lit(1.0), total).alias("weight"), where(F.lit(1.0), F.lit(background)).alias("chance"))


def directed_hausdorff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distance: the greatest distance of a point of a (keys, y, x; from 0) from its nearest of b; null where b has none.

    The exact distances of b's points along rows and columns are taken where a's points are: no pairs of points are made.
    Keys of b alone have no row.
    """
    at = a.select(*keys, "y", "x").distinct().withColumn("__a", F.lit(1))
    goal = b.select(*keys, "y", "x").distinct().withColumn("label", F.lit(1))
    every = at.join(goal, [*keys, "y", "x"], "full")
    far = distances(every, keys).join(many(at), [*keys, "y", "x"])
    worst = F.when(F.count_if(F.col("d1").isNull()) == 0, F.max("d1"))
    return far.groupBy(*keys).agg(worst.alias("distance"))


#: Rows of each key tried in full in the first round.
TRIED = 16
#: A key's rows are dealt to so many tasks at most, and one for each so many rows, where one of the other mask is compared with all of them.
SALTS, SALTED = 16, 256


def row_hausdorff(a: DataFrame, b: DataFrame, heights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distance: the directed Hausdorff distance between two masks whose rows are the points, one coordinate a column.

    a, b: runs of set pixels along rows (keys, y, lo, hi); heights: keys, h, rows that both masks have, those without runs
    too. The square of two rows' distance is the number of pixels that differ: both sizes less twice the overlap of
    their runs. Rows that the other mask has as well are 0 away; others have the distance from the row of their own
    number and its neighbours as a bound. The greatest least distance is found among the rows with the greatest bounds: they
    are compared with all that differ less in size than the bound, twice as many each round, and rows whose bound
    is no more than what was found are out. No join broadcasts rows: written, they are few bytes, but not in memory.
    """
    spark = heights.sparkSession

    def rows(runs: DataFrame) -> DataFrame:
        spans = F.sort_array(F.collect_list(F.struct("lo", "hi")))
        held = runs.groupBy(*keys, F.col("y").cast("long").alias("y")).agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), spans.alias("runs"))
        every = heights.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1)).alias("y"))
        joined = many(every).join(many(held), [*keys, "y"], "left")
        return joined.select(*keys, "y", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("runs", F.array().cast(held.schema["runs"].dataType)).alias("runs"))

    def apart(p: str, q: str) -> Column:
        """The square of the distance of two rows."""
        met = lambda r: F.aggregate(f"{q}_runs", F.lit(0).cast("long"), lambda s, o: s + F.greatest(F.least(r["hi"], o["hi"]) - F.greatest(r["lo"], o["lo"]), F.lit(0)).cast("long"))
        both = F.aggregate(f"{p}_runs", F.lit(0).cast("long"), lambda s, r: s + met(r))
        return F.col(f"{p}_n") + F.col(f"{q}_n") - 2 * both

    named = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("y", "n", "runs")])
    # few bytes, much work: dealt to a number of tasks that isn't coalesced
    spread_out = lambda df, c: many(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, c))
    salts = F.least(F.lit(SALTS), F.floor(F.col("h") / SALTED) + 1).cast("int")
    sized = heights.select(*keys, salts.alias("salts")).distinct()
    held: list[str] = []
    mine, other = rows(a), cut(rows(b), "rows", held)
    # equal rows are one, and those that the other mask has too are settled
    single = mine.groupBy(*keys, "n", "runs").agg(F.min("y").alias("y")).join(many(other.select(*keys, "n", "runs").distinct()), [*keys, "n", "runs"], "left_anti")
    near = spread_out(named(single, "a").withColumn("b_y", F.explode(F.array(*[F.col("a_y") + d for d in (-1, 0, 1)]))), "b_y").join(spread_out(named(other, "b"), "b_y"), [*keys, "b_y"])
    bounds = near.groupBy(*keys, "a_y").agg(F.min(apart("a", "b")).alias("bound"))
    left = cut(named(single, "a").join(many(bounds), [*keys, "a_y"]), "left", own := [])
    found = cut(heights.select(*keys, F.lit(0).cast("long").alias("most")).distinct(), "found", own)
    held += own
    goal = named(other, "b").join(many(sized), keys).withColumn("salt", F.pmod(F.xxhash64("b_y"), F.col("salts")).cast("int")).drop("salts")
    tried = TRIED
    while not left.isEmpty():
        place = Window.partitionBy(*keys).orderBy(F.desc("bound"), "a_y")
        picked = cut(left.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= tried), "picked", held)
        dealt = picked.join(many(sized), keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        met = spread_out(dealt, "salt").join(spread_out(goal, "salt"), [*keys, "salt"]).filter(F.abs(F.col("a_n") - F.col("b_n")) < F.col("bound"))
        exact = met.groupBy(*keys, "a_y").agg(F.min(apart("a", "b")).alias("d"))
        own_least = picked.join(many(exact), [*keys, "a_y"], "left").groupBy(*keys).agg(F.max(F.least("bound", F.coalesce("d", F.col("bound")))).alias("d"))
        found = cut(found.join(many(own_least), keys, "left").select(*keys, F.greatest("most", F.coalesce("d", F.lit(0))).alias("most")), "found", held)
        rest = left.join(many(picked.select(*keys, "a_y")), [*keys, "a_y"], "left_anti").join(many(found), keys).filter(F.col("bound") > F.col("most")).drop("most")
        left, tried = cut(rest, "left", held), 2 * tried
    out = cut(found.select(*keys, F.sqrt(F.col("most").cast("double")).alias("distance")), "hausdorff")
    drop(spark, held)
    return out
