"""Test-time augmentation: transforms of pixel tables, their products, and the way back.

Pixels are rows with slide, y, x and the sizes h, w of the image they stand in; a transform maps these
four and leaves all else. A variant is a list of <name, parameter>, applied in order and taken back
in reverse order.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A transform and the parameters it runs through.
HFLIP, VFLIP, ROT90 = ("hflip", (0, 1)), ("vflip", (0, 1)), ("rot90", (0, 1, 2, 3))
#: The eight transforms of the square.
D4 = (HFLIP, ROT90)
Place = tuple[Column, Column, Column, Column]


def variants(transforms: tuple[tuple[str, tuple[int, ...]], ...]) -> list[list[tuple[str, int]]]:
    """All combinations of the transforms' parameters, the last one's running fastest."""
    return [list(zip([t for t, _ in transforms], own, strict=True)) for own in product(*[p for _, p in transforms])]


def _step(name: str, parameter: int, place: Place) -> Place:
    y, x, h, w = place
    if name == "hflip":
        return (y, w - 1 - x, h, w) if parameter else place
    if name == "vflip":
        return (h - 1 - y, x, h, w) if parameter else place
    if name == "rot90":  # counterclockwise, so many quarters
        for _ in range(parameter % 4):
            y, x, h, w = w - 1 - x, y, w, h
        return y, x, h, w
    raise ValueError(name)


def _moved(px: DataFrame, every: list[list[tuple[str, int]]], back: bool) -> DataFrame:
    """px with places mapped by each row's variant (a number in tta).

    Each number of a place is a sum of the old ones by whole factors, which are looked up by variant: 16 variants cost a row what one does.
    """

    def placed(steps: list[tuple[str, int]], place: tuple[int, ...]) -> tuple[int, ...]:
        for name, parameter in reversed(steps) if back else steps:
            place = _step(name, -parameter if back and name == "rot90" else parameter, place)
        return place

    names = ("y", "x", "h", "w")
    zero = [placed(steps, (0, 0, 0, 0)) for steps in every]
    ones = [[placed(steps, tuple(int(i == j) for i in range(4))) for steps in every] for j in range(4)]

    def looked_up(factors: list[int]) -> Column:
        return F.get(F.array(*[F.lit(f).cast("long") for f in factors]), F.col("tta").cast("int"))

    def number(i: int) -> Column:
        out = looked_up([z[i] for z in zero])
        for j, c in enumerate(names):
            factors = [one[i] - z[i] for one, z in zip(ones[j], zero, strict=True)]
            if any(factors):
                out = out + looked_up(factors) * F.col(c).cast("long")
        return out

    return px.withColumns({c: number(i) for i, c in enumerate(names)})


def augmented(px: DataFrame, transforms: tuple[tuple[str, tuple[int, ...]], ...]) -> DataFrame:
    """px once per variant, with its number in tta and the pixel's place in the image so changed. No shuffle."""
    every = variants(transforms)
    return _moved(px.withColumn("tta", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1)))), every, False)


def deaugmented(px: DataFrame, transforms: tuple[tuple[str, tuple[int, ...]], ...]) -> DataFrame:
    """Rows of augmented() with their places taken back."""
    return _moved(px, variants(transforms), True)


def merged(px: DataFrame, transforms: tuple[tuple[str, tuple[int, ...]], ...], value: str) -> DataFrame:
    """slide, y, x and the mean, maximum and sample deviation of a value over all variants, in the image's own places."""
    return deaugmented(px, transforms).groupBy("slide", "y", "x").agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
