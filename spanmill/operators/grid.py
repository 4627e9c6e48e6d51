"""Tile grids, stitching and resampling. Tiles are rectangles y0, y1, x0, x1, ends excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators.scan import running
from spanmill.plans.session import many


def _axis(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _both(slides: DataFrame, ny: Column, nx: Column) -> DataFrame:
    return slides.withColumn("ty", F.explode(_axis(ny))).withColumn("tx", F.explode(_axis(nx)))


def grid_padded(slides: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """Tiles of the image padded by size - h % size (a whole extra row when it divides), with clipped cores.

    A shifted grid begins at shift, and drops its last row or column where h % size < shift.
    """
    n = lambda s: (F.col(s) + (size - F.col(s) % size)) / size - F.when((shift > 0) & (F.col(s) % size < shift), 1).otherwise(0)
    at = _both(slides, F.floor(n("h")), F.floor(n("w")))
    clip = lambda v, s: F.least(v, F.col(s)).cast("long")
    y, x = F.col("ty") * size + shift, F.col("tx") * size + shift
    return at.withColumns({"y0": clip(y, "h"), "y1": clip(y + size, "h"), "x0": clip(x, "w"), "x1": clip(x + size, "w")})


def grid_centred(slides: DataFrame, size: int) -> DataFrame:
    """Tiles of the image padded evenly on both sides; the first begins at floor(-pad / 2)."""
    pad = lambda s: F.pmod(size - F.col(s) % size, F.lit(size))
    at = _both(slides, (F.col("h") + pad("h")) / size, (F.col("w") + pad("w")) / size)
    y, x = F.floor(-pad("h") / 2) + F.col("ty") * size, F.floor(-pad("w") / 2) + F.col("tx") * size
    return at.withColumns({"y0": y.cast("long"), "y1": (y + size).cast("long"), "x0": x.cast("long"), "x1": (x + size).cast("long")})


def grid_ceil(slides: DataFrame, size: int) -> DataFrame:
    """Tiles from the origin, the last ones clipped."""
    at = _both(slides, F.ceil(F.col("h") / size), F.ceil(F.col("w") / size))
    y, x = F.col("ty") * size, F.col("tx") * size
    return at.withColumns({"y0": y.cast("long"), "y1": F.least(y + size, F.col("h")).cast("long"), "x0": x.cast("long"), "x1": F.least(x + size, F.col("w")).cast("long")})


def grid_clamped(slides: DataFrame, size: int, step: int) -> DataFrame:
    """Overlapping tiles every `step`; those that would pass the border are moved inward, duplicates stay."""
    at = _both(slides, F.ceil(F.col("h") / step), F.ceil(F.col("w") / step))
    y, x = F.least(F.col("ty") * step, F.col("h") - size), F.least(F.col("tx") * step, F.col("w") - size)
    return at.withColumns({"y0": y.cast("long"), "y1": (y + size).cast("long"), "x0": x.cast("long"), "x1": (x + size).cast("long")})


def grid_linspace(slides: DataFrame, size: int, shift: float) -> DataFrame:
    """Tile centres evenly from the first to the last full tile: n = int(side // (size * shift)) + 1 per axis."""
    n = lambda s: F.floor(F.col(s) / (size * shift)) + 1
    at = _both(slides.withColumns({"ny": n("h"), "nx": n("w")}), F.col("ny"), F.col("nx"))

    def centre(i: str, count: str, s: str) -> Column:
        a = F.lit(size / 2)
        return (a + F.coalesce(F.try_divide((F.col(s) - size) * F.col(i), F.col(count) - 1), F.lit(0.0))).cast("long")

    return at.withColumns({"cy": centre("ty", "ny", "h"), "cx": centre("tx", "nx", "w")})


def tile_stats(px: DataFrame, size: int, value: str = "val", mask: str = "mask") -> DataFrame:
    """slide, ty, tx and the masked count, masked ratio of the whole padded tile, population deviation, and dark pixels.

    The deviation counts the padding as zeros, as the ratio does.
    """
    area = float(size * size)
    v = F.col(value).cast("double")
    sums = px.groupBy("slide", F.floor(F.col("y") / size).cast("long").alias("ty"), F.floor(F.col("x") / size).cast("long").alias("tx")).agg(
        F.sum(mask).cast("long").alias("masked"), F.sum(v).alias("__s"), F.sum(v * v).alias("__q"), F.count_if(v < 40).alias("dark"), F.count(F.lit(1)).alias("n")
    )
    deviation = F.sqrt(F.greatest(F.col("__q") / area - F.pow(F.col("__s") / area, F.lit(2)), F.lit(0.0)))
    return sums.select("slide", "ty", "tx", "masked", (F.col("masked") / area).alias("ratio"), deviation.alias("std"), (F.col("__s") / area).alias("mean"), "dark", "n")


def pyramid_weight(y: Column, x: Column, size: int, sigma: float = 1.0, alpha: float = 1.0, eps: float = 1e-6) -> Column:
    """Weight of a pixel of a tile of even size: least at the border, growing inwards.

    The distance from the nearest edge, 1 at the border and size / 2 in the middle, as a share of the latter to the power of sigma, is
    stretched so that the border has about 0 (eps keeps it over); what is over alpha counts as 1, the rest is divided by alpha,
    at least 0.001 and at most 1, in steps of 0.001.
    """
    half = size // 2
    edge = (1.0 / half) ** sigma
    share = F.pow(F.least(y + 1, size - y, x + 1, size - x) / float(half), F.lit(sigma))
    stretched = (share - edge + eps) / (1.0 - edge + eps)
    cut_off = F.when(stretched > alpha, 1.0).otherwise(stretched) / alpha
    return F.round(F.least(F.greatest(cut_off, F.lit(1e-3)), F.lit(1.0)), 3)


def gaussian_weight(y: Column, x: Column, size: int) -> Column:
    """exp of minus the squared distance from the centre, deviation an eighth of the size, 1 at the centre.

    The least weight, at the corners, is over exp(-16) at any size, so there are no zeros to replace.
    """
    c, s = (size - 1) / 2.0, size / 8.0
    return F.exp(-(F.pow(y - c, F.lit(2)) + F.pow(x - c, F.lit(2))) / (2 * s * s))


def stitch(predicted: DataFrame, weight: Column) -> DataFrame:
    """slide, y, x, p: weighted mean of all tiles' predictions of each pixel. One grouping with map-side sums."""
    return predicted.groupBy("slide", "y", "x").agg((F.sum(F.col("p") * weight) / F.sum(weight)).alias("p"))


def downscale_area(px: DataFrame, factor: int, value: str) -> DataFrame:
    """slide, y, x, value: block means; blocks at the border hold fewer pixels."""
    return px.groupBy("slide", F.floor(F.col("y") / factor).cast("long").alias("y"), F.floor(F.col("x") / factor).cast("long").alias("x")).agg(F.avg(value).alias(value))


def downscale_nearest(px: DataFrame, factor: int, value: str) -> DataFrame:
    kept = px.filter((F.col("y") % factor == 0) & (F.col("x") % factor == 0))
    return kept.select("slide", F.floor(F.col("y") / factor).cast("long").alias("y"), F.floor(F.col("x") / factor).cast("long").alias("x"), value)


def crop(px: DataFrame, y0: Column, x0: Column, size: int) -> DataFrame:
    """Pixels of a square window, in its own coordinates; what lies outside the image isn't there."""
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + size) & (F.col("x") >= x0) & (F.col("x") < x0 + size)
    return px.filter(inside).withColumns({"y": (F.col("y") - y0).cast("long"), "x": (F.col("x") - x0).cast("long")})


def boundless(slides: DataFrame, px: DataFrame, y0: int, x0: int, size: int, value: str) -> DataFrame:
    """slide, y, x, value of a window that may pass the image's borders; outside is 0."""
    full = slides.select("slide", F.explode(F.sequence(F.lit(y0), F.lit(y0 + size - 1))).alias("y")).select("slide", "y", F.explode(F.sequence(F.lit(x0), F.lit(x0 + size - 1))).alias("x"))
    near = px.filter((F.col("y") >= y0) & (F.col("y") < y0 + size) & (F.col("x") >= x0) & (F.col("x") < x0 + size))
    return many(full).join(many(near.select("slide", "y", "x", value)), ["slide", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def sampling_cdf(px: DataFrame, p: Column, keys: list[str], order: list[str]) -> DataFrame:
    """px with cdf: running share of p within each key; the order is to be total within a key."""
    placed = running(px, keys, order, {"__cum": p.cast("double")})
    return placed.withColumn("cdf", F.col("__cum") / F.col("all___cum")).drop("__cum", "all___cum")


def pick(cdf: DataFrame, keys: list[str], pos: str, u: Column) -> DataFrame:
    """keys, pos: the first position whose cdf is over u; null if none is."""
    return cdf.groupBy(*keys).agg(F.min(F.when(F.col("cdf") > u, F.col(pos))).alias(pos))


def grid_halo(slides: DataFrame, size: int, pad: int) -> DataFrame:
    """Tiles of `size` with a halo of `pad` on each side: the core (y0 ..) every size - 2 * pad, the halo (qy0 ..), both clipped.

    The image is padded as in grid_padded by the core's size.
    """
    core = size - 2 * pad
    tiles = grid_padded(slides, core)
    y, x = F.col("ty") * core, F.col("tx") * core
    low = lambda v: F.greatest(v - pad, F.lit(0)).cast("long")
    high = lambda v, s: F.least(v + core + pad, F.col(s)).cast("long")
    return tiles.withColumns({"qy0": low(y), "qy1": high(y, "h"), "qx0": low(x), "qx1": high(x, "w")})


def grid_slices(slides: DataFrame, tile: int, padding: int) -> DataFrame:
    """Tiles of `tile` whose output is `padding` smaller: centre cy, cx; output slice y0 .. x1 of the image; the share iy, ix
    (lengths from 0) of the output that is inside. An image smaller than a tile has one."""
    out = tile - padding
    n = lambda s: F.greatest(F.ceil(F.col(s) / out), F.lit(1))
    at = _both(slides, n("h"), n("w"))
    y, x = F.col("ty") * out, F.col("tx") * out
    y1, x1 = F.least(y + out, F.col("h")), F.least(x + out, F.col("w"))
    centre = lambda t: F.floor((F.col(t) + 0.5) * out).cast("long")
    return at.withColumns({"cy": centre("ty"), "cx": centre("tx"), "y0": y.cast("long"), "y1": y1.cast("long"), "x0": x.cast("long"), "x1": x1.cast("long"), "iy": (y1 - y).cast("long"), "ix": (x1 - x).cast("long")})


def paste(canvas: DataFrame, block: DataFrame, y0: Column, x0: Column, value: str) -> DataFrame:
    """canvas (slide, y, x, value) with the block's pixels (slide, y, x from 0) from y0, x0 on; what passes the border is cut off."""
    put = block.select("slide", (F.col("y") + y0).cast("long").alias("y"), (F.col("x") + x0).cast("long").alias("x"), F.col(value).alias("__new"))
    at = canvas.withColumn("y", F.col("y").cast("long")).withColumn("x", F.col("x").cast("long"))
    return many(at).join(many(put), ["slide", "y", "x"], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def covering_tiles(px: DataFrame, size: int, step: int) -> DataFrame:
    """px (slide, y, x, h, w) once for each tile of grid_clamped() that covers it, with ty, tx, dy, dx.

    The tiles of a pixel follow from arithmetic: tiles that begin at most `size` before it, and all
    those moved inward to the last place. No join.
    """

    def along(p: str, s: str) -> Column:
        last = F.col(s) - size
        first = F.greatest(F.ceil((F.col(p) - size + 1) / step), F.lit(0)).cast("long")
        every = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(s) / step).cast("long") - 1)
        near = F.when(F.col(p) >= last, every).otherwise(F.sequence(first, F.floor(F.col(p) / step).cast("long")))
        begin = lambda t: F.least(t * step, last)
        return F.filter(F.transform(near, lambda t: F.struct(t.alias("t"), (F.col(p) - begin(t)).alias("d"))), lambda c: (c["d"] >= 0) & (c["d"] < size))

    met = px.withColumn("__y", F.explode(along("y", "h"))).withColumn("__x", F.explode(along("x", "w")))
    return met.select(*px.columns, F.col("__y.t").alias("ty"), F.col("__x.t").alias("tx"), F.col("__y.d").alias("dy"), F.col("__x.d").alias("dx"))


def stitch_variants(predicted: DataFrame, weight: Column, variant: str) -> DataFrame:
    """slide, y, x, p: as stitch(), of predictions of several variants (test-time augmentations), which count alike.

    At reduced resolution places are those of the reduced image.
    """
    one = predicted.withColumn("__w", weight).groupBy("slide", "y", "x", variant).agg(F.sum(F.col("p") * F.col("__w")).alias("a"), F.sum("__w").alias("b"))
    return one.groupBy("slide", "y", "x").agg((F.sum("a") / F.sum("b")).alias("p"))


def resize_nearest(px: DataFrame, sizes: DataFrame, oh: int, ow: int, value: str) -> DataFrame:
    """slide, y, x, value at oh x ow of pixels of sizes (slide, h, w): the pixel at floor(y * h / oh)."""
    out = _places(sizes, oh, ow)
    at = out.select("slide", F.col("y").alias("__y"), F.col("x").alias("__x"), F.floor(F.col("y") * F.col("h") / oh).cast("long").alias("y"), F.floor(F.col("x") * F.col("w") / ow).cast("long").alias("x"))
    return at.join(_long(px, value), ["slide", "y", "x"]).select("slide", F.col("__y").alias("y"), F.col("__x").alias("x"), value)


def cut_tiles(px: DataFrame, tile: int, value: str, fill: int = 0) -> DataFrame:
    """slide, h, w, ty, tx, tile of pixels (slide, y, x, h, w): the values of each tile row by row, padded with `fill` at the lower and right border.

    Of several values of a pixel the greatest counts; a task holds one tile's.
    """
    place = F.col("y") % tile * tile + F.col("x") % tile
    at = [F.floor(F.col(c) / tile).cast("long").alias(f"t{c}") for c in "yx"]
    once = px.groupBy("slide", "h", "w", *at, place.cast("int").alias("__at")).agg(F.max(value).alias("__v"))
    held = once.groupBy("slide", "h", "w", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__v"))).alias("__held"))
    values = F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda k: F.coalesce(F.try_element_at("__held", k), F.lit(fill)))
    return held.withColumn("tile", values).drop("__held")


def join_tiles(tiles: DataFrame, tile: int, value: str) -> DataFrame:
    """slide, y, x, value of tiles as cut_tiles() makes them; padding is cropped. No shuffle.

    A tile that hasn't all its values is an error.
    """
    whole = F.when(F.size("tile") == tile * tile, F.col("tile")).otherwise(F.raise_error(F.format_string("a tile has %d values", F.size("tile"))))
    px = tiles.select("slide", "h", "w", "ty", "tx", F.posexplode(whole).alias("__at", value))
    px = px.withColumn("y", F.col("ty") * tile + F.floor(F.col("__at") / tile)).withColumn("x", F.col("tx") * tile + F.col("__at") % tile)
    return px.filter("y < h AND x < w").select("slide", "y", "x", value)


def resize_bilinear(px: DataFrame, sizes: DataFrame, oh: int, ow: int, value: str) -> DataFrame:
    """slide, y, x, value at oh x ow: linear between the four nearest pixels, centres of pixels at halves, borders held."""
    hold = lambda p, s, n: F.least(F.greatest((F.col(p) + 0.5) * F.col(s) / n - 0.5, F.lit(0.0)), F.col(s) - 1.0)
    at = _places(sizes, oh, ow).withColumn("fy", hold("y", "h", oh)).withColumn("fx", hold("x", "w", ow))
    return bilinear(px, at, value)


def bilinear(px: DataFrame, at: DataFrame, value: str) -> DataFrame:
    """slide, y, x, value of places at (slide, y, x, fy, fx): the mean of the four pixels around (fy, fx) by nearness; 0 outside."""
    ends = lambda f: F.array(F.struct(F.floor(f).cast("long").alias("at"), (1 - (F.col(f) - F.floor(f))).alias("w")), F.struct((F.floor(f) + 1).cast("long").alias("at"), (F.col(f) - F.floor(f)).alias("w")))
    four = at.select("slide", F.col("y").alias("__y"), F.col("x").alias("__x"), F.explode(ends("fy")).alias("a"), F.col("fx")).select("slide", "__y", "__x", "a", F.explode(ends("fx")).alias("b"))
    four = four.select("slide", "__y", "__x", F.col("a.at").alias("y"), F.col("b.at").alias("x"), (F.col("a.w") * F.col("b.w")).alias("__w"))
    met = four.join(_long(px, value), ["slide", "y", "x"], "left")
    return met.groupBy("slide", F.col("__y").alias("y"), F.col("__x").alias("x")).agg(F.sum(F.col("__w") * F.coalesce(F.col(value), F.lit(0))).alias(value))


def _places(sizes: DataFrame, oh: int, ow: int) -> DataFrame:
    rows = sizes.select("slide", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(oh - 1))).alias("y"))
    return many(rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(ow - 1))).alias("x")).withColumn("y", F.col("y").cast("long")).withColumn("x", F.col("x").cast("long")))


def _long(px: DataFrame, value: str) -> DataFrame:
    return many(px.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), value))


def is_background(bright: Column, total: Column, least: int) -> Column:
    """A tile without tissue: few saturated pixels, or hardly any signal."""
    return (bright <= least) | (total <= least)


def is_rejected(mean: Column, std: Column, dark: Column, area: Column, u: Column, kept: float = 0.05) -> Column:
    """A tile that is dark, bright and flat, or more than a tenth dark pixels; a share of them is kept by u, a number from 0 to 1."""
    return ((mean < 10) | ((mean > 205) & (std < 20)) | (dark > 0.1 * area)) & (u > kept)


def one_hot(px: DataFrame, label: str, n: int, name: str = "hot") -> DataFrame:
    """px once for each class 0 .. n - 1 with cls and 1 where the label is it, else 0."""
    return px.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(name, (F.col(label) == F.col("cls")).cast("int"))
