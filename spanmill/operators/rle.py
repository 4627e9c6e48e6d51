"""Run-length encoding. Inside, a mask is half-open spans lo, hi; at the edge, text "start length ..." from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.plans.session import many

#: Positions whose runs are found in one task; runs are joined across the borders afterwards.
CHUNK = 1 << 20


def encode_spans(px: DataFrame, keys: list[str], pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """keys, lo, hi: the maximal runs of the positions present (each once) per key.

    Gaps and islands in chunks of positions, so a slide of billions of pixels isn't one task; then
    runs that reach a chunk's border are joined with those beyond it: two a chunk at most, and no others travel.
    """
    inside = Window.partitionBy(*keys, "__chunk").orderBy(pos)
    marked = px.select(*keys, F.col(pos).cast("long").alias(pos)).withColumn("__chunk", F.floor(F.col(pos) / chunk))
    island = F.col(pos) - F.row_number().over(inside)
    runs = marked.withColumn("__island", island).groupBy(*keys, "__chunk", "__island").agg(F.min(pos).alias("lo"), (F.max(pos) + 1).alias("hi")).select(*keys, "lo", "hi")
    at_border = (F.col("lo") % chunk == 0) | (F.col("hi") % chunk == 0)
    return many(join_touching(runs.filter(at_border), keys).unionByName(runs.filter(~at_border)))


def join_touching(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi of runs (not overlapping) with those that touch made one."""
    along = Window.partitionBy(*keys).orderBy("lo")
    begins = F.when(F.lag("hi").over(along) == F.col("lo"), 0).otherwise(1)
    numbered = runs.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(along))
    return numbered.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def spans_to_text(spans: DataFrame, keys: list[str], name: str = "rle") -> DataFrame:
    """keys and the text "start length ..." of each key's spans, starts from 1, ascending."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws(" ", r["lo"] + 1, r["hi"] - r["lo"]))
    return spans.groupBy(*keys).agg(F.array_join(parts, " ").alias(name))


def text_to_spans(masks: DataFrame, rle: str, keys: list[str], size: Column | None = None) -> DataFrame:
    """keys, lo, hi of RLE texts. Null and empty texts have none; an odd last number is ignored; spans end at `size`."""
    numbers = F.transform(F.split(F.trim(F.col(rle)), r"\s+"), lambda x: x.try_cast("long"))
    held = masks.filter(F.col(rle).isNotNull() & (F.trim(F.col(rle)) != "")).withColumn("__n", numbers)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__n") / 2).cast("int") - 1), lambda i: F.struct((F.get("__n", 2 * i) - 1).alias("lo"), (F.get("__n", 2 * i) - 1 + F.get("__n", 2 * i + 1)).alias("hi")))
    spans = held.filter(F.size("__n") >= 2).select("*", F.explode(pairs).alias("__s"))
    hi = F.col("__s.hi") if size is None else F.least(F.col("__s.hi"), size)
    return spans.select(*keys, F.col("__s.lo").alias("lo"), hi.alias("hi")).filter("hi > lo")


def positions(spans: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per position of each span."""
    return many(spans.select(*keys, F.explode(F.sequence("lo", F.col("hi") - 1)).alias(pos)))


def lossy_positions(px: DataFrame, keys: list[str], length: str, pos: str = "pos") -> DataFrame:
    """px without the first and last position of each mask, which the lossy form forces to 0."""
    return px.filter((F.col(pos) > 0) & (F.col(pos) < F.col(length) - 1))


def suppress_small(spans: DataFrame, keys: list[str], threshold: int, name: str = "rle") -> DataFrame:
    """spans_to_text, empty where the spans' total length is `threshold` or less."""
    total = spans.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("__total"))
    return spans_to_text(spans, keys, name).join(total, keys).withColumn(name, F.when(F.col("__total") <= threshold, F.lit("")).otherwise(F.col(name))).drop("__total")


def overlap(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """keys, n: positions in spans of both, per key with any.

    Spans are cut at cells, so that the join is an equality join on key and cell with a short residual,
    and no span meets spans far from it.
    """

    def cut(s: DataFrame, lo: str, hi: str) -> DataFrame:
        cells = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("__cell")
        at = s.select(*keys, "lo", "hi", cells)
        return many(at.select(*keys, "__cell", F.greatest("lo", F.col("__cell") * cell).alias(lo), F.least("hi", (F.col("__cell") + 1) * cell).alias(hi)))

    met = cut(a, "alo", "ahi").join(cut(b, "blo", "bhi"), [*keys, "__cell"]).filter("alo < bhi AND blo < ahi")
    return met.groupBy(*keys).agg(F.sum(F.least("ahi", "bhi") - F.greatest("alo", "blo")).cast("long").alias("n"))


def mask_sums(spans: DataFrame, keys: list[str], mask: str, pred: str, truth: str, cell: int = 1024) -> DataFrame:
    """keys, inter, p, t of two masks told apart by a column: sizes and overlap in one pass over all spans.

    Spans are cut at cells; a cell's few spans of both masks meet as arrays of one row, so nothing is
    read twice and no span meets spans far from it.
    """
    at = spans.select(*keys, mask, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("__cell"))
    piece = F.struct(F.greatest("lo", F.col("__cell") * cell).alias("lo"), F.least("hi", (F.col("__cell") + 1) * cell).alias("hi"))
    of = lambda m: F.collect_list(F.when(F.col(mask) == m, piece))
    met = at.groupBy(*keys, "__cell").agg(of(pred).alias("__p"), of(truth).alias("__t"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    shared = F.aggregate("__p", F.lit(0).cast("long"), lambda s, r: s + F.aggregate("__t", F.lit(0).cast("long"), lambda n, q: n + F.greatest(F.least(r["hi"], q["hi"]) - F.greatest(r["lo"], q["lo"]), F.lit(0))))
    return met.groupBy(*keys).agg(F.sum(shared).alias("inter"), F.sum(total(F.col("__p"))).alias("p"), F.sum(total(F.col("__t"))).alias("t"))


def span_sizes(spans: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias(name))


def to_yx(pos: Column, height: Column | int) -> dict[str, Column]:
    """y, x of a position in column-major order, as runs of masks of a height count it."""
    h = F.lit(height) if isinstance(height, int) else height
    return {"y": (pos % h).cast("long"), "x": F.floor(pos / h).cast("long")}


def to_pos(y: Column, x: Column, height: Column | int) -> Column:
    """The column-major position of a pixel."""
    return (x * height + y).cast("long")


def column_spans(spans: DataFrame, keys: list[str], height: Column | int) -> DataFrame:
    """keys, x, lo, hi: column-major spans cut into vertical runs of each column, without pixels."""
    h = F.lit(height) if isinstance(height, int) else height
    at = spans.withColumn("__h", h).withColumn("x", F.explode(F.sequence(F.floor(F.col("lo") / F.col("__h")), F.floor((F.col("hi") - 1) / F.col("__h")))))
    low = F.greatest(F.col("lo") - F.col("x") * F.col("__h"), F.lit(0))
    return at.select(*keys, F.col("x").cast("long").alias("x"), low.cast("long").alias("lo"), F.least(F.col("hi") - F.col("x") * F.col("__h"), F.col("__h")).cast("long").alias("hi"))


def encode_resized(px: DataFrame, keys: list[str], height: Column | int, threshold: int, name: str = "rle") -> DataFrame:
    """keys and RLE text of mask pixels (keys, y, x), column-major; empty where `threshold` or fewer are set.

    px are those of the final shape: a mask of another one goes through grid.resize_nearest first.
    """
    spans = encode_spans(px.select(*keys, to_pos(F.col("y"), F.col("x"), height).alias("pos")), keys)
    return suppress_small(spans, keys, threshold, name)


def combine_additive(masks: DataFrame, keys: list[str], code: str, name: str = "code") -> DataFrame:
    """keys and the sum of the codes of all class masks that hold a position: 3 is both of 1 and 2."""
    return masks.groupBy(*keys).agg(F.sum(code).cast("long").alias(name))


def combine_last(masks: DataFrame, keys: list[str], code: str, name: str = "code") -> DataFrame:
    """keys and the highest code of the class masks that hold a position: later classes overwrite."""
    return masks.groupBy(*keys).agg(F.max(code).cast("long").alias(name))
