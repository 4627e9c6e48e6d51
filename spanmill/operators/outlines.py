"""All contours of masks, inner ones too, from their runs: no component is held as an array.

A contour passes between neighbouring pixels of which one is set. Strips of columns join these crossings, cell by cell,
to paths that end where the strip does; the paths of all strips are then a graph in which each has one successor, and are
ordered into rings by pointer doubling. What travels between strips is a row per path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans.session import cut, drop

#: Columns of a strip.
STRIP = 256


def crossings(cells: np.ndarray, y0: int, x0: int) -> tuple[np.ndarray, np.ndarray]:
    """Where contours enter and leave each cell of 2 x 2 pixels: numbers of the crossings (from, to).

    cells: pixels, cell (y, x) being those from there to (y + 1, x + 1); set pixels stay on one side of the way, and of two
    that touch at a corner only each has a contour of its own. A crossing's number holds its place (y, x), whether it
    lies on a row or a column, and which of its pixels is set, the place first.
    """
    tl, tr, bl, br = cells[:-1, :-1], cells[:-1, 1:], cells[1:, :-1], cells[1:, 1:]
    y, x = np.nonzero((tl != tr) | (bl != br) | (tl != bl))
    tl, tr, bl, br = (c[y, x].astype(np.int64) for c in (tl, tr, bl, br))
    number = lambda dy, dx, kind, first: (y + dy + y0 + 1) << 32 | (x + dx + x0 + 1) << 2 | kind << 1 | first
    top, bottom, left, right = number(0, 0, 0, tl), number(1, 0, 0, bl), number(0, 0, 1, tl), number(0, 1, 1, tr)
    source, target = [], []
    # around each corner, in the order in which a way passes them: a side is entered where its first pixel is set
    enters = {"t": (tl > tr), "r": (tr > br), "b": (br > bl), "l": (bl > tl)}
    leaves = {"t": (tl < tr), "r": (tr < br), "b": (br < bl), "l": (bl < tl)}
    sides = {"t": top, "r": right, "b": bottom, "l": left}
    free = {s: m.copy() for s, m in leaves.items()}
    for shift in (1, 2, 3):  # the next side first, which keeps corners apart
        for k, s in enumerate("trbl"):
            e = "trbl"[(k - shift) % 4]
            own = enters[s] & free[e]
            source.append(sides[s][own])
            target.append(sides[e][own])
            enters[s] = enters[s] & ~own
            free[e] = free[e] & ~own
    return np.concatenate(source), np.concatenate(target)


def paths(source: np.ndarray, target: np.ndarray) -> list[tuple[list[int], int]]:
    """Crossings in order, and the one after the last: of a ring its first, of a path one that no crossing here follows."""
    follows = dict(zip(source.tolist(), target.tolist(), strict=True))
    out = []
    for start in [*sorted(follows.keys() - set(target.tolist())), *sorted(follows)]:
        if start in follows:
            own, at = [], start
            while at in follows:
                own.append(at)
                at = follows.pop(at)
            out.append((own, at))
    return out


def _strip_paths(runs: DataFrame) -> DataFrame:
    """slide, head, points, after: the paths within strips; a ring is one whose after is its head."""
    kind = runs.schema["slide"].dataType.simpleString()
    # a cell has two columns: a strip's last one is the next one's first
    at = F.array_distinct(F.array(F.floor((F.col("x") - 1) / STRIP), F.floor(F.col("x") / STRIP)))
    dealt = runs.select("slide", F.col("x").cast("long").alias("x"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).withColumn("strip", F.explode(at))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        strip, y0 = int(pdf["strip"].iloc[0]), int(pdf["lo"].min()) - 1
        cells = np.zeros((int(pdf["hi"].max()) - y0 + 1, STRIP + 1), dtype=np.int8)
        for x, lo, hi in zip(pdf["x"] - strip * STRIP, pdf["lo"] - y0, pdf["hi"] - y0, strict=True):
            cells[lo:hi, x] = 1
        rows = paths(*crossings(cells, y0, strip * STRIP))
        return pd.DataFrame({"slide": pdf["slide"].iloc[0], "head": [p[0] for p, _ in rows], "points": [p for p, _ in rows], "after": [a for _, a in rows]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, now = [], None
        for pdf in batches:
            for key, part in pdf.groupby(["slide", "strip"], sort=False):
                if now not in (None, key):
                    yield found(pd.concat(parts))
                    parts = []
                parts.append(part)
                now = key
        if parts:
            yield found(pd.concat(parts))

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "slide", "strip").sortWithinPartitions("slide", "strip").mapInPandas(run, f"slide {kind}, head long, points array<long>, after long")


def _in_order(open_: DataFrame, held: list[str]) -> DataFrame:
    """slide, head, lead, k of paths (slide, head, after): the least head of each ring, and which path after that one it is.

    Twice as many steps each round: first what the least head within reach is, then how far off the least is. As
    the paths of a ring are few, so are the rounds; each is written, and the last one's table deleted.
    """
    spark, past = open_.sparkSession, []
    now = cut(open_.select("slide", "head", F.col("after").alias("next"), F.col("head").alias("lead")), "lead", past)
    while True:
        other = now.select("slide", F.col("head").alias("next"), F.col("next").alias("far"), F.col("lead").alias("seen"))
        new = now.join(other, ["slide", "next"]).select("slide", "head", F.col("far").alias("next"), F.least("lead", "seen").alias("lead"), (F.col("seen") < F.col("lead")).alias("moved"))
        own: list[str] = []
        new = cut(new, "lead", own)
        drop(spark, past)
        now, past = new.drop("moved"), own
        if new.filter("moved").isEmpty():
            break
    leads = now.select("slide", "head", "lead")
    steps: list[str] = []
    # how many steps lead to the ring's first path; that one has none to go
    here = F.col("head") == F.col("lead")
    far = cut(open_.select("slide", "head", "after").join(leads, ["slide", "head"]).select("slide", "head", "lead", F.when(here, F.col("head")).otherwise(F.col("after")).alias("next"), F.when(here, 0).otherwise(1).cast("long").alias("d")), "far", steps)
    drop(spark, past)
    while not far.filter("next <> lead").isEmpty():
        other = far.select("slide", F.col("head").alias("next"), F.col("next").alias("beyond"), F.col("d").alias("more"))
        own = []
        new = cut(far.join(other, ["slide", "next"]).select("slide", "head", "lead", F.col("beyond").alias("next"), (F.col("d") + F.col("more")).alias("d")), "far", own)
        drop(spark, steps)
        far, steps = new, own
    held += steps
    # the path nearest to the first is the last
    return far.select("slide", "head", "lead", F.when(F.col("d") > 0, -F.col("d")).otherwise(F.lit(-(1 << 62))).alias("k"))


def all_contours(runs: DataFrame, level: float = 0.8, whole: bool = True) -> DataFrame:
    """slide, ring (its least crossing's number), points (array of x, y, the first again at the end): every closed contour.

    runs: vertical runs of set pixels (slide, x, lo, hi), disjoint in a column; outside of all runs nothing is set, so contours at an
    image's border are closed too. Points lie between pixels where a line from 0 to 1 passes the level; whole: cut to whole numbers,
    towards 0. Rings begin at their uppermost, then leftmost point; set pixels that touch at corners only have rings
    of their own, and holes have rings in the other direction. A ring is one row. Slides without runs have none.
    """
    spark, held = runs.sparkSession, []
    found = cut(_strip_paths(runs), "paths", held)
    open_ = found.filter("head <> after")
    rings = found.filter("head = after").select("slide", "points")
    if not open_.isEmpty():
        order = _in_order(open_.select("slide", "head", "after"), held)
        parts = open_.join(order, ["slide", "head"]).groupBy("slide", "lead").agg(F.sort_array(F.collect_list(F.struct("k", "points"))).alias("parts"))
        rings = rings.unionByName(parts.select("slide", F.flatten(F.transform("parts", lambda p: p["points"])).alias("points")))
    first = F.array_position("points", F.array_min("points")).cast("int")
    turned = F.concat(F.slice("points", first, F.size("points")), F.slice("points", F.lit(1), first))
    part = lambda p, shift, bits: F.shiftright(p, shift).bitwiseAND((1 << bits) - 1)

    def point(p):
        y, x, column, first_set = part(p, 32, 31) - 1, part(p, 2, 30) - 1, part(p, 1, 1) == 1, part(p, 0, 1) == 1
        off = F.when(first_set, 1 - level).otherwise(F.lit(level))
        place = lambda v, along: v + F.when(along, off).otherwise(F.lit(0.0))
        ends = {"x": place(x, ~column), "y": place(y, column)}
        return F.struct(*[(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double") if whole else v).alias(c) for c, v in ends.items()])

    out = cut(rings.select("slide", F.array_min("points").alias("ring"), F.transform(turned, point).alias("points")), "rings")
    drop(spark, held)
    return out
