"""Matching of objects: spatial joins on grid cells, best and greedy matches, optimal assignment."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.operators.graph import connected
from spanmill.plans.session import cut, drop, many


def _by_cell(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by key and cell to a number of tasks that isn't coalesced: few rows of two sides make many pairs."""
    return many(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__cx", "__cy"))


def box_pairs(a: DataFrame, b: DataFrame, cell: int, keys: list[str]) -> DataFrame:
    """All columns of a (as a_*) and b (as b_*) whose boxes overlap, by key and grid cell.

    Boxes are x0, y0, x1, y1. Each box is dealt to the cells it touches; of the cells a pair shares,
    the one with the lower corner of the overlap keeps it, so no pair comes twice and none is sorted out.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
        named = df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
        return named.withColumn("__cx", F.explode(cells(f"{p}_x0", f"{p}_x1"))).withColumn("__cy", F.explode(cells(f"{p}_y0", f"{p}_y1")))

    met = _by_cell(dealt(a, "a"), keys).join(_by_cell(dealt(b, "b"), keys), [*keys, "__cx", "__cy"]).filter("a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    own = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("__cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("__cy"))
    return many(met.filter(own).drop("__cx", "__cy"))


def kinds(boxes: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """boxes with kind: the least name of those that are equal in keys and box. What boxes say of one object holds for all of its kind."""
    return boxes.withColumn("kind", F.min(name).over(Window.partitionBy(*keys, "x0", "y0", "x1", "y1")))


#: Objects in one row of members().
MEMBERS = 1024


def members(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and members: the names (not null) of the rows that are equal in `by`, in lists of up to MEMBERS, as many rows as it takes."""
    place = Window.partitionBy(*by).orderBy(name)
    listed = rows.select(*by, name).withColumn("__list", F.floor((F.row_number().over(place) - 1) / MEMBERS))
    return many(listed.groupBy(*by, "__list").agg(F.sort_array(F.collect_list(name)).alias("members")).drop("__list"))


def overlapping(a: DataFrame, b: DataFrame, cell: int, keys: list[str], name: str = "id") -> DataFrame:
    """keys and name of the boxes of a (x0, y0, x1, y1) that any box of b overlaps: a semi-join on grid cells, which makes no pairs."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    box = lambda df, p: df.withColumn("__cx", cells("x0", "x1")).withColumn("__cy", cells("y0", "y1")).select(*[F.col(c).alias(f"{p}{c}") for c in (*keys, "__cx", "__cy", "x0", "y0", "x1", "y1")], *([name] if p == "a_" else []))
    left, right = box(a, "a_"), box(b, "b_")
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*keys, "__cx", "__cy")] + [F.col("a_x0") < F.col("b_x1"), F.col("b_x0") < F.col("a_x1"), F.col("a_y0") < F.col("b_y1"), F.col("b_y0") < F.col("a_y1")]
    return left.join(right, on, "left_semi").select(*[F.col(f"a_{k}").alias(k) for k in keys], name).distinct()


def near_pairs(a: DataFrame, b: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Pairs of points (x, y; columns a_*, b_*) at most `radius` apart: b stands in its cell, a looks at nine."""
    named = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = named(a, "a").withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    left = left.withColumn("__cx", F.floor(F.col("a_x") / radius) + F.col("__dx")).withColumn("__cy", F.floor(F.col("a_y") / radius) + F.col("__dy"))
    right = named(b, "b").withColumn("__cx", F.floor(F.col("b_x") / radius)).withColumn("__cy", F.floor(F.col("b_y") / radius))
    close = F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)) <= radius * radius
    return _by_cell(left, keys).join(_by_cell(right, keys), [*keys, "__cx", "__cy"]).filter(close).drop("__dx", "__dy", "__cx", "__cy")


def overlap_area() -> Column:
    """Area of the overlap of boxes a_* and b_*."""
    side = lambda k: F.greatest(F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0"), F.lit(0))
    return side("x") * side("y")


def best_match(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """For each a the b of the highest score over 0; of equal ones the least b."""
    by = Window.partitionBy(a).orderBy(F.desc(score), b)
    return pairs.filter(F.col(score) > 0).withColumn("__k", F.row_number().over(by)).filter("__k = 1").drop("__k")


def in_parts(pairs: DataFrame, group: str, a: str, b: str, part: str = "__part") -> DataFrame:
    """pairs with the connected part of the candidates that each belongs to: objects of different parts don't bear on each other.

    a's and b's names may be equal; those of different groups are others.
    """
    node = lambda side, c: F.concat_ws("|", F.lit(side), F.col(group).cast("string"), F.col(c).cast("string"))
    named = pairs.withColumn("__a", node("a", a)).withColumn("__b", node("b", b))
    parts = connected(named.select("__a", "__b"), "__a", "__b")
    return named.join(parts.select(F.col("node").alias("__a"), F.col("part").alias(part)), "__a").drop("__a", "__b")


#: Rounds of greedy matching between two writes of what is left.
ROUNDS = 4


def greedy_match(pairs: DataFrame, group: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """group, a, b, score: in order of a, each takes its best b that is still free (of equal ones the least); a score under `least` is no match.

    In rounds: a pair is fixed if b is the best that a has left and a the first that still has b, for then nothing before
    it can take b. All such pairs of all groups are fixed at once, and what shares an end with them is gone; the first a left is
    always fixed, so the rounds end and give what one pass in order would, and there are as many as the longest chain of objects
    that wait for each other. A task holds the candidates of one object at a time, however many a group has. Of
    several scores of a pair the greatest counts; rows with a null in any of the four columns are left out.
    """
    spark = pairs.sparkSession
    rows = pairs.select(group, a, b, score).dropna().filter((F.col(score) >= least) & (F.col(score) > 0))
    left = rows.groupBy(group, a, b).agg(F.max(score).alias(score)).withColumn("__fixed", F.lit(False))
    by_a, by_b = Window.partitionBy(group, a), Window.partitionBy(group, b)
    past: list[str] = []
    while True:
        for _ in range(ROUNDS):
            free = ~F.col("__fixed")
            left = left.withColumn("__first", F.min(F.when(free, F.col(a))).over(by_b))
            left = left.withColumn("__best", F.min(F.when(free, F.struct((-F.col(score)).alias("s"), F.col(b).alias("b")))).over(by_a))
            left = left.withColumn("__now", free & (F.col(a) == F.col("__first")) & (F.col(b) == F.col("__best.b")))
            left = left.withColumn("__gone", F.max("__now").over(by_a)).withColumn("__gone", F.col("__gone") | F.max("__now").over(by_b))
            left = left.filter(F.col("__fixed") | F.col("__now") | ~F.col("__gone")).select(group, a, b, score, (F.col("__fixed") | F.col("__now")).alias("__fixed"))
        own: list[str] = []
        left = cut(left, "greedy", own)
        drop(spark, past)
        past = own
        if left.filter(~F.col("__fixed")).isEmpty():
            return left.select(group, a, b, score)


#: Rows of a group, its pairs of kinds and its objects, that a task matches in one pass.
WHOLE = 1 << 20


def in_order(pairs: pd.DataFrame, a_objects: pd.DataFrame, b_objects: pd.DataFrame) -> Iterator[tuple]:
    """(a, b, score) of a group: each a (kind, other), by their order, takes its kind's best b that is free, of equal ones the least.

    pairs are kind (of a), other (kind of b) and score; of several scores of a pair the greatest counts. Kinds of one score are
    in a heap by their first free b: those only rise, so what has fallen behind is put right when it comes to the top.
    """
    free: dict = {}
    for kind, b in b_objects.sort_values("other", ascending=False)[["kind", "other"]].itertuples(index=False, name=None):
        free.setdefault(kind, []).append(b)
    by_kind = pairs.groupby(["kind", "other"], as_index=False)["score"].max().sort_values(["kind", "score"], kind="stable")
    to, score = by_kind["other"].tolist(), by_kind["score"].tolist()
    n = by_kind.groupby("kind", sort=True).size()
    begins = dict(zip(n.index.tolist(), zip((n.cumsum() - n).tolist(), n.cumsum().tolist(), strict=True), strict=True))
    left, ways = a_objects["kind"].value_counts().to_dict(), {}
    for kind, a in a_objects.sort_values("other")[["kind", "other"]].itertuples(index=False, name=None):
        left[kind] -= 1
        if kind not in ways:
            own: list[tuple[float, list]] = []  # the best score is the last
            for k in range(*begins.get(kind, (0, 0))):
                if not own or own[-1][0] != score[k]:
                    own.append((score[k], []))
                if free.get(to[k]):
                    own[-1][1].append((free[to[k]][-1], to[k]))
            for _, heap in own:
                heapq.heapify(heap)
            ways[kind] = own
        own = ways[kind] if left[kind] else ways.pop(kind)
        while own:
            s, heap = own[-1]
            while heap:
                first, other = heap[0]
                if free[other] and free[other][-1] == first:
                    break
                if free[other]:
                    heapq.heapreplace(heap, (free[other][-1], other))
                else:
                    heapq.heappop(heap)
            if heap:
                yield a, free[heap[0][1]].pop(), s
                break
            own.pop()


def greedy_match_kinds(pairs: DataFrame, a_objects: DataFrame, b_objects: DataFrame, group: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """greedy_match() of objects of kinds: pairs (group, a_kind, b_kind, score) hold for all a's (group, kind, a) and b's (group, kind, b) of two kinds.

    Pairs of objects aren't made. A group whose pairs of kinds and objects are up to WHOLE rows is matched in one pass in a task; of
    larger ones the pairs of objects are made and matched in rounds, so that no task holds a group of any size. a and b are of one type.
    """
    spark, held = pairs.sparkSession, []
    best = pairs.select(group, "a_kind", "b_kind", score).dropna().filter((F.col(score) >= least) & (F.col(score) > 0))
    none = F.lit(None).cast(pairs.schema[score].dataType).alias("score")
    member = lambda df, c, side: df.select(group, F.lit(side).alias("side"), "kind", F.col(c).alias("other"), none).dropna(subset=[group, "kind", "other"]).distinct()
    rows = best.select(group, F.lit(0).alias("side"), F.col("a_kind").alias("kind"), F.col("b_kind").alias("other"), F.col(score).alias("score"))
    rows = cut(rows.unionByName(member(a_objects, a, 1)).unionByName(member(b_objects, b, 2)), "kinds", held)
    large = cut(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select(group), "large", held)
    some = not large.isEmpty()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = in_order(*(pdf[pdf["side"] == k] for k in (0, 1, 2)))
        out = pd.DataFrame(list(found), columns=[a, b, score])
        out.insert(0, group, pdf[group].iloc[0])
        return out

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    small = rows.join(many(large), group, "left_anti") if some else rows
    out = small.groupBy(group).applyInPandas(run, f"{group} {types[group]}, {a} {types['other']}, {b} {types['other']}, {score} {types['score']}")
    if some:
        mine = rows.join(many(large), group, "left_semi")
        side = lambda k, kind, c: many(mine.filter(F.col("side") == k).select(group, F.col("kind").alias(kind), F.col("other").alias(c)))
        both = mine.filter("side = 0").select(group, F.col("kind").alias("a_kind"), F.col("other").alias("b_kind"), F.col("score").alias(score))
        every = both.join(side(1, "a_kind", a), [group, "a_kind"]).join(side(2, "b_kind", b), [group, "b_kind"])
        out = out.unionByName(greedy_match(every, group, a, b, score, least))
    out = cut(out, "matched")
    drop(spark, held)
    return out


def classify(score: Column, revised: float) -> Column:
    """same at .999 or more, revised at `revised` or more, else added."""
    return F.when(score >= 0.999, "same").when(score >= revised, "revised").otherwise("added")


#: Share of the pairs left that a batch of rounds of optimal matching must settle for another to follow.
SETTLED = 0.1


def heaviest(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the pairs (left, right, positive score) of a one-to-one matching of the largest total score.

    By shortest augmenting paths over the pairs given, so memory is that of the pairs, not of all left times all right.
    Each left may also stay alone, at score 0.
    """
    _, rows = np.unique(left, return_inverse=True)
    _, cols = np.unique(right, return_inverse=True)
    n, m, top = int(rows.max()) + 1, int(cols.max()) + 1, float(score.max())
    edges = [[(m + i, top, -1)] for i in range(n)]  # a column of its own, to stay alone
    for k, (i, j, s) in enumerate(zip(rows.tolist(), cols.tolist(), score.tolist(), strict=True)):
        edges[i].append((j, top - s, k))
    u, v = [0.0] * n, [0.0] * (m + n)
    owner, column, chosen = [-1] * (m + n), [-1] * n, [-1] * n
    for start in range(n):
        least: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        done: dict[int, float] = {}
        reached = [(start, 0.0)]
        heap: list[tuple[float, int]] = []
        while True:
            i, at = reached[-1]
            for j, c, k in edges[i]:
                d = at + c - u[i] - v[j]
                if j not in done and d < least.get(j, math.inf):
                    least[j], way[j] = d, (i, k)
                    heapq.heappush(heap, (d, j))
            at, j = heapq.heappop(heap)
            while j in done:
                at, j = heapq.heappop(heap)
            done[j] = at
            if owner[j] < 0:
                break
            reached.append((owner[j], at))
        for r, d in reached:
            u[r] += at - d
        for c, d in done.items():
            v[c] -= at - d
        i = -1
        while i != start:
            i, k = way[j]
            before = column[i]
            owner[j], column[i], chosen[i] = i, j, k
            j = before
    return [k for k in chosen if k >= 0]


def optimal_match(pairs: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """group, a, b, score: a one-to-one matching of the largest total score per group.

    In rounds, over all groups at once: a pair that scores more than the best other pair of its a and the best other one of its b
    together is in every best matching, so it is fixed, and what shares an end with it is gone. Objects that overlap
    mostly one other, as labels of the same things do, are all matched so, by windows over one object's pairs. Rounds end when they settle few of the pairs left. What is left, where pairs compete,
    falls into connected parts; each is matched in a task that holds its pairs only.
    Of several scores of a pair the greatest counts; rows with a null in any of the four columns and scores of 0 or less are no candidates.
    """
    spark = pairs.sparkSession
    rows = pairs.select(group, a, b, score).dropna().filter(F.col(score) > 0)
    left = rows.groupBy(group, a, b).agg(F.max(score).alias(score)).withColumn("__fixed", F.lit(False))
    by_a, by_b = Window.partitionBy(group, a), Window.partitionBy(group, b)

    def others(df: DataFrame, by: WindowSpec, name: str) -> DataFrame:
        """df with the best score of the other free pairs of an object, 0 without any: a fixed pair's object has no free ones."""
        order = by.orderBy(F.desc(score), a, b)
        before, after = (F.max(score).over(order.rowsBetween(*r)) for r in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
        return df.withColumn(name, F.coalesce(F.greatest(before, after), F.lit(0.0)))

    past: list[str] = []
    open_before = math.inf
    while True:
        for _ in range(2):
            left = others(others(left, by_a, "__other_a"), by_b, "__other_b")
            left = left.withColumn("__now", F.col(score) > F.col("__other_a") + F.col("__other_b"))
            left = left.withColumn("__gone", F.max("__now").over(by_b)).withColumn("__gone", F.col("__gone") | F.max("__now").over(by_a))
            left = left.filter(F.col("__now") | ~F.col("__gone")).select(group, a, b, score, F.col("__now").alias("__fixed"))
        own: list[str] = []
        left = cut(left, "optimal", own)
        drop(spark, past)
        past = own
        still_open = left.filter(~F.col("__fixed")).count()
        if not still_open:
            return left.select(group, a, b, score)
        if still_open > open_before * (1 - SETTLED):
            break
        open_before = still_open

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = heaviest(pdf[a].to_numpy(), pdf[b].to_numpy(), pdf[score].to_numpy(dtype=float))
        return pdf.iloc[kept][[group, a, b, score]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    placed = in_parts(left.filter(~F.col("__fixed")).select(group, a, b, score), group, a, b)
    rest = placed.groupBy("__part").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (group, a, b, score)))
    return left.filter("__fixed").select(group, a, b, score).unionByName(rest)


def label_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """slide, a, b, iou of all label pairs that share pixels, from labelled runs (slide, x, lo, hi, label); labels as text.

    Sizes come from one grouping per side, so no pair reads the pixels again.
    """
    text = lambda r: F.format_string("%d_%d", F.col("label.x"), F.col("label.lo")) if isinstance(r.schema["label"].dataType, T.StructType) else F.col("label").cast("string")
    named = lambda r, n: r.select("slide", "x", F.col("lo").alias(f"{n}lo"), F.col("hi").alias(f"{n}hi"), text(r).alias(n))
    left, right = named(a, "a"), named(b, "b")
    size = lambda r, n: r.groupBy("slide", n).agg(F.sum(F.col(f"{n}hi") - F.col(f"{n}lo")).alias(f"n{n}"))
    both = left.join(right, ["slide", "x"]).filter("alo < bhi AND blo < ahi").groupBy("slide", "a", "b").agg(F.sum(F.least("ahi", "bhi") - F.greatest("alo", "blo")).alias("inter"))
    sized = both.join(size(left, "a"), ["slide", "a"]).join(size(right, "b"), ["slide", "b"])
    return sized.select("slide", "a", "b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("iou"))


def roi_measures(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """slide, tp, recall, precision, f1 of labels matched one to one; matches are those of an IoU over the threshold.

    a is the first argument of the reference's measure: precision divides by its objects.
    """
    hits = optimal_match(label_iou(a, b), "slide", "a", "b", "iou").filter(F.col("iou") > threshold).groupBy("slide").agg(F.count(F.lit(1)).alias("tp"))
    counts = lambda r, n: r.select("slide", "label").distinct().groupBy("slide").agg(F.count(F.lit(1)).alias(n))
    every = counts(a, "na").join(counts(b, "nb"), "slide", "full").join(hits, "slide", "left")
    tp, na, nb = (F.coalesce(c, F.lit(0)) for c in ("tp", "na", "nb"))
    return every.select("slide", tp.alias("tp"), F.try_divide(tp, nb).alias("recall"), F.try_divide(tp, na).alias("precision"), F.try_divide(2 * tp, na + nb).alias("f1"))


def predict(rows: DataFrame, model, schema: str) -> DataFrame:
    """Hook for a user's model: model(pandas batch) -> pandas batch, over Arrow batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield model(pdf)

    return rows.mapInPandas(run, schema)
