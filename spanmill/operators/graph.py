"""Connected parts of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans.session import cut, drop


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, part: the least node that each node of the links is joined with, directly or not.

    Large stars and small stars by turns: a node's greater neighbours are linked to the least node it knows, then it and its
    lesser ones are, till nothing changes. Each step is one grouping and one join on the node itself, so that no part, however large, is one
    task's at its root; parts become stars in about as many rounds as the logarithm of their nodes. State is written each
    step, and past steps' deleted. Links with a null end are left out; a node linked to itself only is its own part.
    """
    spark, links, past = edges.sparkSession, [], []
    ends = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna(), "links", links)
    own = lambda rows: rows.filter("u <> v").distinct()
    state = cut(own(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "stars", past)
    seen = None
    while True:
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == seen:
            break
        seen = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(own(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))), "stars", past)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        held: list[str] = []
        state = cut(own(small), "stars", held)
        drop(spark, past)
        past = held
    nodes = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = cut(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part")), "parts")
    drop(spark, past + links)
    return out
