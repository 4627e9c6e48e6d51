"""Stand-ins for the imaging tables, made from the driver tables, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.plans.session import many, spread, table

#: Rasters and objects that a task makes pixels, tries or pairs of.
RASTERS, OBJECTS = 250, 4000


class Registry:
    """Collects a module's queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return add


def m1d(spark: SparkSession, sf: str) -> DataFrame:
    """1-D masks: slide, pos, truth, pred, score, v from events."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("slide"),
        (F.row_number().over(at) - 1).cast("long").alias("pos"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("truth"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("pred"),
        (1 / (1 + F.exp(-(F.col("value") - 50) / 25))).alias("score"),
        ((F.col("value") - 50) / 25).alias("logit"),
        F.col("value").alias("v"),
    )


M1D = """m1d AS (SELECT user_id AS slide, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS truth, CASE WHEN value > 50 THEN 1 ELSE 0 END AS pred,
  1 / (1 + exp(-(value - 50) / 25)) AS score, (value - 50) / 25 AS logit, value AS v FROM events)"""


def r2d(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters: slide, y, x, h, w, mask, val, one grid per supplier."""
    sizes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("slide"), (20 + F.col("s_suppkey") % 7).cast("int").alias("h"), (20 + F.col("s_suppkey") % 5).cast("int").alias("w"))
    px = spread(sizes, "slide", RASTERS).select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    px = px.select("slide", "y", "x", "h", "w", F.when((F.col("y") * 31 + F.col("x") * 17 + F.col("slide") * 13) % 11 < 4, 1).otherwise(0).alias("mask"), ((F.col("y") * 31 + F.col("x") * 17 + F.col("slide") * 13) % 256).cast("int").alias("val"))
    return many(px)


R2D = """r2d AS (SELECT s_suppkey AS slide, y, x, 20 + s_suppkey % 7 AS h, 20 + s_suppkey % 5 AS w,
  CASE WHEN (y * 31 + x * 17 + s_suppkey * 13) % 11 < 4 THEN 1 ELSE 0 END AS mask, (y * 31 + x * 17 + s_suppkey * 13) % 256 AS val
  FROM supplier, range(27) AS a(y), range(25) AS b(x) WHERE y < 20 + s_suppkey % 7 AND x < 20 + s_suppkey % 5)"""


def rects(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles: id, grp (A even, B odd), slide, x0, y0, x1, y1, from customers."""
    k = F.col("c_custkey")
    boxes = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 2 == 0, "A").otherwise("B").alias("grp"), F.col("c_nationkey").cast("long").alias("slide"),
        (k * 37 % 1000).alias("x0"), (k * 53 % 1000).alias("y0"), (k * 37 % 1000 + 20 + k % 60).alias("x1"), (k * 53 % 1000 + 20 + k % 45).alias("y1"),
    )
    return many(spread(boxes, "id", OBJECTS))


RECTS = """rects AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS grp, CAST(c_nationkey AS BIGINT) AS slide,
  c_custkey * 37 % 1000 AS x0, c_custkey * 53 % 1000 AS y0, c_custkey * 37 % 1000 + 20 + c_custkey % 60 AS x1, c_custkey * 53 % 1000 + 20 + c_custkey % 45 AS y1 FROM customer)"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes: item, expert, label, one per line item; of several lines with one number the first counts."""
    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    rows = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(by)).filter("k = 1")
    return rows.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("long").alias("expert"), F.col("l_returnflag").alias("label"))


VOTES = """votes AS (SELECT l_orderkey AS item, CAST(l_linenumber AS BIGINT) AS expert, l_returnflag AS label FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_returnflag) = 1)"""


def prob(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities: vec, pos, p, grp from embeddings."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), F.col("label").cast("long").alias("grp"), F.posexplode("embedding").alias("pos", "p")).select("vec", "grp", F.col("pos").cast("long").alias("pos"), F.col("p").cast("double").alias("p"))


PROB = """prob AS (SELECT vec_id AS vec, CAST(label AS BIGINT) AS grp, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings)"""


def cls(spark: SparkSession, sf: str) -> DataFrame:
    """Classified items: doc_id, lang, truth, second (rater), score, pred from labelled documents."""
    joined = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return joined.select("doc_id", "lang", "source", F.col("quality").cast("int").alias("truth"), F.col("toxic").cast("int").alias("second"), (F.col("n_chars") / 40000.0).alias("score"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("pred"))


CLS = """cls AS (SELECT doc_id, lang, source, CAST(quality AS INT) AS truth, CAST(toxic AS INT) AS second, n_chars / 40000.0 AS score,
  CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))"""


def runs_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training log: run, epoch, loss from orders."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(by).cast("long").alias("epoch"), F.col("o_totalprice").alias("loss"))


LOG = """log AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch, o_totalprice AS loss FROM orders)"""


def rnd(c, digits: int = 6):
    return F.round(c, digits)


def hashed_unit(seed: int, *columns: str) -> str:
    """augment.unit() as SQL text."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}, '{seed}')), 1, 7))::BIGINT / 268435456e0)"
