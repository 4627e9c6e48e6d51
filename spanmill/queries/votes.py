"""Ensembles, votes, consensus and model state."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import ensemble
from spanmill.plans.session import table
from spanmill.queries.base import LOG, PROB, VOTES, Registry, prob, rnd, runs_log, votes

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


@query(f"WITH {PROB} SELECT grp, pos, round(avg(p), 6) AS mean, round(max(p), 6) AS max, round(stddev_samp(p), 6) AS std FROM prob GROUP BY 1, 2")
def ensemble_mean_max_std(spark, sf):
    return ensemble.merge(prob(spark, sf), ["grp", "pos"]).select("grp", "pos", *[rnd(F.col(c)).alias(c) for c in ("mean", "max", "std")])


@query(f"WITH {PROB}, m AS (SELECT vec % 97 AS item, pos, avg(p) AS p FROM prob GROUP BY 1, 2) SELECT item, CAST(pos AS BIGINT) AS cls, round(p, 6) AS p FROM m QUALIFY row_number() OVER (PARTITION BY item ORDER BY p DESC, pos) = 1")
def ensemble_argmax(spark, sf):
    mean = prob(spark, sf).groupBy((F.col("vec") % 97).alias("item"), F.col("pos").alias("cls")).agg(F.avg("p").alias("p"))
    return ensemble.argmax(mean, ["item"], "cls", "p").select("item", "cls", rnd(F.col("p")).alias("p"))


@query(f"WITH {PROB}, m AS (SELECT grp, vec % 4 AS fold, pos, avg(p) AS p FROM prob GROUP BY 1, 2, 3) SELECT grp, pos, round(avg(p), 6) AS p, CAST(avg(p) > 0.01 AS INT) AS on_ FROM m GROUP BY 1, 2")
def nested_model_mean(spark, sf):
    """Mean of fold means, then a strict threshold."""
    folds = prob(spark, sf).groupBy("grp", (F.col("vec") % 4).alias("fold"), "pos").agg(F.avg("p").alias("p"))
    return folds.groupBy("grp", "pos").agg(F.avg("p").alias("m")).select("grp", "pos", rnd(F.col("m")).alias("p"), (F.col("m") > 0.01).cast("int").alias("on_"))


@query(f"WITH {PROB} SELECT pos, round(avg(p), 6) AS value FROM prob GROUP BY pos")
def parameter_mean(spark, sf):
    return prob(spark, sf).groupBy("pos").agg(rnd(F.avg("p")).alias("value"))


@query(f"WITH {PROB}, r AS (SELECT vec % 50 AS item, vec // 50 AS rep, pos % 8 AS tta, pos // 8 AS k, p FROM prob) SELECT CAST(item AS BIGINT) AS item, CAST(k AS BIGINT) AS k, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std FROM r GROUP BY 1, 2")
def repeated_prediction_std(spark, sf):
    """Mean and deviation over repetitions and augmentations alike."""
    rows = prob(spark, sf).select((F.col("vec") % 50).alias("item"), F.floor(F.col("pos") / 8).cast("long").alias("k"), "p")
    return rows.groupBy("item", "k").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("p")).alias("mean"), rnd(F.stddev_samp("p")).alias("std"))


@query(f"WITH {PROB}, e AS (SELECT vec, pos, exp(p) AS e FROM prob) SELECT vec, pos, round(e / sum(e) OVER (PARTITION BY vec), 6) AS p FROM e")
def softmax(spark, sf):
    return ensemble.softmax(prob(spark, sf), ["vec"], "p").select("vec", "pos", rnd(F.col("softmax")).alias("p"))


@query(f"WITH {PROB} SELECT vec, round(2 * ln(sum(exp(p / 2))), 6) AS energy, round(max(1 / (1 + exp(-p))), 6) AS sigmoid FROM prob GROUP BY vec")
def energy_sigmoid(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), logits.alias("l"))
    return e.select("vec", rnd(ensemble.energy(F.col("l"), 2.0)).alias("energy"), rnd(1 / (1 + F.exp(-F.array_max("l")))).alias("sigmoid"))


_MAJ = f"WITH {VOTES}, c AS (SELECT item, label, count(*) AS n FROM votes GROUP BY 1, 2), m AS (SELECT item, CASE WHEN count(*) FILTER (WHERE n = top) > 1 THEN '?' ELSE max(CASE WHEN n = top THEN label END) END AS label FROM (SELECT *, max(n) OVER (PARTITION BY item) AS top FROM c) GROUP BY item)"


@query(_MAJ + " SELECT item, label FROM m")
def majority_vote(spark, sf):
    return ensemble.majority(votes(spark, sf), ["item"], "label", "?")


@query(_MAJ + ", i AS (SELECT expert, v.item % 5 AS file, count(*) FILTER (WHERE v.label = 'N' AND m.label = 'N') / nullif(CAST(count(*) FILTER (WHERE v.label = 'N' OR m.label = 'N') AS DOUBLE), 0) AS iou FROM votes v JOIN m USING (item) GROUP BY 1, 2) SELECT expert, round(avg(iou), 6) AS average_iou, round(stddev_samp(iou), 6) AS std_iou FROM i GROUP BY expert")
def expert_agreement(spark, sf):
    v = votes(spark, sf).withColumn("file", F.col("item") % 5)
    iou = ensemble.agreement(v, ensemble.majority(v, ["item"], "label", "?"), ["item"], ["expert", "file"], "label", "N")
    return iou.groupBy("expert").agg(rnd(F.avg("iou")).alias("average_iou"), rnd(F.stddev_samp("iou")).alias("std_iou"))


@query(f"WITH {VOTES} SELECT item, list(expert ORDER BY expert)::VARCHAR AS experts, count(*) AS n, count(DISTINCT label) AS labels FROM votes GROUP BY item")
def experts_per_item(spark, sf):
    by = votes(spark, sf).groupBy("item").agg(F.sort_array(F.collect_list("expert")).alias("e"), F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))
    return by.select("item", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x.cast("string")), ", "), F.lit("]")).alias("experts"), "n", "labels")


@query()
def staple_em(spark, sf):
    binary = votes(spark, sf).withColumn("v", F.when(F.col("label") == "N", 1).otherwise(0))
    return ensemble.staple(binary, ["item"], "expert", "v").select("item", rnd(F.col("weight")).alias("weight"), (F.col("weight") > 0.5).cast("int").alias("on_"))


def _staple_sql(rounds: int) -> str:
    """STAPLE in that many rounds over the votes themselves."""
    w = "w{k} AS (SELECT item, 1 / (1 + exp(ln(1 - any_value(f)) - ln(any_value(f)) + sum(ln(CASE WHEN y = 1 THEN 1 - q ELSE q END)) - sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)))) AS w FROM v JOIN r{k} USING (expert), f GROUP BY item)"
    r = "r{n} AS (SELECT expert, least(greatest(sum(w * y) / sum(w), 1e-7), 1 - 1e-7) AS p, least(greatest(sum((1 - w) * (1 - y)) / sum(1 - w), 1e-7), 1 - 1e-7) AS q FROM v JOIN w{k} USING (item) GROUP BY expert)"
    steps = ", ".join(f"{w.format(k=k)}, {r.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"WITH {VOTES}, v AS (SELECT item, expert, CASE WHEN label = 'N' THEN 1e0 ELSE 0e0 END AS y FROM votes), f AS (SELECT avg(y) AS f FROM v), r0 AS (SELECT DISTINCT expert, 0.99e0 AS p, 0.99e0 AS q FROM v), {steps}, {w.format(k=rounds)} SELECT item, round(w, 6) AS weight FROM w{rounds}"


@query(_staple_sql(3))
def staple_three_rounds(spark, sf):
    """The consensus after three rounds, whether or not it has settled."""
    binary = votes(spark, sf).withColumn("v", F.when(F.col("label") == "N", 1).otherwise(0))
    return ensemble.staple(binary, ["item"], "expert", "v", rounds=3, tolerance=0.0).select("item", rnd(F.col("weight")).alias("weight"))


@query(f"WITH {LOG}, t AS (SELECT run, epoch, loss, CASE WHEN epoch = 1 THEN loss ELSE 0.1 * loss END * power(0.9, 1 - epoch) AS term FROM log) SELECT run, epoch, round(sum(term) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) * power(0.9, epoch - 1), 4) AS ema FROM t")
def ema_fold(spark, sf):
    return ensemble.ema(runs_log(spark, sf), ["run"], "epoch", "loss", 0.9).select("run", "epoch", F.round(F.col("ema"), 4).alias("ema"))


@query("SELECT p_brand, arg_max('e' || p_partkey || '_' || p_size || '.pth', p_partkey) AS name, max(p_partkey) AS epoch FROM part GROUP BY p_brand")
def latest_checkpoint(spark, sf):
    """The name of the highest epoch, parsed from the names."""
    names = table(spark, sf, "part").select("p_brand", F.concat(F.lit("e"), "p_partkey", F.lit("_"), "p_size", F.lit(".pth")).alias("name"))
    epoch = F.regexp_extract("name", r"^e(\d+)_", 1).cast("long")
    return names.groupBy("p_brand").agg(F.max(F.struct(epoch.alias("epoch"), "name")).alias("b")).select("p_brand", F.col("b.name").alias("name"), F.col("b.epoch").alias("epoch"))
