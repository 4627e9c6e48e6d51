"""Machines fitted to vectors; SQL can't express the fits, tests compare them with plain solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import linear
from spanmill.plans.session import table
from spanmill.queries.base import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


@query()
def class_svm_report(spark, sf):
    """A linear machine for each label of the vectors, fitted on two thirds of them: accuracy and average precision by class and part."""
    rows = table(spark, sf, "embeddings").withColumn("split", F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train"))
    classes = rows.agg(F.max("label")).first()[0] + 1
    targets = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == F.col("label"), 1).otherwise(-1))
    rows = rows.select("vec_id", "split", "embedding", targets.alias("targets"))
    model = linear.fit_classes(rows.filter("split = 'train'"), "embedding", "targets", unit=True)
    report = linear.class_report(linear.class_scores(rows, model, "embedding", unit=True), "targets", "vec_id", "split")
    return report.select("split", F.col("class").cast("long").alias("class"), "n", "accuracy", "ap_predicted", "ap")


@query()
def one_class_outliers(spark, sf):
    """How far each vector lies from the bulk of those of even ids, by a machine of one class."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = linear.fit_one_class(rows.filter("vec_id % 2 = 0"), "embedding", outliers=0.1, features=128)
    return linear.one_class_scores(rows, model, "embedding").select("vec_id", "score", (F.col("score") < 0).alias("outlier"))
