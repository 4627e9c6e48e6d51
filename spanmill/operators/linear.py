"""Linear support vector machines, one per class or of one class, fitted over all rows in a few passes.

The hinge is rounded within h of its corner, and h shrinks from round to round, so that Newton steps apply and the last result
is the hinge's to within h. A pass adds up gradients and Hessians of all classes in the tasks; sums of tasks are added in a second
layer, and what the driver solves is as large as the model: classes times features squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.operators.metrics import average_precision
from spanmill.plans.session import cut, drop

#: Half widths of the rounded corner, Newton steps for each, and when a step's gain counts as none.
WIDTHS, STEPS, GAIN = (10.0, 1.0, 0.1, 0.01), 12, 1e-7
#: Parts of a Newton step that are tried in one pass; very small ones where no row is near the corner and the step is far too long.
PARTS = 0.5 ** np.array([0, 1, 2, 3, 4, 6, 8, 11, 14, 17, 20, 24, 28])


@dataclass(frozen=True)
class Linear:
    """weights [class, feature], bias [class]: a row's scores are weights @ x + bias."""

    weights: np.ndarray
    bias: np.ndarray


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of what part makes of a task's rows: arrays of one shape. Some tasks add up what the others made; the driver gets one from each of those."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"v": pa.array([part(batches).astype(float).ravel()], pa.list_(pa.float64()))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v"):
                a = v.values.to_numpy()
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    layer = rows.mapInArrow(own, "v array<double>")
    adding = round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5)
    found = layer.repartition(max(adding, 1)).mapInArrow(added, "v array<double>").collect()
    return np.sum([r["v"] for r in found], axis=0)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """x [row, feature] and y [row, class] of some rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            own = batch.slice(at, rows)
            n = len(own)
            yield tuple(own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) for c in ("x", "y"))


def rounded_hinge(u: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(u, 0) with its corner rounded within h of 0, its slope and its curvature."""
    slope = np.clip((u + h) / (2 * h), 0, 1)
    value = np.where(u >= h, u, np.maximum(u + h, 0) ** 2 / (4 * h))
    return value, slope, (np.abs(u) < h) / (2 * h)


def newton(rows: DataFrame, classes: int, features: int, cost: float, margin: float, constant: float, pull: float) -> np.ndarray:
    """theta [class, features + 1] of the least |w|^2 / 2 + pull * b + cost * sum of hinges of margin - y * (w x + constant * b).

    rows: x (array of doubles), y (array of -1, 0, 1 for each class; rows count where it isn't 0).
    """
    theta = np.zeros((classes, features + 1))
    weigh = np.append(np.ones(features), 0.0)

    def with_constant(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.full((len(x), 1), constant)], axis=1)

    for h in WIDTHS:
        for _ in range(STEPS):
            now = theta

            def curves(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, h: float = h) -> np.ndarray:
                out = np.zeros((classes, features + 1, features + 2))
                for x, y in _blocks(batches):
                    x = with_constant(x)
                    _, slope, bend = rounded_hinge(margin - y * (x @ now.T), h)
                    bend, slope = bend * (y != 0), slope * y
                    for k in range(classes):
                        near = bend[:, k] > 0
                        out[k, :, :-1] += (x[near] * bend[near, k, None]).T @ x[near]
                    out[:, :, -1] -= slope.T @ x
                return out

            sums = cost * summed(rows, curves).reshape(classes, features + 1, features + 2)
            slope = sums[:, :, -1] + theta * weigh
            slope[:, -1] += pull
            bend = sums[:, :, :-1] + np.diag(weigh + np.append(np.zeros(features), 1e-6))
            step = -np.linalg.solve(bend, slope[:, :, None])[:, :, 0]

            def costs(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, h: float = h, step: np.ndarray = step) -> np.ndarray:
                out = np.zeros((len(PARTS) + 1, classes))
                for x, y in _blocks(batches):
                    x = with_constant(x)
                    at, along = x @ now.T, x @ step.T
                    for i, part in enumerate((0.0, *PARTS)):
                        out[i] += (rounded_hinge(margin - y * (at + part * along), h)[0] * (y != 0)).sum(axis=0)
                return out

            parts = np.array([0.0, *PARTS])
            tried = theta[None] + parts[:, None, None] * step[None]
            total = cost * summed(rows, costs).reshape(len(parts), classes) + (tried**2 * weigh).sum(axis=2) / 2 + pull * tried[:, :, -1]
            best = total.argmin(axis=0)
            theta = tried[best, np.arange(classes)]
            if (total[0] - total.min(axis=0) <= GAIN * (1 + np.abs(total[0]))).all():
                break
    return theta


def _vectors(rows: DataFrame, x: str, relu: bool, unit: bool) -> DataFrame:
    """rows with __x: x as doubles, what is below 0 cut off, to length 1; vectors with nulls are null."""
    v = F.col(x).cast("array<double>")
    fine = F.when(F.forall(v, lambda c: c.isNotNull()) & (F.size(v) > 0), v)
    v = F.transform(fine, lambda c: F.greatest(c, F.lit(0.0))) if relu else fine
    out = rows.withColumn("__x", v)
    length = F.sqrt(F.aggregate("__x", F.lit(0.0), lambda s, c: s + c * c))
    return out.withColumn("__n", length).withColumn("__x", F.transform("__x", lambda c: c / F.col("__n")) if unit else F.col("__x")).drop("__n").withColumn("__x", F.when(~F.exists("__x", lambda c: F.isnan(c)), F.col("__x")))


def fit_classes(rows: DataFrame, x: str, targets: str, cost: float = 1.0, relu: bool = False, unit: bool = False) -> Linear:
    """A linear machine for each class, against the others: all classes in the same passes.

    targets: array of -1, 0, 1 for each class; 0 is a hard example that its class leaves out. Rows whose vector or targets are null,
    empty or hold nulls take no part; vectors of other than the most common length are an error. No usable row: an error.
    """
    held: list[str] = []
    made = _vectors(rows, x, relu, unit).select(F.col("__x").alias("x"), F.col(targets).cast("array<int>").alias("y"))
    usable = cut(made.filter(F.col("x").isNotNull() & F.forall("y", lambda c: c.isNotNull())), "vectors", held)
    sizes = usable.groupBy(F.size("x").alias("d"), F.size("y").alias("k")).count().orderBy(F.desc("count")).limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("no rows to fit" if not sizes else "vectors or targets differ in length")
    theta = newton(usable, sizes[0]["k"], sizes[0]["d"], cost, 1.0, 1.0, 0.0)
    drop(rows.sparkSession, held)
    return Linear(theta[:, :-1], theta[:, -1])


def class_scores(rows: DataFrame, model: Linear, x: str, relu: bool = False, unit: bool = False) -> DataFrame:
    """rows with scores, an array of doubles, one for each class; null where the vector can't be used."""
    vectors, kept = _vectors(rows, x, relu, unit), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("__x")
            some = own.drop_null()
            v = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
            made = iter((v @ model.weights.T + model.bias).tolist() if len(some) else [])
            scores = pa.array([next(made) if ok else None for ok in own.is_valid().to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], names=[*kept, "scores"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return vectors.select(*rows.columns, "__x").mapInArrow(run, f"{columns}, scores array<double>")


def class_report(scored: DataFrame, targets: str, order: str, split: str) -> DataFrame:
    """split, class, n, accuracy, ap_predicted, ap: of class_scores() by the column split; rows whose target is 0 are left out.

    A score over 0 is a prediction. ap_predicted is the average precision of predictions, all of one kind being tied; ap that of the scores.
    Both are null where a class has no positive row.
    """
    each = scored.select(split, order, F.posexplode(F.arrays_zip(F.col("scores").alias("s"), F.col(targets).alias("t"))).alias("class", "c"))
    rows = each.select(split, order, "class", F.col("c.s").alias("score"), F.col("c.t").alias("t")).filter("score IS NOT NULL AND t <> 0")
    rows = cut(rows.withColumn("truth", F.when(F.col("t") > 0, 1).otherwise(0)).drop("t"), "scored")
    hit, said = (F.col("score") > 0) & (F.col("truth") == 1), F.col("score") > 0
    counts = rows.groupBy(split, "class").agg(F.count(F.lit(1)).alias("n"), F.avg((said == (F.col("truth") == 1)).cast("double")).alias("accuracy"), F.count_if(hit).alias("__tp"), F.count_if(said).alias("__said"), F.sum("truth").alias("__pos"))
    recall = F.try_divide(F.col("__tp"), F.col("__pos"))
    tied = recall * F.coalesce(F.try_divide(F.col("__tp"), F.col("__said")), F.lit(0.0)) + (1 - recall) * F.col("__pos") / F.col("n")
    ranked = average_precision(rows, [split, "class"], "score", "truth", order)
    return counts.join(ranked, [split, "class"]).select(split, "class", "n", "accuracy", tied.alias("ap_predicted"), "ap")


@dataclass(frozen=True)
class OneClass:
    """What fit_one_class() learns: the standardiser, the random features and the machine over them."""

    mean: np.ndarray
    deviation: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        return np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.waves + self.phases)


def fit_one_class(rows: DataFrame, x: str, outliers: float = 0.5, features: int = 256, seed: int = 7) -> OneClass:
    """A machine of one class with a Gaussian kernel of width 1 / number of features, over standardised vectors.

    The kernel is that of `features` random cosines, so the fit is linear in them; outliers bounds the share of rows scored below 0. Rows
    whose vector is null, empty or holds nulls take no part; no usable row is an error. A column that doesn't vary is only centred.
    """
    held: list[str] = []
    made = _vectors(rows, x, False, False).select(F.col("__x").alias("x"), F.array(F.lit(1)).alias("y")).filter("x IS NOT NULL")
    usable = cut(made, "vectors", held)
    size = usable.select(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        raise ValueError("no rows to fit")
    d, n = size["d"], size["n"]

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, d))
        for v, _ in _blocks(batches):
            out += np.stack([v.sum(axis=0), (v * v).sum(axis=0)])
        return out

    mean, square = summed(usable, moments).reshape(2, d) / n
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    rng = np.random.default_rng(seed)
    # exp(-|a - b|^2 / d): waves of variance 2 / d
    own = OneClass(mean, np.where(spread > 0, spread, 1.0), rng.standard_normal((d, features)) * np.sqrt(2.0 / d), rng.random(features) * 2 * np.pi, np.zeros(features), 0.0)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, y in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(own.features(v)), pa.list_(pa.float64())), "y": pa.array(y.astype(int).tolist(), pa.list_(pa.int32()))})

    waves = cut(usable.mapInArrow(turned, "x array<double>, y array<int>"), "waves", held)
    # |w|^2 / 2 - rho + sum of max(rho - w x, 0) / (outliers * n)
    theta = newton(waves, 1, features, 1.0 / (outliers * n), 0.0, -1.0, -1.0)
    drop(rows.sparkSession, held)
    return OneClass(own.mean, own.deviation, own.waves, own.phases, theta[0, :-1], float(theta[0, -1]))


def one_class_scores(rows: DataFrame, model: OneClass, x: str) -> DataFrame:
    """rows with score: over 0 within the class, the lower the farther out; null where the vector can't be used."""
    vectors, kept = _vectors(rows, x, False, False), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("__x")
            some = own.drop_null()
            v = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
            made = iter((model.features(v) @ model.weights - model.offset).tolist() if len(some) else [])
            score = pa.array([next(made) if ok else None for ok in own.is_valid().to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], score], names=[*kept, "score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return vectors.select(*rows.columns, "__x").mapInArrow(run, f"{columns}, score double")
