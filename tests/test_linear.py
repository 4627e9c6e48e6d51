"""Linear machines against plain solvers of the same problems."""

import numpy as np
import pytest

from spanmill.operators import linear


def hinge_svm(x, y, cost, steps=40000):
    """The least |w|^2 / 2 + cost * sum of hinges, by dual coordinate steps over pairs (the constant is not weighed)."""
    k = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(len(y))
    g = -np.ones(len(y))
    for _ in range(steps):
        up = ((y > 0) & (a < cost)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < cost))
        v = -y * g
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
        if v[i] - v[j] < 1e-9:
            break
        curve = k[i, i] + k[j, j] - 2 * y[i] * y[j] * k[i, j]
        t = (v[i] - v[j]) / max(curve, 1e-12)
        t = min(t, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += t * (y[i] * k[:, i] - y[j] * k[:, j])
    w = (a * y) @ x
    free = (a > 1e-8) & (a < cost - 1e-8)
    return w, np.mean((y - x @ w)[free])


def test_classes_by_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 6))
    truth = np.stack([np.sign(x @ rng.standard_normal(6) + 0.4 * rng.standard_normal(150) + 0.3) for _ in range(3)], axis=1).astype(int)
    truth[:20, 1] = 0
    rows = [(i, [float(c) for c in v], [int(c) for c in t]) for i, (v, t) in enumerate(zip(x, truth, strict=True))]
    df = spark.createDataFrame(rows + [(900, None, [1, 1, 1]), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1, 1, 1])], "id int, v array<double>, t array<int>")
    model = linear.fit_classes(df, "v", "t", cost=0.7)
    for k in range(3):
        own = truth[:, k] != 0
        w, b = hinge_svm(x[own], truth[own, k].astype(float), 0.7)
        assert model.weights[k] == pytest.approx(w, abs=0.02) and model.bias[k] == pytest.approx(b, abs=0.02)
    scored = linear.class_scores(df, model, "v")
    got = {r.id: r.scores for r in scored.collect()}
    assert got[900] is None and got[901] is None and got[5] == pytest.approx(list(model.weights @ x[5] + model.bias))
    # the report, spelled out
    report = {(r.part, r["class"]): r for r in linear.class_report(scored.selectExpr("*", "id % 2 AS part"), "t", "id", "part").collect()}
    for part in (0, 1):
        for k in range(3):
            ids = [i for i in range(150) if i % 2 == part and truth[i, k] != 0]
            s, y = np.array([got[i][k] for i in ids]), truth[ids, k] > 0
            tp = ((s > 0) & y).sum()
            recall = tp / y.sum()
            r = report[part, k]
            assert r.n == len(ids) and r.accuracy == pytest.approx(((s > 0) == y).mean())
            assert r.ap_predicted == pytest.approx(recall * tp / (s > 0).sum() + (1 - recall) * y.mean())
            order = np.argsort(-s)
            assert r.ap == pytest.approx(np.mean([y[order[: j + 1]].mean() for j in range(len(ids)) if y[order[j]]]))


def test_what_cannot_be_fitted(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1]), ([1.0], [1])], "v array<double>, t array<int>")
    with pytest.raises(ValueError, match="differ"):
        linear.fit_classes(df, "v", "t")
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_classes(df.limit(0), "v", "t")
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_one_class(df.limit(0), "v")


def one_class_exact(x, outliers):
    """Scores of a machine of one class with the kernel itself, by dual steps over pairs."""
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / x.shape[1])
    n = len(x)
    most = 1.0 / (outliers * n)
    a = np.full(n, 1.0 / n)
    for _ in range(20000):
        g = k @ a
        i, j = np.where(a < most - 1e-12, g, np.inf).argmin(), np.where(a > 1e-12, g, -np.inf).argmax()
        if g[j] - g[i] < 1e-9:
            break
        t = min((g[j] - g[i]) / (k[i, i] + k[j, j] - 2 * k[i, j]), most - a[i], a[j])
        a[i] += t
        a[j] -= t
    g = k @ a
    free = (a > 1e-9) & (a < most - 1e-9)
    return g - g[free].mean()


def test_one_class_ranks_outliers_as_the_exact_one(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((180, 4)) * (1, 5, 0.2, 1), rng.standard_normal((12, 4)) * (1, 5, 0.2, 1) + np.array([9, 45, 2, -9])])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>")
    model = linear.fit_one_class(df, "v", outliers=0.2, features=600)
    got = {r.id: r.score for r in linear.one_class_scores(df, model, "v").collect()}
    exact = one_class_exact(x, 0.2)
    mine = np.array([got[i] for i in range(len(x))])
    assert got[999] is None
    assert set(np.argsort(exact)[:12]) == set(range(180, 192)) and len(set(np.argsort(mine)[:12]) & set(range(180, 192))) >= 11
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(mine), rank(exact))[0, 1] > 0.97
    assert 0.1 < (mine < 0).mean() < 0.3


def test_queries_learn_from_the_table(spark):
    from spanmill.queries import QUERIES
    from tests.compare import DATA

    rows = QUERIES["class_svm_report"](spark, DATA).collect()
    assert {r.split for r in rows} == {"test", "train"} and all(r.accuracy > 0.5 and 0 <= r.ap <= 1 for r in rows)
    assert np.mean([r.ap for r in rows if r.split == "train"]) > np.mean([r.ap for r in rows if r.split == "test"])
    scores = QUERIES["one_class_outliers"](spark, DATA).collect()
    assert 0.02 < np.mean([r.outlier for r in scores]) < 0.3 and all(r.outlier == (r.score < 0) for r in scores)
