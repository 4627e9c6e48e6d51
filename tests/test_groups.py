"""Batches cut between groups, and the kernels that take many groups at once."""

import numpy as np
import pandas as pd
import pytest

from spanmill.operators import components, contours
from spanmill.operators.groups import whole_groups


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_no_group_is_in_two_batches(size):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"a": np.sort(rng.integers(0, 5, 60)).astype(float), "k": 0, "v": range(60)}).sort_values(["a", "v"])
    rows.loc[rows["a"] == 4, "a"] = None
    got = list(whole_groups((rows.iloc[i : i + size] for i in range(0, 60, size)), ["a", "k"]))
    assert pd.concat([p for p, _ in got])["v"].tolist() == rows["v"].tolist()
    seen = [g["a"].iloc[0] for p, group in got for _, g in p.groupby(group)]
    assert len(seen) == rows["a"].nunique(dropna=False) and all((group >= 0).all() for _, group in got)


def test_small_slides_share_a_batch(spark, monkeypatch):
    """A task's slides are labelled together; one call each made 26 ms a slide."""
    plan = components.label_runs(spark.createDataFrame([(s, x, 0, 2) for s in range(50) for x in (0, 1, 3)], "slide long, x long, lo long, hi long"))
    got = {(r.slide, r.x): tuple(r.label) for r in plan.collect()}
    assert got == {(s, x): (0 if x < 2 else 3, 0) for s in range(50) for x in (0, 1, 3)}


def test_equal_figures_are_followed_once(spark):
    spots = [(s, k, y + 9 * k, x + 5) for s in range(3) for k in range(4) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(spots, "slide long, label long, y long, x long")
    made = contours.contours(df)
    assert "MapInPandas" in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.slide, r.label): ({p.x for p in r.ring}, {p.y for p in r.ring}) for r in made.collect()}
    # coordinates are truncated: 0.8 of a pixel before the first is 0 at the border, else the one before
    assert got == {(s, k): ({4.0, 5.0, 6.0, 7.0}, {0.0, 1.0} if k == 0 else {9.0 * k - 1, 9.0 * k, 9.0 * k + 1}) for s in range(3) for k in range(4)}
