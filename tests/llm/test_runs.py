"""Periodic runs against definitions spelled out."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from spanmill.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """(start, length, period) by trying every period at every place."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and w[e] == w[e + p]:
                e += 1
            if e - i + p >= max(24, 3 * p):
                found.setdefault((i, e - i + p), p)
            i = e
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(key, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def answer(key, text):
    w = planted(key, text)
    found = all_runs(w)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (key, len(found), *best, milli, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def texts(seed=3):
    rng = random.Random(seed)
    out = [None, "", " \t", "a", "a " * 23, "a " * 24, "a " * 25 + "b", "a b " * 12, "a b " * 11 + "a", "a b c d e f g h " * 3, "a b c d e f g h i " * 3, "a b c d e f g h i " * 3 + "a b", "a a b " * 40, "a\xa0b   c " * 30, "é ü " * 30 + "x"]
    for _ in range(60):
        letters = "abc"[: rng.randint(1, 3)]
        w = []
        while len(w) < rng.randint(10, 300):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            w += block * rng.randint(1, 9)
        out.append(" ".join(w))
    inner = "a a a a b " * 8
    out.append(inner * 4 + "z " + inner * 3)  # runs within runs
    out.append(" ".join(f"w{i % 1000}" for i in range(3500)))
    return out


def test_digests_against_definitions(spark):
    rows = list(enumerate(texts())) + [(None, "x y " * 20), (5, "b " * 30), (5, "b " * 30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words long, runs string")
    got = [tuple(r) for r in runs.run_digests(runs.periodic_runs(runs.with_repeats(df))).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((answer(*r) for r in rows), key=key)
    assert max(r[1] for r in got) > 3


def test_planting(spark):
    rows = [(k, f"p q r {k} s\tt  u v w") for k in range(300)]
    got = {r.doc_id: r.text for r in runs.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 10 == 0]
    assert changed and all(got[k] == (" ".join(planted(k, t)) if k in changed else t) for k, t in rows)


def test_empty_table_and_fewer_periods(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert runs.run_digests(runs.periodic_runs(df)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, times=2)


@pytest.mark.parametrize("seed", range(5))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2, 200) if seed else np.zeros(200, dtype=int)
    i, j = rng.integers(0, 200, (2, 500))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(200) if max(x, y) + k >= 200 or codes[x + k] != codes[y + k]), 200) for x, y in zip(i, j, strict=True)]
    assert runs.Extensions(codes).of(i, j).tolist() == want


def test_long_text_in_few_points_at_a_time(monkeypatch):
    """A text of 60,000 words, one run over all; the grid is looked at in slices."""
    monkeypatch.setattr(runs, "POINTS", 5000)
    codes = np.arange(60000) % 700
    text, period, place = runs.grid_points(codes, np.array([60000]))
    assert set(period.tolist()) == {700 * k for k in range(1, 29)}
    assert runs.runs_at(codes, period, place).tolist() == [[0, 60000, 700]]


def test_whole_table_by_definition(spark):
    from spanmill.llm.queries import QUERIES
    from tests.compare import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, DATA).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text or "") < 12000]  # the definition is quadratic
    assert len(short) > 0.9 * len(rows)
    for r in short:
        assert got[r.doc_id] == answer(r.doc_id, r.text)
