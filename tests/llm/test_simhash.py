"""SimHash near-duplicates against fingerprints and links spelled out."""

import random

import numpy as np
import pytest
import xxhash

from spanmill.llm import simhash
from spanmill.llm.words import pieces, utf8


def spelled_out(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = min(3, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def least_reachable(fps):
    """{key: least key} by comparing all fingerprints."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "A b  c\x0bd e", "é Ä x y z", "w " * 50, "x y z " * 400])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == spelled_out(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr("spanmill.llm.words.PIECE", 64)
    assert [w for p in pieces(utf8(text), 64) for w in p] == text.encode().split()
    assert simhash.fingerprint_of(text) == whole == spelled_out(text)


def near_fingerprints(n, seed):
    """Fingerprints in clusters of a few flipped bits, and a large group that shares most of its bits."""
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(n)}
    for base in list(fps)[: n // 4]:
        for _ in range(3):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(n)}
    return sorted(f - (1 << 64) if f >> 63 else f for f in fps)


@pytest.mark.parametrize("partitions", [2, 3, None])
def test_links_lose_nothing(spark, tmp_path, partitions, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 16)
    monkeypatch.setattr(simhash, "CROWD", 100)
    fps = near_fingerprints(300, 5)
    spark.createDataFrame([(f,) for f in fps], "fp long").write.parquet(str(tmp_path / "fps"))
    table = spark.read.parquet(str(tmp_path / "fps"))
    held = []
    plan = simhash.fit_plan(table, partitions)
    got = {(r.a, r.b) for r in simhash.links(table, plan, held).collect()}
    a = np.array(fps)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 2
    assert got == {(fps[i], fps[j]) for i, j in np.argwhere(np.triu(near, 1))}
    assert len(got) > 1000


def test_thresholds_sum_and_differ(spark, tmp_path):
    """Fingerprints with a constant partition leave it out, and give another a larger threshold."""
    rng = random.Random(1)
    rows = [(rng.getrandbits(40),) for _ in range(20000)]
    spark.createDataFrame(rows, "fp long").distinct().write.parquet(str(tmp_path / "fps"))
    table = spark.read.parquet(str(tmp_path / "fps"))
    plan = simhash.fit_plan(table, 3)
    given = simhash.thresholds(plan, np.array([r.fp for r in table.limit(500).collect()], dtype=np.uint64))
    assert (given.sum(axis=0) == 0).all() and given.min() >= -1
    assert (given == -1).any()


def test_correlated_bits_stand_together():
    rng = np.random.default_rng(3)
    bits = np.ones((4000, 65))
    bits[:, :64] = rng.integers(0, 2, (4000, 64))
    for a, b in ((0, 63), (5, 40), (17, 33)):
        bits[:, b] = bits[:, a]
    groups = simhash.grouped_bits(bits.T @ bits, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    for a, b in ((0, 63), (5, 40), (17, 33)):
        assert any(a in g and b in g for g in groups)


def test_components(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(base[:200] + ["new"] + base[200:]))]
    rows += [(k, " ".join(rng.choice(vocabulary) for _ in range(50))) for k in range(20, 60)]
    rows += [(70, ""), (71, None), (72, " \n"), (5, "one"), (80, "ONE"), (81, "one two"), (30, "one two three four")]
    rows += [(20, rows[3][1])] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "one", "x")], "doc_id long, text string, fingerprint string")
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows) + 1
    by_row = {(k, f"{spelled_out(t):016x}") for k, t in rows} | {(None, f"{spelled_out('one'):016x}")}
    assert {(r.doc_id, r.fingerprint) for r in got} == by_row
    assert all(r.component_id is None for r in got if r.doc_id is None)
    # a key of several texts joins what they are linked to
    many = {}
    for k, t in rows:
        many.setdefault(k, set()).add(spelled_out(t))
    root = {k: k for k in many}
    for a in sorted(many):
        for b in sorted(many):
            if a < b and any((x ^ y).bit_count() <= 2 for x in many[a] for y in many[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert root[11] == 10 and root[71] == 70 and root[80] == 5


def test_components_of_hot_copies_and_empty(spark):
    rows = [(k, "the same text every time") for k in range(3000)] + [(5000, "another one altogether is here"), (5001, "x")]
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3002 and all(got[k] == 0 for k in range(3000))
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scratch_is_cleaned(spark):
    import os

    from spanmill.llm.common import shared_dir
    from spanmill.plans.session import cleaned

    here = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(here))
    with cleaned(spark):
        assert simhash.simhash_components(spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")).count() == 2
        assert set(os.listdir(here)) != before
    assert set(os.listdir(here)) == before


def test_whole_table_by_brute_force(spark):
    """All documents of the smallest test data, compared with each other."""
    from spanmill.llm.queries import QUERIES
    from tests.compare import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: spelled_out(r.text) for r in rows}
    want = {(k, f"{fps[k]:016x}", c) for k, c in least_reachable(fps).items()}
    assert {tuple(r) for r in QUERIES["op13_simhash"](spark, DATA).collect()} == want
