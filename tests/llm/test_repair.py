"""Conversation repair against every sequence of edits."""

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from spanmill.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(turns, marks):
    """(cost, audit) among all results of edits: a row's edit, then up to two inserted turns."""

    def inserted(found):
        more = {(i + "".join(roles), c + 3 * n, a + "I" * n) for i, c, a in found for n in (1, 2) for roles in product("ua", repeat=n)}
        return {f for f in found | more if re.fullmatch(r"s?(ua)*u?", f[0])}  # others can't become right any more

    found = inserted({("", 0, "")})
    for (role, _), mark in zip(turns, marks, strict=True):
        new = {(i, c + 4, a + "D") for i, c, a in found}
        if mark not in ("blank", "duplicate"):
            more = 3 if mark == "truncated" else 0
            new |= {(i + (role[:1] or "?"), c + more, a + "K") for i, c, a in found}
            new |= {(i + r, c + 3 + more, a + "R") for i, c, a in found for r in "ua"}
        found = inserted(new)
    return min((c, a) for i, c, a in found if GRAMMAR.fullmatch(i))


@pytest.mark.parametrize("seed", range(40))
def test_edits_are_the_cheapest(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", "system", "tool", "", " "] if seed % 3 else ["user", "assistant"]), rng.choice(["", " \t", "Hi.", "Well", "Yes!", f"No {rng.random()}?", "why"])) for _ in range(rng.randint(0, 5))]
    marks = repair.faults(turns)
    cost, audit = repair.edits(turns, marks)
    assert (cost, audit) == cheapest(turns, marks)
    fixed = repair.applied(turns, audit)
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in fixed))


def test_faults():
    turns = [("user", " \n"), ("user", "a."), ("user", "a."), ("assistant", "a."), ("user", "b"), ("user", "b"), ("user", ""), ("user", "c. "), ("user", "\xa0")]
    assert repair.faults(turns) == ["blank", "", "duplicate", "", "truncated", "duplicate", "blank", "", "truncated"]
    assert repair.turn_gaps([None, 3, 7, 7, 4]) == 2 and repair.turn_gaps([None]) == repair.turn_gaps([]) == 0
    assert repair.illegal_pairs([("system", ""), ("user", ""), ("user", ""), ("assistant", ""), ("assistant", ""), ("user", "")]) == 2


@pytest.mark.parametrize("put_away", [1, 3, 10**9])
def test_long_conversations_carry_short_audits(monkeypatch, put_away):
    rng = random.Random(11)
    turns = [(rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", ""])) for _ in range(2000)]
    marks = repair.faults(turns)
    monkeypatch.setattr(repair, "PUT_AWAY", 64)
    want = repair.edits(turns, marks)
    monkeypatch.setattr(repair, "PUT_AWAY", put_away)
    assert repair.edits(turns, marks) == want
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in repair.applied(turns, want[1])))


def spelled_out(rows):
    """The contract's rows of conversations [(conv_id, turn, role, text)], row by row."""
    after = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = name(role), name(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        after[c] += [(t, role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = []
    for c, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[1:] for r in own]
        marks = repair.faults(turns)
        cost, audit = repair.edits(turns, marks)
        text = "\n".join(f"{r}:{t}" for r, t in repair.applied(turns, audit))
        numbers = {t for t, *_ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((c, gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], repair.illegal_pairs(turns), cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(120), None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Good.", "Fine?", "well", "", None, f"{c} {t}!", "x\n."])))
    return rows + rows[:30]


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, one turn twice, other roles, and columns whose names clash."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x", False) for r in rows], "conv_id long, turn int, role string, text string, cost int, turns string, present boolean")
    got = [tuple(r) for r in repair.repair_digests(repair.repair(repair.damaged(df), "present")).collect()]
    assert sorted(got, key=str) == spelled_out(rows)
    assert any(r[7] == "" for r in got) or len(got) == 121


def test_sql_gives_the_same_for_odd_rows(spark, tmp_path):
    import duckdb

    rows = odd_rows()
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{next((tmp_path / 'c').glob('*.parquet'))}')")
    got = con.execute(repair.SQL).fetchall()
    assert sorted(got, key=str) == spelled_out(rows)


def test_general_use_and_empty_table(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (2, 1, "system", "Be kind."), (2, 2, "user", "One."), (2, 3, "user", "Two.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    assert (got[1].cost, got[1].audit) == (6, "IKKI")
    assert (got[2].cost, got[2].audit, [t.role for t in got[2].turns]) == (3, "KKR", ["system", "user", "assistant"])
    assert repair.repair(df.limit(0)).count() == 0
