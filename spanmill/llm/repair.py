"""Conversation structure repair: the cheapest edits after which roles alternate as they should.

A conversation's rows, by turn, pass a forward Viterbi search over four grammar states: nothing yet, after the system
turn, after a user's, after an assistant's. Each state carries the least (cost, audit), the audit being the initials
of the edits so far; a row is kept, given another role or deleted, and then the layer is closed by inserted turns, of
which no more than lead from any state to any other are ever worth their cost. Audits of one cost differ before
either ends, so the least of a state stays the least whatever follows.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import slices

# Costs of edits; what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that a kept row of an initial leads from, and to.
KEEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
#: Where another role or an inserted turn leads from each state; in this order twice, inserts reach all that they can.
NEXT = ((START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\v\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Rows after which what all states' audits share is put away, so that they stay short.
PUT_AWAY = 64

Turn = tuple[str, str]
Layer = list[tuple[float, str]]


def faults(turns: Sequence[Turn]) -> list[str]:
    """The first fault of each turn (role, text): blank, duplicate (both seen earlier), truncated, or none."""
    seen: set[Turn] = set()
    out = []
    for turn in turns:
        said = turn[1].rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if turn in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(turn)
    return out


def _close(layer: Layer) -> Layer:
    """The layer with turns inserted where that is cheaper: two passes, as no state is more than two turns away."""
    for _ in range(2):
        for a, b in NEXT:
            layer[b] = min(layer[b], (layer[a][0] + INSERT, layer[a][1] + "I"))
    return layer


def edits(turns: Sequence[Turn], marks: Sequence[str]) -> tuple[int, str]:
    """The least cost of edits after which the initials of roles are `(s?(ua)+)?`, and their audit, the least in ASCII of that cost."""
    never = (float("inf"), "")
    layer, done = _close([(0.0, ""), never, never, never]), []
    for at, ((role, _), mark) in enumerate(zip(turns, marks, strict=True)):
        new = [(cost + DELETE, audit + "D") for cost, audit in layer]
        if mark not in ("blank", "duplicate"):
            more = TRUNCATED if mark == "truncated" else 0
            for a, b in KEEPS.get(role[:1], ()):
                new[b] = min(new[b], (layer[a][0] + more, layer[a][1] + "K"))
            for a, b in NEXT:
                new[b] = min(new[b], (layer[a][0] + REROLE + more, layer[a][1] + "R"))
        layer = _close(new)
        if at % PUT_AWAY == PUT_AWAY - 1:
            shared = os.path.commonprefix([audit for cost, audit in layer if cost < float("inf")])
            done.append(shared)
            layer = [(cost, audit[len(shared) :]) for cost, audit in layer]
    cost, audit = min(layer[START], layer[ASSISTANT])
    return int(cost), "".join(done) + audit


def applied(turns: Sequence[Turn], audit: str) -> list[Turn]:
    """The turns after the edits of an audit; a kept turn stays as it is, others are the user's or the assistant's as the grammar has it."""
    out, state, rows = [], START, iter(turns)
    follows = dict(NEXT)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = follows[state]
            role = ROLES[state]
        out.append((role, text))
    return out


def illegal_pairs(turns: Sequence[Turn]) -> int:
    """Neighbouring turns whose roles' initials don't follow each other."""
    return sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))


def turn_gaps(numbers: Sequence[int | None]) -> int:
    """Numbers missing between the least and the greatest; nulls don't count."""
    known = {n for n in numbers if n is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            counts: dict[str, list[int]] = {c: [] for c in COUNTS}
            audits, repaired = [], []
            for rows in part.column("turns").to_pylist():
                turns = [(r["role"], r["text"]) for r in rows]
                marks = faults(turns)
                cost, audit = edits(turns, marks)
                found = {"gaps": turn_gaps([r["turn"] for r in rows]), "illegal": illegal_pairs(turns), "cost": cost} | {f: marks.count(f) for f in FAULTS[1:]}
                for c in COUNTS:
                    counts[c].append(found[c])
                audits.append(audit)
                repaired.append([{"role": r, "text": t} for r, t in applied(turns, audit)])
            columns = [part.column("conv_id"), *[pa.array(counts[c], pa.int64()) for c in COUNTS], pa.array(audits, pa.string()), pa.array(repaired, TURNS)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *COUNTS, "audit", "turns"])


def repair(rows: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (array of role, text): a row per conversation.

    rows: conv_id, turn (integers), role, text. A conversation's rows are taken by turn (nulls first), those of one turn
    by role and text. Null roles and texts are one blank each. Roles whose initial is none of s, u, a (an empty one
    too) are given another or deleted. Rows of null conv_id are one conversation. Where `present` names a boolean column,
    rows without it are no turns, but their conversation has a row; without turns all counts are 0, the audit and
    the turns empty. Other columns are left out. An empty table gives no rows. A conversation is one row, before and after.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    held = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.when(F.col(present), turn) if present else turn)).alias("turns"))
    return held.mapInArrow(_repaired, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns array<struct<role: string, text: string>>")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: conversations with faults, chosen by the CRC-32 of `conv_id:turn` modulo 20.

    0 drops the row (it stays as one that isn't present), 1 empties its text, 2 takes `.`, `!` and `?` out, 3 repeats it, 4 makes
    its role user. Nulls are one blank: in what is hashed, and as role and text.
    """
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    made = rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (k != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy"),
    )
    return made.drop("copy")


def repair_digests(repaired: DataFrame) -> DataFrame:
    """Of repair(): its counts, the audit, and the digest of the repaired turns as `role:text`, parted by newlines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))


#: What repair_digests(repair(damaged(conversations), "present")) gives: the states of all conversations advance by a row each step.
SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS h FROM keyed),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS r(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM rows_after),
marked AS (
  SELECT *, substr(role, 1, 1) AS r, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
edits(a, b, letter, needs, price) AS (VALUES
  ('-', '-', 'D', '', 4), ('s', 's', 'D', '', 4), ('u', 'u', 'D', '', 4), ('a', 'a', 'D', '', 4),
  ('-', 's', 'K', 's', 0), ('-', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0),
  ('-', 'u', 'R', '', 3), ('s', 'u', 'R', '', 3), ('a', 'u', 'R', '', 3), ('u', 'a', 'R', '', 3)),
inserts(a, b, letters, price) AS (VALUES
  ('-', '-', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0),
  ('-', 'u', 'I', 3), ('s', 'u', 'I', 3), ('a', 'u', 'I', 3), ('u', 'a', 'I', 3), ('-', 'a', 'II', 6), ('s', 'a', 'II', 6)),
walk(conv_id, i, state, cost, audit) AS (
  SELECT c.conv_id, CAST(0 AS BIGINT), n.b, CAST(n.price AS BIGINT), n.letters FROM counts c, inserts n WHERE n.a = '-'
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT w.conv_id, m.i, n.b AS state, w.cost + e.price + n.price + CASE WHEN m.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || e.letter || n.letters AS audit,
      row_number() OVER (PARTITION BY w.conv_id, n.b ORDER BY w.cost + e.price + n.price + CASE WHEN m.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END, w.audit || e.letter || n.letters) AS best
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
    JOIN edits e ON e.a = w.state AND (e.needs = '' OR e.needs = m.r) AND (e.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts n ON n.a = e.b) WHERE best = 1),
ended AS (
  SELECT conv_id, cost, audit FROM (
    SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.i DESC, w.cost, w.audit) AS best FROM walk w WHERE w.state IN ('-', 'a')) WHERE best = 1),
letters AS (
  SELECT conv_id, p, substr(audit, p, 1) AS letter, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM ended)),
filled AS (
  SELECT l.conv_id, l.place, l.letter, m.r, CASE WHEN l.letter = 'I' THEN '' ELSE m.text END AS text, m.role
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
lines AS (
  SELECT conv_id, place, CASE WHEN letter = 'K' THEN role WHEN (place + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
  FROM (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM filled)),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS repaired FROM lines GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
