"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Equal fingerprints are one from
the start. To find those that differ in few bits, the 64 bits are grouped into partitions, correlated bits
together; each fingerprint is given a threshold per partition, unequal ones, which add up to
radius - partitions + 1. Any other within the radius then differs from it by no more than the threshold in one
partition at least: if it exceeded all of them, it would differ by more than the radius in sum. A threshold of -1
leaves a partition out. The thresholds of a fingerprint are those of the least estimated work, found by dynamic
programming over the partitions; the estimates are counts of all fingerprints by parts of partitions.

Fingerprints then probe the values within their threshold of their own, partition by partition, and what they
meet is verified on all 64 bits. The result does not depend on partitions, thresholds or estimates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import delete, slices, written
from spanmill.llm.neardup import components
from spanmill.llm.words import pieces, utf8

BITS = 64
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's shingles, repeats included; a shorter text is one shingle, one without words has 0."""
    n, ones, carried = 0, np.zeros(BITS, dtype=np.int64), []
    for words in pieces(utf8(text, lower=True)):
        words = carried + words
        if len(words) >= shingle:
            n += _count(words, shingle, seed, ones)
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and carried:
        n += _count(carried, len(carried), seed, ones)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _count(words: list[bytes], shingle: int, seed: int, ones: np.ndarray) -> int:
    """Adds to `ones` how many of the words' shingles have each bit, the highest first; returns their number."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins, ends = np.concatenate(([0], ends[:-1])), ends - 1
    begins, ends = begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begins), COUNTED):
        h = np.array([digest(joined[b:e], seed) for b, e in zip(begins[at : at + COUNTED], ends[at : at + COUNTED], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return len(begins)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            made = np.array([fingerprint_of(t) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made)], names=["key", "fp"])


@dataclass(frozen=True)
class Plan:
    """Partitions (masks of bits), their parts and, per part and value, the share of fingerprints at each distance."""

    masks: tuple[int, ...]
    radius: int
    #: Of each partition the parts: their bits and the shares, an array [distance, value].
    parts: tuple[tuple[tuple[tuple[int, ...], np.ndarray], ...], ...]
    rows: int


#: Bits of a part whose values are counted: a table of 2 to the PART_BITS for each part.
PART_BITS = 11


def grouped_bits(joint: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits 0 (lowest) to 63 in groups of like size; joint[i, j]: how many fingerprints have both bits i and j, the last row and column: all.

    A group starts with the bit most correlated with all that are left, and takes those most correlated with its members.
    """
    n = max(joint[BITS, BITS], 1)
    p = joint[BITS, :BITS] / n
    cov = joint[:BITS, :BITS] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(like, 0)
    left, groups = list(range(BITS)), []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        own = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda b: (like[b, own].sum(), -b))
            own.append(nxt)
            left.remove(nxt)
        groups.append(sorted(own))
    return groups


def _value(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The bits picked out of each fingerprint, as a number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, over all fingerprints of a task: a table of 65 x 65 numbers."""
    total = np.zeros((BITS + 1, BITS + 1))
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.ones((len(fps), BITS + 1))
        for b in range(BITS):
            bits[:, b] = (fps >> np.uint64(b)) & np.uint64(1)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(total.size), BITS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])


def _parts_of(groups: list[list[int]]) -> list[list[tuple[int, ...]]]:
    out = []
    for bits in groups:
        k = -(-len(bits) // PART_BITS)
        out.append([tuple(int(b) for b in part) for part in np.array_split(bits, k)])
    return out


def _within(counts: np.ndarray, radius: int) -> np.ndarray:
    """[distance, value]: how many fingerprints lie at each distance up to `radius` of a value of a part."""
    width = len(counts).bit_length() - 1
    # by bits: rows at distance d once the first bits have been looked at
    table = np.zeros((radius + 1, len(counts)))
    table[0] = counts
    for b in range(width):
        flipped = table[:, np.arange(len(counts)) ^ (1 << b)]
        table[1:] += flipped[:-1]
    return table


def partitions_for(rows: int, radius: int = RADIUS) -> int:
    """The number of partitions of least expected work for so many fingerprints spread evenly.

    A probe or index row is shuffled, which costs about as much as verifying PROBE_COST candidates. Few partitions
    need many probes within a threshold, many partitions are short and hold many candidates each.
    """

    def work(m: int) -> float:
        budget, width = radius - m + 1, BITS / m
        spread = [budget // m + (k < budget % m) for k in range(m)]
        probes = sum(comb(round(width), d) for t in spread if t >= 0 for d in range(t + 1))
        return (m + probes) * PROBE_COST + probes * rows / 2.0**width

    return min(range(2, radius + 2), key=work)


#: Candidates that are verified in the time a probe takes to be shuffled.
PROBE_COST = 20.0


def fit_plan(fps: DataFrame, partitions: int | None = None, radius: int = RADIUS) -> Plan:
    """Partitions and counts from all of fps (fp long, written, distinct); what the driver gets is 65 x 65 numbers and at most 2 to the PART_BITS per part."""
    joint = np.zeros((BITS + 1, BITS + 1), dtype=np.int64)
    for r in fps.mapInArrow(_joint, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        joint[r["i"], r["j"]] = r["n"]
    rows = int(joint[BITS, BITS])
    groups = grouped_bits(joint, partitions or partitions_for(rows, radius))
    parts = _parts_of(groups)
    flat = [bits for own in parts for bits in own]
    counts = [np.zeros(1 << len(bits), dtype=np.int64) for bits in flat]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(bits), dtype=np.int64) for bits in flat]
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, bits in enumerate(flat):
                total[k] += np.bincount(_value(own, bits), minlength=1 << len(bits))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int64)), pa.array(at), pa.array(t[at])], names=["part", "value", "n"])

    for r in fps.mapInArrow(count, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).collect():
        counts[r["part"]][r["value"]] = r["n"]
    shares = iter([_within(c, radius) / max(rows, 1) for c in counts])
    told = tuple(tuple((bits, next(shares)) for bits in own) for own in parts)
    return Plan(tuple(sum(1 << b for b in bits) for bits in groups), radius, told, rows)


def candidates(plan: Plan, fps: np.ndarray) -> np.ndarray:
    """[partition, threshold + 1, fingerprint]: rows expected within each threshold from -1 to the radius; parts count as independent."""
    out = np.zeros((len(plan.masks), plan.radius + 2, len(fps)))
    for k, own in enumerate(plan.parts):
        near = None
        for bits, shares in own:
            mine = shares[:, _value(fps, bits)]
            near = mine if near is None else np.stack([sum(near[a] * mine[d - a] for a in range(d + 1)) for d in range(plan.radius + 1)])
        out[k, 1:] = np.cumsum(near, axis=0) * plan.rows
    return out


def thresholds(plan: Plan, fps: np.ndarray) -> np.ndarray:
    """[partition, fingerprint]: the thresholds, from -1 to the radius, that add up to radius - partitions + 1 at the least work.

    Dynamic programming over partitions: the least work of the first k of them for each sum of thresholds.
    """
    m, widths = len(plan.masks), [mask.bit_count() for mask in plan.masks]
    probes = np.array([[sum(comb(w, d) for d in range(t + 1)) for t in range(-1, plan.radius + 1)] for w in widths], dtype=float)
    work = candidates(plan, fps) + PROBE_COST * probes[:, :, None]
    goal = plan.radius - m + 1
    sums = range(-m, plan.radius + 1)
    best = {0: np.zeros(len(fps))}
    took: list[dict[int, np.ndarray]] = []
    for k in range(m):
        nxt, own = {}, {}
        for s in sums:
            # what is left can lower the sum by one per partition, and raise it without bound: only sums that may still reach the goal
            for t in range(-1, plan.radius + 1):
                if s - t not in best or s - (m - 1 - k) > goal:
                    continue
                cost = best[s - t] + work[k, t + 1]
                if s not in nxt:
                    nxt[s], own[s] = cost, np.full(len(fps), t)
                else:
                    less = cost < nxt[s]
                    own[s] = np.where(less, t, own[s])
                    nxt[s] = np.where(less, cost, nxt[s])
        best = nxt
        took.append(own)
    out = np.zeros((m, len(fps)), dtype=np.int64)
    left = np.full(len(fps), goal)
    for k in range(m - 1, -1, -1):
        for s, t in took[k].items():
            out[k] = np.where(left == s, t, out[k])
        left = left - out[k]
    return out


def _probes(plan: Plan):
    """Rows (fp, part, value): each value within its threshold of a fingerprint's own, by partition."""
    flips = []
    for mask in plan.masks:
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips.append([np.array([sum(1 << b for b in c) for c in combinations(bits, d)], dtype=np.uint64) for d in range(plan.radius + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, PROBED):
                fps = piece.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                given = thresholds(plan, fps)
                for k, mask in enumerate(plan.masks):
                    for d in range(plan.radius + 1):
                        own = fps[given[k] >= d]
                        values = ((own & np.uint64(mask))[:, None] ^ flips[k][d][None, :]).ravel()
                        if len(values):
                            who = np.repeat(own, len(flips[k][d])).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.full(len(who), k, dtype=np.int32)), pa.array(values.view(np.int64))], names=["fp", "part", "value"])

    return run


#: Fingerprints whose probes are made at once, those of one value in a joined row, and those of one value in a task.
PROBED, HELD, CROWD = 1024, 512, 4096


def links(fps: DataFrame, plan: Plan, held: list[str]) -> DataFrame:
    """Pairs (a, b), a < b as numbers, of fps (fp long, written, distinct) that differ in at most the plan's radius of bits.

    The index holds the fingerprints of a value in arrays of up to HELD; a probe is joined with the arrays of
    its value and leaves the join as the links it found. Probes of a value that over CROWD fingerprints
    have are dealt to a task per CROWD of them, and its arrays copied to each.
    """
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> 63 else m) for m in plan.masks])
    index = fps.select("fp", F.posexplode(masks).alias("part", "mask")).select("fp", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    counts = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowds = written(counts.select("part", "value", F.ceil(F.col("n") / CROWD).cast("int").alias("tasks")), "crowds", held)
    placed = index.join(crowds, ["part", "value"], "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    lists = placed.groupBy("part", "value", F.pmod(F.xxhash64("fp"), F.col("tasks")).alias("block")).agg(F.collect_list("fp").alias("fps"), F.max("tasks").alias("tasks"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("fps"), F.lit(HELD)), lambda at: F.slice("fps", at, HELD))
    lists = lists.select("part", "value", "tasks", F.explode(cuts).alias("fps"))
    lists = lists.select("part", "value", "fps", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    probes = fps.mapInArrow(_probes(plan), "fp long, part int, value long").join(crowds, ["part", "value"], "left")
    probes = probes.select("fp", "part", "value", F.pmod(F.xxhash64("fp"), F.coalesce("tasks", F.lit(1))).cast("int").alias("task"))
    met = probes.join(lists, ["part", "value", "task"])
    near = F.filter("fps", lambda other: (other > F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(other)) <= plan.radius))
    return met.select(F.col("fp").alias("a"), F.explode(near).alias("b")).distinct()


#: One in so many of all rows makes a fingerprint a hot one: there are fewer than HOT hot ones.
HOT = 1000


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, partitions: int | None = None) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id: a row per row of docs.

    Words are stretches without ASCII blanks of the text with A-Z lowered, shingles three words. Rows whose
    fingerprints differ in at most `radius` bits are linked; component_id is the least key reachable over links.
    Null texts are empty; texts without words have the fingerprint 0 and are linked like any other. Rows
    with null key have a fingerprint and a null component, and link nothing. Repeated rows and rows of one
    key with several texts stay, each with its own fingerprint; the key stands for all of them, so what one
    of them links, the key links. Keys are integers; other columns are left out. An empty table gives no rows.
    """
    held: list[str] = []
    rowed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = written(rowed.mapInArrow(_fingerprints, "key long, fp long"), "fingerprints")
    named = rows.filter("key IS NOT NULL")
    fps = written(named.groupBy("fp").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n")), "distinct", held)
    plan = fit_plan(fps.select("fp"), partitions, radius)
    pairs = written(links(fps.select("fp"), plan, held), "links", held)
    ends = pairs.join(fps.select(F.col("fp").alias("a"), F.col("id").alias("ida")), "a").join(fps.select(F.col("fp").alias("b"), F.col("id").alias("idb")), "b").select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    # a key of several fingerprints joins them: all but one per fingerprint are linked to its least key, if they have others
    several = named.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("key")
    crossing = named.join(several, "key", "left_semi").distinct().join(fps.select("fp", "id"), "fp").filter("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    roots = components(ends.unionByName(crossing), "roots", held)
    answer = written(fps.join(roots, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component_id")), "components")
    delete(docs.sparkSession, held)
    # fingerprints that over one in HOT rows have are fewer than HOT: those are broadcast, and no other is hot
    total = answer.agg(F.sum("n")).first()[0] or 0
    hot = answer.filter(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id"))
    rare = answer.filter(F.col("n") * HOT <= total).select("fp", "component_id")
    told = rows.join(F.broadcast(hot), "fp", "left")
    common = told.filter("hot_id IS NOT NULL OR key IS NULL").select("key", "fp", F.when(F.col("key").isNotNull(), F.col("hot_id")).alias("component_id"))
    others = told.filter("hot_id IS NULL AND key IS NOT NULL").select("key", "fp").join(rare, "fp").select("key", "fp", "component_id")
    return common.unionByName(others).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
