"""MinHash near-duplicates by ProbMinHash, banding and verification.

Shingles are five words; a shingle's weight grows with its count. Each element of a document is a
Poisson process whose rate is its weight: its arrivals come after exponential waits, each at a random
register, and a register keeps the element that arrives first. Arrivals are drawn in rounds, for all
elements at once, and an element ends as soon as its next arrival is later than every register's
earliest. Equal registers of two documents estimate the probability Jaccard of their weights. Where counts
differ much it is far below the Jaccard of the sets, which is what links are verified by: texts that repeat
shingles are sketched with all weights 1 too, which estimates that of the sets.

Bands of registers give buckets. Exact copies are one text from the start. Texts of a bucket are
linked by stars first: in each round the bucket's members that don't share a component are compared
with one of them, so that most of a large group of near copies costs a star; a centre of many edges has its
shingles copied, and its edges are dealt to the copies. Buckets that still hold
several components are then compared whole, in blocks, so no link is lost, and give only the links
that join components. Blocks of large buckets hold sets of like size, and only those are compared whose sizes allow
the similarity. Every link is verified by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import delete, slices, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
STAR_ROUNDS = 2
MASK = (1 << 64) - 1
MIX1, MIX2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits given."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of code points above the blank, in lower case."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = data > 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return np.empty(0, dtype=np.uint64)
    # a polynomial in the place within the word: sums of byte * hash(place) over each word
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(data)]))))
    terms = (data.astype(np.uint64) + np.uint64(1)) * mixed(place.astype(np.uint64) + GOLDEN)
    terms[~inside] = 0
    return mixed(np.add.reduceat(terms, begins) + (ends - begins).astype(np.uint64) * GOLDEN)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of `size` words; a shorter text that has words is one shingle, others have none."""
    words = word_hashes(text or "")
    n = min(size, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * GOLDEN + words[k : len(words) - n + 1 + k])
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first at each register; elements are distinct 64-bit hashes, weights over 0.

    Each round draws a few arrivals of each element that is left, together about as many as fill all
    registers; elements whose last arrival came after every register's first one end.
    """
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, dtype=np.uint64)
    ids, rate, at, k = elements, weights.astype(float)[:, None], np.zeros(len(elements)), 0
    enough = registers * (math.log(registers) + 1)
    while len(ids):
        m = math.ceil(enough / len(ids))
        numbers = np.arange(k + 1, k + m + 1, dtype=np.uint64) * GOLDEN
        h = mixed(ids[:, None] + numbers)
        times = -np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        times[:, 0] += at
        np.cumsum(times, axis=1, out=times)
        at, k, latest = times[:, -1], k + m, first.max()
        row, column = np.nonzero(times < latest)
        near, h = times[row, column], h[row, column]
        where = (mixed(h ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        own = np.flatnonzero(near < first[where])
        # latest first, so that of several arrivals at one register the earliest is written last
        order = own[np.argsort(-near[own])]
        first[where[order]], winner[where[order]] = near[order], ids[row[order]]
        alive = at < first.max()
        ids, rate, at = ids[alive], rate[alive], at[alive]
    return winner


def sketch(text: str | None, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """The bucket of each band, by count and, where shingles repeat, by set too; none for a text without words."""
    elements, counts = np.unique(shingle_hashes(text), return_counts=True)
    if not len(elements):
        return []
    found = []
    for weights in (1.0 + np.log(counts), np.ones(len(counts)))[: 1 + int(counts.max() > 1)]:
        registers = prob_minhash(elements, weights, bands * rows).reshape(bands, rows)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            out = mixed(out * GOLDEN + registers[:, k])
        found.append(out.view(np.int64))
    return np.unique(np.concatenate(found)).tolist()


def _sketches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buckets = [sketch(t, bands, rows) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("sha"), pa.array(buckets, LONGS)], names=["key", "sha", "buckets"])

    return run


LONGS = pa.list_(pa.int64())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [np.unique(shingle_hashes(t)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, LONGS)], names=["id", "shingles"])


#: Edges of one text that a copy of its shingles is joined with.
STAR_PART = 1000


def verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(Written) edges (a, b) whose shingle sets have a Jaccard similarity of `threshold` or more.

    A text of many edges, as a star's centre, is dealt to several tasks: its shingles are copied for
    every STAR_PART edges. Which copy an edge meets is settled before any shingles travel.
    """
    dealt = edges
    sides = []
    for end, other in (("a", "b"), ("b", "a")):
        hot = edges.groupBy(F.col(end).alias("id")).agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts")).filter("parts > 1")
        dealt = dealt.join(hot.select(F.col("id").alias(end), F.col("parts").alias(f"parts_{end}")), end, "left")
        dealt = dealt.withColumn(f"part_{end}", F.coalesce(F.pmod(F.xxhash64(other), F.col(f"parts_{end}")).cast("int"), F.lit(0)))
        copied = sets.join(hot, "id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        sides.append(copied.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}"), F.col("shingles").alias(f"s{end}")))
    thin = dealt.select("a", "b", "part_a", "part_b")
    both = thin.join(sides[1], ["b", "part_b"]).join(sides[0], ["a", "part_a"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def components(edges: DataFrame, name: str = "components", held: list[str] | None = None) -> DataFrame:
    """id, root: the least id of each connected component of edges (a, b); ids without edges are left out.

    Alternating large-star and small-star steps till nothing changes; each step is one grouping, and
    its result is written, so lineage stays short. Tables of past steps are deleted, the last one's
    path is appended to `held`.
    """
    spark, own = edges.sparkSession, []
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name, own)
    state = None
    while True:
        seen = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if tuple(seen) == state:
            if held is not None:
                held.extend(own)
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        state, past = tuple(seen), own
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        half = written(large, name, past)
        low = half.groupBy("u").agg(F.min("v").alias("m"))
        small = half.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        own = []
        e = written(small, name, own)
        delete(spark, past)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, class_id: a row per row of docs; class_id is the least key of the texts linked, directly or not.

    Links join texts whose sets of five-word shingles have a Jaccard similarity of `threshold` or
    more, and equal texts, however often shingles repeat; at 0.8 two texts share no bucket once in
    1,500 times. Null texts are empty; texts without words are linked to equal ones only.
    Rows with null key stay with a null class and link nothing. Keys are integers; rows of one key
    with several texts are one document, compared by the shingles of all. Other columns are left out.
    """
    rowed = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.col("key").isNotNull())
    # one pass over the texts; a hash of 256 bits stands for a text from here on
    hashed = rowed.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    held: list[str] = []
    sketched = written(hashed.mapInArrow(_sketches(bands, rows), "key long, sha string, buckets array<long>"), "sketches", held)
    # exact copies are one text, named by their least key
    named = written(sketched.groupBy("sha").agg(F.min(F.struct("key", "buckets")).alias("least"), F.count(F.lit(1)).alias("n")).select("sha", F.col("least.key").alias("id"), F.col("least.buckets").alias("buckets"), "n"), "texts", held)
    links = _copies(sketched.select("key", "sha"), named.filter("n > 1").select("sha", "id"))
    buckets = named.select("id", F.explode("buckets").alias("bucket")).distinct()
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = written(buckets.join(crowded, "bucket"), "crowded", held)
    # a text's popularity: how many others its buckets hold; that of which the rest are copies has most
    popular = crowded.groupBy("id").agg(F.sum("n").alias("popular"))
    shared = written(crowded.join(popular, "id"), "shared", held)
    # shingle sets of the texts that share a bucket with another; a text's row is one of its least key
    # (dealt by id at every size: the list of ids has no bound to broadcast it by)
    ends = shared.select("id").distinct().hint("merge")
    texts = rowed.select(F.col("key").alias("id"), "text").join(ends, "id", "left_semi")
    several = written(sketched.groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "several", held)
    if several.isEmpty():
        sets = written(texts.mapInArrow(_sets, "id long, shingles array<long>"), "shingles", held)
    else:  # keys of several rows: equal texts once, then the shingles of all, each once before they meet
        single = texts.join(several, "id", "left_anti").mapInArrow(_sets, "id long, shingles array<long>")
        sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
        distinct = texts.join(several, "id", "left_semi").groupBy("id", sha).agg(F.min("text").alias("text")).select("id", "text")
        joined = distinct.mapInArrow(_sets, "id long, shingles array<long>").select("id", F.explode("shingles").alias("s")).distinct().groupBy("id").agg(F.collect_list("s").alias("shingles"))
        sets = written(single.unionByName(joined), "shingles", held)
    found = done = None
    for k in range(STAR_ROUNDS):
        edges = _star(shared, found, k)
        edges = written(edges if done is None else edges.join(done, ["a", "b"], "left_anti"), "edges", held)
        done = edges if done is None else done.unionByName(edges)
        good = verified(edges, sets, threshold)
        found = components(good if found is None else good.unionByName(_as_links(found)), "found", held)
    rest = written(_across(shared, found, sets, threshold), "rest", held)
    last = components(rest.unionByName(_as_links(found)).unionByName(links), "classes")
    delete(docs.sparkSession, held)
    out = docs.select(F.col(key), F.col(key).cast("long").alias("__k"))
    return out.join(last, out["__k"] == last["id"], "left").select(F.col(key), F.coalesce("root", "__k").alias("class_id"))


#: Copies of one text are dealt to so many tasks when they are told its least key.
COPY_PARTS = 16


def _copies(named: DataFrame, least: DataFrame) -> DataFrame:
    """Links (a, b) between the key of each further copy of a text and the text's least key."""
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    joined = named.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(COPY_PARTS)).cast("int")).join(parts, ["sha", "part"])
    return joined.filter("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))


def _as_links(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _rooted(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return shared.withColumn("root", F.col("id"))
    return shared.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))


#: Texts of a bucket that one task tells what is known of the bucket.
BUCKET_PART = 1000


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (id, n of their bucket, ...) with the part of the bucket that they are in."""
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BUCKET_PART)).cast("int"))


def _copied(buckets: DataFrame) -> DataFrame:
    """A row per bucket (n, ...) for each of its parts: nothing of a large bucket is joined in one task."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BUCKET_PART).cast("int") - 1))).drop("n")


def _star(shared: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """In each bucket, pairs (a, b), a < b, of a centre and the members of other components than its own.

    The centre is the most popular member first, then one by a hash that changes with each round.
    """
    rooted = _rooted(shared, found)
    rank = -F.col("popular") if k == 0 else F.xxhash64("id", F.lit(k))
    centres = rooted.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "id", "root")).alias("c"), F.max("n").alias("n")).select("bucket", "n", F.col("c.id").alias("centre"), F.col("c.root").alias("centre_root"))
    pairs = _dealt(rooted).join(_copied(centres), ["bucket", "part"]).filter("root <> centre_root")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _spanning(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) of texts of one group that are similar, only as many as join its components.

    Intersections are counted for all at once, over the shingles that two or more have, a slice of them
    at a time.
    """
    ids, roots = pdf["id"].to_numpy(), pdf["root"].to_numpy()
    lengths = pdf["shingles"].map(len).to_numpy()
    names, columns, times = np.unique(np.concatenate(pdf["shingles"].to_list()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), lengths)
    kept = times[columns] > 1
    row, columns = row[kept], np.unique(columns[kept], return_inverse=True)[1]
    shared = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for start in range(0, int(columns.max(initial=-1)) + 1, SLICE):
        own = (columns >= start) & (columns < start + SLICE)
        part = np.zeros((len(ids), SLICE), dtype=np.float32)
        part[row[own], columns[own] - start] = 1
        shared += part @ part.T
    similar = shared >= threshold * (lengths[:, None] + lengths[None, :] - shared)
    similar &= roots[:, None] != roots[None, :]
    group = {r: r for r in roots}

    def top(r: int) -> int:
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    links = []
    for i, j in np.argwhere(np.triu(similar)):
        if (x := top(roots[i])) != (y := top(roots[j])):
            group[max(x, y)] = min(x, y)
            links.append((ids[i], ids[j]))
    return links


#: Texts of a bucket that one task compares with as many others, and shingles counted at once.
BLOCK, SLICE = 500, 4096


def _across(shared: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of one bucket and different components, enough to join all that belong together.

    Every two texts of such a bucket that can be similar by their sizes are compared, those of large
    ones in pairs of blocks, but only links that join components leave a task, not pairs. A size
    class spans the ratio 1 / threshold, so similar sets are in one class or in neighbouring ones. The
    texts of a bucket's largest component stand in blocks of their own, which meet the others' only: what
    is left of a large group of near copies meets the group, and the group isn't compared again.
    """
    rooted = _rooted(shared, found)
    roots = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed_buckets = roots.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).filter("roots > 1").select("bucket", "n", F.col("most.root").alias("largest"))
    width = max(math.log(1 / threshold), 0.01) * 1.000001
    sized = _dealt(rooted).join(_copied(mixed_buckets), ["bucket", "part"]).join(sets.select("id", F.size("shingles").alias("size")), "id")
    large = F.col("n") > BLOCK
    group = F.when(large, F.floor(F.log("size") / width).cast("int")).otherwise(0)
    members = sized.select("id", "root", "bucket", F.when(large & (F.col("root") == F.col("largest")), 1).otherwise(0).alias("side"), group.alias("class"), "n", "part")
    counts = members.groupBy("bucket", "side", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("n").alias("n"))
    counts = counts.groupBy("bucket").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.struct("side", "class"), "blocks"))).alias("blocks"))
    blocks = lambda side, c: F.coalesce(F.try_element_at(F.col("blocks"), F.struct(side.alias("side"), c.alias("class"))), F.lit(0))

    def met(side: Column) -> Column:
        """All blocks of one side of the classes that a text's own class can be similar to."""
        every = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.sequence(F.lit(1), F.greatest(blocks(side, F.col("class") + d), F.lit(1))), lambda k: F.struct(side.alias("side"), (F.col("class") + d).alias("class"), (k - 1).alias("block"))))
        return F.filter(F.flatten(every), lambda b: b["block"] < blocks(b["side"], b["class"]))

    own = F.struct("side", "class", F.pmod(F.xxhash64("id"), blocks(F.col("side"), F.col("class"))).cast("int").alias("block"))
    others = F.when(F.col("side") == 1, met(F.lit(0))).otherwise(F.concat(met(F.lit(0)), met(F.lit(1))))
    dealt = members.join(_copied(counts), ["bucket", "part"]).select("id", "root", "bucket", own.alias("own"), F.explode(others).alias("other"))
    placed = dealt.select("id", "root", "bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")).join(sets, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = _spanning(pdf, threshold) if pdf["root"].nunique() > 1 else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return placed.groupBy("bucket", "first", "second").applyInPandas(run, "a long, b long")
