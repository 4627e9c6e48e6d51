"""Approximate nearest neighbours by a forest of hash prefixes.

Each vector gets, per tree, a long hash string: one bit per random hyperplane. The rows are dealt to
segments of bounded size; a segment keeps, per tree, its hash strings as a sorted array, built once by
the one task that has the segment. A query
descends in every tree to the rows with the longest common prefix, then all trees ascend together,
one bit at a time, until enough hits share the prefix. The rows that most trees have met, a bounded
share of the segment and all that tie with the last, are scored by exact cosine.

Queries are written once and each task reads them, block by block, so that neither they nor the rows
are shuffled per pair of blocks. Segments are searched in two rounds: a few of them (as the square root
of all) give each query a floor, the others return only what isn't below it. Each query meets every
segment, so recall doesn't fall as the table grows; the stated query set against all rows, in
blocks, is the price.

Fixed values of the method are seeded, so that reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import delete, scratch, written

TREES = 200
BITS = 24
SEGMENT_ROWS = 8192
QUERY_ROWS = 1024
#: The trees ascend until the rows sharing the prefix, counted per tree, are so many times a segment's.
HITS = 2.0
#: The rows met by most trees that are scored: a share of the segment, but at least so many.
SCORED_SHARE, SCORED_ROWS = 0.15, 256
#: Rows hashed at once.
HASH_ROWS = 256


@lru_cache(maxsize=8)
def hyperplanes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((dim, trees * bits)).astype(np.float32)


def hash_strings(x: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """rows x trees: each tree's string of `bits` (under 32) as a number, first bit highest."""
    size = -(-bits // 8)
    weights = (1 << 8 * np.arange(size - 1, -1, -1)).astype(np.float64)
    out = np.empty((len(x), trees), dtype=np.uint32)
    # directions only: components of any size fit the smaller type
    unit = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    for at in range(0, len(x), HASH_ROWS):
        on = (unit[at : at + HASH_ROWS] @ hyperplanes(x.shape[1], trees, bits) > 0).reshape(-1, trees, bits)
        out[at : at + HASH_ROWS] = (np.packbits(on, axis=2) @ weights).astype(np.uint32)
    return out >> np.uint32(8 * size - bits)


class Segment:
    """Sorted arrays of hash strings, one per tree, over some rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits, keys = bits, hash_strings(x, trees, bits)
        order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(keys, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32)).ravel()
        self.rows = len(x)

    def ranges(self, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows stand that share as many first bits as `level` says of each query: queries x trees, from and to."""
        rest = (self.bits - level).astype(np.uint32)[:, None]
        low = q >> rest << rest
        high = low + (np.uint32(1) << rest)
        return tuple(np.stack([np.searchsorted(own, at[:, t]) for t, own in enumerate(self.sorted)], axis=1) for at in (low, high))

    def votes(self, q: np.ndarray, hits: int) -> Iterator[np.ndarray]:
        """For each query's hash strings, by row, how many trees meet it at the deepest common level with `hits` or more.

        Hits only grow as the trees ascend, so that level is found by halving.
        """
        lowest, above = np.zeros(len(q), dtype=np.int64), np.full(len(q), self.bits + 1)
        lo, hi = self.ranges(q, lowest)
        while (above - lowest > 1).any():
            level = (lowest + above) // 2
            a, b = self.ranges(q, level)
            enough = (b - a).sum(axis=1) >= hits
            lo[enough], hi[enough], lowest[enough] = a[enough], b[enough], level[enough]
            above[~enough] = np.maximum(level, 1)[~enough]
        trees = np.arange(q.shape[1]) * self.rows
        for a, b in zip(lo, hi, strict=True):
            n = b - a
            ends = np.cumsum(n)
            places = np.repeat(trees + a - (ends - n), n) + np.arange(ends[-1])
            yield np.bincount(self.order[places], minlength=self.rows)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(rows: np.ndarray, lengths: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows with these norms, each row's computed alike wherever it stands."""
    return (rows * q).sum(axis=1) / (lengths * np.sqrt((q * q).sum()))


def scored_rows(votes: np.ndarray, scored: int) -> np.ndarray:
    """The rows with most votes, `scored` and those that tie with the last; rows without votes are none."""
    least = 1 if len(votes) <= scored else max(1, np.partition(votes, len(votes) - scored)[len(votes) - scored])
    return np.flatnonzero(votes >= least)


def best(own: Segment, ids: np.ndarray, x: np.ndarray, numbers: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int, hits: float = HITS, share: float = SCORED_SHARE) -> pd.DataFrame:
    """Each (numbered) query's k nearest scored rows of one segment that reach its floor; rows of its id are left out."""
    out, trees, lengths = [], len(own.sorted), norms(x)
    # enough for k rows beside the query's own, and a share of the segment
    most = max(math.ceil(hits * len(x)), trees * (k + 1))
    for i, votes in enumerate(own.votes(hash_strings(q, trees, own.bits), most)):
        rows = scored_rows(votes, max(math.ceil(share * len(x)), SCORED_ROWS, k + 1))
        rows = rows[ids[rows] != query_ids[i]]
        score = cosines(x[rows], lengths[rows], q[i])
        keep = score >= floors[i]
        if keep.sum() > k:  # ties with the k-th stay until the ids decide
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[keep], score[keep]
        at = np.lexsort((ids[rows], -score))[:k]
        out.append(pd.DataFrame({"q": numbers[i], "vec_id": ids[rows][at], "score": score[at]}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the vectors that take part: id not null, no null or non-finite component, not zero."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", hits: float = HITS, share: float = SCORED_SHARE, trees: int = TREES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of `vectors` found, its own id left out.

    Nearest first by cosine, ties to the smaller id. Vectors null, zero, or with null or non-finite
    components, and those without id, take no part; vectors meet those of their own length only. Each
    of several rows with one id is a candidate. Queries of one id and one vector are one query; those of one id and
    different vectors are several, each with ranks of its own from 1, and none finds rows of that id. Empty tables give no
    rows; other columns are not used. With share=1 and hits=trees every row is scored, and the result is exact.
    """
    spark, held = vectors.sparkSession, []
    rows = usable(vectors, key, vector)
    # numbered once: the numbers are read back, never made again
    asked = written(usable(queries, key, vector).distinct().withColumn("q", F.monotonically_increasing_id()), "asked", held)
    segments = max(1, math.ceil(rows.count() / segment_rows))
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(segments)), F.lit(segments)).alias("segment"))
    first = math.ceil(math.sqrt(segments))
    search = lambda part, n, path: _searched(part.repartition(n, "dim", "segment"), path, k, hits, share, trees)
    path = _queries(asked.withColumn("floor", F.lit(-2.0)), held)
    found = written(_ranked(search(dealt.filter(F.col("segment") < first), first, path), k), "found", held)
    if first < segments:
        floors = found.filter(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        path = _queries(asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), held)
        rest = search(dealt.filter(F.col("segment") >= first), segments - first, path)
        found = _ranked(rest.unionByName(found.drop("rank")), k)
    out = written(found.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score"), "nearest")
    delete(spark, held)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _queries(asked: DataFrame, held: list[str]) -> str:
    """q, id, v, floor of the queries, written for every task to read."""
    asked.select("q", "id", "v", "floor").write.parquet(path := scratch(asked.sparkSession, "queries"))
    held.append(path)
    return path


def _blocks(path: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, ids, vectors and floors of the queries of one length, up to QUERY_ROWS at a time."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(base)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(QUERY_ROWS):
                    v = batch.column("v")
                    own = np.flatnonzero(v.value_lengths().to_numpy() == dim)
                    if len(own):
                        yield batch.column("q").to_numpy()[own], batch.column("id").to_numpy()[own], v.take(own).flatten().to_numpy().reshape(-1, dim), batch.column("floor").to_numpy()[own]


def _searched(dealt: DataFrame, path: str, k: int, hits: float, share: float, trees: int) -> DataFrame:
    """q, vec_id, score: what each segment returns. A task holds one segment at a time and a block of queries."""

    def searched(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts)
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["v"].to_list())
        own = Segment(x, trees)
        for numbers, query_ids, q, floors in _blocks(path, x.shape[1]):
            yield best(own, ids, x, numbers, query_ids, q, floors, k, hits, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, at = [], None
        for pdf in batches:
            for group, part in pdf.groupby(["dim", "segment"], sort=False):
                if at not in (None, group):
                    yield from searched(parts)
                    parts = []
                parts.append(part)
                at = group
        if parts:
            yield from searched(parts)

    return dealt.sortWithinPartitions("dim", "segment", "id").mapInPandas(run, "q long, vec_id long, score double")
