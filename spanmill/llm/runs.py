"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch that repeats with a period, several times over, and that no neighbouring word extends. For each
period p, a run of three periods or more holds three neighbouring points of the grid 0, p, 2p, ...; how far the text
from one point agrees with that from the next, forwards and backwards, gives the run's ends. Both extensions are
range minima over the common prefixes of a suffix array, of the words and of the words reversed. The grids of all
periods have n/1 + n/2 + ... points, about n log n. Extensions are asked only where the words at the points, and at
three places between them, agree as they must within a run; a text without such points needs no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bind, slices
from spanmill.llm.words import pieces

#: A run has so many words at least, and so many periods.
WORDS, TIMES = 24, 3
#: Words of texts looked at together, and grid points at once.
TOGETHER, POINTS = 1 << 18, 1 << 21
#: Common prefixes in a block of the range minima.
BLOCK = 16


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and each start's rank: ranks by one word, then by twice as many till all differ."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order, rank
        step *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each suffix in order, how many words it shares with the one before it (the first: 0).

    By text position: what a suffix shares with its neighbour, the next suffix shares but for one word.
    """
    n = len(codes)
    out = np.zeros(n, dtype=np.int32)
    word, place, start = memoryview(np.ascontiguousarray(codes, dtype=np.int64)), memoryview(rank), memoryview(order)
    shared = 0
    for i in range(n):
        r = place[i]
        if not r:
            shared = 0
            continue
        j = start[r - 1]
        most = n - max(i, j)
        while shared < most and word[i + shared] == word[j + shared]:
            shared += 1
        out[r] = shared
        if shared:
            shared -= 1
    return out


class Extensions:
    """How many words two suffixes of a text share, for many pairs at once."""

    def __init__(self, codes: np.ndarray) -> None:
        order, rank = suffix_array(codes)
        shared = common_prefixes(codes, order, rank)
        self.rank = rank
        self.shared = np.concatenate((shared, np.full(-len(shared) % BLOCK, len(codes), dtype=np.int32)))
        blocks = self.shared.reshape(-1, BLOCK)
        # minima from a block's beginning and to its end, and of runs of whole blocks by powers of two
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(blocks):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words shared by the suffixes at i and at j, which differ."""
        ri, rj = self.rank[i], self.rank[j]
        a, b = np.minimum(ri, rj) + 1, np.maximum(ri, rj)
        ba, bb = a // BLOCK, b // BLOCK
        out = np.minimum(self.tail[a], self.head[b])
        one = np.flatnonzero(ba == bb)
        if len(one):
            within = np.minimum(a[one, None] + np.arange(BLOCK), b[one, None])
            out[one] = self.shared[within].min(axis=1)
        width = bb - ba - 1
        for k, row in enumerate(self.table):
            own = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
            if len(own):
                whole = np.minimum(row[ba[own] + 1], row[bb[own] - (1 << k)])
                out[own] = np.minimum(out[own], whole)
        return out.astype(np.int64)


def grid_points(codes: np.ndarray, sizes: np.ndarray, words: int = WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, place in the text) of grid points that may lie in a run; the texts' codes stand one after another."""
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    longest = np.where(sizes >= words, sizes // times, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    # the last point of a period's grid has two more after it
    points = (sizes[text] - 1) // period - 1 if len(text) else text
    total = np.cumsum(points)
    found, at = [], 0
    while at < len(text):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + POINTS, side="right")), at + 1)
        count = points[at:end]
        row = np.repeat(np.arange(at, end), count)
        p = period[row]
        place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * p
        x = begins[text[row]] + place
        kept = np.flatnonzero((codes[x] == codes[x + p]) & (codes[x + p] == codes[x + 2 * p]))
        row, place, x, p = row[kept], place[kept], x[kept], p[kept]
        for quarter in (2, 1, 3):
            y = x + p * quarter // 4
            kept = np.flatnonzero(codes[y] == codes[y + p])
            row, place, x, p = row[kept], place[kept], x[kept], p[kept]
        found.append((text[row], p, place))
        at = end
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs_at(codes: np.ndarray, period: np.ndarray, place: np.ndarray, words: int = WORDS, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs through points of the grids, by start and period, each with its smallest period."""
    n = len(codes)
    forwards, backwards = Extensions(codes), Extensions(codes[::-1])
    ahead = forwards.of(place, place + period)
    behind = np.zeros(len(place), dtype=np.int64)
    inner = np.flatnonzero(place > 0)
    behind[inner] = backwards.of(n - place[inner], n - place[inner] - period[inner])
    start, length = place - behind, period + ahead + behind
    kept = length >= np.maximum(words, times * period)
    # a stretch of three periods that has a smaller period too has it all along: the ends are the same
    rows = np.unique(np.stack([start[kept], length[kept], period[kept]], axis=1), axis=0)
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _coded(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of a text, and the words by number."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words)) for words in pieces(data)]
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)), list(known)


def _collapsed(codes: np.ndarray, names: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, parted by one blank."""
    change = np.zeros(len(codes) + 1, dtype=np.int32)
    if len(runs):
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([names[c] for c in codes[np.cumsum(change)[:-1] == 0].tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(words: int, times: int):
    def together(keys: list[int], texts: list[tuple[np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c, _ in texts], dtype=np.int64)
        text, period, place = grid_points(np.concatenate([c for c, _ in texts]), sizes, words, times)
        runs = {}
        order = np.argsort(text, kind="stable")
        own, begins = np.unique(text[order], return_index=True)
        for k, rows in zip(own.tolist(), np.split(order, begins[1:]), strict=False):
            runs[k] = runs_at(texts[k][0], period[rows], place[rows], words, times)
        none = np.empty((0, 3), dtype=np.int64)
        every = [runs.get(k, none) for k in range(len(texts))]
        flat = np.concatenate(every)
        ends = np.concatenate(([0], np.cumsum([len(r) for r in every])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(RUN)))
        collapsed = pa.array([_collapsed(c, names, runs.get(k, none)) for k, (c, names) in enumerate(texts)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), lists, collapsed], names=["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for key, data in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    keys.append(key)
                    texts.append(_coded(data or b""))
                    held += len(texts[-1][0])
                    if held >= TOGETHER or len(keys) >= 1024:
                        yield together(keys, texts)
                        keys, texts, held = [], [], 0
        if keys:
            yield together(keys, texts)

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, times: int = TIMES) -> DataFrame:
    """key, n_words, runs (array of start, length, period by start and period), collapsed: a row per row of docs.

    Words are stretches without ASCII blanks. A run has a smallest period q and max(words, times * q) words
    at least, times being 3 or more. `collapsed` is the text without what a run repeats: the words that no run holds after its
    first period, parted by one blank; a text without runs keeps all words. Null and empty texts have no
    words. Rows with null key, repeated rows and rows of one key stay, each for itself; other columns are left
    out. An empty table gives no rows. A task holds about TOGETHER words, or one text.
    """
    if times < 3:
        raise ValueError("runs of less than three periods need not hold three points of a grid")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(_found(words, times), "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.withColumnRenamed("key", key)


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with texts that repeat in one row of ten: what finding runs is tried on.

    Of h, the CRC-32 of the key in decimals, and g = floor(h / 10): where h % 10 is 0 and the text has n > 0 words, its
    words from a = g % n on repeat with the period 1 + floor((n - a) / (3 + g % 8)), parted by one blank.
    Other texts, and those of null keys, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)

        def at(a: Column) -> Column:
            p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("int")
            place = F.sequence(F.lit(0), n - 1)
            return F.array_join(F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

        return F.when(n > 0, bind((g % n).cast("int"), at)).otherwise("")

    found = F.expr(rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0)")
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), bind(found, repeated)).otherwise(F.col(text)))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of periodic_runs(): the number of runs, that of most periods, and digests of all runs and of the collapsed text.

    The run of the greatest length / period, compared exactly; ties go to the smallest start, then period. Without runs
    start, length, period and exponent_milli are null.
    """
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    made = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return made.select(key, "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
