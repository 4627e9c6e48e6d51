"""Byte-level BPE in Spark higher-order functions.

Merges are folded over the byte arrays of distinct words with a literal rank map. A count over all
words picks the most frequent, at most KEPT_WORDS by construction; each is folded once, and their
codes are broadcast to a pass over the documents, so no text is shuffled. Words that are not kept, a
few in a hundred, and very long ones are folded in that pass: in higher-order functions that cost several times
the CPU seconds allowed (README). Decoding concatenates binary pieces.

The rank map is kept by pairs of ids: the merge of ids a and b has the rank of the token whose bytes
are those of a and b together. A literal array of small buckets stands in for a hash table, as Spark
searches a map entry by entry.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import bind, delete, slices, written

#: Bounds of the broadcast codes of frequent words: how many, bytes of a word, and bytes of all codes,
#: taken as CODE_BYTES for each byte of a word (ids as decimals, the word, the bytes decoded) and WORD_BYTES.
KEPT_WORDS = 1 << 19
LONGEST_KEPT = 64
KEPT_BYTES = 128 << 20
CODE_BYTES, WORD_BYTES = 9, 40
#: Words of more bytes are folded with a heap.
LONG_WORD = 256
#: Buckets of the literal rank map, about 7 pairs in each.
PAIR_BUCKETS = 1 << 14
#: Words whose codes a task keeps at hand as objects.
TASK_WORDS = 100_000


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: token bytes by id."""

    tokens: tuple[bytes, ...]

    @property
    def by_bytes(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Ranks:
    """The ranks in a file of lines: base64 of a token, blank, rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return Ranks(tuple(ranks[i] for i in range(len(ranks))))


def pair_bucket(a: Column, b: Column) -> Column:
    return F.pmod(a * 31 + b * 1009, F.lit(PAIR_BUCKETS))


@lru_cache(maxsize=4)
def _pair_json(ranks: Ranks) -> str:
    ids = ranks.by_bytes
    buckets: list[tuple[list[int], list[int]]] = [([], []) for _ in range(PAIR_BUCKETS)]
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                own = buckets[(a * 31 + b * 1009) % PAIR_BUCKETS]
                own[0].append(a << 20 | b)
                own[1].append(rank)
    return json.dumps([{"k": k, "v": v} for k, v in buckets], separators=(",", ":"))


def pair_map(ranks: Ranks) -> Column:
    """The literal rank map: bucket -> pairs of ids and the rank of their merge."""
    return F.from_json(F.lit(_pair_json(ranks)), "array<struct<k:array<bigint>,v:array<int>>>")


def pair_rank(pairs: Column, a: Column, b: Column) -> Column:
    """The rank of the merge of a and b; null if there is none or either is null."""
    own = F.get(pairs, pair_bucket(a, b))
    return F.get(own["v"], F.array_position(own["k"], a.cast("bigint") * (1 << 20) + b).cast("int") - 1)


def fold_word(word: Column, pairs: Column, byte_ids: Column) -> Column:
    """Ids of one binary word: always the lowest rank is merged, leftmost first, till none is left."""
    first = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(byte_ids, F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")))

    def merge(s: Column, _: Column) -> Column:
        ids, ranks = s["ids"], s["ranks"]

        def at(m: Column) -> Column:
            return F.when(m.isNull(), s).otherwise(bind(F.array_position(ranks, m).cast("int"), lambda p: replaced(m, p)))

        def replaced(m: Column, p: Column) -> Column:
            before = F.when(p > 1, F.array(pair_rank(pairs, F.get(ids, p - 2), m))).otherwise(F.array().cast("array<int>"))
            n = F.size(ids)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, n)).alias("ids"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), before, F.array(pair_rank(pairs, m, F.get(ids, p + 1))), F.slice(ranks, p + 2, n)).alias("ranks"),
            )

        return bind(F.array_min(ranks), at)

    def fold(ids: Column) -> Column:
        ranks = F.transform(ids, lambda x, i: pair_rank(pairs, x, F.get(ids, i + 1)))
        return F.aggregate(ids, F.struct(ids.alias("ids"), ranks.alias("ranks")), merge)["ids"]

    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(bind(first, fold))


def byte_ids(ranks: Ranks) -> Column:
    """The id of each single byte, a literal array of 256."""
    ids = ranks.by_bytes
    return F.from_json(F.lit(json.dumps([ids[bytes([b])] for b in range(256)])), "array<int>")


def token_pieces(ranks: Ranks) -> Column:
    """The bytes of each id in hexadecimal, a literal array."""
    return F.from_json(F.lit(json.dumps([t.hex() for t in ranks.tokens])), "array<string>")


def decode_with(ids: Column, pieces: Column) -> Column:
    """Binary: the pieces of ids, concatenated (as hexadecimal, which joins in one pass)."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of an array of ids; null ids are skipped, an id out of range gives none, null gives null."""
    return bind(token_pieces(ranks), lambda p: decode_with(ids, p))


def words_of(text: Column, pattern: str) -> Column:
    """All matches of a tokenizer's pattern, white space as in Unicode; null is empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def encode_words(words: DataFrame, ranks: Ranks) -> DataFrame:
    """word -> word, code: <n, ids, bytes>: ids as decimal text, bytes decoded from the ids."""
    tables = F.struct(pair_map(ranks).alias("pairs"), byte_ids(ranks).alias("bytes"), token_pieces(ranks).alias("pieces"))
    return words.select("word", bind(tables, lambda t: code_of(F.col("word"), t)).alias("code"))


def code_of(word: Column, tables: Column) -> Column:
    def code(ids: Column) -> Column:
        return F.struct(F.size(ids).alias("n"), F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"), decode_with(ids, tables["pieces"]).alias("bytes"))

    return bind(fold_word(word.cast("binary"), tables["pairs"], tables["bytes"]), code)


def kept_words(docs: DataFrame, pattern: str, ranks: Ranks, text: str = "text", most: int = KEPT_WORDS) -> tuple[DataFrame, list[str]]:
    """(word, code; paths to delete after use) of the most frequent distinct words of the whole table, folded once each.

    Words are kept down to a count chosen from a histogram of counts so that at most `most` are, and
    their codes fit KEPT_BYTES; words longer than LONGEST_KEPT bytes aren't. The count table goes again.
    """
    held: list[str] = []
    counts = written(docs.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words", held)
    short = counts.filter(F.octet_length("word") <= LONGEST_KEPT)
    size = F.octet_length("word") * CODE_BYTES + WORD_BYTES
    bins = short.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum(size).alias("bytes"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    words, size, least = 0, 0, None
    for b in bins:
        words, size = words + b["words"], size + b["bytes"]
        if words > most or size > KEPT_BYTES:
            break
        least = b["least"]
    frequent = short.filter(F.col("n") >= least) if least is not None else short.limit(0)
    return encode_words(frequent.select("word"), ranks), held


#: A rank over all ranks: no merge.
NONE = 1 << 40


class RareWords:
    """The same fold in Python for words that aren't kept, with the codes found so far in this task, kept ones too."""

    def __init__(self, ranks: Ranks):
        ids = self.ids = ranks.by_bytes
        self.tokens = ranks.tokens
        self.merges = {(ids[t[:c]], ids[t[c:]]): r for t, r in ids.items() for c in range(1, len(t)) if t[:c] in ids and t[c:] in ids}
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.found: dict[str, tuple[int, str, bytes]] = {}

    def code(self, word: str, kept: KeptCodes | None = None) -> tuple[int, str, bytes]:
        own = self.found.get(word)
        if own is None:
            if len(self.found) >= TASK_WORDS:
                self.found.clear()
            own = kept.code(word) if kept else None
            if own is None:
                ids = self.fold([self.bytes[b] for b in word.encode("utf-8", "surrogatepass")])
                own = len(ids), " ".join(map(str, ids)), b"".join([self.tokens[i] for i in ids])
            self.found[word] = own
        return own

    def fold(self, ids: list[int]) -> list[int]:
        if len(ids) > LONG_WORD:
            return self.fold_long(ids)
        get, ids = self.merges.get, list(ids)
        ranks = [get(p, NONE) for p in pairwise(ids)]
        while ranks and (low := min(ranks)) != NONE:
            k = ranks.index(low)  # the leftmost
            ids[k : k + 2] = [low]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((low, ids[k + 1]), NONE)
            if k:
                ranks[k - 1] = get((ids[k - 1], low), NONE)
        return ids

    def fold_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of <rank, place>, in n log n steps: places stay, the next one of each is kept."""
        get, n = self.merges.get, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, p in enumerate(pairwise(ids)) if (r := get(p)) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            # out of date: the place was merged away, or its pair is another by now
            if ids[k] < 0 or (right := after[k]) >= n or get((ids[k], ids[right])) != rank:
                continue
            ids[k], ids[right], after[k] = rank, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := get((rank, ids[after[k]]))) is not None:
                    heappush(heap, (r, k))
            if before[k] >= 0 and (r := get((ids[before[k]], rank))) is not None:
                heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def _rare(ranks: Ranks) -> RareWords:
    """One per vocabulary and Python worker."""
    return RareWords(ranks)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words and codes as one piece of compressed Arrow bytes."""
    if own := [b for b in batches if b.num_rows]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in own:
                out.write_batch(b)
        yield pa.RecordBatch.from_pydict({"part": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _packed(words: DataFrame) -> list[bytes]:
    """Words and their codes, packed where they are made: the driver passes compressed bytes on, no objects."""
    return [bytes(r[0]) for r in words.select("word", "code.*").mapInArrow(_pack, "part binary").collect()]


class KeptCodes:
    """Codes of the kept words in one buffer a column, found by sorted hashes: a dict of them takes several times the memory.

    Made once per task, so that an idle Python worker doesn't keep them.
    """

    def __init__(self, parts: list[bytes]):
        batches = [b for part in parts for b in pa.ipc.open_stream(part)]
        hashes = np.fromiter((hash(w) for b in batches for own in slices(b.column("word").cast(pa.binary()), 4096) for w in own.to_pylist()), np.int64)
        order = np.argsort(hashes)
        self.hashes, self.at = array("q", hashes[order].tobytes()), array("i", order.astype(np.int32).tobytes())
        self.n = array("i", b"".join([b.column("n").to_numpy().astype(np.int32).tobytes() for b in batches]))
        self.words, self.ids, self.bytes = (_flat([b.column(c).cast(pa.binary()) for b in batches]) for c in ("word", "ids", "bytes"))
        del batches
        pa.default_memory_pool().release_unused()

    def code(self, word: str) -> tuple[int, str, bytes] | None:
        own = word.encode("utf-8", "surrogatepass")
        hashes, k = self.hashes, bisect_left(self.hashes, h := hash(own))
        while k < len(hashes) and hashes[k] == h:
            at = self.at[k]
            ends, words = self.words
            if words[ends[at] : ends[at + 1]] == own:
                (id_ends, ids), (byte_ends, held) = self.ids, self.bytes
                return self.n[at], ids[id_ends[at] : id_ends[at + 1]].decode(), held[byte_ends[at] : byte_ends[at + 1]]
            k += 1
        return None


def _flat(columns: list[pa.BinaryArray]) -> tuple[array, bytes]:
    """(where each value begins and the last ends, all values) of a binary column."""
    if not any(len(c) for c in columns):
        return array("i", [0]), b""
    _, ends, held = pa.concat_arrays(columns).buffers()
    return array("i", ends.to_pybytes()[: 4 * (sum(map(len, columns)) + 1)]), held.to_pybytes()


# The letters and digits of the Latin blocks, and the characters of which texts are that
# need no other table: besides them, white space and punctuation, but no further numerals.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9"}
_OTHER = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u203a]")


def latin_pattern(pattern: str) -> str:
    """A tokenizer's pattern for Latin texts: its letter and digit classes spelled out."""
    out, inside = [], False
    for token in re.findall(r"\\p\{[LN]\}|\\.|\[\^?|\]|.", pattern, re.DOTALL):
        inside = token[0] == "[" or inside and token != "]"
        out.append((LATIN[token] if inside else f"[{LATIN[token]}]") if token in LATIN else token)
    return "".join(out)


@lru_cache(maxsize=4)
def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a tokenizer's pattern in a text; Latin texts by spelled-out classes, which takes half the time."""
    import regex

    every = regex.compile(pattern).findall
    try:
        latin = re.compile(latin_pattern(pattern)).findall
    except re.error:  # something that only the larger library has
        return every
    return lambda text: every(text) if _OTHER.search(text) else latin(text)


def encode(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text", most: int = KEPT_WORDS) -> DataFrame:
    """docs' rows with n_tokens, ids (decimals joined by blanks) and decoded (binary) beside their columns but the text.

    Columns of docs with one of these three names are left out.

    Whole texts are encoded; null and empty ones have no ids. Repeated rows stay. A long run of
    letters is one word and takes time as its length times its logarithm.
    """
    frequent, held = kept_words(docs, pattern, ranks, text, most)
    kept = docs.sparkSession.sparkContext.broadcast(_packed(frequent))
    delete(docs.sparkSession, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, codes, rare = finder(pattern), KeptCodes(kept.value), _rare(ranks)
        get = rare.found.get
        try:
            for batch in batches:
                for part in slices(batch):
                    ns, ids, decoded = [], [], []
                    for t in part.column("__text").to_pylist():
                        own = [get(w) or rare.code(w, codes) for w in find(t)]
                        ns.append(sum([c[0] for c in own]))
                        ids.append(" ".join([c[1] for c in own]))
                        decoded.append(b"".join([c[2] for c in own]))
                    columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "__text"]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ns, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())], names=[*(n for n in part.schema.names if n != "__text"), "n_tokens", "ids", "decoded"])
        finally:
            rare.found.clear()

    rest = [c for c in docs.columns if c not in (text, "n_tokens", "ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(*rest, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    coded = encode(docs.select("doc_id", "text"), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
