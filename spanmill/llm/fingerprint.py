"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A digest counts the hashed byte triplets of a text in BUCKETS buckets, writes each
bucket's quartile in two bits, and puts the length (logarithm) and the quartile
ratios before them. likeness() is one minus a bounded difference score.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 512
#: Offsets of the second and third byte of a triplet in a window of four bytes.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
#: Bytes counted at once, so that a very long text needs no more memory than this allows.
SLICE = 1 << 20
#: Difference of two codes: opposite quartiles weigh twice as much.
CODE_DIFFERENCE = np.array([0, 1, 2, 6], dtype=np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    """Occurrences of hashed byte triplets by bucket; the last three bytes, which no window begins, are one too."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(33 - BUCKETS.bit_length())
    for start in range(0, max(len(data) - 2, 0), SLICE):
        b = np.frombuffer(data[start : start + SLICE + 3], dtype=np.uint8).astype(np.uint32)
        for k, (i, j) in enumerate(TRIPLETS):
            n = min(len(b) - j, SLICE)
            h = (b[:n] + (b[i : i + n] << 8) + (b[j : j + n] << 16) + np.uint32((k + 1) << 24)) * np.uint32(2654435761)
            h ^= h >> 15
            h *= np.uint32(2246822519)
            counts += np.bincount(h >> shift, minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """Hexadecimal digest: 2 digits of length, 2 of quartile ratios, then the codes. Null is as empty.

    A text of under three bytes has no triplet: all such texts of one length have one digest.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    q = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    q1, q2, q3 = (int(q[k * BUCKETS // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, int(8 * np.log2(len(data) + 1)))
    ratios = (q1 * 15 // max(q3, 1)) << 4 | (q2 * 15 // max(q3, 1))
    return f"{length:02x}{ratios:02x}{packed.tobytes().hex()}"


def _codes(digests: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(len(digests), -1)
    codes = np.stack([raw[:, 2:] >> s & 3 for s in (0, 2, 4, 6)], axis=2)
    head = np.stack([raw[:, 0], raw[:, 1] >> 4, raw[:, 1] & 15], axis=1)
    return head.astype(np.int64), codes.reshape(len(digests), -1).astype(np.int64)


def likeness_of(a: pd.Series, b: pd.Series) -> np.ndarray:
    """From 0 to 1; equal digests have 1. The difference is bounded by twice the number of buckets."""
    (head_a, codes_a), (head_b, codes_b) = _codes(a), _codes(b)
    apart = CODE_DIFFERENCE[np.abs(codes_a - codes_b)].sum(axis=1)
    apart = apart + np.abs(head_a[:, 0] - head_b[:, 0]) + np.abs(head_a[:, 1:] - head_b[:, 1:]).sum(axis=1)
    return np.maximum(0.0, 1.0 - apart / (2.0 * BUCKETS))


@F.pandas_udf(T.StringType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The digest of each text; null and empty texts have the same."""
    for s in texts:
        yield s.map(digest, na_action=None) if len(s) else pd.Series([], dtype=str)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two digests, 0 to 1; null where either is null."""
    both = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Float64")
    if both.any():
        out[both] = likeness_of(a[both], b[both])
    return out


def with_next(docs: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """docs with the columns of the next row by ascending key (after the last, the first).

    Rows are dealt to ranges of the (integer) key; a copy of the first row of each range goes to the
    range before it too, so that each row finds its successor in its own range. Only a bounded list
    of range limits passes the driver. Null keys come first; rows of equal key follow the order of
    the columns asked for; an only row follows itself. Extra columns stay.
    """
    spark = docs.sparkSession
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    limits = sorted({int(x) for x in limits or []})
    dealt = docs.withColumn("__slot", _below(F.from_json(F.lit(json.dumps(limits)), "array<bigint>"), len(limits), F.col(key)))
    firsts = dealt.groupBy("__slot").agg(F.min(key).alias("lo"), F.count_if(F.col(key).isNull()).alias("nulls")).orderBy("__slot").collect()
    if not firsts:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"{prefix}{c}") for c in columns])
    # a row per range, of which there are at most `parts`: its first key, and the range before it
    told = spark.createDataFrame([(r["__slot"], firsts[i - 1]["__slot"], None if r["nulls"] else r["lo"]) for i, r in enumerate(firsts)], "__slot int, __before int, __lo long")
    copies = (
        dealt.join(F.broadcast(told), "__slot")
        .filter(F.col(key).eqNullSafe(F.col("__lo")))
        .groupBy("__before", key)
        .agg(F.min(F.struct(*columns)).alias("__first"))
        .select(F.col("__before").alias("__slot"), F.lit(True).alias("__halo"), key, *[F.col(f"__first.{c}").alias(c) for c in columns])
    )
    both = dealt.withColumn("__halo", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    w = Window.partitionBy("__slot").orderBy("__halo", F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns])
    out = both.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})
    return out.filter(~F.col("__halo")).drop("__slot", "__halo")


def _below(bounds: Column, n: int, at: Column) -> Column:
    """How many of n sorted bounds are at or below a value (null: 0), by halving."""
    if n == 0:
        return F.lit(0)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def halve(place: Column, step: Column) -> Column:
        return F.when((place + step <= n) & (F.try_element_at(bounds, place + step) <= at), place + step).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's digest beside that of its text edited with the next document's beginning.

    The last floor(n/4) code points are replaced by the first as many (or all) of the next document
    by ascending doc_id. Null texts are empty. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. An only document follows itself; an empty table
    gives no rows; rows of equal doc_id follow each other by text.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the digest follows the row: the window sorts one copy of the texts and needs no second join
    marked = with_next(texts.withColumn("fp", fingerprint("text")), "doc_id", ["text", "fp"])
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - k), F.col("next_text").substr(F.lit(1), k))
    made = marked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"), "next_fp")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fp").alias("near_next"))
