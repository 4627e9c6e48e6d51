"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words,
each of which counts by itself and by its first and last letters; a document's is the noisy-or of its sentences', 1 - prod(1 - p). The weights are fitted from document
labels only, by gradient descent on the likelihood with a share NOISE of labels taken as wrong. The
offending sentences are those whose own score is high.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import delete, slices, written

#: The bound of the labelled sample that a fit reads: documents, by the order of a hash of their id.
SAMPLE_DOCS = 8192
#: Features in fewer toxic sampled documents, or not so many standard deviations more frequent there
#: than chance would have it, get no weight.
MIN_DOCS = 3
MIN_DEVIATION = 4.0
#: Words whose weight a task keeps at hand, and features that it counts before it passes their counts on.
KEPT_WORDS = 100_000
NOISE = 0.03
THRESHOLD = 0.7

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


@dataclass
class ToxicityModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)


def sentence_words(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, length, distinct lower-case words) of each sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        if words := set(WORD.findall(m.group().lower())):
            out.append((m.start(), m.end() - m.start(), words))
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            bags = ["\n".join(" ".join(sorted(w)) for _, _, w in sentence_words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(bags, pa.string())], names=["toxic", "bag"])


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 and endings of 4 and 5 letters where it is longer."""
    n = len(word)
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if n > k), *(f"*{word[-k:]}" for k in (4, 5) if n > k)]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, toxic and all documents that have it, summed over as many documents as KEPT_WORDS features allow."""
    counts: dict[str, list[int]] = {}
    made = lambda: pd.DataFrame({"feature": list(counts), "toxic": [n[0] for n in counts.values()], "docs": [n[1] for n in counts.values()]})
    for pdf in batches:
        for y, bag in zip(pdf["toxic"], pdf["bag"], strict=True):
            for f in {f for w in set(bag.split()) for f in word_features(w)}:
                own = counts.setdefault(f, [0, 0])
                own[0] += y
                own[1] += 1
            if len(counts) >= KEPT_WORDS:
                yield made()
                counts.clear()
    if counts:
        yield made()


def telling_features(bags: DataFrame) -> DataFrame:
    """The features that toxic documents have more often than chance would have it."""
    share = bags.agg(F.avg("toxic")).first()[0] or 0.0
    counts = bags.mapInPandas(_feature_counts, "feature string, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    chance = MIN_DEVIATION * F.sqrt(F.col("docs") * (share * (1 - share)))
    return counts.filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") - F.col("docs") * share >= chance)).select("feature")


def numbered(bag: str, vocab: dict[str, int], kept: dict[str, list[int]]) -> tuple[list[list[int]], list[int], int]:
    """The numbers of the telling features of each sentence that has any, equal ones once; how often each stands; how many have none."""
    told: dict[tuple[int, ...], int] = {}
    plain = 0
    for sentence in bag.split("\n") if bag else []:
        own: list[int] = []
        for w in sentence.split(" "):
            if (known := kept.get(w)) is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                known = kept[w] = [i for f in word_features(w) if (i := vocab.get(f)) is not None]
            own += known
        if own:
            key = tuple(sorted(own))
            told[key] = told.get(key, 0) + 1
        else:
            plain += 1
    return [list(k) for k in told], list(told.values()), plain


def fit_bags(labels: np.ndarray, told: list[list[list[int]]], plain: np.ndarray, features: int, times: list[list[int]] | None = None, steps: int = 200, rate: float = 0.3, ridge: float = 0.02) -> np.ndarray:
    """Weights of the features and, last, the bias, fitted by Adam to 0/1 labels of bags.

    A bag is a list of sentences (feature numbers), how often each stands there (if not given: once),
    and a count of sentences without features.
    """
    doc_of, sent_of, word_of, s = array("q"), array("q"), array("q"), 0
    for d, bag in enumerate(told):
        for sentence in bag:
            doc_of.append(d)
            sent_of.extend([s] * len(sentence))
            word_of.extend(sentence)
            s += 1
    doc, sent, word = (np.array(a, dtype=np.int64) for a in (doc_of, sent_of, word_of))
    often = np.ones(s) if times is None else np.array([n for own in times for n in own], dtype=float)
    y = labels.astype(float)
    x = np.zeros(features + 1)
    x[-1] = -6.0
    m, v, k = np.zeros_like(x), np.zeros_like(x), 1 - 2 * NOISE
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(sent, weights=x[word], minlength=s)
        clean = np.exp(-np.bincount(doc, weights=often * _softplus(z), minlength=len(y)) - plain * _softplus(x[-1]))  # prod(1 - p)
        slope = np.where(y > 0, k * clean / (NOISE + k * (1 - clean)), -k * clean / (NOISE + k * clean))
        g_z = -often * slope[doc] / (1.0 + np.exp(-z))
        g_plain = -(slope * plain).sum() / (1.0 + np.exp(-x[-1]))
        g = np.append(np.bincount(word, weights=g_z[sent], minlength=features), g_z.sum() + g_plain)
        g[:-1] += ridge * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 50)
    return x


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit from document labels.

    Reads at most `sample_docs` labelled texts (those whose ids have the least hashes), whole: a text for each id, label and
    text, however often rows or labels repeat, and the bound holds after labels and documents have met. Null labels and ids, and
    labels other than 0 and 1, take no part. No usable label, or no toxic one: a model that scores all 0.
    """
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    # the least ids first, so that the labels are as few before texts are hashed; then one row per text, no more than the bound
    chosen = chosen.distinct().join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_docs)
    held: list[str] = []
    chosen = written(chosen, "labels", held)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    met = docs.select("doc_id", sha.alias("sha")).join(F.broadcast(chosen), "doc_id").distinct()
    met = written(met.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "sha").limit(sample_docs), "texts", held)
    # of equal rows one: their texts are the same
    texts = docs.select("doc_id", "text", sha.alias("sha")).join(F.broadcast(met), ["doc_id", "sha"]).groupBy("doc_id", "sha", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    bags = written(texts.select("toxic", "text").mapInArrow(_bags, "toxic int, bag string"), "bags", held)
    vocab = {r[0]: i for i, r in enumerate(telling_features(bags).orderBy("feature").collect())}
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[int]] = {}
        for pdf in batches:
            rows = [numbered(b, shared.value, kept) for b in pdf["bag"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "told": [r[0] for r in rows], "times": [r[1] for r in rows], "plain": [r[2] for r in rows]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.itertuples(index=False)]
        y = np.array([r.toxic for r in rows], dtype=int)
        if y.any():
            x = fit_bags(y, [r.told for r in rows], np.array([r.plain for r in rows], dtype=float), len(shared.value), [r.times for r in rows])
            yield pd.DataFrame({"feature": [*shared.value, BIAS], "weight": x})

    # what the bounded sample tells, equal sentences of a document once, meets in one task; the driver gets the weights only
    small = bags.mapInPandas(told, "toxic int, told array<array<int>>, times array<int>, plain long")
    weights = small.repartition(1).sortWithinPartitions("toxic", "plain", "told", "times").mapInPandas(fitted, "feature string, weight double").toPandas()
    delete(docs.sparkSession, held)
    model = dict(zip(weights["feature"], weights["weight"].astype(float), strict=True))
    return ToxicityModel(model.pop(BIAS), model) if BIAS in model else ToxicityModel()


#: The name of the bias among the fitted weights: no feature holds a blank.
BIAS = " bias"


def score_text(text: str | None, model: ToxicityModel, kept: dict[str, float] | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of a text's sentences, and those with a score of half or more. kept: words' weights so far."""
    kept = {} if kept is None else kept
    clean, spans, at_base = 0.0, [], float(_softplus(np.array(model.bias)))
    for start, length, words in sentence_words(text):
        z = model.bias
        for w in words:
            own = kept.get(w)
            if own is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                own = kept[w] = sum(model.weights.get(f, 0.0) for f in word_features(w))
            z += own
        if z == model.bias:
            clean += at_base
            continue
        clean += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        if z >= 0:
            spans.append((start, length, 1.0 / (1.0 + math.exp(-z))))
    return -math.expm1(-clean), spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted, and sentences: <start, length, score> (code points) of offending ones.

    Every whole text is scored, in batches; null and empty texts have 0. A row for each row of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = shared.value, {}
        for batch in batches:
            for part in slices(batch):
                found = [score_text(t, own, kept) for t in part.column("text").to_pylist()]
                spans = [[{"start": a, "length": b, "score": c} for a, b, c in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, SPANS)], names=["key", "score", "sentences"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, sentences array<struct<start:int,length:int,score:double>>")
    return out.select(F.col("key").alias(key), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "sentences")


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the labels whose id's CRC-32 modulo 3 isn't 1."""
    model = fit(docs, labels.filter(remainder() != 1))
    return score(docs, model).select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores `threshold` or more: a filter, no join; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, kept = shared.value, {}
        for a in batches:
            yield pa.array([score_text(t, own, kept)[0] for part in slices(a) for t in part.to_pylist()], pa.float64())

    return docs.filter(scored(F.col(text)) < threshold)
