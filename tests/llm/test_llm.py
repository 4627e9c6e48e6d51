"""The operators against plain Python, and their edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import io
import itertools
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.llm import bpe, chat, fingerprint, forest, licenses, mixing, neardup, sharding, toxicity, warc
from spanmill.llm.common import scratch
from spanmill.llm.queries import QUERIES, SQL
from spanmill.plans.session import table
from tests.compare import DATA, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "lo") for b in ("ra", "ste", "min", "tol", "ver")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def odd_texts():
    rng = random.Random(0)
    return ["", None, "a", "same text here", "same text here", "\U0001f600 \x00 <|im_end|> é" * 3, "x" * 5000, prose(rng, 3000)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name])


# 1


def test_fingerprints_by_brute_force(spark):
    texts = [r["text"] or "" for r in table(spark, DATA, "documents").orderBy("doc_id").collect()]
    rows = QUERIES["op1_fingerprints"](spark, DATA).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for k, (t, r) in enumerate(zip(texts, rows, strict=True)):
        cut, after = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[: len(t) - cut] + after[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.digest(t) and r["edited_fingerprint"] == fingerprint.digest(edited)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.3


def test_fingerprint_edge_cases(spark):
    docs = documents(spark, odd_texts()).withColumn("fp", F.lit("clash")).withColumn("next_text", F.lit(1))
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert len(rows) == 8 and rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[3]["fingerprint"] == rows[4]["fingerprint"]
    assert rows[0]["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(docs.limit(0)).collect() == []
    only = fingerprint.edited_fingerprints(documents(spark, ["abcdefgh"])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprint.edited_fingerprints(documents(spark, ["a b c", "d e f", "d e f"], [None, None, 1])).count() == 3
    assert fingerprint.digest("x" * (fingerprint.SLICE * 2 + 5))[2:] != fingerprint.digest("")[2:]


def test_digest_by_its_definition():
    rng = random.Random(12)
    for n in (0, 2, 3, 40, 3000):
        text = "".join(rng.choice("abc déf") for _ in range(n))
        data, counts = text.encode(), [0] * 512
        for k in range(len(data)):
            for number, (i, j) in enumerate(((1, 2), (1, 3), (2, 3)), 1):
                if k + j < len(data):
                    h = (data[k] + (data[k + i] << 8) + (data[k + j] << 16) + (number << 24)) * 2654435761 & 0xFFFFFFFF
                    h = (h ^ h >> 15) * 2246822519 & 0xFFFFFFFF
                    counts[h >> 23] += 1
        q1, q2, q3 = (sorted(counts)[k] for k in (127, 255, 383))
        codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
        packed = bytes(sum(codes[4 * k + b] << 2 * b for b in range(4)) for k in range(128))
        head = bytes([min(255, int(8 * math.log2(len(data) + 1))), q1 * 15 // max(q3, 1) << 4 | q2 * 15 // max(q3, 1)])
        assert fingerprint.digest(text) == (head + packed).hex()


def test_likeness_by_its_definition():
    import pandas as pd

    rng = random.Random(13)
    digests = [fingerprint.digest(prose(rng, n)) for n in (0, 30, 400, 400)]
    for a, b in itertools.product(digests, repeat=2):
        x, y = bytes.fromhex(a), bytes.fromhex(b)
        apart = sum((0, 1, 2, 6)[abs((p >> s & 3) - (q >> s & 3))] for p, q in zip(x[2:], y[2:], strict=True) for s in (0, 2, 4, 6))
        apart += abs(x[0] - y[0]) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
        assert fingerprint.likeness_of(pd.Series([a]), pd.Series([b]))[0] == pytest.approx(max(0, 1 - apart / 1024))


def test_long_text_is_counted_whole_across_slices(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = fingerprint.bucket_counts(data)
    monkeypatch.setattr(fingerprint, "SLICE", 64)
    assert (fingerprint.bucket_counts(data) == whole).all()


def test_last_triplet_is_counted(monkeypatch):
    assert fingerprint.bucket_counts(b"abc").sum() == 1 and fingerprint.bucket_counts(b"ab").sum() == 0
    assert fingerprint.digest("abc") != fingerprint.digest("xyz")
    monkeypatch.setattr(fingerprint, "SLICE", 4)
    for n in range(3, 20):  # adjacent triplets at n - 2 places, the others at n - 3
        assert fingerprint.bucket_counts(bytes(range(n))).sum() == 3 * n - 8


# 2

CONV = "conv_id long, turn long, role string, text string, extra string, blocks int"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi", "x", 1), (1, 1, "user", "there <|im_sep|> &amp; <|", "x", 1), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nno", "x", 1), (1, 3, "assistant", "", "x", 1),
        (2, 5, None, None, "x", 1), (2, None, "a\nb<|", "&lt;|", "x", 1), (3, 1, "assistant", "é" * 5, None, 1), (3, 1, "assistant", "é" * 5, None, 1), (None, 0, "user", "z", "x", 1),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, CONV))
    read = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse_chats(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in read[1]["t"]] == [r[2:4] for r in rows[:4]]
    assert read[1]["loss"] == rows[2][3] and read[1]["formatted"].count(chat.START) == 2
    assert [tuple(t) for t in read[2]["t"]] == [("a\nb<|", "&lt;|"), ("", "")]
    assert len(read[3]["t"]) == 2 and read[3]["loss"] == "é" * 10 and None in read
    assert chat.format_chats(spark.createDataFrame([], CONV)).collect() == []


def test_long_conversation_of_one_role(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5000 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    r = chat.chat_digests(chat.format_chats(turns)).first()
    assert time.time() - began < 30
    own = [f"é<|{i}" for i in range(n) if i % 5000]
    assert r["n_turns"] == n and r["loss_chars"] == sum(map(len, own)) and r["loss_sha256"] == hashlib.sha256("".join(own).encode()).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, 2, 5, 16, 17, 1000):
        rng = random.Random(n)
        lengths = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(lengths,)], "l array<int>").select(chat.running(F.col("l")).alias("r")).first()["r"]
        assert got == list(itertools.accumulate(lengths, initial=0))[:-1]


def test_probe_conversation(spark):
    r = chat.chat_digests(chat.format_chats(chat.with_probe(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).first()
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()


# 3


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        sentences = [prose(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 12))]
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k] + " " + rng.choice(["vilest", "scoundrel", "rotten"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out_and_spans(spark):
    texts, labels = toxic_corpus(900)
    docs = documents(spark, texts)
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.held_out_scores(docs, lab).collect()}
    import zlib

    held = [i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in rows)
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.97
    model = toxicity.fit(docs, lab)
    found = toxicity.score(docs, model).filter("predicted = 1").limit(5).collect()
    for r in found:
        assert any(w in texts[r["doc_id"]][s["start"] : s["start"] + s["length"]] for s in r["sentences"] for w in ("vilest", "scoundrel", "rotten"))


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(120):
        sentences = [prose(rng, 3) for _ in range(2500 if i < 12 else 3)]
        if i % 2:
            sentences[-1] += " vilest"
        texts.append(". ".join(sentences))
        labels.append(i % 2)
    docs = documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == labels


def test_bags_by_brute_force():
    rng = np.random.default_rng(4)
    told = [[rng.integers(0, 5, rng.integers(1, 4)).tolist() for _ in range(rng.integers(0, 4))] for _ in range(40)]
    plain, y = rng.integers(0, 3, 40).astype(float), rng.integers(0, 2, 40)
    # a sentence without features is as one with a feature of no effect
    fitted = toxicity.fit_bags(y, told, plain, 5, steps=20)
    spelled = [bag + [[5]] * int(n) for bag, n in zip(told, plain, strict=True)]
    x = np.zeros(6)
    x[-1] = -6.0
    m, v, k = np.zeros(6), np.zeros(6), 1 - 2 * toxicity.NOISE
    for step in range(1, 21):
        g = np.zeros(6)
        for label, bag in zip(y, spelled, strict=True):
            z = [x[-1] + sum(x[i] for i in s if i < 5) for s in bag]
            clean = math.prod(1 / (1 + math.exp(t)) for t in z)
            slope = k * clean / (toxicity.NOISE + k * (1 - clean)) if label else -k * clean / (toxicity.NOISE + k * clean)
            for s, t in zip(bag, z, strict=True):
                for i in [*(i for i in s if i < 5), 5]:
                    g[i] -= slope / (1 + math.exp(-t))
        g[:-1] += 0.02 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 50)
    assert fitted == pytest.approx(x)


def test_equal_sentences_count_as_often_as_they_stand():
    vocab = {"bad": 0, "worse": 1}
    told, times, plain = toxicity.numbered("bad x\nbad y\nworse\nz", vocab, {})
    assert (told, times, plain) == ([[0], [1]], [2, 1], 1)
    y, one = np.array([1, 0]), np.array([1.0, 2.0])
    spelled = toxicity.fit_bags(y, [[[0], [0], [1]], [[1]]], one, 2, steps=30)
    assert toxicity.fit_bags(y, [[[0], [1]], [[1]]], one, 2, [[2, 1], [1]], steps=30) == pytest.approx(spelled)


def test_noisy_or(spark):
    model = toxicity.ToxicityModel(-2.0, {"bad": 3.0})
    p, q = 1 / (1 + math.exp(-1.0)), 1 / (1 + math.exp(2.0))
    score, spans = toxicity.score_text("A bad one. Fine here.", model)
    assert score == pytest.approx(1 - (1 - p) * (1 - q)) and [s[:2] for s in spans] == [(0, 9)]
    assert toxicity.score_text("", model) == (0.0, []) and toxicity.score_text(None, model)[0] == 0.0


def test_toxicity_edge_cases(spark):
    docs = documents(spark, odd_texts(), [0, 1, 2, 3, 3, None, 6, 7]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.held_out_scores(docs, none).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    odd = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 1), (7, 5)], "doc_id long, toxic int")
    assert toxicity.held_out_scores(docs, odd).count() == 8
    assert toxicity.held_out_scores(docs.limit(0), none).count() == 0


def test_toxicity_fit_is_bounded_after_the_join(spark, monkeypatch):
    """10^5 rows of one labelled id, equal or not, and repeated labels: no more texts are fitted than the bound."""
    fitted = []
    whole = toxicity.telling_features
    monkeypatch.setattr(toxicity, "telling_features", lambda bags: (fitted.append(bags.count()), whole(bags))[1])
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    rows = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a vile text.")).otherwise(F.lit("a kind text.")).alias("text"))
    toxicity.fit(rows, labels)
    toxicity.fit(rows.withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string"))), labels, sample_docs=50)
    assert fitted == [2, 50]


# 4


def test_forest_queries_of_one_id(spark):
    """Equal queries are one, others of one id have lists of their own; the exact way finds every neighbour."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    first, other = [float(c) for c in x[3]], [float(c) for c in x[90]]
    asked = spark.createDataFrame([(5, first), (5, first), (5, other)] * 1000 + [(6, other)], "vec_id long, embedding array<double>")
    got = forest.nearest(df, asked, k=4, segment_rows=200, share=1.0, hits=float(forest.TREES)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == sorted([(5, k) for k in range(1, 5)] * 2 + [(6, k) for k in range(1, 5)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q, at in ((5, 3), (5, 90), (6, 90)):
        s = unit @ unit[at]
        s[q] = -9
        want += [(q, k + 1, int(v)) for k, v in enumerate(np.argsort(-s, kind="stable")[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(want)


def test_forest_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 48))
    x[10] = x[20] * 3
    x[50] = x[55]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = forest.nearest(df, df.filter("vec_id % 50 = 0"), segment_rows=1000).collect()
    x = np.array([[np.float32(c) for c in v] for v in x], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        assert all(abs(s[v] - z) < 1e-9 for _, v, z in own)
        s[q] = -9
        hits += len({v for _, v, _ in own} & set(np.argsort(-s)[:5].tolist()))
    assert hits / (60 * 5) >= 0.9
    assert next(r["vec_id"] for r in got if r["query_id"] == 50 and r["rank"] == 1) == 55


def test_forest_recall_on_the_table(spark):
    vectors = table(spark, os.path.join(os.path.dirname(DATA), "sf0.1"), "embeddings")
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for segment_rows in (8192, 300):  # in one round and in two, with floors
        found = defaultdict(set)
        for r in forest.nearest(vectors, vectors.filter("vec_id % 50 = 0"), segment_rows=segment_rows).collect():
            found[r["query_id"]].add(r["vec_id"])
        kept = []
        for q in np.flatnonzero(ids % 50 == 0):
            s = unit @ unit[q]
            s[q] = -9
            kept.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:5]])) / 5)
        assert len(kept) == 40 and np.mean(kept) >= 0.9


def test_few_rows_are_scored():
    x = np.random.default_rng(3).standard_normal((3000, 64))
    own = forest.Segment(x)
    votes = list(own.votes(forest.hash_strings(x[:20]), 2 * len(x)))
    assert all(v[i] == forest.TREES for i, v in enumerate(votes))
    assert np.mean([len(forest.scored_rows(v, 450)) for v in votes]) < 0.25 * len(x)
    # equal rows have equal votes, and all of them are scored
    same = np.concatenate([np.repeat(x[:1], 1500, axis=0), x[:1500]])
    (v,) = forest.Segment(same).votes(forest.hash_strings(x[:1]), 6000)
    assert len(forest.scored_rows(v, 450)) >= 1500


def test_votes_by_brute_force():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((70, 8)), rng.standard_normal((9, 8))
    keys, asked = forest.hash_strings(x, 11, 12), forest.hash_strings(q, 11, 12)
    spelled = lambda v: [f"{int(k):012b}" for k in v]
    for hits in (1, 40, 300, 10**6):
        for own, v in zip(asked, forest.Segment(x, 11, 12).votes(asked, hits), strict=True):
            for level in range(12, -1, -1):
                want = [sum(a[:level] == b[:level] for a, b in zip(spelled(own), spelled(row), strict=True)) for row in keys]
                if sum(want) >= hits or level == 0:
                    break
            assert v.tolist() == want


def test_forest_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("segment", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in forest.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert forest.nearest(df.limit(0), df.limit(0)).collect() == []


# 5


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.by_bytes, special_tokens={})


def test_bpe_equals_the_library(spark, vocabulary):
    ranks, pattern, own = vocabulary
    texts = [*odd_texts(), "don't we'll I'VE  \n\n  x  y 123,456 ½ 漢字 ñandú" * 2, "\n" * 300, " " * 301, "e" * 700]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in bpe.encode(docs, ranks, pattern, most=20).collect()}
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert rows[i]["ids"] == " ".join(map(str, want)) and rows[i]["n_tokens"] == len(want)
        assert bytes(rows[i]["decoded"]) == (t or "").encode()
    assert bpe.encode(docs.limit(0), ranks, pattern).count() == 0


def test_folds_agree(spark, vocabulary):
    ranks, _, own = vocabulary
    rng = random.Random(4)
    words = ["", *("".join(rng.choice("aeirstnh é漢") for _ in range(rng.randint(1, 14))) for _ in range(80))]
    got = {r["word"]: r["code"] for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string").distinct(), ranks).collect()}
    rare = bpe.RareWords(ranks)
    for w in words:
        want = rare.code(w)
        assert want[1] == " ".join(map(str, own._core_bpe.encode_single_piece(w.encode()) if w else []))
        assert (got[w]["n"], got[w]["ids"], bytes(got[w]["bytes"])) == want and want[2] == w.encode()


def test_long_words_and_byte_bounds(spark, vocabulary, monkeypatch):
    ranks, pattern, own = vocabulary
    rng = random.Random(8)
    rare = bpe.RareWords(ranks)
    for n in (300, 2000, 20_000):
        word = "".join(rng.choice("aeirstnh") for _ in range(n))
        assert rare.code(word)[1] == " ".join(map(str, own._core_bpe.encode_single_piece(word.encode())))
    began = time.time()
    rare.fold([ranks.by_bytes[b"a"]] * 300_000)
    assert time.time() - began < 20
    docs = documents(spark, ["x" * 5000 + " the the the cat", "y" * 100, "the cat sat"])
    words = lambda: {r["word"] for r in bpe.kept_words(docs, pattern, ranks)[0].collect()}
    assert max(map(len, words())) <= bpe.LONGEST_KEPT
    monkeypatch.setattr(bpe, "KEPT_BYTES", 2 * (4 * bpe.CODE_BYTES + bpe.WORD_BYTES))
    assert words() == {" the", " cat"}


def test_kept_codes_are_held_flat(vocabulary):
    import tracemalloc

    words = [f"{'é' if k % 7 == 0 else ' w'}{k}" for k in range(60_000)]
    codes = {w: (k % 9, f"{k} {k + 1}", w.encode()) for k, w in enumerate(words)}
    batches = [pa.RecordBatch.from_pydict({"word": own, **{c: [codes[w][i] for w in own] for i, c in enumerate(("n", "ids", "bytes"))}}) for own in (words[:20_000], words[20_000:20_001], words[20_001:])]
    parts = [r for b in batches for r in next(bpe._pack(iter([b]))).column("part").to_pylist()]
    tracemalloc.start()
    held = bpe.KeptCodes(parts)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 100 * len(words)  # as a dict of tuples: over 300 bytes each
    assert all(held.code(w) == codes[w] for w in words)
    assert held.code("w0") is None and bpe.KeptCodes([]).code("w0") is None
    rare = bpe.RareWords(vocabulary[0])
    assert rare.code(words[5], held) == codes[words[5]] and rare.code("w0", held) == bpe.RareWords(vocabulary[0]).code("w0")


def test_latin_texts_are_cut_alike(vocabulary):
    import regex

    _, pattern, _ = vocabulary
    every, find = regex.compile(pattern).findall, bpe.finder(pattern)
    latin = re.compile(bpe.latin_pattern(pattern)).findall
    safe = [chr(c) for c in range(0x2100) if not bpe._OTHER.search(chr(c))]
    assert len(safe) > 500
    rng = random.Random(15)
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice([safe, " \n'ab1.é", "'stremdlv \xa0"])) for _ in range(rng.randint(0, 30)))
        assert latin(text) == every(text) == find(text)
    for c in map(chr, range(0x3100)):  # any character beside a letter, a digit and a blank
        text = f"a{c}b 1{c} {c}."
        assert find(text) == every(text)


def test_decode(spark, vocabulary):
    ranks, _, own = vocabulary
    ids = own.encode_ordinary("héllo wörld\n")
    df = spark.createDataFrame([(ids,), ([],), (None,)], "ids array<int>")
    got = [r["b"] for r in df.select(bpe.decode(F.col("ids"), ranks).alias("b")).collect()]
    assert bytes(got[0]) == "héllo wörld\n".encode() and bytes(got[1]) == b"" and got[2] is None


# 6


def test_archives_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 20000
    pages = [(0, "u", None), (1, "u", ""), (2, "u\r\nX: y", "short"), (3, None, "short"), (4, "u", big), (5, "u", big), (6, "u", "z" * 100), (7, "u", "z" * 100), (8, "u", "z" * 99), (9, "u", "z" * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("data", F.lit(1)).withColumn("record_id", F.lit("clash"))
    rows = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(rows) == 10
    for i, _, html in pages:
        data = (html or "").encode()
        assert rows[i]["payload_bytes"] == len(data) and rows[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert {i: rows[i]["refers_to"] for i in rows if rows[i]["record_type"] == "revisit"} == {5: 4, 7: 6}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_hold_null_and_repeated_ids(spark):
    big, long = "<p>é" * 40_000, "z" * 150
    pages = [(None, "a", big), (None, "b", big), (None, None, None), (None, "a", "short"), (3, "a", big), (3, "b", big), (3, "a", big), (3, "c", long), (2, "d", long), (2, "d", long), (7, "e", big), (7, "e", big), (7, "f", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = min((j for j, _, h in pages if h == html and j is not None), default=None) if len(data) >= 100 else None
        revisit = None not in (i, to) and to < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in [*held, "spark.sql.autoBroadcastJoinThreshold"]}
    try:
        for threshold in ("-1", "10m"):  # revisits joined by a shuffle and by a broadcast
            for k, v in (held | {"spark.sql.autoBroadcastJoinThreshold": threshold}).items():
                spark.conf.set(k, v)
            assert sorted(map(str, map(tuple, warc.round_trip(df).collect()))) == sorted(map(str, want))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_parse_reads_in_any_block_size():
    head = {"record_id": 3, "url": "u", "digest": hashlib.sha256(b"ab\r\n").hexdigest(), "bytes": 4, "refers_to": None}
    http = warc._http(head)
    data = (warc._header("response", head, len(http) + 4) + http + b"ab\r\n\r\n\r\n") * 2
    for block in (1, 2, 3, 7, 10_000):
        assert [r["bytes"] for r in warc.parse(io.BytesIO(data), block)] == [4, 4]


def test_chunks_are_small(spark):
    df = spark.createDataFrame([(1, "u", "a" * 1000), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    rows = warc.chunked(df, chunk_bytes=64).orderBy("rec", "chunk_no").collect()
    assert [r["chunk_no"] for r in rows] == [*range(-1, 16), -1, 0] and max(len(warc.inflated(r["data"])) for r in rows if r["data"] is not None) == 64
    for k, r in enumerate(rows[1:17]):  # digests and sizes run along
        assert r["bytes"] == min(1000, 64 * (k + 1))
        assert r["digest"] == hashlib.sha256(b"a" * r["bytes"]).hexdigest()
    assert b"".join(warc.inflated(r["data"]) for r in rows[1:17]) == b"a" * 1000
    assert (rows[0]["bytes"], rows[0]["digest"], rows[0]["url"]) == (1000, rows[16]["digest"], "u")
    assert (rows[17]["bytes"], rows[17]["record_id"], rows[17]["url"]) == (0, None, "")


def test_archives_roll_and_are_read_in_a_task_each(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "u", prose(rng, 800)) for i in range(40)], "page_id long, url string, html string").repartition(3)
    table = scratch(spark, "chunks")
    warc.chunked(df).write.parquet(table)
    rows, folder = spark.read.parquet(table), scratch(spark, "archives")
    manifest = warc.write_archives(warc.placed(rows, warc.revisits(rows)), folder, archive_bytes=4000)
    n = manifest.count()
    read = warc.read_archives(manifest, folder)
    assert n > 4 and manifest.agg(F.sum("records")).first()[0] == 40
    assert {r["page_id"] for r in read.collect()} == set(range(40))
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == n
    import gzip

    path = manifest.first()["path"]
    with gzip.open(path) as f:
        assert f.read(8) == b"WARC/1.1"


# 7


def water_fill(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if most * sizes[s] < level * w[s] or most * sizes[s] == level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_targets(spark):
    for seed in range(6):
        rng = random.Random(seed)
        sizes = {f"s{i}": rng.choice([0, 3, 50, 400, 9000]) for i in range(rng.randint(1, 9))} | ({None: 70} if seed % 2 else {})
        df = spark.createDataFrame([(f"s{s}" if s is not None else "n", s, n) for s, n in sizes.items()], "key string, source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water_fill(sizes)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_permutations(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select("id", mixing.shuffled(F.col("id"), F.lit(n), F.lit(5)).alias("p")).select("id", "p", mixing.unshuffled(F.col("p"), F.lit(n), F.lit(5)).alias("back"))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_mix_of_documents(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 900)) for _ in range(240)] + [None, "", "dup dup", "dup dup"]
    docs = spark.createDataFrame([(i, t, ["a", "b", "c", None][i % 4 if i < 120 else 0], "k") for i, t in enumerate(texts)], "doc_id long, text string, source string, key string")
    rows = mixing.taken_words(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()))
    assert len(rows) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    want = water_fill({s: sum(r["size"] for r in rows if source[r["doc_id"]] == s) for s in set(source.values())})
    for s, t in want.items():
        own = [r for r in rows if source[r["doc_id"]] == s]
        assert all(r["target"] == pytest.approx(t) for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= 2 * mixing.BLOCK_WORDS
    mixed = mixing.mixed_texts(docs).collect()
    taken = {r["doc_id"]: r["taken"] for r in rows}
    assert all(len((r["text"] or "").split()) == taken[r["doc_id"]] for r in mixed) and len(mixed) >= len(texts) - sum(t == 0 for t in taken.values())
    assert mixing.taken_words(docs.limit(0)).collect() == [] and mixing.mixed_texts(docs.limit(0)).collect() == []


def test_shards_draw_their_counts(spark):
    sizes = {"sa": 5000, "sb": 70_000, "n": 64, "sc": 0}
    df = spark.createDataFrame([(k, k, n, 1.5 * n) for k, n in sizes.items()], "key string, source string, source_size long, target double")
    counted = mixing.block_counts(df)
    own = {r["key"]: r for r in counted.collect()}
    drawn = mixing.shard_counts(counted, 3, shard_slots=100).cache()
    counts = defaultdict(Counter)
    for r in drawn.collect():
        counts[r["shard"]][r["key"]] = r["n"]
    total = sum(r["slots"] for r in own.values())
    # every shard is full but for the last, and the sources' totals are met
    assert [sum(counts[k].values()) for k in sorted(counts)] == [100] * (total // 100) + ([total % 100] if total % 100 else [])
    assert {k: sum(c[k] for c in counts.values()) for k in sizes} == {k: r["slots"] for k, r in own.items()}
    # the draws vary as multinomial ones do
    share = own["sa"]["slots"] / total
    draws = [counts[k]["sa"] for k in sorted(counts)[:-1]]
    assert np.mean(draws) == pytest.approx(100 * share, abs=2) and 0.4 < np.var(draws) / (100 * share * (1 - share)) < 2.2
    # the slots of each shard are as many as drawn; a pass takes each block once
    rows = mixing.slots(drawn, counted, 3).collect()
    assert Counter((r["shard"], r["key"]) for r in rows) == {(k, s): n for k, c in counts.items() for s, n in c.items()}
    assert max(Counter((r["key"], r["pass"], r["index"]) for r in rows).values()) == 1
    assert all(0 <= r["index"] < own[r["key"]]["blocks"] and r["pass"] < 2 for r in rows)


def test_mix_works_each_permutation_once(spark):
    docs = documents(spark, ["a b c", "d e"])
    plan = mixing.taken_words(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") <= 1  # that of the index; the other made the draws, which are written


def test_mixed_text_keeps_its_spacing(spark):
    docs = spark.createDataFrame([(1, "a  b\n\nc\td ", "s", 10)], "doc_id long, text string, source string, n_chars int")
    r = mixing.mixed_texts(docs).first()
    assert r["text"] in ("a  b\n\nc\td", "a  b\n\nc\td\na  b\n\nc\td") and r["n_chars"] == len(r["text"])


# 8


def test_compaction(spark):
    held = sharding.ShardSet(spark, scratch(spark, "shards"), documents(spark, ["a"]).schema, target_bytes=1 << 20, smallest_bytes=1 << 10, fan_in=2)
    assert held.read().count() == 0 and held.compact() == 0
    for k in range(6):
        held.append(documents(spark, [f"t{k}", None, "same"], [k, None, 7]))
        held.compact()
    assert held.read().count() == 18
    tiers = Counter(r.tier for r in held.runs())
    assert max(tiers.values()) < 2
    at = held.version()
    with pytest.raises(FileExistsError):
        held.commit(held.runs(), at - 1)
    assert held.version() == at


def test_versions_stay_readable_until_they_expire(spark):
    held = sharding.ShardSet(spark, scratch(spark, "shards"), documents(spark, ["a"]).schema, smallest_bytes=1 << 10, fan_in=2)
    for k in range(3):
        held.append(documents(spark, [f"t{k}"], [k]))
    at, old = held.version(), held.read()
    assert held.compact() > at
    assert sorted(r["doc_id"] for r in old.collect()) == [0, 1, 2] and held.read(1).count() == 1 and held.read(at).count() == 3
    spark.range(3).write.parquet(f"{held.root}/run-crashed")
    assert held.expire(keep=held.version() - at + 1) == [] and old.count() == 3
    gone = held.expire(keep=1, orphan_seconds=0)
    assert len(gone) == 4 and any(g.endswith("run-crashed") for g in gone)
    assert held.read().count() == 3 and held.versions() == [held.version()]
    with pytest.raises(ValueError):
        held.read(at)


def test_two_writers(spark, monkeypatch):
    root, schema = scratch(spark, "shards"), documents(spark, ["a"]).schema
    one, two = (sharding.ShardSet(spark, root, schema, smallest_bytes=1 << 10, fan_in=2) for _ in range(2))
    commit, late = one.commit, [True]

    def raced(runs, after):  # the other writer commits between this one's reading and its commit
        if late:
            late.clear()
            two.append(documents(spark, ["b"], [2]))
        return commit(runs, after)

    monkeypatch.setattr(one, "commit", raced)
    assert one.append(documents(spark, ["a"], [1])) == 2
    assert sorted(r["doc_id"] for r in one.read().collect()) == [1, 2]
    late.append(True)
    one.compact()
    two.compact()
    assert sorted(r["doc_id"] for r in two.read().collect()) == [1, 2, 2] and len(two.runs()) < 3


def test_arrivals_hold_all_rows(spark):
    docs = documents(spark, odd_texts(), [0, 1, 2, 3, 3, None, 6, 7])
    held = sharding.arrive(docs, "doc_id", scratch(spark, "shards"), arrivals=5, smallest_bytes=1 << 10)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(held.read()) == key(docs)
    assert sharding.arrive(docs.limit(0), "doc_id", scratch(spark, "shards")).read().count() == 0


# 9


def test_licenses_by_brute_force(spark):
    texts = [*odd_texts(), "Under the MIT license. under  the-mit license! xunder the mit license under the mit licenses", "APACHE LICENSE VERSION 2 cc by nc, cc-by-nc sa", "under the mit license" * 2, "İ ÀPACHE license version 2"]
    rows = {r["doc_id"]: r for r in licenses.license_labels(documents(spark, texts).withColumn("base", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert rows[i]["n_words"] == len(words) and rows[i]["n_base"] == len(places)
        assert rows[i]["first_word"] == (places[0][0] if places else None) and rows[i]["last_word"] == (places[-1][0] if places else None)
        assert rows[i]["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, rows[i]["base_labels"].split(","))) <= set(rows[i]["labels"].split(",")) and 0 <= rows[i]["score"] <= 1
    assert licenses.license_labels(documents(spark, texts).limit(0)).count() == 0


def test_license_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    labels = lambda t: [r.label for _, _, r in licenses.detections(t)]
    assert labels("SPDX-License-Identifier: GPL-2.0-only") == ["gpl-2"]
    assert labels("Distributed under the BSD 3-Clause license") == ["bsd-3-clause"]
    assert set(labels("Licensed under CC BY-NC-SA 4.0")) == {"cc-by-nc-sa"}
    assert labels("Mozilla Public License 2.0") == ["mpl-2"] and labels("limit the permit") == []


def test_license_suppression_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        rules = [licenses.Rule(f"r{k}", rng.choice("abc"), rng.randint(1, 4), 1.0, frozenset(), "") for k in range(8)]
        found = [(s, s + rng.randint(1, 12), rng.choice(rules)) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        kept = []
        for a, b, r in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
            if not any(c <= a and b <= d or r.label == o.label and a < d and c < b for c, d, o in kept):
                kept.append((a, b, r))
        assert licenses.unsuppressed(found) == sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def test_license_scan_is_linear():
    began = time.time()
    assert len(licenses.detections("mit license and bsd 3 clause license, " * 10_000)) == 20_000
    assert licenses.base_places("under the mit license " * 40_000)[0] == 160_000
    assert time.time() - began < 20


def test_license_rules_are_linear_on_what_parts_words():
    """Every rule, begun at each of its words, over 100,000 characters of underscores, blanks and mixtures of both with words."""
    assert licenses.detections("mit released " + "_" * 100_000 + " x") == [] == licenses.detections("no part of this book may be reproduced " + "_" * 100_000 + " x permission")
    fillers = ("_", " ", "x_", "_ x")
    for r in licenses.rules():
        plain = r.pattern
        for a, b in ((r"\(\?<!.*?\)", ""), (r"\(\?!.*?\)", ""), (r"\(\?:_\|\[.*?\]\)\+", " "), (r"\[\^?\\W_\][+*]?|\[\^\\w[^]]*\][+*]?", " "), (r"\\.", " ")):
            plain = re.sub(a, b, plain)
        words = re.findall(r"[a-z0-9]+", plain)
        assert words, r.name
        for filler in fillers:
            began = time.time()
            size = 100_000 // (len(words) * len(filler))
            text = " x ".join((filler * 50).join(words[:k]) + " " + filler * size for k in range(1, len(words) + 1))
            list(licenses._compiled(r.pattern).finditer(text))
            assert time.time() - began < 2, (r.name, filler)


def test_license_notices():
    labels = lambda t: {r.label for _, _, r in licenses.detections(t)}
    rules = licenses.rules()
    # every notice is found by its own words, with the gate, and by the label it has
    for line in licenses.NOTICES.strip().splitlines():
        label, _, _, _, pattern = licenses._cells(line)
        said = pattern.replace("[1-4]", "4").replace(r"\d", "0")
        said = re.sub(r"\(\?!.*?\)", "", said)
        said = re.sub(r"\(\?:\\w\+ \)\{\d+,\d+\}\??", "some words ", said)
        while "(?:" in said:
            said = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)\??", r"\1", said)
        said = said.replace(" ?", " ")
        assert label in labels(f"A text.\n{said.upper()}\nMore."), said
    assert all(r.keywords for r in rules)
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software)") == {"mit"}
    assert labels("This program is not licensed under the GPL v3.") == set() and labels("It is no longer distributed under the MIT license.") == set()
    assert labels("It is not good. It is licensed under the GPL v3.") == {"gpl-3"}
    assert labels("admit the account is a disclaimer") == set() and not any(licenses.WHOLE & r.keywords for r in licenses._due("admit the account is a disclaimer, permit"))


def test_license_gate_loses_nothing(monkeypatch):
    names = ["GNU General Public License version 2", "GNU Lesser General Public License v3", "All rights reserved", "Creative Commons Attribution", "SIL Open Font License", "Public Domain Dedication", "Python Software Foundation", "Open Data Commons Database", "European Union Public Licence", "Microsoft Public", "Expat", "ASL 2.0", "do what the fun you want to public license", "Apache License 2.0", "BSD 3-Clause", "CC BY-NC-SA 4.0", "0BSD"]
    forms = ["{}", "Released under the terms of the {} license", "licence: {}", "dual licensed by us as {}", "{} compatible"]
    texts = [sep.join(f.format(n).split(" ")) for n in names for f in forms for sep in (" ", "\n", "  ", "-", "\n * ")] + ["licence: MIT", "Licence = 'GPL-2.0'", '"licence": "0BSD"']
    gated = [licenses.detections(t) for t in texts]
    monkeypatch.setattr(licenses, "_due", lambda low: licenses.rules())
    assert gated == [licenses.detections(t) for t in texts]
    labels = lambda t: {r.label for _, _, r in licenses.detections(t)}
    monkeypatch.undo()
    assert labels("GNU General\nPublic License version 2") == {"gpl-2"} and labels("All rights\nreserved") == {"all-rights-reserved"}
    assert labels("under the Expat license") == {"mit"} and labels("licence: MIT") == {"mit"} and labels("ASL 2.0") == {"apache-2"}


# 10


def shingles(text):
    """Runs of five words, spelled out; a shorter text that has words is one."""
    words = re.findall(r"[^\x00-\x20]+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def classes(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, (t, s) in enumerate(zip(texts, sets, strict=True)):
        where[("t", t or "")].append(i)
        for h in s:
            where[h].append(i)
    for own in where.values():
        for i, j in itertools.combinations(own, 2):
            n = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_near_duplicates_of_a_hot_key(spark):
    """10^5 rows of one key, equal ones and some others: its texts are one document, whose shingles are those of all."""
    rng = random.Random(9)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 1000 == 0, F.lit(two)).otherwise(F.lit(one)).alias("text"))
    rest = spark.createDataFrame([(2, one), (3, three), (4, f"{one} {two}"), (5, two + " more")], "doc_id long, text string")
    found = neardup.near_duplicates(hot.unionByName(rest)).distinct()
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert got[1] == got[2] == got[4] == 1 and got[3] == 3


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    big = [f"{a}{i}" for i in range(60) for a in WORDS]
    base = [[rng.choice(big) for _ in range(rng.randint(20, 150))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 12])):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(big)
            texts.append(" ".join(own))
    texts += [None, "", "one two", "one two", "One  TWO", "x" * 4000]
    docs = documents(spark, texts).withColumn("id", F.lit("clash")).withColumn("bucket", F.lit(0))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    want = classes(texts)
    links = sum(got[i] == want[i] for i in got)
    assert links == len(texts)


def test_near_duplicate_edge_cases(spark):
    docs = documents(spark, ["same words in this text", "same words in this text", "other"], [4, None, 2])
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in neardup.near_duplicates(docs).collect()) == [("2", "2"), ("4", "4"), ("None", "None")]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []
    twice = documents(spark, ["a b c d e f", "a b c d e f", "q r s t u v"], [9, 9, 9])
    assert [r["class_id"] for r in neardup.near_duplicates(twice).collect()] == [9, 9, 9]
    # one key with two texts beside a null key: the shingles of both are compared
    rng = random.Random(9)
    left, right = (" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60)) for _ in range(2))
    mixed = documents(spark, [left, right, left + " more", right + " more", None], [5, 5, 6, 7, None])
    assert {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(mixed).collect()} == {(5, 5), (6, 6), (7, 7), (None, None)}


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 2**63, 60).astype(np.uint64)
    w1, w2 = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    w1[:10], w2[50:] = 0, 0
    a, b = (neardup.prob_minhash(ids[w > 0], w[w > 0], 8192) for w in (w1, w2))
    true = sum(1 / np.maximum(w1 / w1[k], w2 / w2[k]).sum() for k in range(60) if w1[k] and w2[k])
    assert (a == b).mean() == pytest.approx(true, abs=0.03)


def test_near_duplicates_that_repeat_lines(spark):
    rng = random.Random(11)
    word = lambda: f"{rng.choice(WORDS)}{rng.randrange(10**6)}"
    texts = []
    for _ in range(30):  # a line stands 50 times in one text and once in the other, which also has words of its own
        line, rest, own = ([word() for _ in range(n)] for n in (30, 90, 8))
        texts += [" ".join(line * 50 + rest), " ".join(line + rest + own)]
    assert all(set(neardup.sketch(a)) & set(neardup.sketch(b)) for a, b in zip(texts[::2], texts[1::2], strict=True))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    want = classes(texts)
    assert [got[i] for i in range(60)] == want and want == [i // 2 * 2 for i in range(60)]


def test_blocks_join_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "STAR_PART", 2)
    monkeypatch.setattr(neardup, "BUCKET_PART", 5)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    rng = random.Random(2)
    words = [f"{rng.choice(WORDS)}{i}" for i in range(120)]
    texts = []
    for k in range(24):  # a chain: each is near the next, not near those further on
        texts.append(" ".join([f"n{k}x{j}" if j in range(3 * k, 3 * k + 3) else w for j, w in enumerate(words)]))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(24)] == classes(texts)


def test_pairs_in_blocks_by_size(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(14)
    sets = {}
    for i in range(60):  # sizes over several classes, many just at the threshold
        base = set(range(rng.choice([8, 10, 20, 25, 40, 50])))
        sets[i] = base | {1000 * (i + 1) + k for k in range(rng.choice([0, 0, 1, 2]))}
    monkeypatch.setattr(neardup, "BUCKET_PART", 7)
    shared = spark.createDataFrame([(i, 7, 1, len(sets)) for i in sets], "id long, bucket long, popular long, n long")
    rows = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()], "id long, shingles array<long>")

    def tops(pairs):
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    true = [(a, b) for a, b in itertools.combinations(sets, 2) if near(a, b)]
    largest = Counter(tops(true).values()).most_common(1)[0][0]
    group = [i for i, r in tops(true).items() if r == largest]
    for known in ([], group, group[: len(group) // 2]):  # nothing is joined yet; the largest group is; half of it is
        found = spark.createDataFrame([(i, known[0]) for i in known], "id long, root long")
        links = [tuple(r) for r in neardup._across(shared, found, rows, 0.8).collect()]
        assert all(near(a, b) for a, b in links)
        assert tops(links + [(i, known[0]) for i in known]) == tops(true)
        assert not any(a in known and b in known for a, b in links)


# pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts, labels = toxic_corpus(300, 4)
    long = prose(random.Random(8), 400)
    texts += [long, long, long + " extra", None, ""]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = pipeline.drop_toxic(spark, docs, str(tmp_path))
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and sum((i in kept) == (not y) for i, y in enumerate(labels)) >= 290 and {300, 301, 302, 303, 304} <= kept
    unique = pipeline.drop_near_duplicates(spark, clean, str(tmp_path))
    assert {r["doc_id"] for r in unique.filter("doc_id >= 300").collect()} == {300, 303} and unique.columns == docs.columns
    odd = documents(spark, ["one text that stays", "one text that stays", "another of the same id", None, None, "no id", "no id", None], [1, 1, 1, 2, 2, None, None, None])
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, odd, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "one text that stays"), (1, "another of the same id"), (2, None), (None, "no id"), (None, None)], key=str)
    mixed = pipeline.mix_sources(spark, unique, str(tmp_path))
    assert mixed.columns == docs.columns
    coded = pipeline.encode_texts(spark, mixed, str(tmp_path))
    assert coded.filter("NOT decodes").count() == 0 and coded.count() == mixed.count()
    assert pipeline.run(spark, str(tmp_path)).count() == coded.count()
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert pipeline.run(spark, str(empty)).collect() == []
