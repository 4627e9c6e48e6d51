"""A corpus pipeline of four stages over documents: toxicity, near-duplicates, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import bpe, mixing, neardup, toxicity
from spanmill.llm.common import written
from spanmill.plans.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted from the labels of all documents given, doesn't reject.

    Rows without id are scored too; columns and repeated rows stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id; of rows equal in id and text one.

    Rows of one id with different texts are one document and stay. Rows without id are compared with
    none, but of those with one text one stays; a null text is as an empty one.
    """
    gone = neardup.near_duplicates(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    repeated = docs.filter("doc_id IS NOT NULL").select("doc_id", sha.alias("sha")).groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id").distinct()
    # lists of ids, written: their size says whether they are broadcast, and then no text is shuffled
    gone, repeated = written(gone, "gone"), written(repeated, "repeated")
    once = docs.filter("doc_id IS NOT NULL").join(gone.unionByName(repeated), "doc_id", "left_anti")
    again = docs.join(repeated.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"])
    nameless = docs.filter("doc_id IS NULL").withColumn("__sha", sha).dropDuplicates(["__sha"])
    return once.select(docs.columns).unionByName(again.select(docs.columns)).unionByName(nameless.select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's words that the mix takes, repeated where it takes them twice."""
    return mixing.mixed_texts(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimals joined by blanks), decodes: whether they decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    checked = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = bpe.encode(checked, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("__sha")).alias("decodes"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode_texts)]

#: Toxicity is a fitted model, the mix is pseudorandom: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
