"""The operators' queries over the driver tables, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import bpe, chat, fingerprint, forest, licenses, mixing, neardup, repair, runs, sharding, simhash, toxicity, warc
from spanmill.llm.common import scratch
from spanmill.plans.session import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contents(sharding.arrive(table(spark, sf_dir, "documents"), "doc_id", scratch(spark, "shards")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_repeats(table(spark, sf_dir, "documents"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), "present"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_chat_format": op2_chat_format, "op3_toxicity": op3_toxicity, "op4_nearest": op4_nearest, "op5_byte_bpe": op5_byte_bpe, "op6_warc": op6_warc, "op7_mixing": op7_mixing, "op8_sharding": op8_sharding, "op9_licenses": op9_licenses, "op10_near_duplicates": op10_near_duplicates, "op11_runs": op11_runs, "op12_repair": op12_repair, "op13_simhash": op13_simhash}

#: Where SQL can express a query.
SQL: dict[str, str] = {"op2_chat_format": chat.SQL, "op6_warc": warc.SQL, "op8_sharding": sharding.SQL, "op12_repair": repair.SQL}
