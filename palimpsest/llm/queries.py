"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import toxicity

    got = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import sharding

    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import quality

    got = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def secret_key(spark: SparkSession) -> str:
    """The key of surrogates in spark.palimpsest.surrogates.key. Where it is unset the queries take one that anybody can
    read here, so that they can be run and compared; it protects nothing, and real data needs a key of its own."""
    return spark.conf.get("spark.palimpsest.surrogates.key", None) or "for comparison only"


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import pii

    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_toxicity, op3_packing, op4_sharding, op5_quality_rules, op6_perspectives, op7_byte_bpe, op8_simhash,
        op9_neighbours, op10_surrogates)
}
#: The others hash, learn or iterate beyond what DuckDB has; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op6_perspectives": chat.ORACLE}
