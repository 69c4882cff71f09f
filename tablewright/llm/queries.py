"""The queries of the corpus operators over the driver's tables: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, huffman, licenses, near_dup, oracle, secrets, suffix_dedup, token_counts, topk, toxicity
from .common import scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), budget=2048)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    huffman.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), end_id=0)
    return huffman.read_ids(spark, path)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_top_k, op4_toxicity, op5_decontaminate, op6_jaccard_join, op7_licenses, op8_bpe_codec, op9_token_files, op10_secrets)}

#: The others need a library, a trained model, rules of their own, or too many strings for SQL.
ORACLE_SQL: dict[str, str] = {"op3_top_k": oracle.TOP_K, "op5_decontaminate": oracle.DECONTAMINATE, "op6_jaccard_join": oracle.JACCARD, "op10_secrets": oracle.SECRETS}
