"""The corpus pipeline: good text, once, without benchmark passages and secrets, as tokens.

Each stage reads the rows that its predecessor wrote. All but the last return the columns of
``documents``; the operators define the odd cases (nulls, repeated rows, empty tables).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colscope.llm import bpe, decontaminate, neardup, resampling, secret_scan
from colscope.llm.common import save


def importance_resampling(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the importance sample takes; the others are rejected."""
    return resampling.resample(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def secret_removal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    ratios = secret_scan.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return secret_scan.redact(docs, ratios)


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256`` of all documents."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).selectExpr(
        "doc_id", "CAST(octet_length(ids) / 4 AS LONG) AS n_tokens", "ids AS token_ids",
        "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256",
    )


STAGES = [
    ("importance_resampling", importance_resampling),
    ("minhash_neardup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_removal", secret_removal),
    ("byte_bpe", byte_bpe),
]
#: Models, similarity joins and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
