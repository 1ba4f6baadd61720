"""The corpus pipeline: STAGES over documents, each written as Parquet and read again for the next.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of documents. What a stage rejects goes; nothing else does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontaminate, quality_rules, secrets, simhash
from foliant.llm.common import documents, shared_path
from foliant.llm.queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass policy v1. Measurements travel beside the row, so no join is needed."""
    return quality_rules.filter_rows(docs, "v1")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the least id, then the least hash of its text. Rows with one id and different texts are different documents."""
    return simhash.keep_one(docs)


def keep_without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded_ok (the ids decode to the text's very bytes) of all documents."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.encode_documents(docs, ranks, pattern, outputs=("token_ids", "decoded_ok"))
    return coded.select("doc_id", "n_tokens", "token_ids", "decoded_ok")


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", keep_without_benchmark),
    ("secret scans", hide_secrets),
    ("byte-level BPE", encode),
]

#: SimHash and BPE can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
