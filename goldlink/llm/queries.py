"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldlink.llm import bpe, chat, hamming, licenses, mixing, near_text, near_vectors, quality, sharding, suffix
from goldlink.plans.workers import ship


def _over(table: str, operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(ship(spark).read.parquet(f"{sf_dir}/{table}.parquet"))

    return query


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ship(spark).read
    return quality.op9_quality(read.parquet(f"{sf_dir}/documents.parquet"), read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_sharding": _over("documents", sharding.op1_sharding),
    "op2_chat": _over("conversations", chat.op2_chat),
    "op3_suffix": _over("documents", suffix.op3_suffix),
    "op4_bpe": _over("documents", bpe.op4_bpe),
    "op5_licenses": _over("documents", licenses.op5_licenses),
    "op6_mixing": _over("documents", mixing.op6_mixing),
    "op7_near_duplicates": _over("documents", near_text.op7_near_duplicates),
    "op8_near_vectors": _over("embeddings", near_vectors.op8_near_vectors),
    "op9_quality": op9_quality,
    "op10_hamming_top_k": _over("embeddings", hamming.op10_hamming_top_k),
}

ORACLE_SQL = {"op2_chat": chat.OP2_SQL, "op7_near_duplicates": near_text.OP7_SQL, "op8_near_vectors": near_vectors.OP8_SQL, "op10_hamming_top_k": hamming.OP10_SQL}
