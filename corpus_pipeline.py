"""The corpus pipeline: quality filter, near-duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of ``documents``; what a stage decides is applied to the rows it returns, row by row, also where
ids repeat or are null. An empty input passes through. A stage's table goes once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldlink.llm import bpe, mixing, near_text, quality, suffix
from goldlink.plans.scratch import discard_since, materialize, tables
from goldlink.plans.workers import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Co-trained classifier, fitted on the labels of the documents given; rejected documents go."""
    model = quality.fit(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs.select(*COLUMNS), model).where("quality_keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 of five-word shingles, one row stays; blank texts stay."""
    ship(spark)
    return near_text.deduplicate(docs.select(*COLUMNS))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 100-byte strings that start earlier are cut out of the texts."""
    ship(spark)
    return suffix.remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document that the weighted mix takes."""
    return mixing.mixed_rows(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    ship(spark)
    read = bpe.encode_column(docs.select(*COLUMNS), check="decodes")
    return read.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "decodes")


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("source mixing", source_mix),
    ("byte-level bpe", tokens),
]

#: No SQL expresses these stages; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table that the next one reads."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    started = tables()
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
            discard_since(started, keep=docs)
    return docs
