"""Two-pass external shuffle of a corpus into shards.

Pass 1 scatters every record by a seeded hash into buckets sized for one task's memory. Pass 2 loads
one bucket at a time, puts it into a canonical order, shuffles it with Fisher-Yates under a generator
seeded by (seed, bucket), and deals the records out. Buckets follow one another in the global
order, so the record at global position p goes to shard p mod n, slot p div n: shard sizes are at most
one apart and slots have no gaps (law ``rows``).

Defined results: a null text has size 1 and is kept; null or repeated keys are kept (rows equal in key
and text share a bucket); an empty input gives an empty output; an input column with the name of an
output column is replaced by the output.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUTS = ("shard", "slot")


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text plus 1; a null text counts as empty."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(1).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n) by the Durstenfeld form of Fisher-Yates."""
    generator = np.random.Generator(np.random.PCG64([seed & 0x7FFFFFFF, bucket]))
    order = np.arange(n)
    if n > 1:
        top = np.arange(n - 1, 0, -1)
        picks = generator.integers(0, top + 1)
        items = order.tolist()
        for i, j in zip(top.tolist(), picks.tolist(), strict=True):
            items[i], items[j] = items[j], items[i]
        order = np.array(items)
    return order


def shuffle_into_shards(
    records: DataFrame,
    n_shards: int = 8,
    seed: int = 20240601,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = 32 << 20,
    min_buckets: int = 64,
) -> DataFrame:
    """All records with ``shard`` (int) and ``slot`` (long) in a seeded uniform order.

    ``bucket_bytes`` bounds what one task holds; ``min_buckets`` keeps small inputs parallel. The driver
    holds one count for each bucket: 8 bytes for every ``bucket_bytes`` of input.
    """
    body = records.drop(*OUTPUTS)
    names = body.columns
    total = records.agg(F.sum(record_size(text))).first()[0] or 0
    n_buckets = max(min_buckets, math.ceil(total / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    scattered = body.select(
        F.pmod(place, F.lit(n_buckets)).cast("int").alias("__bucket"), place.alias("__place"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    )
    counts = np.zeros(n_buckets + 1, dtype=np.int64)
    for bucket, n in scattered.groupBy("__bucket").count().collect():
        counts[bucket + 1] = n
    starts = np.cumsum(counts)[:-1]

    def deal(key_values: tuple, table: pa.Table) -> pa.Table:
        bucket = key_values[0].as_py()
        canonical = np.argsort(table.column("__place").to_numpy(), kind="stable")
        order = canonical[fisher_yates(len(canonical), seed, bucket)]
        at = int(starts[bucket]) + np.arange(len(order), dtype=np.int64)
        # arrow offsets are 32 bits a chunk: combine only within a bucket, which is far smaller
        return pa.table({"__row": table.column("__row").combine_chunks().take(pa.array(order)), "shard": pa.array((at % n_shards).astype(np.int32)), "slot": pa.array(at // n_shards)})

    schema = T.StructType([T.StructField("__row", scattered.schema["__row"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # a partition for each bucket on average, so that tasks do not grow with the input
    dealt = scattered.repartition(n_buckets, "__bucket").groupBy("__bucket").applyInArrow(deal, schema)
    return dealt.select("__row.*", "shard", "slot") if names else dealt.select("shard", "slot")


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Shuffle and write one folder of Parquet for each shard, rows in slot order within a file."""
    dealt = shuffle_into_shards(records, **options)
    dealt.repartition("shard", (F.col("slot") / 65536).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(documents: DataFrame) -> DataFrame:
    """The digest columns of the shuffled documents."""
    dealt = shuffle_into_shards(documents.select("doc_id", "text"))
    return dealt.select(
        "doc_id",
        record_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
