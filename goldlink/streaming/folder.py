"""Auto-discovery of source files with Structured Streaming.

The stream only watches for new files. Each micro-batch extracts and standardizes them once, appends the records to a
table, and resolves and merges again what the new records touch: the clusters of the stored records that share a key
with a new one, found by joins on keys. All other profiles stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldlink.functions.normalize import normalize
from goldlink.operators.merge import merge
from goldlink.operators.resolve import match_keys, resolve_entities
from goldlink.operators.score import score
from goldlink.plans.policy import EnginePolicy
from goldlink.sources import registry


def affected(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored records in a cluster that shares a key with a fresh record (columns of ``records``, with cluster_id)."""
    keys = match_keys(fresh).select("key_type", "key").distinct()
    touched = match_keys(records).join(keys, ["key_type", "key"], "left_semi").select("record_id").distinct()
    clusters = records.join(touched, "record_id", "left_semi").select("cluster_id").distinct()
    return records.join(clusters, "cluster_id", "left_semi")


def update(store: DataFrame | None, fresh: DataFrame, policy: EnginePolicy = EnginePolicy()) -> tuple[DataFrame, DataFrame]:
    """(records with cluster_id that replace those of the same record_id, profiles that are new or changed)."""
    group = fresh if store is None else affected(store, fresh).drop("cluster_id").unionByName(fresh)
    resolved = resolve_entities(group)
    return resolved, score(merge(resolved, policy), policy)


def watch(spark: SparkSession, folder: str, state: str, on_profiles: Callable[[DataFrame, int], None], policy: EnginePolicy = EnginePolicy(), enable_notes: bool = False, **trigger) -> StreamingQuery:
    """Start the stream. ``state`` holds the record table (one folder for each version) and the stream's checkpoint.

    ``on_profiles`` gets the changed profiles of each batch; a batch that is run again after a failure replaces its own version.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.*").load(folder).select("path")
    fs = spark._jvm.org.apache.hadoop.fs

    def versions(batch: int) -> list[int]:
        root = fs.Path(f"{state}/records")
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = [int(s.getPath().getName().split("=")[1]) for s in store.listStatus(root) if s.getPath().getName().startswith("v=")]
        return sorted(v for v in found if v < batch)

    def each(batch: DataFrame, number: int) -> None:
        paths = sorted(r[0] for r in batch.distinct().collect() if registry.suffix_of(r[0]) in registry.KNOWN_SUFFIXES)
        if not paths:
            return
        raw, _ = registry.extract(spark, paths, enable_notes)
        old = versions(number)
        store = spark.read.parquet(f"{state}/records/v={old[-1]}") if old else None
        # files are numbered on from the last one stored, so new records come after all earlier ones
        last = store.agg(F.max("record_id")).first()[0] if store is not None else None
        base = 0 if last is None else (last >> registry.FILE_BITS) + 1
        fresh = normalize(raw).withColumn("record_id", F.col("record_id") + F.lit(base << registry.FILE_BITS))
        changed, profiles = update(store, fresh, policy)
        changed = changed.persist()
        table = changed if store is None else store.join(changed.select("record_id"), "record_id", "left_anti").unionByName(changed)
        table.write.mode("overwrite").parquet(f"{state}/records/v={number}")
        on_profiles(profiles, number)
        changed.unpersist()

    return names.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
