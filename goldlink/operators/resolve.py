"""Entity resolution: records that share an e-mail or a phone number, directly or through others, are one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldlink.functions.text import strip
from goldlink.operators.components import connected_components
from goldlink.plans.scratch import materialize


def match_keys(records: DataFrame) -> DataFrame:
    """record_id, key_type, key: one row for each non-blank key of a record."""
    lists = F.array(
        F.struct(F.lit("email").alias("key_type"), F.col("emails").alias("keys")),
        F.struct(F.lit("phone").alias("key_type"), F.col("phones").alias("keys")),
    )
    rows = records.select("record_id", F.explode(lists).alias("k")).select("record_id", "k.key_type", F.explode("k.keys").alias("raw"))
    return rows.select("record_id", "key_type", F.lower(strip(F.col("raw"))).alias("key")).where("key <> ''").distinct()


def star_edges(records: DataFrame) -> DataFrame:
    """src, dst: every record with the smallest record that has the same key; linear in the keys, whatever their sharing.

    The smallest record of each key is aggregated with map-side combine and written out; joined back, both sides are
    exchanges, so the rows of a key that very many records share can be split over tasks.
    """
    keys = materialize(match_keys(records), "match-keys")
    hubs = materialize(keys.groupBy("key_type", "key").agg(F.min("record_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "match-hubs")
    return keys.join(hubs, ["key_type", "key"]).where("record_id <> hub").select(F.col("record_id").alias("src"), F.col("hub").alias("dst")).distinct()


def resolve_entities(records: DataFrame) -> DataFrame:
    """``records`` with cluster_id, the smallest record_id of the entity; records without keys stand alone."""
    found = connected_components(star_edges(records))
    named = found.select(F.col("node").alias("record_id"), F.col("component").alias("cluster_id"))
    joined = records.drop("cluster_id").join(named, "record_id", "left")
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", "record_id"))
