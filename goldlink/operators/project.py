"""Projection of profiles into the shape that a config describes; rows may differ in their keys, so the output is JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.operators.score import is_empty
from goldlink.plans.policy import FieldProjection, ProjectionConfig
from goldlink.plans.schema import VALUE

_KEEP_NULLS = {"ignoreNullFields": "false"}


def missing(field: str) -> Column:
    return is_empty(F.col(field)["value"], field) if field in VALUE else F.lit(True)


def entry(p: FieldProjection) -> Column:
    """The value, or value with confidence and provenance where they are asked for."""
    field = F.col(p.source_field)
    if not (p.include_confidence or p.include_provenance):
        return field["value"]
    parts = [field["value"].alias("value")]
    if p.include_confidence:
        parts.append(field["confidence"].alias("confidence"))
    if p.include_provenance:
        parts.append(field["provenance"].alias("provenance"))
    return F.struct(*parts)


def _json(value: Column, kind: str) -> Column:
    """JSON text of any value; wrapped and unwrapped, as only structs, maps and arrays can be written."""
    text = F.to_json(F.struct(value.alias("v")), _KEEP_NULLS)
    return F.substr(text, F.lit(6), F.length(text) - 6)


def outputs(config: ProjectionConfig) -> list[FieldProjection]:
    """Projections by output name; a repeated name keeps its first place and takes its last definition."""
    last: dict[str, FieldProjection] = {}
    for p in config.fields:
        last[p.output_field] = p
    return list(last.values())


def _member(name: str, text: Column) -> Column:
    quoted = F.to_json(F.struct(F.lit(name).alias("v")))
    key = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    return F.concat(key, F.lit(":"), text)


def project(profiles: DataFrame, config: ProjectionConfig, sources_failed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles with ``output``, a JSON object in the config's order; rejects with profile_id and message).

    Rejects are rows only under ``on_missing = error``: profiles that lack a projected field, with the first one named.
    """
    members = []
    for p in outputs(config):
        if p.source_field not in VALUE:
            text = F.lit("null")
        else:
            text = F.when(missing(p.source_field), F.lit("null")).otherwise(_json(entry(p), p.source_field))
        member = _member(p.output_field, text)
        members.append(F.when(~missing(p.source_field), member) if config.on_missing == "omit" else member)
    if config.include_overall_confidence:
        members.append(_member("overall_confidence", F.col("overall_confidence").cast("string")))
    if config.include_metadata:
        failed = F.array(*[F.lit(x) for x in sources_failed or []]).cast("array<string>")
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        about = F.struct("profile_id", "sources_used", failed.alias("sources_failed"), stamp.alias("merge_timestamp"))
        members.append(_member("_metadata", F.to_json(about, _KEEP_NULLS)))
    body = F.array_join(F.array_compact(F.array(*members)), ",")
    done = profiles.withColumn("output", F.concat(F.lit("{"), body, F.lit("}")))
    lacks = F.lit(None).cast("string")
    if config.on_missing == "error":
        for p in reversed(config.fields):
            note = f"Required field '{p.source_field}' (projected as '{p.output_field}') is missing."
            lacks = F.when(missing(p.source_field), F.lit(note)).otherwise(lacks)
    judged = done.withColumn("__lacks", lacks)
    return judged.where("__lacks is null").drop("__lacks"), judged.where("__lacks is not null").select("profile_id", F.col("__lacks").alias("message"))
