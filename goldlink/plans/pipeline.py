"""The whole run: discover, extract, normalize, resolve, merge, score, project, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from goldlink.functions.normalize import normalize
from goldlink.operators.merge import merge
from goldlink.operators.project import project
from goldlink.operators.resolve import resolve_entities
from goldlink.operators.score import score
from goldlink.operators.validate import validate
from goldlink.plans.policy import EnginePolicy, ProjectionConfig
from goldlink.plans.scratch import materialize
from goldlink.sources import registry


@dataclass
class Run:
    """What a run made: DataFrames stay lazy but for the linkage loop."""

    records: DataFrame
    profiles: DataFrame
    validated: DataFrame
    rejects: DataFrame
    sources: list[str]
    sources_failed: list[str]


def golden_records(records: DataFrame, policy: EnginePolicy = EnginePolicy(), normalized: bool = False, **options) -> DataFrame:
    """Scored profiles of raw records."""
    ready = records if normalized else normalize(records, **options)
    # the linkage loop reads keys several times and the merge reads all: standardize once
    return score(merge(resolve_entities(materialize(ready, "normalized")), policy), policy)


def run(spark: SparkSession, folder: str, config: ProjectionConfig, policy: EnginePolicy = EnginePolicy(), enable_notes: bool = False, strict: bool = False) -> Run:
    sources = registry.discover(spark, folder)
    records, failed = registry.extract(spark, sources, enable_notes)
    profiles = golden_records(records, policy)
    projected, rejects = project(profiles, config, failed)
    return Run(records, profiles, validate(projected, config, strict), rejects, sources, failed)
