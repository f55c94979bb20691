"""Policies and the projection config: planning metadata, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = ("full_name", "current_company", "current_title", "location")
ARRAYS = ("emails", "phones", "links")
COLLECTIONS = ("skills", "experience", "education")
FIELDS = ("full_name", "emails", "phones", "location", "skills", "experience", "education", "current_company", "current_title", "links")


@dataclass(frozen=True)
class EnginePolicy:
    """Trust of sources, weight of fields, and what agreement and bad formats are worth."""

    # The defaults that results are comparable under.
    trust: dict[str, float] = field(default_factory=lambda: {"csv": 0.8, "ats_json": 0.9, "resume_pdf": 0.7, "recruiter_notes": 0.5})
    criticality: dict[str, float] = field(
        default_factory=lambda: {"full_name": 2.0, "emails": 2.0, "phones": 1.5, "location": 1.0, "skills": 1.5, "experience": 1.0, "education": 1.0, "current_company": 1.0, "current_title": 1.0, "links": 0.5}
    )
    unknown_order: float = 0.0
    unknown_confidence: float = 0.5
    agreement_bonus: float = 0.05
    most: float = 1.0
    email_penalty: float = 0.1
    phone_penalty: float = 0.2
    date_penalty: float = 0.1
    critical_from: float = 2.0

    def __post_init__(self):
        unknown = set(self.criticality) - set(FIELDS)
        if unknown:
            raise ValueError(f"criticality of unknown fields: {sorted(unknown)}")
        if any(not 0 <= w <= 1 for w in self.trust.values()):
            raise ValueError("trust weights must be between 0 and 1")

    def weight(self, source_type: Column, default: float) -> Column:
        pairs = [F.lit(x) for pair in self.trust.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), source_type), F.lit(default))


@dataclass(frozen=True)
class FieldProjection:
    source_field: str
    output_field: str
    include_confidence: bool = False
    include_provenance: bool = False


_TRUE, _FALSE = {"true", "yes", "on", "1", "y", "t"}, {"false", "no", "off", "0", "n", "f"}


def _flag(value, name: str) -> bool:
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in _TRUE | _FALSE:
        return word in _TRUE
    raise ValueError(f"{name} must be a boolean, not {value!r}")


@dataclass(frozen=True)
class ProjectionConfig:
    """Fields to emit, in order, and what to do about missing ones. Unknown keys are ignored."""

    fields: tuple[FieldProjection, ...]
    on_missing: str = "null"
    include_overall_confidence: bool = True
    include_metadata: bool = True

    def __post_init__(self):
        if not self.fields:
            raise ValueError("fields must hold at least one entry")
        if self.on_missing not in ("null", "omit", "error"):
            raise ValueError(f"on_missing must be null, omit or error, not {self.on_missing!r}")
        for f in self.fields:
            if f.source_field.startswith("_") or f.source_field in ("id", "profile_id", "overall_confidence", "sources_used", "sources_failed", "merge_timestamp"):
                raise ValueError(f"{f.source_field!r} is no field of a profile")

    @staticmethod
    def of(data: dict) -> ProjectionConfig:
        if not isinstance(data, dict) or not isinstance(data.get("fields"), list):
            raise ValueError("a projection config is an object with a list of fields")
        made = []
        for entry in data["fields"]:
            if not isinstance(entry, dict) or not isinstance(entry.get("source_field"), str) or not isinstance(entry.get("output_field"), str):
                raise ValueError("each field needs the strings source_field and output_field")
            flags = {k: _flag(entry[k], k) for k in ("include_confidence", "include_provenance") if k in entry}
            made.append(FieldProjection(entry["source_field"], entry["output_field"], **flags))
        flags = {k: _flag(data[k], k) for k in ("include_overall_confidence", "include_metadata") if k in data}
        return ProjectionConfig(tuple(made), data.get("on_missing", "null"), **flags)

    @staticmethod
    def load(path: str) -> ProjectionConfig:
        with open(path, encoding="utf-8") as f:
            return ProjectionConfig.of(json.load(f))
