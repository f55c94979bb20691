"""Validation of projected output: issues are collected, nothing is withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.functions import dictionaries as d
from goldlink.functions.text import strip
from goldlink.operators.project import missing, outputs
from goldlink.plans.policy import ProjectionConfig
from goldlink.plans.schema import VALUE

ISSUE = "struct<field:string,severity:string,message:string>"


def issue(field: Column, message: Column, severity: str = "warning") -> Column:
    return F.struct(field.alias("field"), F.lit(severity).alias("severity"), message.alias("message")).cast(ISSUE)


def check_confidence(name: str, value: Column) -> Column:
    """No number: an error. Outside 0 to 1: a warning."""
    bad = issue(F.lit(name), F.concat(F.lit("Confidence "), value.cast("string"), F.lit(" is outside [0.0, 1.0] range.")))
    none = issue(F.lit(name), F.lit("Confidence must be a number, got null."), "error")
    return F.when(value.isNull(), F.array(none)).when(~value.between(0.0, 1.0), F.array(bad)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _format_check(name: str, rank: int, pattern: str, before: str, after: str):
    def check(v: Column, i: Column) -> Column:
        found = issue(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), F.concat(F.lit(before), v, F.lit(after)))
        return F.when(v.isNotNull() & ~v.rlike(pattern), F.struct(i.alias("i"), F.lit(rank).alias("k"), found.alias("x")))

    return check


def check_list(name: str, values: Column) -> Column:
    """Formats by what the output's name says: phones and e-mails."""
    low = name.lower()
    rules = []
    if "phone" in low:
        rules.append((d.E164, "Phone '", "' is not in E.164 format."))
    if "email" in low:
        rules.append((f"^{d.EMAIL}$", "Email '", "' does not match expected format."))
    found = [F.transform(values, _format_check(name, k, *rule)) for k, rule in enumerate(rules)]
    if not found:
        return F.array().cast(f"array<{ISSUE}>")
    return F.transform(F.array_sort(F.array_compact(F.concat(*found))), lambda x: x["x"])


def check_string(name: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (strip(value) == ""), F.array(issue(F.lit(name), F.lit("Field is an empty string.")))).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _severity(severity: str):
    return lambda x: x["severity"] == severity


def validate(projected: DataFrame, config: ProjectionConfig, strict: bool = False) -> DataFrame:
    """``projected`` with is_valid and issues; where there are issues, ``output`` gets a ``_validation`` member."""
    none = F.array().cast(f"array<{ISSUE}>")
    parts = []
    for p in outputs(config):
        if p.output_field.startswith("_") or p.source_field not in VALUE:
            continue
        field, kind = F.col(p.source_field), VALUE[p.source_field]
        checks = [check_confidence(f"{p.output_field}.confidence", field["confidence"])] if p.include_confidence else []
        if kind == "array<string>":
            checks.append(check_list(p.output_field, field["value"]))
        elif kind == "string":
            checks.append(check_string(p.output_field, field["value"]))
        if checks:
            parts.append(F.when(missing(p.source_field), none).otherwise(F.concat(*checks)))
    if config.include_overall_confidence:
        parts.append(check_confidence("overall_confidence", F.col("overall_confidence")))
    checked = projected.withColumn("issues", F.concat(*parts) if parts else none)
    errors, warnings = (F.size(F.filter("issues", _severity(severity))) for severity in ("error", "warning"))
    valid = (F.size("issues") == 0) if strict else errors == 0
    report = F.to_json(F.struct(valid.alias("is_valid"), errors.alias("error_count"), warnings.alias("warning_count"), F.col("issues")))
    annotated = F.concat(F.substr("output", F.lit(1), F.length("output") - 1), F.when(F.col("output") != "{}", F.lit(",")).otherwise(F.lit("")), F.lit('"_validation":'), report, F.lit("}"))
    return checked.withColumn("is_valid", valid).withColumn("output", F.when(F.size("issues") > 0, annotated).otherwise(F.col("output")))
