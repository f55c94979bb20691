"""Confidence: format penalties for single fields, then the weighted mean over fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.functions import dictionaries as d
from goldlink.functions.text import strip
from goldlink.plans.policy import EnginePolicy
from goldlink.plans.schema import VALUE


def is_empty(value: Column, field: str) -> Column:
    """Null, an empty list, or a blank text."""
    return value.isNull() | ((strip(value) == "") if VALUE.get(field) == "string" else (F.size(value) == 0))


def penalized(confidence: Column, bad: Column, total: Column, penalty: float, rounding=F.bround) -> Column:
    """``confidence`` less the penalty's share of bad values, not below 0, to 4 places; as it is if none is bad."""
    return F.when((total > 0) & (bad > 0), rounding(F.greatest(confidence - penalty * (bad / total), F.lit(0.0)), 4)).otherwise(confidence)


def _count(values: Column, pattern: str) -> Column:
    return F.size(F.filter(values, lambda v: ~F.coalesce(v.rlike(pattern), F.lit(False))))


def score(profiles: DataFrame, policy: EnginePolicy = EnginePolicy(), rounding=F.bround) -> DataFrame:
    """``profiles`` with adjusted field confidences and overall_confidence.

    A missing field leaves the denominator, unless it is critical: then it counts as 0. Sums run in the order of the policy.
    """
    emails, phones, experience = F.col("emails"), F.col("phones"), F.col("experience")
    dates = F.filter(F.flatten(F.transform(experience["value"], lambda e: F.array(e["start_date"], e["end_date"]))), lambda x: x.isNotNull() & (x != "") & (x != "Present"))
    adjusted = profiles.withColumns(
        {
            "emails": emails.withField("confidence", penalized(emails["confidence"], _count(emails["value"], f"^{d.EMAIL}$"), F.size(emails["value"]), policy.email_penalty, rounding)),
            "phones": phones.withField("confidence", penalized(phones["confidence"], _count(phones["value"], d.E164), F.size(phones["value"]), policy.phone_penalty, rounding)),
            "experience": experience.withField("confidence", penalized(experience["confidence"], _count(dates, d.YEAR_MONTH), F.size(dates), policy.date_penalty, rounding)),
        }
    )
    points, weights = F.lit(0.0), F.lit(0.0)
    for field, weight in policy.criticality.items():
        value = F.col(field)
        missing = is_empty(value["value"], field)
        points = points + F.when(missing, 0.0).otherwise(value["confidence"] * weight)
        weights = weights + F.when(missing, F.lit(weight if weight >= policy.critical_from else 0.0)).otherwise(weight)
    return adjusted.withColumn("overall_confidence", F.when(weights > 0, rounding(points / weights, 4)).otherwise(0.0))
