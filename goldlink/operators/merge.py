"""Merging the records of an entity into one profile, with confidence and provenance for every field.

One aggregation collects an entity's records, ordered by trust, then record_id; every field is an expression over that
array, so a merge costs one shuffle. A profile lists the contribution of each of its records, so its size is
that of its entity by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.functions.text import let, strip
from goldlink.plans.policy import EnginePolicy
from goldlink.plans.schema import VALUE, field_type, provenance_type

_KEYED = {"experience": ("company", "title"), "education": ("institution", "degree")}


def _source(record: Column, field: str, value: Column, method: str | Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        record["source_type"].alias("source_type"),
        record["source_path"].alias("source_path"),
        value.alias("original_value"),
        (F.lit(method) if isinstance(method, str) else method).alias("method"),
    )


def _field(value: Column, confidence: Column, provenance: Column, field: str) -> Column:
    return F.struct(value.alias("value"), confidence.cast("double").alias("confidence"), provenance.alias("provenance")).cast(field_type(field))


def merge_scalar(members: Column, field: str, policy: EnginePolicy = EnginePolicy()) -> Column:
    """Most trusted value; among equal trust the longest, then the earliest record. If all agree, a bonus for each further record."""
    empty = _field(F.lit(None).cast("string"), F.lit(0.0), F.array().cast(f"array<{provenance_type(field)}>"), field)
    # what the rules need of a record; each step is bound once
    form = lambda m: F.struct(m["trust"].alias("trust"), m["source_type"].alias("source_type"), m["source_path"].alias("source_path"), m[field].alias(field), strip(m[field]).alias("bare"))
    given = F.filter(F.transform(members, form), lambda m: m["bare"] != "")

    def resolved(g: Column) -> Column:
        n, first = F.size(g), F.get(g, F.lit(0))
        alike = F.size(F.array_distinct(F.transform(g, lambda m: F.lower(m["bare"])))) == 1
        # of the most trusted values the longest, then the earliest: the greatest of (length, -place)
        rank = lambda m, i: F.when(m["trust"] == first["trust"], F.struct(F.length(m[field]).alias("length"), (-i).alias("late")))
        best = F.get(g, -F.array_max(F.transform(g, rank))["late"])
        picked = F.struct(alike.alias("alike"), F.when(alike, first).otherwise(best).alias("winner"), n.alias("n"))

        def made(p: Column) -> Column:
            winner, agreed = p["winner"], (p["n"] > 1) & p["alike"]
            weight = policy.weight(winner["source_type"], policy.unknown_confidence)
            confidence = F.when(agreed, F.least(weight + policy.agreement_bonus * (p["n"] - 1), F.lit(policy.most))).otherwise(weight)
            method = F.when(p["n"] == 1, "direct").when(agreed, "agreement").otherwise("trust_weight")
            return _field(winner[field], confidence, F.array(_source(winner, field, winner[field], method)), field)

        return F.when(n > 0, let(picked, made)).otherwise(empty)

    return let(given, resolved)


def _key(field: str):
    if field not in _KEYED:
        return lambda v: F.coalesce(F.lower(strip(v)), F.lit(""))
    a, b = _KEYED[field]
    part = lambda v, name: F.coalesce(F.lower(strip(v[name])), F.lit(""))
    return lambda v: F.when((part(v, a) == "") & (part(v, b) == ""), F.lit("")).otherwise(F.concat(part(v, a), F.lit("::"), part(v, b)))


def merge_list(members: Column, field: str, policy: EnginePolicy = EnginePolicy()) -> Column:
    """Values of all records in order of trust, the first of each key; every record with a usable value counts as a source."""
    key = _key(field)
    usable = lambda m: F.exists(m[field], lambda v: key(v) != "")
    empty = _field(F.array().cast(VALUE[field]), F.lit(0.0), F.array().cast(f"array<{provenance_type(field)}>"), field)

    def united(sources: Column) -> Column:
        weights = F.transform(sources, lambda m: policy.weight(m["source_type"], policy.unknown_confidence))
        confidence = F.least(F.array_max(weights) + policy.agreement_bonus * (F.size(sources) - 1), F.lit(policy.most))
        values = _firsts(F.flatten(F.transform(sources, lambda m: m[field])), key)
        return F.when(F.size(sources) > 0, _field(values, confidence, F.transform(sources, lambda m: _source(m, field, m[field], "union")), field)).otherwise(empty)

    return let(F.filter(members, lambda m: F.coalesce(usable(m), F.lit(False))), united)


def _firsts(values: Column, key) -> Column:
    """The first value of each non-empty key, in order: by sorting (key, place), so in n log n for any number of values."""

    def pick(vs: Column) -> Column:
        keyed = F.filter(F.transform(vs, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"))), lambda x: x["k"] != "")
        heads = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"]))
        places = F.array_sort(F.transform(let(F.array_sort(keyed), heads), lambda x: x["i"]))
        return F.transform(places, lambda i: F.get(vs, i))

    return let(values, pick)


def collect_members(records: DataFrame, policy: EnginePolicy = EnginePolicy()) -> DataFrame:
    """cluster_id and its ``members``, ordered by falling trust, then record_id."""
    trust = policy.weight(F.col("source_type"), policy.unknown_order)
    columns = ["record_id", "source_type", "source_path", "position", *VALUE]
    member = F.struct((-trust).alias("order"), *columns, trust.alias("trust"))
    return records.groupBy("cluster_id").agg(F.array_sort(F.collect_list(member), _by_rank).alias("members"))


def _by_rank(a: Column, b: Column) -> Column:
    return F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def merge(records: DataFrame, policy: EnginePolicy = EnginePolicy()) -> DataFrame:
    """One profile for each cluster_id: profile_id, the ten fields, sources_used.

    profile_id is a digest of where the members come from, so it is the same on every run.
    """
    members = F.col("members")
    gathered = collect_members(records, policy)
    places = F.array_sort(F.transform(members, lambda m: F.concat_ws("\u0001", m["source_path"], F.coalesce(m["position"], m["record_id"]).cast("string"))))
    fields = {f: merge_scalar(members, f, policy) if VALUE[f] == "string" else merge_list(members, f, policy) for f in VALUE}
    return gathered.select(
        "cluster_id",
        F.sha2(F.array_join(places, "\u0002"), 256).alias("profile_id"),
        *[c.alias(f) for f, c in fields.items()],
        F.array_distinct(F.transform(F.array_sort(F.transform(members, lambda m: F.struct(m["record_id"].alias("i"), m["source_path"].alias("p")))), lambda x: x["p"])).alias("sources_used"),
    )
