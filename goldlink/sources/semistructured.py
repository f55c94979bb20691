"""Semi-structured sources: JSON objects or arrays of objects of varying shape, read as VARIANT.

A file of any size streams through a task line by line and is cut into its objects, so a task holds one object and one
batch of lines. Of a key that an object repeats the last value counts; NaN and the infinities become null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldlink.functions.text import filled, let, split_filled, strip
from goldlink.plans.scratch import materialize
from goldlink.plans.schema import EDUCATION, EXPERIENCE
from goldlink.plans.workers import ship

FALSY = ("null", '""', "0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def member(v: Column, *path: str) -> Column:
    """A member at a path of keys, as VARIANT; null where there is none."""
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def kind(v: Column) -> Column:
    """One of STRING, ARRAY, OBJECT, BOOLEAN, VOID, NUMBER; null for null."""
    name = F.schema_of_variant(v)
    return F.when(name.startswith("ARRAY"), "ARRAY").when(name.startswith("OBJECT"), "OBJECT").when(name.isin("STRING", "BOOLEAN", "VOID"), name).when(name.isNotNull(), "NUMBER")


def truthy(v: Column) -> Column:
    """False for null, blank text, zero, false, and empty arrays and objects."""
    return F.coalesce(v.isNotNull() & ~F.to_json(v).isin(*FALSY), F.lit(False))


def first_truthy(v: Column, *paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[let(member(v, *p), lambda m: F.when(truthy(m), m)) for p in paths])


def string(v: Column) -> Column:
    """Text of a string, null of anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def shown(v: Column) -> Column:
    """Text of a string, JSON of anything else."""
    return F.coalesce(string(v), F.to_json(v))


def items(v: Column) -> Column:
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _key(name: str) -> tuple[str, ...]:
    return (name,)


def parse_objects(objects: DataFrame) -> DataFrame:
    """Records of (source_path, position, v), one object each; objects with neither name nor e-mail are skipped.

    A name that is no string drops its record.
    """
    v = F.col("v")
    chains = {
        # a contact that is no object has no members, so its paths miss
        "name_": [("applicant_name",), ("candidate_name",), ("full_name",), ("name",)],
        "mail_": [("contact", "email"), ("contact", "mail"), ("email",)],
        "call_": [("contact", "phone"), ("contact", "telephone"), ("phone",)],
        "skill_": [("skills_list",), ("skills",), ("technical_skills",)],
        "place_": [("location",), ("city",)],
    }
    objects = objects.where(kind(v) == "OBJECT").withColumns({c: first_truthy(v, *paths) for c, paths in chains.items()})
    none = F.array().cast("array<string>")
    name, mail, call, skill, place = (F.col(c) for c in chains)
    emails = F.when(kind(mail) == "STRING", F.array(strip(string(mail)))).when(kind(mail) == "ARRAY", F.filter(F.transform(items(mail), lambda x: strip(string(x))), lambda x: x.isNotNull()))
    whole = F.try_variant_get(call, "$", "double").try_cast("long").cast("string")  # cut, not rounded
    phones = F.when(kind(call) == "STRING", F.array(strip(string(call)))).when(kind(call) == "NUMBER", F.array(whole)).when(kind(call) == "ARRAY", F.transform(items(call), lambda x: strip(shown(x))))
    skills = F.when(kind(skill) == "STRING", split_filled(string(skill), ",")).when(kind(skill) == "ARRAY", F.transform(F.filter(items(skill), truthy), lambda x: strip(shown(x))))
    parts = F.array_compact(F.array(*[F.nullif(string(member(place, k)), F.lit("")) for k in ("city", "state", "country")]))
    location = F.when(kind(place) == "OBJECT", F.array_join(parts, ", ")).otherwise(string(place))

    def entries(key: str, fields: dict[str, tuple[str, ...]], type_: str) -> Column:
        made = lambda e: F.struct(*[F.coalesce(shown(first_truthy(e, *map(_key, keys))), F.lit("")).alias(n) for n, keys in fields.items()])
        found = F.filter(items(member(v, key)), lambda e: kind(e) == "OBJECT")
        return F.coalesce(F.transform(found, made), F.array()).cast(f"array<{type_}>")

    links = []
    for key in ("linkedin", "github", "portfolio", "website", "links"):
        one = member(v, key)
        links.append(F.coalesce(F.when(kind(one) == "STRING", F.array_compact(F.array(filled(string(one))))).when(kind(one) == "ARRAY", F.transform(F.filter(items(one), truthy), lambda x: strip(shown(x)))), none))
    rows = objects.where((name.isNull() | (kind(name) == "STRING"))).select(
        F.lit("ats_json").alias("source_type"),
        "source_path",
        "position",
        string(name).alias("full_name"),
        F.coalesce(emails, none).alias("emails"),
        F.coalesce(phones, none).alias("phones"),
        location.alias("location"),
        F.coalesce(skills, none).alias("skills"),
        entries("experience", {"company": ("company", "organization"), "title": ("title", "role", "position"), "start_date": ("start_date", "from"), "end_date": ("end_date", "to")}, EXPERIENCE).alias("experience"),
        entries("education", {"institution": ("institution", "school", "university"), "degree": ("degree", "qualification"), "year": ("year", "graduation_year")}, EDUCATION).alias("education"),
        shown(first_truthy(v, *map(_key, ("current_employer", "current_company", "company")))).alias("current_company"),
        shown(first_truthy(v, *map(_key, ("position_applied", "current_title", "title", "job_title")))).alias("current_title"),
        F.concat(*links).alias("links"),
        F.concat(F.lit('{"original_object":'), F.to_json(v), F.lit("}")).alias("raw_metadata"),
    )
    return rows.where(F.col("full_name").isNotNull() | (F.size("emails") > 0))


class Splitter:
    """Cuts the text of one file into the members of its root array, or its root object; text comes in pieces."""

    def __init__(self):
        self.decoder = json.JSONDecoder(parse_constant=lambda _: None, parse_float=self._finite)
        self.text, self.state, self.position, self.wait = "", "start", 0, 0

    @staticmethod
    def _finite(digits: str) -> float | None:
        x = float(digits)
        return x if math.isfinite(x) else None

    def feed(self, more: str, last: bool = False) -> Iterator[tuple[int, str]]:
        """(place among the members, JSON) of the objects that are complete. Raises ValueError on malformed text."""
        self.text += more
        if not last and len(self.text) < self.wait:
            return
        at, text = 0, self.text
        while True:
            while at < len(text) and text[at] in " \t\n\r":
                at += 1
            if at == len(text):
                break
            if self.state == "start":
                self.state = "first" if text[at] == "[" else "whole"
                at += self.state == "first"
            elif self.state in ("first", "next") and text[at] == "]" and self.state == "first":
                self.state, at = "end", at + 1
            elif self.state == "after":
                if text[at] not in ",]":
                    raise ValueError("a comma or the end of the array is missing")
                self.state, at = ("next" if text[at] == "," else "end"), at + 1
            elif self.state == "end":
                raise ValueError("text after the root value")
            else:
                try:
                    value, end = self.decoder.raw_decode(text, at)
                except json.JSONDecodeError:
                    if last:
                        raise
                    end = len(text)
                if end == len(text) and not last:  # perhaps cut off: try again when the text has doubled
                    self.wait = 2 * (len(text) - at)
                    self.text = text[at:]
                    return
                if isinstance(value, dict):
                    yield self.position, json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()
                self.position += 1
                self.state, at = ("end" if self.state == "whole" else "after"), end
        self.text, self.wait = "", 0
        if last and self.state not in ("start", "end"):
            raise ValueError("the root array has no end")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, sorted by file and place → (source_path, position, text) of objects, or source_path and ``fault``."""
    path, splitter, out = None, None, []

    def step(more: str, last: bool) -> None:
        nonlocal splitter
        try:
            out.extend((path, position, text, None) for position, text in splitter.feed(more, last))
        except (ValueError, RecursionError) as e:
            out.append((path, None, None, str(e)))
            splitter = None

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["source_path", "position", "text", "fault"])

    for batch in batches:
        lines: list[bytes] = []
        for name, line in zip(batch.column("source_path").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if name != path:
                if splitter is not None:
                    step(_decoded(lines), True)
                path, splitter, lines = name, Splitter(), []
            lines.append(line)
        if splitter is not None:
            step(_decoded(lines), False)
        yield made()
    if splitter is not None:
        step("", True)
        yield made()


def _decoded(lines: list[bytes]) -> str:
    try:
        return "\n".join([*(x.decode() for x in lines), ""])
    except UnicodeDecodeError:
        return "\x00"  # no JSON: the file is reported


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Files that hold an object or an array of objects; other roots give no records.

    A file that is malformed, no UTF-8, or holds an object beyond what a VARIANT may take gives no records and is reported.
    """
    ship(spark)
    place = ["source_path", "block", "i"]
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("line"))
    found = lines.repartition("source_path").sortWithinPartitions(*place).select("source_path", "line").mapInArrow(_split, "source_path string, position bigint, text string, fault string")
    found = found.select("source_path", "position", F.try_parse_json("text").alias("v"), "fault")
    found = materialize(found, "json-objects")
    bad = sorted(r[0] for r in found.where("fault is not null or v is null").select("source_path").distinct().collect())  # names of files only
    good = found.where("v is not null").drop("fault")
    if bad:
        good = good.join(spark.createDataFrame([(p,) for p in bad], "source_path string"), "source_path", "left_anti")
    return parse_objects(good), bad
