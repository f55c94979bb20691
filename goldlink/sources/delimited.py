"""Delimited files: header synonyms, quoted fields, byte-order marks, ragged rows.

All files are one read and one plan, however many there are and whatever their headers: each row looks up how its file's header
maps columns to fields.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldlink.functions import dictionaries as d
from goldlink.functions.text import filled, let, split_filled
from goldlink.plans.schema import EDUCATION, EXPERIENCE
from goldlink.plans.workers import ship

OPTIONS = {"header": "true", "enforceSchema": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}


def headers_of(spark: SparkSession, paths: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """Column names of each file that has any, and the files whose bytes are no UTF-8: one job, one line a file to the driver."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    filled_line = F.when(F.is_valid_utf8("value") & (F.trim("value") != ""), F.col("at"))
    seen = lines.groupBy("path").agg(F.min_by("value", filled_line).alias("head"), F.min(F.is_valid_utf8("value")).alias("valid")).collect()
    names = {}
    for path, head, valid in seen:
        if valid and head is not None:
            if head.count('"') % 2:  # a quoted name runs on in the next line
                row = spark.read.options(**{**OPTIONS, "header": "false"}).csv(path).head(1)
                names[path] = ["" if x is None else x.lstrip("\ufeff") for x in row[0]]
            else:
                names[path] = next(csv.reader([head.lstrip("\ufeff")]))
    return names, sorted(r["path"] for r in seen if not r["valid"])


def _numbered(rows: DataFrame) -> DataFrame:
    """``position``: the place of a row in its file, from 1. A file is read by one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = None, 0
        for batch in batches:
            places = []
            for name in batch.column("source_path").to_pylist():
                path, at = name, at + 1 if name == path else 1
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "position"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("position", T.LongType())]))


def read(spark: SparkSession, paths: list[str], strict: bool = False, headers: dict[str, str] = d.HEADERS) -> tuple[DataFrame, list[str]]:
    """Records of all files, each under its own header. Rows without name and e-mail are skipped.

    Where several columns map to one field, the last non-empty one counts. Missing trailing cells are nulls; ``strict``
    discards a whole file if a mapped cell is missing. A file that is no UTF-8 gives no records and is reported.
    """
    from goldlink.sources.registry import empty_records

    names, bad = headers_of(ship(spark), paths)
    if not names:
        return empty_records(spark).drop("record_id"), bad
    width = max(len(n) for n in names.values())
    columns = [f"c{i}" for i in range(width)]
    cells = spark.read.options(**OPTIONS).schema(", ".join(f"{c} string" for c in columns)).csv(sorted(names))
    cells = _numbered(cells.select(F.col("_metadata.file_path").alias("source_path"), F.array(*columns).alias("cells")))
    table = []
    for path, own in names.items():
        last = {name: i for i, name in enumerate(own)}  # of a repeated name the last column counts
        table.append((path, list(last), list(last.values()), [headers.get(n.strip().lower()) for n in last]))
    # one row a file; Spark broadcasts it only while it is small
    known = spark.createDataFrame(table, "source_path string, names array<string>, at array<int>, fields array<string>")
    rows = cells.join(known, "source_path").withColumn("cells", F.transform("at", lambda i: F.get("cells", i)))
    if strict:
        missing = F.exists(F.arrays_zip("cells", "fields"), lambda x: x["cells"].isNull() & x["fields"].isNotNull())
        short = rows.where(missing & F.exists("cells", lambda x: x.isNotNull())).select("source_path").distinct()
        rows = rows.join(short, "source_path", "left_anti")

    def get(field: str):
        held = F.transform(F.arrays_zip("cells", "fields"), lambda x: F.when(x["fields"] == field, filled(x["cells"])))
        return let(F.array_compact(held), lambda x: F.get(x, F.size(x) - 1))

    single = lambda f: F.array_compact(F.array(get(f)))
    return rows.select(
        F.lit("csv").alias("source_type"),
        "source_path",
        "position",
        get("full_name").alias("full_name"),
        single("email").alias("emails"),
        single("phone").alias("phones"),
        get("location").alias("location"),
        split_filled(get("skills"), ",").alias("skills"),
        F.array().cast(f"array<{EXPERIENCE}>").alias("experience"),
        F.array().cast(f"array<{EDUCATION}>").alias("education"),
        get("current_company").alias("current_company"),
        get("current_title").alias("current_title"),
        F.array().cast("array<string>").alias("links"),
        F.to_json(F.struct(F.map_from_arrays("names", "cells").alias("original_row"))).alias("raw_metadata"),
    ).where(F.col("full_name").isNotNull() | (F.size("emails") > 0)), bad
