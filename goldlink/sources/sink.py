"""Sinks: JSON lines for any size, and single files with the customary names for small results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def write_lines(validated: DataFrame, path: str) -> None:
    """Distributed: one JSON object a line."""
    validated.select("output").write.mode("overwrite").text(path)


def write_table(validated: DataFrame, path: str) -> None:
    """Distributed: all columns as Parquet."""
    validated.write.mode("overwrite").parquet(path)


def write_files(validated: DataFrame, folder: str) -> int:
    """``candidate_<n>.json`` for each profile in cluster order and ``all_candidates.json``; streams one profile at a time."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    with open(os.path.join(folder, "all_candidates.json"), "w", encoding="utf-8") as together:
        together.write("[")
        for row in validated.orderBy("cluster_id").select("output").toLocalIterator():
            n += 1
            text = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)
            with open(os.path.join(folder, f"candidate_{n}.json"), "w", encoding="utf-8") as f:
                f.write(text)
            together.write(("," if n > 1 else "") + "\n  " + text.replace("\n", "\n  "))
        together.write("\n]" if n else "]")
    return n
