"""Discovery of source files, dispatch by suffix, and the union of all records.

A reader takes (spark, paths) and returns (records without record_id, failed paths). New formats are added
with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldlink.plans.schema import RECORD
from goldlink.sources import delimited, documents, semistructured

Reader = Callable[[SparkSession, list[str]], tuple[DataFrame, list[str]]]

KNOWN_SUFFIXES = {".csv": "csv", ".json": "ats_json", ".pdf": "resume_pdf", ".txt": "recruiter_notes"}
#: Suffixes that are read. Notes (.txt) are discovered, but read only on request: see ``extract``.
_READERS: dict[str, Reader] = {".csv": delimited.read, ".json": semistructured.read, ".pdf": documents.read_pdf}
FILE_BITS = 40


def register(suffix: str, reader: Reader, source_type: str) -> None:
    _READERS[suffix.lower()] = reader
    KNOWN_SUFFIXES[suffix.lower()] = source_type


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Files of known suffixes right in the folder, sorted by path, through the store's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in store.listStatus(path) if s.isFile()]
    return sorted(p for p in found if suffix_of(p) in KNOWN_SUFFIXES)


def get_reader(path: str, enable_notes: bool = False) -> Reader | None:
    suffix = suffix_of(path)
    return documents.read_notes if suffix == ".txt" and enable_notes else _READERS.get(suffix)


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def number(records: DataFrame, paths: list[str]) -> DataFrame:
    """record_id: the file's place among the sorted paths, then the place in the file. No global sort."""
    # one row a file; Spark broadcasts it only while it is small
    place = records.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], "source_path string, place bigint")
    numbered = records.join(place, "source_path").withColumn("record_id", F.shiftleft("place", FILE_BITS) + F.col("position"))
    names = [c.split()[0] for c in RECORD.split(", ") if c.split()[0] in numbered.columns]
    return numbered.select(*names)


def extract(spark: SparkSession, paths: list[str], enable_notes: bool = False) -> tuple[DataFrame, list[str]]:
    """(records of all files, paths that could not be read)."""
    groups: dict[Reader, list[str]] = {}
    failed = []
    for path in paths:
        reader = get_reader(path, enable_notes)
        if reader is None:
            failed.append(path)
        else:
            groups.setdefault(reader, []).append(path)
    frames = []
    for reader, some in groups.items():
        records, bad = reader(spark, some)
        frames.append(records)
        failed += bad
    if not frames:
        return empty_records(spark), failed
    return number(reduce(DataFrame.unionByName, frames), paths), [p for p in paths if p in set(failed)]
