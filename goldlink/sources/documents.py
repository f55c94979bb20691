"""Documents: plain-text notes of any common encoding, and text of PDF files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldlink.operators.extract import parse_blocks, parse_resumes
from goldlink.plans.scratch import materialize
from goldlink.plans.workers import ship


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1; line ends are unified later."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def _binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_path"), "content")


def read_notes(spark: SparkSession, paths: list[str], require_key: bool = False) -> tuple[DataFrame, list[str]]:
    files = _binary(spark, paths).select("source_path", decoded(F.col("content")).alias("text"))
    return parse_blocks(files, require_key), []


def pdf_text(content: pd.Series) -> pd.Series:
    """Text of all pages, joined by line feeds; empty where there is none, null for unreadable files or without a PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pd.Series([None] * len(content), dtype=object)

    def one(data: bytes) -> str | None:
        try:
            pages = [page.extract_text() for page in PdfReader(io.BytesIO(data)).pages]
        except Exception:  # a damaged file is reported, as the reader's contract says
            return None
        return "\n".join(p for p in pages if p)

    return content.map(one)


def read_pdf(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Records of the files' texts; files whose text cannot be read are reported."""
    ship(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source_path": part["source_path"], "text": pdf_text(part["content"])})

    files = materialize(_binary(spark, paths).mapInPandas(run, "source_path string, text string"), "pdf-text")
    bad = sorted(r[0] for r in files.where("text is null").select("source_path").collect())  # names of files only
    return parse_resumes(files.where("text is not null")), bad
