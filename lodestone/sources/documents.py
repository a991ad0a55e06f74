"""Page records from a table of ``source_file``, ``page_number`` and raw page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.text import document_type, normalize_text
from lodestone.operators.checks import require_nonempty


def page_records(pages: DataFrame, text_col: str = "raw_text", variant: str = "pages") -> DataFrame:
    """One row per page with document id, type and whitespace-normalised text."""
    stem = F.regexp_replace("source_file", r"\.[^./]*$", "")
    name = F.col("source_file") if variant == "pages" else stem
    return pages.select(
        stem.alias("document_id"),
        document_type(name, variant).alias("document_type"),
        "source_file",
        "page_number",
        normalize_text(F.col(text_col)).alias("text"),
    )


def list_files(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """File names under a folder (contents are not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    listing = files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", "modificationTime"
    )
    return require_nonempty(listing, f"no files matching {pattern} in {path}")
