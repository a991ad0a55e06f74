"""Raw CSV files as all-text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import quoted
from lodestone.sources.lines import number_rows
from lodestone.sources.schemas import all_text


def read_csv(spark: SparkSession, path: str | list[str], table: str, multiline: bool = True, split: bool = True) -> DataFrame:
    """Every column as text; nothing is inferred or trimmed.

    ``multiline`` allows line breaks inside quotes. Files are read by as many tasks as they have splits, and the frame has
    the records' numbers as ``source_row``; ``split=False`` leaves it to Spark's own reader, a task a file, without numbers.
    Extracts without such breaks should pass ``multiline=False``, which reads them once instead of twice.
    """
    if multiline and split:
        return quoted.read(spark, path, all_text(table))
    return (
        spark.read.schema(all_text(table))
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("emptyValue", "")
        .option("enforceSchema", True)
        .csv(path)
    )


def with_source_row(df: DataFrame) -> DataFrame:
    """Number the logical records from 2, the header being row 1. Later files go on counting, in the order of their
    paths, so a number names one record of the table. Frames that have their numbers stay as they are."""
    if "source_row" in df.columns:
        return df
    return number_rows(df, "source_row", start=2, per_file=False).drop("_file")
