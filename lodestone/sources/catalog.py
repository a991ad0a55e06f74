"""What tables and columns a session can see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def columns(spark: SparkSession, table: str) -> list[str]:
    """Column names in order."""
    return spark.table(table).columns


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {table}")
