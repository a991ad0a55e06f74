"""Writers. Paths are overwritten unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.checks import require_nonempty


def _as_text(df: DataFrame) -> DataFrame:
    """Missing values leave the lake as empty text."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Header and exact values: outer blanks are kept, missing values are empty."""
    (
        _as_text(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_clean(df: DataFrame, path: str) -> None:
    write_csv(df.drop("source_row", "rejection_reason"), path)


def write_rejected(df: DataFrame, path: str) -> None:
    rest = [c for c in df.columns if c not in ("source_row", "rejection_reason")]
    write_csv(df.select("source_row", "rejection_reason", *rest), path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One line per table: ``name: input=.., clean=.., rejected=..``."""
    line = F.format_string(
        "%s: input=%d, clean=%d, rejected=%d", "table_name", "input_rows", "clean_rows", "rejected_rows"
    )
    summary.select(line.alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "chunk_id") -> None:
    """Ids and float32 vectors."""
    df.select(id_col, F.col("embedding").cast("array<float>").alias("embedding")).write.mode(
        "overwrite"
    ).parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def extraction_manifest(pages: DataFrame) -> DataFrame:
    """One row: documents, pages and pages without text. The list of those pages is its own frame."""
    return pages.agg(
        F.countDistinct("source_file").alias("document_count"),
        F.count("*").alias("page_count"),
        F.count_if(F.col("text") == "").alias("empty_page_count"),
    )


def empty_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("text") == "").select("source_file", "page_number")


def embedding_manifest(vectors: DataFrame, model: str, batch_size: int) -> DataFrame:
    require_nonempty(vectors, "no chunks available for embedding")
    return vectors.agg(
        F.count("*").alias("chunk_count"), F.max(F.size("embedding")).alias("embedding_dimension")
    ).select(
        F.lit(model).alias("model"),
        F.lit("L2 normalized").alias("normalization"),
        F.lit(batch_size).alias("batch_size"),
        "chunk_count",
        "embedding_dimension",
    )


def append_run(df: DataFrame, path: str) -> None:
    """Add run results as JSON; earlier runs stay."""
    df.write.mode("append").json(path)


def latest_run(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The named run, or the one with the greatest ``run_id`` (ids are timestamps)."""
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    newest = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(F.broadcast(newest), "run_id", "left_semi")
