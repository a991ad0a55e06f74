"""Profiles of raw text tables. Each report is one pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import clean

# Columns checked for currency signs.
MONEY_COLUMNS = ["labor_cost", "unit_cost", "unit_price", "claim_amount", "approved_amount"]


def sample(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for frame in counts[1:]:
        out = out.unionByName(frame)
    return out


def value_counts(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """The ``n`` most frequent values."""
    counts = df.groupBy(col).agg(F.count("*").alias("occurrences"))
    return counts.orderBy(F.col("occurrences").desc(), F.col(col).asc_nulls_first()).limit(n)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Groups sharing a key and their surplus rows; keys are trimmed and blank keys ignored."""
    value = clean.squeeze(F.coalesce(F.col(key), F.lit("")))
    counts = df.groupBy(value.alias("_key")).agg(F.count("*").alias("_n")).filter("_key <> ''")
    return counts.agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"),
    )


def columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Missing, HTML, whitespace and encoding counts per column; columns without findings are left out.

    All counts are taken in one row of four counters a column, which is turned into a row a column at the end.
    """
    names = names or df.columns
    counters = []
    for i, name in enumerate(names):
        value = F.coalesce(F.col(name), F.lit(""))
        missing = clean.is_missing(value)
        counters += [
            F.count_if(missing).alias(f"m{i}"),
            F.count_if(clean.has_html(value)).alias(f"h{i}"),
            F.count_if(~missing & clean.untidy_ws(value)).alias(f"w{i}"),
            F.count_if(clean.has_encoding_flag(value)).alias(f"e{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("column_name"), F.col(f"m{i}").alias("missing"), F.col(f"h{i}").alias("html"),
            F.col(f"w{i}").alias("whitespace"), F.col(f"e{i}").alias("encoding_flags"),
        )
        for i, name in enumerate(names)
    ]
    report = df.agg(*counters).select(F.inline(F.array(*rows)))
    return report.filter("missing + html + whitespace + encoding_flags > 0")


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per value: a test is planned once and its counts are combined before the shuffle."""
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value")) for n in names]
    return df.select(F.inline(F.array(*entries)))


def _present(df: DataFrame, names: list[str]) -> DataFrame:
    return _long(df, names).filter(~clean.is_missing(F.col("value")))


def date_formats(df: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """How often each date layout occurs in the date-like columns; None without such a column, as in the next two."""
    names = names or [c for c in df.columns if "date" in c.lower() or "expiration" in c.lower()]
    if not names:
        return None
    classed = _present(df, names).withColumn("format", clean.date_format_class(F.col("value")))
    return classed.groupBy("column_name", "format").agg(F.count("*").alias("occurrences"))


def statuses(df: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    names = names or [c for c in df.columns if c.lower() == "status"]
    if not names:
        return None
    trimmed = F.regexp_replace("value", f"^{clean.SPACE}+|{clean.SPACE}+$", "").alias("value")
    return _present(df, names).select("column_name", trimmed).groupBy("column_name", "value").agg(
        F.count("*").alias("occurrences")
    )


def currency_symbols(df: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    names = names or [c for c in df.columns if c.lower() in MONEY_COLUMNS]
    if not names:
        return None
    sums = [F.count_if(clean.has_currency(F.col(n))).alias(n) for n in names]
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("with_symbol")) for n in names]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def untrimmed_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which any of the columns has outer blanks, and rows with tags in them."""
    from functools import reduce

    blanks = reduce(lambda a, b: a | b, [clean.extra_ws(F.col(n)) for n in names])
    tags = reduce(lambda a, b: a | b, [clean.has_html(F.col(n)) for n in names])
    return df.agg(
        F.count_if(blanks).alias("rows_with_extra_whitespace"), F.count_if(tags).alias("rows_with_html")
    )
