"""Latency and citation reports over run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import materialize

# Timed stages and the response-time target in milliseconds.
STAGES = [
    "routing_ms", "sql_ms", "document_ms", "vector_ms", "retrieval_ms", "prompt_ms", "generation_ms", "total_ms",
]
TARGET_MS = 5000.0
PROBABILITIES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentiles(
    df: DataFrame, value: str, by: list[str] | None = None, probabilities: dict[str, float] = PROBABILITIES,
    approximate: bool = False,
) -> DataFrame:
    """Exact percentiles with linear interpolation; NULL for a group without values.

    Equal values are counted, the counts are sorted by range, and each range learns how many values of the
    group lie before it. So the wanted ranks are picked where they are, and no task holds a group.
    ``approximate`` uses a sketch of fixed size instead.
    """
    by = by or []
    if approximate:
        points = F.approx_percentile(value, list(probabilities.values()), 10_000)
        grouped = df.groupBy(*by).agg(points.alias("_p"))
        return grouped.select(*by, *[F.col("_p")[i].alias(n) for i, n in enumerate(probabilities)])
    counted = df.groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(value).alias("_n"))
    ranged = counted.repartitionByRange(*by, "_value").select("*", F.spark_partition_id().alias("_range"))
    ranged = materialize(ranged, "ranges")
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum")).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"), F.sum("_sum").over(whole).alias("_total"),
    )
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    up_to = Window.partitionBy("_range", *by).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_end", F.sum("_n").over(up_to)).join(sums, same)
    end = F.col("_earlier") + F.col("_end")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < end) & (rank >= end - F.col("_n")), F.col("_value")))

    cells = []
    for name, p in probabilities.items():
        rank = (F.col("_total") - 1) * F.lit(p)
        cells += [at(F.floor(rank)).alias(f"_low_{name}"), at(F.ceil(rank)).alias(f"_high_{name}"), F.max(rank - F.floor(rank)).alias(f"_part_{name}")]
    found = placed.groupBy(*by).agg(*cells)
    mixed = [(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in probabilities]
    return found.select(*by, *mixed)


def long_stages(runs: DataFrame, stages: list[str] = STAGES, keep: list[str] | None = None) -> DataFrame:
    pairs = [F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in stages]
    return runs.select(*(keep or []), F.inline(F.array(*pairs)))


def answered(runs: DataFrame) -> DataFrame:
    """Runs with a model answer, or all runs when there are none."""
    ok = runs.filter(F.col("llm_status").contains(" - ok"))
    return runs if ok.isEmpty() else ok


def stage_report(runs: DataFrame, stages: list[str] = STAGES, total: str = "total_ms") -> DataFrame:
    """Mean, P50, P95, P99 and maximum per stage over positive timings, and the share of the mean total.

    A stage that never ran is reported with zeros.
    """
    long = long_stages(runs, stages)
    ran = F.when(F.col("ms") > 0, F.col("ms"))
    totals = long.groupBy("stage").agg(F.avg(ran).alias("mean"), F.max(ran).alias("max"))
    points = percentiles(long.filter("ms > 0"), "ms", ["stage"])
    overall = runs.agg(F.avg(total).alias("_mean_total"))  # one row
    report = totals.join(points, "stage", "left").crossJoin(F.broadcast(overall))
    numbers = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p50", "p95", "p99", "max")]
    # From six places, so that the order of summation does not decide a tie.
    share = F.round(F.round(F.coalesce("mean", F.lit(0.0)) / F.col("_mean_total") * 100, 6), 0)
    return report.select("stage", *numbers, share.alias("share_of_total"))


def slo(runs: DataFrame, total: str = "total_ms", target: float = TARGET_MS) -> DataFrame:
    under = F.col(total) < target
    return runs.agg(
        F.count_if(under).alias("runs_under_target"),
        F.count("*").alias("runs"),
        F.avg(F.when(under, 1.0).otherwise(0.0)).alias("share_under_target"),
    )


def by_question(runs: DataFrame, question: str = "q", stages: tuple[str, ...] = ("retrieval_ms", "generation_ms", "total_ms")):
    """Median timings per question over answered runs, or over all its runs when none was answered."""
    ok = F.col("llm_status").contains(" - ok")
    any_ok = runs.groupBy(question).agg(F.max(ok).alias("_any"))
    chosen = runs.join(any_ok, question).filter(ok | ~F.col("_any"))
    # All stages in one run of ranks, by question and stage.
    medians = percentiles(long_stages(chosen, list(stages), [question]), "ms", [question, "stage"], {"median": 0.5})
    wide = medians.groupBy(question).agg(*(F.max(F.when(F.col("stage") == s, F.col("median"))).alias(f"median_{s}") for s in stages))
    return chosen.groupBy(question).agg(F.count("*").alias("runs")).join(wide, question)


def citation_coverage(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.sum("cited_n").alias("cited_statements"),
        F.sum("statements_n").alias("statements"),
        F.sum("unknown_tags").alias("unknown_tags"),
    )
