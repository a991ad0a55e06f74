"""Temperature mixing of sources.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is bisected to meet
a target entropy of the weights, or a limit on how often the rarest source is repeated. The weights are then realised
as a schedule: the documents of a source are dealt into blocks of about ``block_tokens`` tokens, each pass over the
source is another permutation of its blocks, and passes go on until the source's budget of tokens is spent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.tables import WORD, spare
from lodestone.session import broadcast_if_small, materialize

BLOCK_TOKENS = 250_000
RANGE_BLOCKS = 100_000  # blocks of a source that one task sorts, about
GRID = 16  # exponents tried in one pass over the sources: four halvings


def tokens(text: Column) -> Column:
    """Words and one end; never 0, so that empty documents have a place as well."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """(key, size, share) of each source, from rows of key and size."""
    sizes = rows.groupBy("key").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size").alias("total")).first()["total"] or 1
    return sizes.withColumn("share", F.col("size") / F.lit(float(total)))


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


@dataclass(frozen=True)
class Mix:
    exponent: float
    norm: float  # sum of the powers
    entropy: float  # of the weights, in nats
    repeats: float  # of the most repeated source, when the least repeated one is read once


def measure(sources: DataFrame, exponents: list[float]) -> list[Mix]:
    """One pass over the sources. Repeats are share ** (exponent - 1), relative to the least repeated source."""
    cells = []
    for i, a in enumerate(exponents):
        power, rate = F.pow("share", F.lit(a)), F.pow("share", F.lit(a - 1.0))
        cells += [F.sum(power).alias(f"n{i}"), F.sum(power * F.log("share")).alias(f"l{i}"), F.max(rate).alias(f"h{i}"), F.min(rate).alias(f"m{i}")]
    r = sources.agg(*cells).first()
    if r["n0"] is None:
        return [Mix(a, 1.0, 0.0, 1.0) for a in exponents]
    return [Mix(a, r[f"n{i}"], math.log(r[f"n{i}"]) - a * r[f"l{i}"] / r[f"n{i}"], r[f"h{i}"] / r[f"m{i}"]) for i, a in enumerate(exponents)]


def temperature(sources: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> Mix:
    """The flattest mix (exponent from 0 to 1) that keeps to ``max_repeats``, or the mix of ``target_entropy`` nats;
    exponent 1 or 0 where the target lies beyond what either gives. Both entropy and repeats fall as it grows."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    over = (lambda m: m.repeats > max_repeats) if target_entropy is None else (lambda m: m.entropy > target_entropy)
    low, high = measure(sources, [0.0, 1.0])
    if not over(low):
        return low
    while high.exponent - low.exponent > 1e-9:
        step = (high.exponent - low.exponent) / GRID
        tried = [low, *measure(sources, [low.exponent + i * step for i in range(1, GRID)]), high]
        at = next((i for i, m in enumerate(tried) if i and not over(m)), GRID)
        low, high = tried[at - 1], tried[at]
    return high


def budgets(sources: DataFrame, mix: Mix, total: float | None = None) -> DataFrame:
    """``sources`` with weight and budget: its share of ``total`` tokens. Without a total, the least at which each
    source is read in full at least once, so that no document is left out."""
    weighted = sources.withColumn("weight", F.pow("share", F.lit(mix.exponent)) / F.lit(mix.norm))
    if total is None:
        total = weighted.agg(F.max(F.col("size") / F.col("weight")).alias("t")).first()["t"] or 0.0
    return weighted.withColumn("budget", F.floor(F.col("weight") * F.lit(float(total)) + 0.5).cast("long"))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float | None = 2.0,
    target_entropy: float | None = None, total: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0,
) -> DataFrame:
    """The schedule: columns of ``docs``, then mix_tokens, mix_epoch (pass over the source, from 0), mix_block (place of the
    block in its pass), mix_place (place in the block, from 0) and mix_at (share of the source's budget spent before).

    Ordered by mix_at, any prefix holds the sources in the weights, up to a block. Rows start while budget is left, so a
    source exceeds its budget by less than a row. Repeated rows are scheduled each for itself, null sources are a source,
    null texts have one token. Rows are written once with their sizes and a number, and dealt to blocks by that number as well
    as their id, so that equal rows spread like others. An empty table gives no rows. A name that ``docs`` uses itself gets an
    underscore behind.
    """
    names = [spare(docs, name) for name in ("mix_tokens", "mix_epoch", "mix_block", "mix_place", "mix_at")]
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    numbered = docs.select(
        row, F.col(id).alias("id"), source_key(source).alias("key"), tokens(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("number")
    )
    numbered = materialize(numbered, "rows")
    sources = materialize(source_sizes(numbered), "sources")
    planned = budgets(sources, temperature(sources, max_repeats, target_entropy), total)
    planned = planned.where("budget > 0").select(
        "key", "size", "budget", F.greatest(F.lit(1), F.ceil(F.col("size") / block_tokens)).cast("long").alias("blocks")
    )
    planned = broadcast_if_small(materialize(planned, "budgets"))
    numbered = numbered.withColumn("card", F.xxhash64("id", "number", F.lit(seed))).drop("number")
    dealt = numbered.join(planned.select("key", "blocks"), "key")
    dealt = dealt.withColumn("block", F.pmod("card", "blocks")).drop("blocks")

    # Blocks are rows of their own: which passes they take part in, and the tokens of the schedule before them.
    narrow = dealt.select("key", "block", "size")
    blocks = narrow.groupBy("key", "block").agg(F.sum("size").alias("tokens"))
    passes = F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("size")).cast("int"))).alias("epoch")
    blocks = blocks.join(planned, "key").select("key", "block", "tokens", "size", "budget", "blocks", passes)
    # Blocks stand in the order of a hash. Ranges of it are sorted by themselves and start where the earlier ones end.
    blocks = blocks.withColumn("draw", F.xxhash64("block", "epoch", F.lit(seed + 1)))
    share = F.col("draw").cast("double") / 2.0**64 + 0.5
    blocks = blocks.withColumn("range", F.floor(share * F.ceil(F.col("blocks") / RANGE_BLOCKS)).cast("long"))
    ranges = blocks.groupBy("key", "epoch", "range").agg(F.sum("tokens").alias("in_range"), F.count("*").alias("n"))
    before = Window.partitionBy("key", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "key", "epoch", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("blocks_before"),
    )
    order = Window.partitionBy("key", "epoch", "range").orderBy("draw", "block")
    earlier = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("earlier", earlier).withColumn("nth", F.row_number().over(order) - 1)
    blocks = blocks.join(ranges, ["key", "epoch", "range"]).select(
        "key", "block", "epoch", "budget", (F.col("blocks_before") + F.col("nth")).cast("long").alias("mix_block"),
        (F.col("epoch") * F.col("size") + F.col("tokens_before") + F.col("earlier")).alias("before"),
    ).where("before < budget")

    inside = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64("card", "epoch", F.lit(seed + 2)), "id", "size")
    spent = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.join(blocks, ["key", "block"]).select(
        "row", "size", "epoch", "mix_block", "budget", (F.row_number().over(inside) - 1).cast("long").alias("place"),
        (F.col("before") + spent).alias("at"),
    ).where("at < budget")
    return out.select(
        "row.*", F.col("size").alias(names[0]), F.col("epoch").alias(names[1]), F.col("mix_block").alias(names[2]),
        F.col("place").alias(names[3]), (F.col("at") / F.col("budget")).alias(names[4]),
    )
