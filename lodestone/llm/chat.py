"""Chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of it in which their turns are the assistant's, all others are named
users', and the loss mask covers exactly the assistant's texts with their end marks. System turns stay system turns in
all renderings. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.tables import shuffle_partitions
from lodestone.session import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
PART_CHARS = 1 << 16


def _plain(text: Column) -> Column:
    """Text that cannot be read as a mark of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<\\|im_"))


def header(speaker: Column, participant: Column, system: tuple[str, ...]) -> Column:
    name = F.regexp_replace(_plain(speaker), r"\s", "_")
    user = F.when(speaker.isNull(), F.lit(f"{BEGIN}user\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), name, F.lit("\n")))
    return (
        F.when(speaker.isin(*system), F.lit(f"{BEGIN}system\n"))
        .when(speaker == participant, F.lit(f"{BEGIN}assistant\n"))
        .otherwise(user)
    )


def turns(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    system: tuple[str, ...] = ("system",),
) -> DataFrame:
    """One row for each turn and participant: conv, participant, n (place in the dialogue, from 0), piece, start, mask_start,
    mask_end. Positions are code points of the rendering; both mask columns are null where nothing is learned.

    Turns are in the order of (turn, role, text), so ties and repeated rows have a defined place; null turns come first.
    Messages without a role come from an unnamed user, who is no participant; null texts are empty; null conversation
    ids are one dialogue. A dialogue of system and unnamed turns alone has no rendering.

    A dialogue may be of any length: turns are cut into ranges, and sums over ranges give their offsets.
    """
    slim = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), _plain(F.col(text)).alias("text"))
    order = ["conv", "turn", "role", "text"]
    ranged = slim.repartitionByRange(shuffle_partitions(messages.sparkSession), *order).sortWithinPartitions(*order)
    # Written, so that ranges and numbers stay what they are. Numbers grow in the order of the dialogue.
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("number")), "turns")
    people = ranged.where(F.col("role").isNotNull() & ~F.col("role").isin(*system)).select(F.col("conv").alias("of"), F.col("role").alias("participant")).distinct()

    # Offsets are worked out without the texts.
    each = ranged.select("range", "number", "conv", "role", F.length("text").cast("long").alias("chars"))
    each = each.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    each = each.withColumn("head", F.length(header(F.col("role"), F.col("participant"), system)).cast("long"))
    each = each.withColumn("size", F.col("head") + F.col("chars") + len(END)).drop("chars")
    sums = each.groupBy("range", "conv", "participant").agg(F.sum("size").alias("sum"), F.count("*").alias("count"))
    earlier = Window.partitionBy("conv", "participant").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("range").alias("r"), F.col("conv").alias("c"), F.col("participant").alias("p"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("turns_before"),
    )
    inside = Window.partitionBy("range", "conv", "participant").orderBy("number")
    placed = each.withColumn("row", F.row_number().over(inside)).withColumn(
        "chars", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = placed.join(sums, (F.col("range") == F.col("r")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")))
    start = F.col("chars_before") + F.col("chars")
    own = F.col("role") == F.col("participant")
    placed = placed.select(
        "number", "participant", (F.col("turns_before") + F.col("row") - 1).alias("n"), start.alias("start"),
        F.when(own, start + F.col("head")).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).alias("mask_end"),  # the line break after the end mark is not learned
    )
    piece = F.concat(header(F.col("role"), F.col("participant"), system), "text", F.lit(END))
    return ranged.join(placed, "number").select(
        F.col("conv").alias(conv), "participant", "n", piece.alias("piece"), "start", "mask_start", "mask_end"
    )


def dialogues(rendered: DataFrame, conv: str = "conv_id", part_chars: int = PART_CHARS) -> DataFrame:
    """Renderings as texts, from ``turns``: conv, participant, part (from 0), n_turns, text, mask ("start:end" of the whole
    rendering, comma-joined). A rendering is one row up to ``part_chars`` code points; a longer one has a row for the turns
    that start in each such stretch, which join to the whole, so that no row is unbounded."""
    part = F.floor(F.col("start") / part_chars).cast("int")
    mask = F.concat_ws(":", F.col("mask_start").cast("string"), F.col("mask_end").cast("string"))
    rows = rendered.select(conv, "participant", part.alias("part"), F.struct("n", "piece", F.when(F.col("mask_start").isNotNull(), mask).alias("mask")).alias("turn"))
    grouped = rows.groupBy(conv, "participant", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select(
        conv, "participant", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("text"),
        F.array_join(F.filter(F.col("turns.mask"), lambda m: m.isNotNull()), ",").alias("mask"),
    )
