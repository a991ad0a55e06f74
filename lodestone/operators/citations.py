"""Citation tags in answers: one spelling, coverage check and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Tag patterns, bracket styles around tag lists, and lines that are only headings.
TAG = r"\[((?:SQL|MDB|VEC)\d+)\]"
LOOSE_TAG = r"(SQL|MDB|VEC)\s?(\d+)"
BRACKETED = r"[【\[(]([^【】\[\]()]*?(?:SQL|MDB|VEC)\s?\d+[^【】\[\]()]*)[】\])]"
BARE_TAG = r"(?U)(?<![\[\w])(SQL|MDB|VEC)\s?(\d+)(?![\]\w])"
HEADING = r"^[*#\s]*(Summary|Recommended next step)[*:\s]*$"
DECORATION = r"\[[A-Z]+\d+\]|[*#\-:\s]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{2060}\x{feff}]"
# Fixed value: shorter lines are not statements.
MIN_STATEMENT = 15


def normalize(answer: Column) -> Column:
    """Every citation style rewritten as ``[SQL1][MDB2]``; invisible characters are dropped first."""
    text = F.regexp_replace(answer, ZERO_WIDTH, "")
    groups = F.regexp_extract_all(text, F.lit(BRACKETED), 0)
    between = F.split(text, BRACKETED, -1)

    def canonical(group: Column) -> Column:
        tags = F.regexp_extract_all(group, F.lit(LOOSE_TAG), 0)
        return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), F.regexp_replace(t, r"\s", ""), F.lit("]"))), "")

    rewritten = F.concat(F.transform(groups, canonical), F.array(F.lit("")))
    pieces = F.zip_with(between, rewritten, lambda plain, tags: F.concat(plain, tags))
    return F.regexp_replace(F.array_join(pieces, ""), BARE_TAG, "[$1$2]")


def tags_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), 1)


def statements(answer: Column) -> Column:
    """Lines that make a claim: long enough without decoration, and not a heading."""
    lines = F.transform(F.split(answer, LINE_BREAK), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))
    return F.filter(
        lines,
        lambda l: (F.length(F.regexp_replace(l, DECORATION, "")) > MIN_STATEMENT) & ~l.rlike(HEADING),
    )


def _tag_order(tags: Column) -> Column:
    """By source, then by number."""
    keyed = F.transform(
        F.array_distinct(tags),
        lambda t: F.struct(F.substring(t, 1, 3).alias("s"), F.substring(t, 4, 9).cast("int").alias("n"), t.alias("t")),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def check(answers: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """Statements, cited and uncited ones, invented tags and used tags per answer.

    An answer's evidence is a short list, so its tags are gathered per answer; the rest is computed
    inside the row.
    """
    valid = evidence.groupBy(key).agg(F.collect_set("tag").alias("_valid"))
    both = answers.join(valid, key, "left").withColumn(
        "_valid", F.coalesce("_valid", F.array().cast("array<string>"))
    )
    both = both.withColumn("_statements", statements(F.col("answer"))).withColumn("_used", tags_in(F.col("answer")))
    uncited = F.filter("_statements", lambda s: F.size(F.array_intersect(tags_in(s), F.col("_valid"))) == 0)
    return both.withColumn("uncited", uncited).select(
        key,
        F.size("_statements").alias("statements"),
        (F.size("_statements") - F.size("uncited")).alias("cited_statements"),
        "uncited",
        F.array_sort(F.array_except("_used", "_valid")).alias("unknown_tags"),
        _tag_order(F.array_intersect("_used", "_valid")).alias("used_tags"),
    )


def provenance(evidence: DataFrame, checked: DataFrame, key: str = "question_id") -> DataFrame:
    """Evidence rows with a flag for the ones an answer cites."""
    used = checked.select(key, F.explode("used_tags").alias("tag"), F.lit(True).alias("_cited"))
    return evidence.join(used, [key, "tag"], "left").withColumn(
        "cited", F.coalesce("_cited", F.lit(False))
    ).drop("_cited")
