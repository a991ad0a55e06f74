"""Column functions for page text, tokens and answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions.clean import squeeze

# Token pattern; identifiers joined by - or _ stay whole.
TOKEN = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"

# Document type by the second dash-separated part of a file name.
DOCUMENT_TYPES = {
    "ECO": "engineering_change_order",
    "INC": "incident_report",
    "MAN": "manual",
    "SOP": "standard_operating_procedure",
    "SPEC": "specification",
}
# The two stages differ in the supplier type and in the fallback.
DOCUMENT_TYPE_VARIANTS = {
    "pages": {"SUP": "supplier_report", None: "other"},
    "chunks": {"SUP": "supply_chain_report", None: "document"},
}
# Fixed value: note added to an answer that was cut at the token limit.
TRUNCATION_NOTE = "\n\n*(Answer truncated at the token limit.)*"


def normalize_text(col: Column) -> Column:
    return squeeze(F.coalesce(col, F.lit("")))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), 0)


def document_type(file_name: Column, variant: str = "pages") -> Column:
    special = DOCUMENT_TYPE_VARIANTS[variant]
    names = {**DOCUMENT_TYPES, "SUP": special["SUP"]}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    code = F.try_element_at(F.split(file_name, "-"), F.lit(2))
    return F.coalesce(F.try_element_at(lookup, F.coalesce(code, F.lit(""))), F.lit(special[None]))


def excerpt(col: Column, n: int) -> Column:
    """The first ``n`` characters without trailing blanks, and ``...`` when that is not all."""
    head = F.rtrim(F.substring(col, 1, n))
    return F.when(F.length(col) > F.length(head), F.concat(head, F.lit("..."))).otherwise(head)


def first_id(col: Column) -> Column:
    return F.element_at(F.split(col, ","), 1)


def strip_reasoning(col: Column, truncated: Column | None = None) -> Column:
    """Drop ``<think>`` blocks; mark an answer that was cut at the limit."""
    body = F.regexp_replace(col, r"(?s)<think>.*?</think>", "")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    if truncated is None:
        return body
    return F.when(truncated, F.concat(body, F.lit(TRUNCATION_NOTE))).otherwise(body)


def model_code(col: Column) -> Column:
    """Short model code such as ``X-5200`` from a long model name; the input when there is none."""
    pattern = r"([A-Z])-?(\d{3,5})"
    found = F.concat_ws("-", F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2))
    return F.when(col.rlike(pattern), found).otherwise(F.coalesce(col, F.lit("")))
