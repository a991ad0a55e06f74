"""Column functions that normalise raw text values. Missing values are NULL throughout."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Markers that mean "missing", compared in upper case after trimming.
NULL_MARKERS = ["", "NULL", "N/A", "NA"]
# Spellings that mean the United States, compared in upper case.
US_NAMES = ["US", "USA", "U.S.", "UNITED STATES"]
# Traces of wrongly decoded text.
MOJIBAKE_MARKS = ["\ufffd", "Ã", "â"]
# Tag pattern, and every code point that counts as whitespace.
TAG = "<[^>]*>"
_ODD_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[ {_ODD_SPACE}]"
# Bytes of text that are Python strings at a time; the rest of a batch stays in Arrow, where a character takes no more than its bytes.
PIECE = 1 << 20


def _pieces(values: pa.Array) -> Iterator[pa.Array]:
    """Views of consecutive values, each of at most :data:`PIECE` bytes besides its first value."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(values), 0).cast(pa.int64())).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(values)]
    for start, end in pairwise(cuts):
        yield values.slice(start, end - start)


def _decoded(values: pa.Array, unescape_first: bool) -> Iterator[pa.Array]:
    def one(value: str) -> str:
        if unescape_first:
            return unicodedata.normalize("NFKC", html.unescape(value))
        return html.unescape(unicodedata.normalize("NFKC", value))

    for piece in _pieces(values):
        yield pa.array([None if v is None else one(v) for v in piece.to_numpy(zero_copy_only=False)], values.type)


@F.arrow_udf(StringType())
def _nfkc_then_unescape(values: pa.Array) -> pa.Array:
    return pa.concat_arrays(list(_decoded(values, unescape_first=False)))


@F.arrow_udf(StringType())
def _unescape_then_nfkc(values: pa.Array) -> pa.Array:
    return pa.concat_arrays(list(_decoded(values, unescape_first=True)))


@F.arrow_udf(StringType())
def _nfkc_then_unescape_long(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield from _decoded(values, unescape_first=False)


@F.arrow_udf(StringType())
def _unescape_then_nfkc_long(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield from _decoded(values, unescape_first=True)


def decode(col: Column, order: str = "nfkc_first", long: bool = False) -> Column:
    """NFKC and HTML entities. Plain ASCII values without ``&`` are not sent to Python.

    ``long`` texts are sent back piece by piece, so that no batch of results is held; each such column takes Python workers of its own.
    """
    needs = col.rlike(r"[&]|[^\x00-\x7f]")
    if order == "unescape_first":
        worker = _unescape_then_nfkc_long if long else _unescape_then_nfkc
    else:
        worker = _nfkc_then_unescape_long if long else _nfkc_then_unescape
    return F.coalesce(worker(F.when(needs, col)), col)


def strip_tags(col: Column) -> Column:
    return F.when(col.contains("<"), F.regexp_replace(col, TAG, "")).otherwise(col)


def squeeze(col: Column) -> Column:
    """Each run of whitespace becomes one blank; the ends are trimmed. Single blanks are not touched."""
    return F.trim(F.regexp_replace(col, f"{SPACE}{{2,}}|[{_ODD_SPACE}]", " "))


def is_missing(col: Column) -> Column:
    stripped = F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")
    return col.isNull() | F.upper(stripped).isin(NULL_MARKERS)


def text(col: Column, order: str = "nfkc_first", long: bool = False) -> Column:
    """Decoded, tag-free, single-spaced text; missing markers become NULL. ``long`` as in :func:`decode`."""
    value = _settle(decode(col, order, long))
    return F.when(~F.upper(value).isin(NULL_MARKERS), value)


def _settle(decoded: Column) -> Column:
    """Tags and whitespace. Values of plain characters only need their double blanks looked at."""
    odd = squeeze(F.regexp_replace(decoded, TAG, ""))
    plain = F.trim(F.when(decoded.contains("  "), F.regexp_replace(decoded, " {2,}", " ")).otherwise(decoded))
    return F.when(decoded.rlike("[^ -;=-~]"), odd).otherwise(plain)


def texts(cols: list[Column], order: str = "nfkc_first") -> Column:
    """:func:`text` of several columns as one array. The rule is planned once, not once per column."""
    # Two steps, as a value used twice in one step would be computed twice.
    values = F.transform(F.array(*[decode(c, order) for c in cols]), _settle)
    return F.transform(values, lambda v: F.when(~F.upper(v).isin(NULL_MARKERS), v))


# Accepted date layouts. Month and day may be unpadded; a time of day is dropped.
_Y, _M, _D = r"((?!0000)\d{4})", r"(1[0-2]|0?[1-9])", r"(3[01]|[12]\d|0?[1-9]| [1-9])"
_TIME = r"[Tt](?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d[Zz]"
DATE_LAYOUTS = [
    (f"{_Y}-{_M}-{_D}(?:{_TIME})?", "$1-$2-$3"),
    (f"{_Y}/{_M}/{_D}", "$1-$2-$3"),
    (f"{_M}/{_D}/{_Y}", "$3-$1-$2"),
    (f"{_M}-{_D}-{_Y}", "$3-$1-$2"),
]
_ANY_DATE = "^(?:" + "|".join(pattern for pattern, _ in DATE_LAYOUTS) + ")$"


def date(col: Column) -> Column:
    """The value as ``yyyy-MM-dd`` text, or NULL when no layout fits or the day does not exist."""
    iso = col
    for pattern, rewritten in DATE_LAYOUTS:
        iso = F.regexp_replace(iso, f"^{pattern}$", rewritten)
    padded = F.regexp_replace(iso, r"- ?(\d)(?=-|$)", "-0$1")
    return F.when(col.rlike(_ANY_DATE), padded.try_cast("date").cast("string"))


def date_error(col: Column, parsed: Column | None = None) -> Column:
    """Error text of a value that has no date; ``parsed`` is its date if that is already a column."""
    parsed = date(col) if parsed is None else parsed
    return F.when(col.isNotNull() & parsed.isNull(), F.concat(F.lit("unrecognized date: "), col))


def _bare_number(col: Column) -> Column:
    return F.regexp_replace(col, "[$,]", "")


def _shift_point(col: Column) -> Column:
    """A number with an exponent, written without it: the point moves in the text, so no digit is lost."""
    # As a function over an array of one value, the steps stay out of the generated code of the many plain numbers.
    return F.get(F.transform(F.array(col), _without_exponent), F.lit(0))


def _without_exponent(value: Column) -> Column:
    parts = r"^([+-]?)(\d*)\.?(\d*)[eE]([+-]?\d+)$"
    sign, whole, rest, power = (F.regexp_extract(value, parts, i) for i in range(1, 5))
    power = F.coalesce(power.try_cast("int"), F.lit(0))
    left = F.lpad(whole, F.greatest(F.length(whole), -power), "0")
    digits = F.concat(left, F.rpad(rest, F.greatest(F.length(rest), power), "0"))
    point = F.length(left) + power
    return F.concat(sign, F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))


def number(col: Column) -> Column:
    """Plain decimal notation without ``$``, ``,`` and idle zeros; NULL when it is not a number."""
    bare = F.trim(F.regexp_replace(col, "[$,_]", ""))
    power = bare.rlike("[eE]")
    digits = F.when(power, _shift_point(bare)).otherwise(bare)
    split = F.regexp_replace(digits, r"^\+?(-?)0*(\d*?)(?:\.(\d*?)0*)?$", "$1$2.$3")
    short = F.regexp_replace(F.regexp_replace(split, r"\.$", ""), r"^(-?)(?=\.|$)", "$10")
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$"), short)


def number_error(col: Column, parsed: Column | None = None) -> Column:
    parsed = number(col) if parsed is None else parsed
    bare = _bare_number(col)
    return F.when(
        col.isNotNull() & parsed.isNull() & (bare != ""), F.concat(F.lit("invalid numeric value: "), bare)
    )


def phone(col: Column) -> Column:
    digits = F.regexp_replace(col, "[^0-9]", "")
    dashed = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")
    return F.when(F.length(digits) == 10, dashed).otherwise(col)


def country(col: Column) -> Column:
    upper = F.upper(col)
    return F.when(upper.isin(US_NAMES), "US").otherwise(upper)


def title(col: Column) -> Column:
    """Upper case at the start of every run of letters, lower case elsewhere (``In-Progress``)."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))
    )
    return F.array_join(cased, "")


def state(col: Column) -> Column:
    return F.upper(col)


# ---- predicates used by profiles and checks


def has_html(col: Column) -> Column:
    return col.rlike(TAG)


def has_encoding_flag(col: Column) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(mark) for mark in MOJIBAKE_MARKS])


def extra_ws(col: Column) -> Column:
    """Value differs from its trimmed form."""
    return col != F.trim(col)


def untidy_ws(col: Column) -> Column:
    """Leading or trailing whitespace, or two whitespace characters in a row."""
    return col.rlike(f"^{SPACE}|{SPACE}$|{SPACE}{{2,}}")


def has_currency(col: Column) -> Column:
    return col.contains("$")


# Names of the date layouts in profile reports.
DATE_CLASSES = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "ISO timestamp"),
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{4}/\d{2}/\d{2}$", "YYYY/MM/DD"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-DD-YYYY"),
]


def date_format_class(col: Column) -> Column:
    value = squeeze(col)
    out = F.lit("Other")
    for pattern, name in reversed(DATE_CLASSES):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def or_default(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(default))


def any_contains(col: Column, words: list[str]) -> Column:
    """Disjunction of case-insensitive substring tests; TRUE when there are no words."""
    if not words:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.lower(col).contains(w.lower()) for w in words])
