"""The cleaners and chunkers under names that SQL statements can use.

    register(spark)
    spark.sql("SELECT clean_phone(phone) FROM customers")
    spark.sql("SELECT * FROM chunk_sentences(TABLE(pages), 900, 180)")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession, functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from lodestone.functions import clean
from lodestone.operators import chunk


def _listed(values: list[str]) -> str:
    return ", ".join(f"r'{v}'" for v in values)


_SQUEEZED = f"trim(regexp_replace(value, r'{clean.SPACE}{{2,}}|[{clean._ODD_SPACE}]', ' '))"

# Bodies of the functions of one text value.
SCALARS = {
    "clean_squeeze": _SQUEEZED,
    "clean_tags": f"regexp_replace(value, r'{clean.TAG}', '')",
    "clean_missing": f"CASE WHEN upper({_SQUEEZED}) NOT IN ({_listed(clean.NULL_MARKERS)}) THEN {_SQUEEZED} END",
    "clean_phone": """CASE WHEN length(regexp_replace(value, '[^0-9]', '')) = 10
        THEN regexp_replace(regexp_replace(value, '[^0-9]', ''), r'^(\\d{3})(\\d{3})(\\d{4})$', r'$1-$2-$3') ELSE value END""",
    "clean_country": f"CASE WHEN upper(value) IN ({_listed(clean.US_NAMES)}) THEN 'US' ELSE upper(value) END",
    "clean_state": "upper(value)",
    "clean_title": r"""array_join(transform(regexp_extract_all(value, r'(\p{L}+|\P{L}+)', 1),
        run -> concat(upper(substring(run, 1, 1)), lower(substring(run, 2)))), '')""",
    "clean_date": "try_cast(" + "".join("regexp_replace(" for _ in clean.DATE_LAYOUTS) + "value"
    + "".join(f", r'^{pattern}$', r'{rewritten}')" for pattern, rewritten in clean.DATE_LAYOUTS) + " AS DATE)",
    "model_code": r"""CASE WHEN value RLIKE r'([A-Z])-?(\d{3,5})'
        THEN concat_ws('-', regexp_extract(value, r'([A-Z])-?(\d{3,5})', 1), regexp_extract(value, r'([A-Z])-?(\d{3,5})', 2))
        ELSE coalesce(value, '') END""",
    "strip_reasoning": r"regexp_replace(regexp_replace(value, r'(?s)<think>.*?</think>', ''), r'^\s+|\s+$', '')",
}
RETURNS = {"clean_date": "DATE"}


class _Chunks:
    """A row for each chunk of each page; pages come as a table with document_id, page_number and text, and may be partitioned.

    Further columns of the pages are handed on. ``size`` and ``overlap`` are constants.
    """

    cutter = staticmethod(chunk.windows)

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable or not {"document_id", "page_number", "text"} <= set(pages.dataType.names):
            raise ValueError("the first argument is TABLE(...) with document_id, page_number and text")
        if size is not None and overlap is not None and overlap.value >= size.value:
            raise ValueError("overlap must be smaller than the chunk size")
        schema = StructType().add("chunk_id", StringType()).add("chunk_index", LongType()).add("chunk_text", StringType())
        for field in pages.dataType:
            if field.name != "text":
                schema = schema.add(field.name, field.dataType)
        return AnalyzeResult(schema.add("chunk_size_characters", IntegerType()).add("overlap_characters", IntegerType()))

    def eval(self, pages: Row, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> Iterator[tuple]:
        if pages["text"] is None:
            return
        rest = [pages[name] for name in pages.__fields__ if name != "text"]
        for n, piece in enumerate(type(self).cutter(pages["text"], size, overlap), 1):
            yield (f"{pages['document_id']}:p{pages['page_number']}:c{n}", n, piece, *rest, size, overlap)


class SlidingChunks(_Chunks):
    pass


class SentenceChunks(_Chunks):
    cutter = staticmethod(chunk.packs)


def register(spark: SparkSession) -> None:
    """Temporary functions of this session: those of :data:`SCALARS`, ``decode_text``, ``chunk_sliding`` and ``chunk_sentences``."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS {RETURNS.get(name, 'STRING')} RETURN {body}")
    spark.udf.register("decode_text", clean._nfkc_then_unescape)
    spark.udtf.register("chunk_sliding", F.udtf(SlidingChunks, useArrow=True))
    spark.udtf.register("chunk_sentences", F.udtf(SentenceChunks, useArrow=True))
