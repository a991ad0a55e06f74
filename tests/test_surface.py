"""Functions for SQL statements give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import clean, surface, text
from lodestone.operators import chunk

VALUES = [None, "", " N/A ", "  a \t b ", "<b>x</b>", "(555) 123-4567", "5551234567x9", "usa", "France", "in-progress ÉTÉ x1", "2024-1-5", "5/3/2024",
          "2024-02-30", "2024/12/01", "7-4-2024", "2024-01-02T03:04:05Z", "Pack X5200", "G-310 y", "none", "<think>a\nb</think> ok "]


def test_scalars(spark):
    surface.register(spark)
    spark.createDataFrame([(v,) for v in VALUES], "v string").createOrReplaceTempView("surface_values")
    frame = spark.table("surface_values")
    c = F.col("v")
    same = {
        "clean_squeeze": clean.squeeze(c), "clean_tags": clean.strip_tags(c), "clean_phone": clean.phone(c), "clean_country": clean.country(c),
        "clean_state": clean.state(c), "clean_title": clean.title(c), "clean_date": clean.date(c), "model_code": text.model_code(c),
        "strip_reasoning": text.strip_reasoning(c), "clean_missing": F.when(~F.upper(clean.squeeze(c)).isin(clean.NULL_MARKERS), clean.squeeze(c)),
    }
    assert set(same) == set(surface.SCALARS)
    for name, column in same.items():
        mine = [(r.v, None if r.x is None else str(r.x)) for r in spark.sql(f"SELECT v, {name}(v) AS x FROM surface_values").collect()]
        assert mine == [(r.v, r.x) for r in frame.select("v", column.alias("x")).collect()], name
    assert spark.sql("SELECT decode_text('a&amp;b ﬁ') AS x").first().x == "a&b fi"


def test_table_functions(spark):
    surface.register(spark)
    pages = [("d", 1, "One two. Three four! Five six? " * 20, "m"), ("d", 2, None, "m"), ("e", 1, "", "s"), ("e", 2, "short", "s")]
    spark.createDataFrame(pages, "document_id string, page_number int, text string, kind string").createOrReplaceTempView("surface_pages")
    for name, cutter in (("chunk_sliding", chunk.windows), ("chunk_sentences", chunk.packs)):
        expected = sorted((f"{d}:p{p}:c{n}", n, x, d, p, k, 60, 20) for d, p, t, k in pages if t is not None for n, x in enumerate(cutter(t, 60, 20), 1))
        for partition in ("", " PARTITION BY (document_id) ORDER BY (page_number)"):
            found = spark.sql(f"SELECT * FROM {name}(TABLE(surface_pages){partition}, 60, 20)")
            assert found.columns == ["chunk_id", "chunk_index", "chunk_text", "document_id", "page_number", "kind", "chunk_size_characters", "overlap_characters"]
            assert sorted(map(tuple, found.collect())) == expected
    with pytest.raises(Exception, match="overlap must be smaller"):
        spark.sql("SELECT * FROM chunk_sliding(TABLE(surface_pages), 10, 10)")
    with pytest.raises(Exception, match="the first argument"):
        spark.sql("SELECT * FROM chunk_sliding(TABLE(SELECT 1 AS x), 10, 5)")
