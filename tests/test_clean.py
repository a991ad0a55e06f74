import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import clean, text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_text(spark):
    check(spark, clean.text, {
        " <b>A</b>  &amp;\tB\n": "A & B", "&lt;i&gt;x": "x", "a&nbsp; b": "a b", "Ｆｕｌｌ": "Full", "n/a": None,
        " null ": None, "": None, "&#xFF21;": "Ａ", None: None, "plain": "plain", "a b": "a b", "x &ampy": "x &y",
    })
    check(spark, lambda c: clean.text(c, "unescape_first"), {"&#xFF21;": "A"})


def test_date(spark):
    check(spark, clean.date, {
        "2024-01-05T10:20:30Z": "2024-01-05", "2024-1-5": "2024-01-05", "2024/02/29": "2024-02-29", "3/4/2021": "2021-03-04",
        "03-04-2021": "2021-03-04", "2021-02-30": None, "2024-001-05": None, "13/13/2020": None, "soon": None,
        "2024-01-05T25:00:00Z": None, "0000-01-01": None, None: None, "2024-01-05t1:2:3z": "2024-01-05",
    })
    assert apply(spark, clean.date_error, ["soon", "2024-01-05", None]) == ["unrecognized date: soon", None, None]


def test_number(spark):
    check(spark, clean.number, {
        "$1,234.50": "1234.5", "1e3": "1000", "007": "7", "0.00": "0", "-0.50": "-0.5", "100": "100", "5.": "5", ".5": "0.5",
        "+3": "3", "abc": None, "NaN": None, "1_000": "1000", "120.0100": "120.01", "1.2.3": None, "-0": "-0", None: None,
    })
    assert apply(spark, clean.number_error, ["$abc", "$5", None, "$"]) == ["invalid numeric value: abc", None, None, None]


def test_contacts(spark):
    check(spark, clean.phone, {"(555) 123-4567": "555-123-4567", "12345": "12345", "1-555-123-4567": "1-555-123-4567"})
    check(spark, clean.country, {"usa": "US", "U.S.": "US", "United States": "US", "Canada": "CANADA"})
    check(spark, clean.title, {"in-progress": "In-Progress", "UNDER review": "Under Review", "o'neil": "O'Neil"})


def test_profile_rules(spark):
    check(spark, clean.date_format_class, {
        "2024-01-05T10:20:30Z": "ISO timestamp", "2024-01-05": "YYYY-MM-DD", "2024/01/05": "YYYY/MM/DD",
        "01/05/2024": "MM/DD/YYYY", "01-05-2024": "MM-DD-YYYY", "1/5/2024": "Other",
    })
    check(spark, clean.is_missing, {" na ": True, None: True, "N/A": True, "nab": False})
    check(spark, clean.untidy_ws, {" a": True, "a  b": True, "a b": False, "a\n": True})
    check(spark, clean.has_encoding_flag, {"Ã©": True, "plain": False, "�": True})


def test_text_functions(spark):
    check(spark, lambda c: text.excerpt(c, 5), {"abcd efgh": "abcd...", "abc": "abc", "abcde": "abcde"})
    check(spark, text.model_code, {"Pack X5200 S": "X-5200", "Pack": "Pack", "Z-123 G-9": "Z-123", None: ""})
    check(spark, text.document_type, {"AB-SOP-1 x.pdf": "standard_operating_procedure", "AB-SUP-2.pdf": "supplier_report",
                                      "memo.pdf": "other"})
    check(spark, lambda c: text.document_type(c, "chunks"), {"AB-SUP-2": "supply_chain_report", "memo": "document"})
    check(spark, text.tokens, {"SN-X7 and Err_Inv_404, ok-": ["sn-x7", "and", "err_inv_404", "ok"]})
    check(spark, lambda c: text.strip_reasoning(c), {"<think>a\nb</think>\n yes ": "yes"})
    check(spark, text.first_id, {"A-1, A-2": "A-1"})


def test_any_contains(spark):
    df = spark.createDataFrame([("Lithium Cell",), ("Bolt",)], "p string")
    assert df.filter(clean.any_contains(F.col("p"), ["cell"])).count() == 1
    assert df.filter(clean.any_contains(F.col("p"), [])).count() == 2


@pytest.mark.parametrize("value", ["a b", "tidy", "x"])
def test_tidy_values_stay(spark, value):
    assert apply(spark, clean.squeeze, [value]) == [value]


def test_exponents_keep_every_digit(spark):
    cases = {
        "1e-13": "0.0000000000001", "1e30": "1" + "0" * 30, "-2.50e1": "-25", "1.2345e2": "123.45", ".5e1": "5", "5.e-1": "0.5",
        "+12e0": "12", "123456789012345678901234567890e2": "12345678901234567890123456789000", "1e": None, "e5": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string").select("v", clean.number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in frame.collect()} == cases


DECODERS = [
    (clean._nfkc_then_unescape, clean._nfkc_then_unescape_long, "Ａ"), (clean._unescape_then_nfkc, clean._unescape_then_nfkc_long, "A"),
]


@pytest.mark.parametrize("piece", [1, 7, 20, 1 << 20])
@pytest.mark.parametrize("values", [[], [None], [None, "a&amp;b", "", None, "ﬁ" * 9, "&#xFF21;", "&#x1F600;é", None], ["&lt;"] * 30])
def test_pieces_give_every_value(monkeypatch, values, piece):
    monkeypatch.setattr(clean, "PIECE", piece)
    for short, long, letter in DECODERS:
        plain = {None: None, "a&amp;b": "a&b", "": "", "ﬁ" * 9: "fi" * 9, "&#xFF21;": letter, "&#x1F600;é": "😀é", "&lt;": "<"}
        array = pa.array(values, pa.string())
        assert short.func(array).to_pylist() == [plain[v] for v in values]
        parts = list(long.func(iter([array, array])))
        assert [v for part in parts for v in part.to_pylist()] == [plain[v] for v in values * 2]
        assert all(sum(len(v.encode()) for v in part.to_pylist()[1:] if v) <= 2 * piece for part in parts)


def test_only_a_piece_of_a_batch_is_python_strings():
    # 16 MB of text, four bytes a character in Python: as a whole 64 MB, and as much for the results.
    batch = pa.array(["x &amp; y" * 500 + "😀"] * 3700, pa.string())
    for short, long, _ in DECODERS:
        tracemalloc.start()
        for part in long.func(iter([batch])):
            assert part.nbytes < 2 * clean.PIECE
        streamed = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert len(short.func(batch)) == len(batch)
        whole = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(streamed, whole) < 16 * clean.PIECE


def test_long_texts_come_back_in_pieces(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<p>é &amp;"), F.repeat(F.lit(" ab "), 400), F.col("id"))).alias("v"))
    found = rows.coalesce(1).select("id", "v", clean.text(F.col("v"), long=True).alias("long"), clean.text(F.col("v")).alias("short")).collect()
    assert len(found) == 3000
    for r in found:
        assert r.long == r.short == (None if r.v is None else "é &" + " ab" * 400 + f" {r.id}")


def test_clean_text_streams_pages(spark, tmp_path):
    from lodestone.plans.queries import QUERIES

    pages = [(1, "u", "<b>Café</b> &copy;\n"), (2, "u", None), (2, "u", " n/a "), (None, "u", "plain  text")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["clean_text"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "Café ©"), (2, None), (2, None), (None, "plain text")], key=str)
    # Results of a batch are not gathered: batches go to Python and pieces come back.
    assert "_long(" in out._jdf.queryExecution().executedPlan().toString()
