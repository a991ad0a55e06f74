"""CSV with line breaks inside quotes, split anywhere, against Spark's own reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import bronze, quoted
from lodestone.sources.schemas import RAW_COLUMNS, all_text

HEADER = ",".join(RAW_COLUMNS["parts"])


def field(rng):
    word = "".join(rng.choices("ab ,xyzé", k=rng.randint(0, 8)))
    kind = rng.random()
    if kind < 0.25:
        return '"' + word + rng.choice(["\n", "\n\n", "\r\n", '""\n""', '\n,"",\n', '""', "\n" * 9]) + word + '"'
    if kind < 0.3:
        return '""'
    return word.replace(",", ";") + rng.choice(["", "", ' 5" pipe', '"'] if word.strip() else [""])


def content(rng, records):
    lines = []
    for i in range(records):
        lines.append(",".join([f"P{i}", *(field(rng) for _ in range(8))]))
        if rng.random() < 0.02:
            lines.append("")
    return "\n".join([HEADER, *lines]) + "\n"


@pytest.mark.parametrize("seed, split", [(1, 400), (2, 64), (3, 5000)])
def test_same_records_as_whole_files(spark, tmp_path, seed, split):
    rng = random.Random(seed)
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.csv", "b.csv", "c.csv"):
        (folder / name).write_bytes(content(rng, rng.choice([1, 40, 300])).encode())
    (folder / "d.csv").write_bytes(f"{HEADER}\n".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        mine = quoted.read(spark, str(folder), all_text("parts"))
        mine = sorted(map(tuple, mine.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = bronze.with_source_row(bronze.read_csv(spark, str(folder), "parts", split=False)).select("source_row", *RAW_COLUMNS["parts"])
    assert mine == sorted(map(tuple, whole.collect()))


def test_a_record_over_many_splits_and_an_open_quote(spark, tmp_path):
    long = "\n".join(f'line {i} of ""it"", with, commas' for i in range(300))
    body = f'{HEADER}\nP1,"{long}",c,m,s,1,2,3,4\nP2,x,c,m,s,1,2,3,4\n'
    (tmp_path / "parts.csv").write_text(body + 'P3,"never closed\nP4,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = quoted.records(spark, str(tmp_path / "parts.csv")).orderBy("source_row").collect()
        names = quoted.read(spark, str(tmp_path / "parts.csv"), all_text("parts")).where("source_row = 2").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.source_row for r in rows] == [2, 3, 4] and rows[2].text.startswith('P3,"never closed\nP4,x')
    assert names.part_name == long.replace('""', '"')


def test_states_of_lines(spark):
    cases = {  # line: (ends inside if it starts outside, if it starts inside)
        "": (False, True), "a,b": (False, True), '"': (True, False), '""': (False, True), '"""': (True, False), 'a,"': (True, False),
        'a"b,"c': (True, False), '"a",b': (False, True), '"a""': (True, False), '",': (True, False), '","': (False, True), ' "x': (False, False),
        '"a"b"c': (False, True),
    }
    frame = spark.createDataFrame([(line,) for line in cases], "value string")
    got = {r[0]: (r[1], r[2]) for r in frame.select("value", quoted.opens(F.col("value")), quoted.stays(F.col("value"))).collect()}
    for line, expected in cases.items():
        assert got[line][0] == expected[0], line
    deep = spark.range(1).select(F.repeat(F.lit('"",a""b,"x""y",'), 200_000).alias("value"))
    assert deep.select(quoted.opens(F.col("value")), quoted.stays(F.col("value"))).first() is not None  # no deep recursion


def test_many_tasks_read_one_file(spark, tmp_path):
    with open(tmp_path / "parts.csv", "w") as out:
        out.write(HEADER + "\n")
        for i in range(60_000):
            out.write(f'P{i},"two\nlines {i}",c,m,"s ""x""",1,2,3,4\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        rows = quoted.read(spark, str(tmp_path / "parts.csv"), all_text("parts"))
        wrong = rows.where("cast(substr(part_id, 2) as int) + 2 <> source_row or part_name <> concat('two\nlines ', substr(part_id, 2)) or supplier <> 's \"x\"'")
        assert rows.count() == 60_000 and wrong.count() == 0
        assert spark.read.text(str(tmp_path / "parts.csv")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
