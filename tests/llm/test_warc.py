"""Archives: round trips, revisits, and reading without this library."""

import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows, least=1000):
    """(id, bytes, digest, type, refers_to) of each row."""
    bodies = [(html or "").encode() for _, _, html in rows]
    out = []
    for n, ((id, _, _), body) in enumerate(zip(rows, bodies)):
        group = [(-1 if rows[m][0] is None else rows[m][0], m) for m in range(len(rows)) if bodies[m] == body]
        top = max(group)[1]
        if len(body) < least or top == n:
            out.append((id, len(body), hashlib.sha1(body).hexdigest(), "response", None))
        else:
            out.append((id, len(body), hashlib.sha1(body).hexdigest(), "revisit", rows[top][0]))
    return sorted(out, key=str)


def read_back(index, **kind):
    return [(None if r["id"] is None else int(r["id"]), r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"] and int(r["refers_to"])) for r in warc.read(index, **kind).collect()]


def pages(n, seed=1):
    rng = random.Random(seed)
    words = ["nav", "<p>", "</p>", "über", "日本", "table", "stone", "river", "\r\n", "WARC/1.1"]
    return [(i, f"http://host{i % 7}.example/{i}", " ".join(rng.choices(words, k=rng.randint(0, 400)))) for i in range(n)]


def test_round_trip_with_revisits_and_odd_rows(spark):
    rows = pages(120)
    rows += [(200 + i, f"http://copy.example/{i}", rows[3][2] * 3) for i in range(40)]  # equal payloads
    rows += [(300, None, None), (301, "", ""), (302, "http://a b\r\nX: y", "x" * 999), (303, "u", "x" * 999), (304, "u", "y" * 1000), (304, "u", "y" * 1000)]
    rows += [(None, "n", "z" * 5000), (None, "n", "z" * 5000), (500, "m", "z" * 5000), (None, "n", "w" * 2000), (None, "n", "w" * 2000)]
    rows += [(400, "http://long.example", "long text " * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("row"), F.lit("k").alias("key"), F.lit(2).alias("id")).repartition(3)
    index = warc.write(frame)
    assert sorted(read_back(index), key=str) == expected(rows)
    # offsets and lengths of the index lead to single records
    some = index.where("id in (200, 304, 400)")
    texts = {r["id"]: r["payload"] for r in warc.fetch(some).collect() if r["type"] == "response"}
    assert bytes(texts["400"]).decode() == rows[-1][2] and "200" not in texts and bytes(texts["304"]) == b"y" * 1000
    whole = {r["id"]: bytes(r["payload"]).decode() for r in warc.read(index, payloads=True).where("type = 'response' and id < 120").collect()}
    assert whole == {str(i): html for i, _, html in rows[:120] if i != 3} | {"3": rows[3][2]}


def test_an_archive_needs_nothing_else(spark, tmp_path):
    rows = pages(3000, seed=2)
    index = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder=f"file://{tmp_path}/out", archive_bytes=300_000, sample_bytes=1 << 18)
    paths = sorted(r[0].removeprefix("file://") for r in index.select("path").distinct().collect())
    assert len(paths) > 1 and index.count() == 3000
    seen = 0
    for path in paths:
        raw = open(path, "rb").read()
        assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
        size = int.from_bytes(raw[4:8], "little")
        assert size > 1000 and raw[8:12] == bytes.fromhex("37a430ec")  # a trained dictionary
        assert raw[8 + size :][:4] == bytes.fromhex("28b52ffd")
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True).read()
        seen += plain.count(b"WARC-Type: response")
        without = sum(len(zstandard.ZstdCompressor(level=3).compress(b"WARC/1.1\r\n" + r)) for r in plain.split(b"WARC/1.1\r\nWARC-Type")[1:])
        assert len(raw) - size < without  # records are smaller with the dictionary
    assert seen == 3000


def test_nothing_and_damage(spark, tmp_path):
    empty = warc.write(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and warc.read(empty).count() == 0
    index = warc.write(spark.createDataFrame(pages(5), SCHEMA).coalesce(1), folder=str(tmp_path / "x"))
    path = index.first()["path"]
    raw = bytearray(open(path, "rb").read())
    raw[-9] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="(?i)checksum|corrupt|data|cut off|changed"):
        warc.read(index).collect()
    assert warc.train([]) == b"" and warc.train([b"a" * 100]) == b""


def test_many_repeated_payloads_take_the_shuffle_join(spark, monkeypatch):
    rows = [(i, "u", f"{i % 30}" * 600) for i in range(300)]
    monkeypatch.setattr("lodestone.llm.warc.broadcast_if_small", lambda df: df)
    assert sorted(read_back(warc.write(spark.createDataFrame(rows, SCHEMA))), key=str) == expected(rows)
