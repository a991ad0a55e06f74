import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, enrich, ranking, upsert
from lodestone.session import materialize
from lodestone.sources import bronze, catalog, sinks, tables, telemetry
from lodestone.sources.schemas import RAW_COLUMNS

HEADER = ",".join(RAW_COLUMNS["parts"])


def test_csv_records_and_rows(spark, tmp_path):
    body = f'﻿{HEADER}\r\nP1," a ""q"" ",c,m,s,1,2,3,4\r\nP2,"two\r\nlines",c,m,s,,2,3,4\r\n\r\nP3,x,c,m,s,1,2,3,4\r\n'
    (tmp_path / "parts.csv").write_bytes(body.encode())
    rows = bronze.with_source_row(bronze.read_csv(spark, str(tmp_path / "parts.csv"), "parts")).orderBy("source_row").collect()
    assert [(r.source_row, r.part_id) for r in rows] == [(2, "P1"), (3, "P2"), (4, "P3")]
    assert rows[0].part_name == ' a "q" ' and rows[1].part_name.split() == ["two", "lines"]


def test_row_numbers_over_many_splits(spark, tmp_path):
    lines = [f"P{i},name {i},c,m,s,1,2,3,4" for i in range(20_000)]
    (tmp_path / "parts.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = bronze.read_csv(spark, str(tmp_path / "parts.csv"), "parts", multiline=False)
        assert raw.rdd.getNumPartitions() > 4
        wrong = bronze.with_source_row(raw).filter(F.expr("cast(substr(part_id, 2) as int) + 2 <> source_row"))
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ndjson(spark, tmp_path):
    good = {"log_id": "T1", "timestamp": "2024-01-01T00:00:00Z", "model": "Pack X5200", "telemetry": {"temperature_c": 5}}
    rows = [json.dumps(good), "", "{broken", json.dumps({"timestamp": "2024-01-01T00:00:00Z"}),
            json.dumps({"log_id": "T2", "timestamp": "noon"}), json.dumps({**good, "log_id": "T3", "fault_code": "E"}), "[1]"]
    (tmp_path / "t.json").write_text("\n".join(rows) + "\n")
    ok, bad = telemetry.read_ndjson(spark, str(tmp_path / "t.json"))
    got = {r.log_id: (r.source.line, r.model_code, r.telemetry.temperature_c) for r in ok.collect()}
    assert got == {"T1": (1, "X-5200", 5.0), "T3": (6, "X-5200", 5.0)}
    assert {(r.source.line, r.problem) for r in bad.collect()} >= {
        (3, "undecodable line"), (4, "missing log_id"), (5, "bad timestamp")}
    assert bad.count() == 4


def test_publish_keeps_complete_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_published(spark, path) is None
    assert tables.publish(spark.range(3), path) == 1
    assert tables.publish(spark.range(5), path) == 2
    (tmp_path / "t" / "version=3").mkdir()
    assert tables.read_published(spark, path).count() == 5


def test_upsert_last_wins_and_counts(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, line int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "k string, v int, line int")
    out = upsert.replace_by_key(target, batch, "k", [F.col("line").desc()])
    assert {(r.k, r.v) for r in out.collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert tuple(upsert.replace_counts(target, batch, "k", 2).first()) == (1, 1, 2)


def test_payloads_keep_ids(spark, tmp_path):
    logs = spark.createDataFrame([(f"D{i}", "E1") for i in range(3)], "dispatch_id string, equipment_id string").selectExpr(
        "*", "date'2024-01-01' dispatch_date", "null technician", "'x' service_type", "' a  b ' resolution_summary", "'s' status")
    units = spark.createDataFrame([("E1", "M", "C1")], "equipment_id string, model string, customer_id string")
    path = str(tmp_path / "payloads")
    assert enrich.prepare_payloads(spark, logs.filter("dispatch_id > 'D0'"), units, path).first()[0] == 2
    before = {r.dispatch_id: r.payload_id for r in tables.read_published(spark, path).collect()}
    assert enrich.prepare_payloads(spark, logs, units, path).first()[0] == 3
    after = {r.dispatch_id: r for r in tables.read_published(spark, path).collect()}
    assert before == {"D1": 1, "D2": 2} and {k: r.payload_id for k, r in after.items()} == {"D1": 1, "D2": 2, "D0": 3}
    assert after["D0"].payload_text.split("\n")[-1] == "CLEANED_RESOLUTION: a b"
    view = enrich.safe_view(logs, units.withColumn("serial_number", F.lit("S")))
    assert not {"customer_id", "labor_cost", "claim_amount"} & set(view.columns)
    view.createOrReplaceTempView("safe")
    assert catalog.columns(spark, "safe")[2] == "equipment_model" and "safe" in catalog.tables(spark)


def test_surrogate_ids_are_consecutive(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    ids = ranking.surrogate_id(df, ["k"], "n", start=11, partitions=7).orderBy("n").collect()
    assert [r.n for r in ids] == list(range(11, 1011))
    assert [r.k for r in ids] == sorted(r.k for r in ids)


def test_history_is_append_only(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(1, "x")], "audit_id long, record_id string")
    audit.append(path, rows)
    with pytest.raises(PermissionError, match="append-only; updates"):
        audit.append(path, rows)
    with pytest.raises(PermissionError, match="append-only; deletes"):
        audit.delete(path)
    audit.append(path, rows.withColumn("audit_id", F.lit(2).cast("long")))
    assert audit.read(spark, path).count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, "a", None), (3, "why", None, 'q"x')],
                                 "source_row int, rejection_reason string, k string, v string")
    sinks.write_rejected(rows, str(tmp_path / "r"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r"))
    assert back.columns == ["source_row", "rejection_reason", "k", "v"] and back.filter("v = 'q\"x'").count() == 1
    for run in ("20240101-000000", "20240201-000000"):
        sinks.append_run(spark.createDataFrame([(run, 1)], "run_id string, n int"), str(tmp_path / "runs"))
    runs = spark.read.json(str(tmp_path / "runs"))
    assert sinks.latest_run(runs).first().run_id == "20240201-000000"
    assert sinks.latest_run(runs, "20240101-000000").count() == 1


def test_contexts_are_written_behind_the_join(spark):
    """The join of payloads and of the view moves short columns, not the texts made of them."""
    logs = spark.range(3).selectExpr(
        "concat('D', id) dispatch_id", "concat('E', id) equipment_id", "date'2024-01-01' dispatch_date", "'T' technician",
        "'Diagnostic' service_type", "'Done' resolution_summary", "'Completed' status")
    units = spark.range(3).selectExpr("concat('E', id) equipment_id", "'M' model", "'C' customer_id", "'S' serial_number")
    for out in (enrich.payloads(logs, units), enrich.safe_view(logs, units)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Service Date" in plan and "Service Date" not in plan[plan.index("Join "):]
        assert out.count() == 3


def test_ranges_are_packed(spark):
    from lodestone.operators import ranking

    placed = ranking.ranged(spark.range(10), ["id"], 2)
    assert all(name.endswith(".zstd.parquet") for name in placed.inputFiles())


def test_written_stages_leave_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = files(), spark.conf.get(setting, None)
    counts = spark.range(1000).groupBy(F.col("id") % 7).count()
    stage = materialize(counts, "counts")
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting, None) == kept
    assert stage.agg(F.sum("count")).first()[0] == 1000
