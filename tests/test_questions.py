import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import answers, citations, evidence, metrics, router, suppliers, vectors
from lodestone.plans import queries
from lodestone.plans.ask import ask, index_documents
from lodestone.session import broadcast_if_small

# The recorded questions. (question, intents, entities, sources)
GOLDENS = [
    ("What are common failure modes for Model X-7000 batteries in high-temperature environments?",
     "failure_modes hot telemetry", {"model": ["X-7000"]}, "sql document vector"),
    ("Which suppliers provide lithium cells for our commercial energy storage units?", "supply", {}, "sql vector"),
    ("Show me service history for equipment unit SN-4829 and related warranty claims", "service warranty",
     {"serial": ["SN-4829"]}, "sql document vector"),
    ("Show service history and warranty claims for equipment EQ-6269", "service warranty", {"equipment": ["EQ-6269"]}, "sql vector"),
    ("What does fault code ERR_INV_404 mean and which units reported it?", "telemetry", {"fault": ["ERR_INV_404"]}, "document vector"),
    ("Why is unit SN-C12-0055 raising cooling faults and what should the technician check?", "failure_modes service telemetry",
     {"serial": ["SN-C12-0055"]}, "sql document vector"),
    ("Which parts have a single-source supplier risk?", "supply", {}, "sql vector"),
    ("What are the emergency response steps for a confirmed thermal runaway event?", "hot procedure telemetry", {}, "vector"),
]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDENS)], "question_id long, question string")


def test_routes(questions):
    for row in router.route(questions).collect():
        _, intents, found, sources = GOLDENS[row.question_id]
        assert row.intents == intents.split() and row.sources == sources.split()
        assert {k: v for k, v in row.entities.asDict().items() if v} == found
    first = router.route(questions).filter("question_id = 0").first().route
    assert first == ("intents=['failure_modes', 'hot', 'telemetry']; entities: model=['X-7000']; "
                     "sources=['sql', 'document', 'vector']")


def test_models_get_a_dash_also_inside_serials(spark):
    df = spark.createDataFrame([("x5200 and SN-X7100-68449",)], "question string")
    assert router.route(df).first().entities.model == ["X-5200", "X-7100"]


def tables(spark):
    sql = {
        "customers": "SELECT 'C1' customer_id, 'Acme' company_name",
        "equipment_units": """SELECT * FROM VALUES ('EQ-6269', 'C1', 'X-7000', 'SN-C12-0055', date'2021-01-01',
            cast(50 as decimal(12,2)), date'2026-01-01', 'In Service') t(equipment_id, customer_id, model, serial_number,
            install_date, capacity_kw, warranty_expiration, status)""",
        "service_logs": """SELECT concat('DISP-', id) dispatch_id, 'EQ-6269' equipment_id, date_add(date'2024-01-01', cast(id as int))
            dispatch_date, 'T' technician, 'Diagnostic' service_type, cast(1.5 as decimal(10,2)) hours_spent,
            cast(20 as decimal(12,2)) labor_cost, 'Fixed' resolution_summary, 'Completed' status FROM range(7)""",
        "warranty_claims": """SELECT 'CLM-1' claim_id, 'EQ-6269' equipment_id, null dispatch_id, 'PRT-1' part_id, date'2024-02-02'
            claim_date, cast(10 as decimal(12,2)) claim_amount, cast(null as decimal(12,2)) approved_amount, 'Pending' status,
            '' denial_reason""",
        "parts_inventory": """SELECT * FROM VALUES ('PRT-1', ' Lithium Cell ', 'S1', 'M1', 3), ('PRT-2', 'Lithium Cell', 'S2', 'M1', 4),
            ('PRT-3', 'Fuse', 'S1', 'M2', 5) t(part_id, part_name, supplier, manufacturer, stock_quantity)""",
        "telemetry": """SELECT concat('TLM-', id) log_id, timestamp_seconds(1700000000 + id) timestamp, 'SN-C12-0055' equipment_id,
            'X-7000' model_code, 'On' status, CASE WHEN id % 2 = 0 THEN 'ERR_INV_404' END fault_code, 'High' severity,
            named_struct('voltage_v', 1.0D, 'current_a', 2.0D, 'temperature_c', 20.0D + id, 'soc_percent', 50.0D,
            'voltage_delta_mv', 1.0D) telemetry, array('P1') flagged_components, 'note' notes FROM range(5)""",
    }
    made = {name: spark.sql(text) for name, text in sql.items()}
    pages = spark.createDataFrame(
        [("d", "manual", "d.pdf", 1, "ERR_INV_404 means overcurrent. Check the fuse."), ("e", "manual", "e.pdf", 1, "Cooling pump service.")],
        "document_id string, document_type string, source_file string, page_number int, text string")
    made["collection"] = index_documents(pages)
    return made


@pytest.fixture(scope="module")
def asked(spark, questions):
    data = tables(spark)
    return ask(questions, data, F.lit("2025-01-01").cast("date")), data


def records(result, question, source):
    rows = result.evidence.filter((F.col("question_id") == question) & (F.col("source") == source)).orderBy("position").collect()
    return [(r.tag, r.record_id) for r in rows]


def test_evidence(asked):
    result, _ = asked
    assert result.errors == {}
    assert records(result, 2, "sql") == [("SQL1", "no matching row")]
    assert records(result, 2, "document") == [("MDB1", "no matching document")]
    assert records(result, 3, "sql") == [
        ("SQL1", "EQ-6269"), ("SQL2", "DISP-6"), ("SQL3", "DISP-5"), ("SQL4", "DISP-4"), ("SQL5", "DISP-3"), ("SQL6", "DISP-2"),
        ("SQL7", "CLM-1")]
    assert records(result, 4, "document") == [("MDB1", "TLM-4, TLM-2, TLM-0"), ("MDB2", "TLM-4"), ("MDB3", "TLM-2")]
    assert records(result, 4, "vector")[0] == ("VEC1", "d:p1:c1")
    assert records(result, 6, "sql") == [("SQL1", "PRT-3")]
    assert records(result, 1, "sql") == [("SQL1", "PRT-1, PRT-2")]
    assert records(result, 0, "document")[0] == ("MDB1", "TLM-4, TLM-2, TLM-0")
    text = result.evidence.filter("question_id = 3 AND tag = 'SQL7'").first().text
    assert text == ("Warranty claim CLM-1 on 2024-02-02 for EQ-6269: part PRT-1 ( Lithium Cell ), dispatch n/a, claimed $10.00, "
                    "approved $None, status Pending.")


def test_answers_and_verification(asked):
    result, data = asked
    answers = {r.question_id: r.answer for r in result.answers.collect()}
    assert answers[2].split("\n")[1] == (
        "- [SQL1] ERP lookup returned NO equipment_units record for SN-4829; this unit has no ERP service or warranty history on file.")
    checks = {r.question_id: r for r in result.citations.collect()}
    assert checks[2].used_tags[:2] == ["MDB1", "SQL1"] and checks[2].unknown_tags == []
    day = F.lit("2025-01-01").cast("date")
    for as_of in (day, None):
        verified = evidence.verify(result.evidence, data, as_of).collect()
        assert len(verified) == result.evidence.count() and all(r.verified for r in verified)
    runs = result.runs("20250101-000000")
    assert runs.count() == len(GOLDENS)
    report = {r.stage: r for r in metrics.stage_report(metrics.answered(runs)).collect()}
    assert set(report) == set(metrics.STAGES)
    assert report["total_ms"].p50 >= report["retrieval_ms"].p50 >= report["sql_ms"].p50 > 0
    assert metrics.slo(runs).first().runs == len(GOLDENS)


def test_false_counts_and_absent_tables_are_not_verified(spark, asked):
    result, data = asked
    fleets = result.evidence.filter("record_id like 'aggregate model=%'")
    assert fleets.count() > 0
    day = F.lit("2025-01-01").cast("date")

    def verdicts(rows, tables, as_of=day):
        return {r.verified for r in evidence.verify(rows, tables, as_of).collect()}

    assert verdicts(fleets, data) == {True}
    claims = result.evidence.filter("claim.about IN ('failures', 'claims', 'faults', 'stock')")
    assert {r.about for r in claims.select("claim.about").distinct().collect()} >= {"faults", "stock"}
    assert verdicts(claims, data) == {True}
    reworded = claims.withColumn("text", F.regexp_replace("text", r"(\d+) (times|claims, |units in stock)", "7$1 $2"))
    assert reworded.exceptAll(claims).count() == claims.count() and verdicts(reworded, data) == {False}
    fewer = data | {"telemetry": data["telemetry"].filter("log_id <> 'TLM-0'")}
    summary = claims.filter("claim.about = 'faults'")
    assert summary.count() > 0 and verdicts(summary, fewer) == {False}
    for said, other in ((": 1 units", ": 12 units"), ("1 in service", "0 in service"), ("1 still", "3 still")):
        wrong = fleets.withColumn("text", F.replace("text", F.lit(said), F.lit(other)))
        assert wrong.exceptAll(fleets).count() == fleets.count() and verdicts(wrong, data) == {False}
    later = fleets.withColumn("text", F.replace("text", F.lit("1 still"), F.lit("3 still")))
    assert verdicts(later, data, None) == {True}  # warranties are not compared without the day
    # A model that has no units verifies only if none are claimed.
    none = data | {"equipment_units": data["equipment_units"].filter("false")}
    assert verdicts(fleets, none) == {False}
    assert verdicts(fleets.withColumn("text", F.regexp_replace("text", r": 1 units, 1 in service, 1 still", ": 0 units, 0 in service, 0 still")), none) == {True}
    assert verdicts(fleets, {k: v for k, v in data.items() if k != "equipment_units"}) == {False}


def test_expected_document_comes_first(spark):
    """Each question finds the page that answers it."""
    texts = {
        "runaway.pdf": "Thermal runaway emergency: evacuate, isolate the battery cabinet and call the fire brigade.",
        "inverter.pdf": "Inverter overcurrent fault: inspect the fuse and the inverter output cable.",
        "warranty.pdf": "Warranty claims are approved when the equipment is within its coverage period.",
    }
    pages = spark.createDataFrame(
        [(n, "manual", n, 1, t) for n, t in texts.items()],
        "document_id string, document_type string, source_file string, page_number int, text string")
    collection = index_documents(pages, vectors.HashedTerms(512))
    questions = {
        "thermal runaway emergency in a battery cabinet": "runaway.pdf", "inverter overcurrent fault fuse": "inverter.pdf",
        "when are warranty claims approved": "warranty.pdf",
    }
    asked = vectors.embed(spark.createDataFrame([(q,) for q in questions], "text string"), vectors.HashedTerms(512))
    best = vectors.topk_exact(asked.withColumnRenamed("text", "query_id"), collection, 1).join(collection, "chunk_id")
    assert {r.query_id: r.source_file for r in best.collect()} == questions


def test_missing_source_is_reported(spark, questions):
    data = tables(spark)
    del data["telemetry"]
    result = ask(questions, data, F.lit("2025-01-01").cast("date"))
    assert result.errors == {"document": "missing tables: telemetry"}
    assert result.evidence.filter("source = 'document'").count() == 0


def test_failing_source_is_reported(spark, questions):
    data = tables(spark)
    data["telemetry"] = data["telemetry"].withColumn("fault_code", F.raise_error(F.lit("log store is down")).cast("string"))
    result = ask(questions, data, F.lit("2025-01-01").cast("date"))
    assert set(result.errors) == {"document"} and result.errors["document"].startswith("failed: ")
    assert {r.source for r in result.evidence.select("source").distinct().collect()} == {"sql", "vector"}
    assert result.answers.count() == len(GOLDENS)


def failing(spark):
    """The tables, of which the event log fails when it is read."""
    data = tables(spark)
    data["telemetry"] = data["telemetry"].withColumn("fault_code", F.raise_error(F.lit("log store is down")).cast("string"))
    return data


def test_gathered_evidence_is_whole_or_fails(spark, questions):
    routed, day = router.route(questions), F.lit("2025-01-01").cast("date")
    with pytest.raises(PySparkException, match="log store is down"):
        evidence.gather(routed, failing(spark), day)
    without = {name: df for name, df in tables(spark).items() if name != "telemetry"}
    with pytest.raises(ValueError, match="document: missing tables: telemetry"):
        evidence.gather(routed, without, day)


@pytest.mark.parametrize("name", ["verify_evidence", "evidence_tags", "extractive_answers", "prompt_context"])
def test_queries_fail_with_a_source(spark, questions, monkeypatch, name):
    monkeypatch.setattr(queries, "_tables", lambda *_: failing(spark))
    monkeypatch.setattr(queries, "_routed", lambda *_: router.route(questions))
    with pytest.raises(PySparkException, match="log store is down"):
        queries.QUERIES[name](spark, "nowhere").collect()


def test_units_are_found_by_both_ids_once(spark):
    units = spark.createDataFrame([("E1", "S1"), ("E2", "S2")], "equipment_id string, serial_number string")
    ids = spark.createDataFrame([(1, "E1"), (1, "S1"), (2, "S2"), (3, "zz")], "question_id long, id string")
    got = {(r.question_id, r.equipment_id) for r in evidence.find_units(units, ids).collect()}
    assert got == {(1, "E1"), (2, "E2")}


def test_citations(spark):
    cases = {
        "a【VEC2】": "a[VEC2]", "【MDB1†L3】": "[MDB1]", "x (SQL1).": "x [SQL1].", "[SQL 1]": "[SQL1]", "[SQL1, MDB2]": "[SQL1][MDB2]",
        "see MDB1 now": "see [MDB1] now", "[MD​B2]": "[MDB2]", "none (of it)": "none (of it)", "[SQL1][MDB2]": "[SQL1][MDB2]",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert [r[0] for r in df.select(citations.normalize(F.col("a"))).collect()] == list(cases.values())
    answer = "**Summary:**\n- The unit tripped twice today [SQL1][MDB10]\n- An unsupported longer statement\n- short [SQL1]\nBad tag in here, truly [VEC9]"
    rows = spark.createDataFrame([(1, answer)], "question_id long, answer string")
    tags = spark.createDataFrame([(1, "SQL1"), (1, "MDB10"), (1, "MDB2")], "question_id long, tag string")
    got = citations.check(rows, tags).first()
    assert (got.statements, got.cited_statements, got.unknown_tags, got.used_tags) == (3, 1, ["VEC9"], ["MDB10", "SQL1"])
    assert got.uncited == ["- An unsupported longer statement", "Bad tag in here, truly [VEC9]"]
    cited = {r.tag: r.cited for r in citations.provenance(tags, citations.check(rows, tags)).collect()}
    assert cited == {"SQL1": True, "MDB10": True, "MDB2": False}


def test_supplier_words(spark):
    df = spark.createDataFrame([("lithium battery cells",), ("single fuse",), ("parts",)], "q string")
    got = [r[0] for r in df.select(suppliers.question_fragments(F.col("q"))).collect()]
    assert got == [["Cell", "Lithium"], [], []]


def test_repairs_and_claims_are_joined_once(spark):
    """Counts and newest ids are read from one written join."""
    data = tables(spark)
    failures = evidence.model_failures(data["service_logs"], data["equipment_units"])
    claims = evidence.model_claims(data["warranty_claims"], data["equipment_units"])
    assert failures.inputFiles() and all("/repairs-" in name for name in failures.inputFiles())
    assert claims.inputFiles() and all("/claims-" in name for name in claims.inputFiles())
    assert [(r.model, r.n, r.examples) for r in failures.collect()] == [("X-7000", 7, "DISP-6, DISP-5, DISP-4")]
    assert [(r.model, r.status, r.n, r.examples) for r in claims.collect()] == [("X-7000", "Pending", 1, "CLM-1")]


@pytest.fixture(scope="module")
def crowd(spark):
    """Many questions about one fault code and one part name, units and parts to list, and the evidence with texts apart."""
    data = tables(spark)
    data["telemetry"] = data["telemetry"].crossJoin(spark.range(200).withColumnRenamed("id", "unit")).withColumn(
        "equipment_id", F.concat(F.lit("SN-U-"), "unit")).withColumn("log_id", F.concat("log_id", F.lit("-"), "unit")).drop("unit")
    data["parts_inventory"] = data["parts_inventory"].crossJoin(spark.range(300).withColumnRenamed("id", "n")).withColumn(
        "part_id", F.concat("part_id", F.lit("-"), "n")).drop("n")
    texts = [GOLDENS[i][0] for i in (1, 4, 6, 7)]
    asks = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)] + [(None, texts[0])], "question_id long, question string")
    routed = router.route(asks)
    return routed, data, evidence.gather(routed, data, F.lit("2025-01-01").cast("date"))[0]


def test_texts_that_questions_share_are_written_once(crowd):
    _, _, found = crowd
    shared = found.rows.filter("_body IS NOT NULL")
    assert shared.count() == 50 + 51 * 1 + 50 * 1 and shared.filter("text IS NOT NULL OR length(record_id) > 200").count() == 0
    assert found.texts.count() == shared.select("_body").distinct().count() == 3
    whole = found.whole()
    assert whole.count() == found.rows.count() and whole.filter("text IS NULL").count() == 0
    units = whole.filter("database = 'documents.telemetry' AND text LIKE 'Fault code%'").select("text").distinct().collect()
    assert len(units) == 1 and units[0].text.count("SN-U-") == 200
    parts = whole.filter("record_id LIKE 'PRT-1-0, %'").select("record_id").distinct().collect()
    assert len(parts) == 1 and len(parts[0].record_id.split(", ")) == 600


def test_shared_texts_are_the_same_with_and_without_broadcast(crowd, monkeypatch):
    _, _, found = crowd
    kept = [c for c in found.whole().columns if c != "claim"]
    rows = sorted(found.whole().select(kept).collect(), key=str)
    monkeypatch.setattr(evidence, "TASK_BYTES", 1 << 14)
    assert sorted(found.whole().select(kept).collect(), key=str) == rows
    monkeypatch.setattr(evidence, "BROADCAST_BYTES", -1)
    assert sorted(found.whole().select(kept).collect(), key=str) == rows


def test_verification_of_shared_rows_is_that_of_whole_rows(crowd):
    _, data, found = crowd
    day = F.lit("2025-01-01").cast("date")
    data = data | {"parts_inventory": data["parts_inventory"].filter("part_id <> 'PRT-1-7'")}
    columns = ["question_id", "tag", "records", "found", "verified"]
    apart = evidence.verify_apart(found, data, day).whole().filter("question_id IS NOT NULL").select(columns).collect()
    whole = evidence.verify(found.whole().filter("question_id IS NOT NULL"), data, day).select(columns).collect()
    assert sorted(apart) == sorted(whole) and {r.verified for r in apart} == {True, False}


def test_contexts_are_not_broadcast(crowd):
    routed, _, found = crowd
    prompts = answers.build_prompt(routed, found.whole())
    for joined in (prompts, answers.extractive(routed, found.whole())):
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=merge)" in plan
    assert prompts.filter("prompt LIKE '%SN-U-199%'").count() == 50


def test_files_hold_long_texts_that_rows_share_once(spark, crowd, monkeypatch, tmp_path):
    routed, data, found = crowd
    rows = sorted(str(r) for r in found.whole().drop("claim").collect())
    monkeypatch.setattr(evidence, "TASK_BYTES", 1 << 14)
    assert sorted(str(r) for r in found.whole(by_text=True).drop("claim").collect()) == rows
    # A text of two megabytes, which packing alone makes hardly shorter.
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 15)), lambda i: F.sha2(i.cast("string"), 256)), "")
    texts = evidence.materialize(found.texts.withColumn("text", F.concat("_body", long)))
    monkeypatch.setattr(evidence, "TASK_BYTES", 1 << 27)
    evidence.telemetry(routed, data)  # sets how the session writes
    evidence.Apart(found.rows, texts).whole(by_text=True).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.sum(F.length("text"))).first()[0] > 151 << 21
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 40 << 20


def test_prompts_of_shared_texts_are_those_of_whole_rows(crowd, monkeypatch):
    routed, _, found = crowd
    whole = answers.build_prompt(routed, found.whole()).select("question_id", "prompt").collect()
    apart = answers.build_prompt_apart(routed, found).select("question_id", "prompt")
    assert sorted(apart.collect(), key=str) == sorted(whole, key=str)
    # Texts come last, by broadcast: none of them is shuffled or sorted.
    plan = apart._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("rightHint=(strategy=broadcast)") < plan.index("collect_list")
    monkeypatch.setattr(evidence, "TASK_BYTES", 1 << 14)
    assert sorted(answers.build_prompt_apart(routed, found).select("question_id", "prompt").collect(), key=str) == sorted(whole, key=str)
    monkeypatch.setattr(evidence, "BROADCAST_BYTES", -1)
    assert sorted(answers.build_prompt_apart(routed, found).select("question_id", "prompt").collect(), key=str) == sorted(whole, key=str)


def test_vectors_of_questions_are_not_broadcast(spark, questions, monkeypatch):
    asked, search = [], vectors.search_containing
    monkeypatch.setattr(vectors, "search_containing", lambda pairs, *rest: asked.append(pairs) or search(pairs, *rest))
    found = evidence.vector(router.route(questions), tables(spark)["collection"], vectors.HashedTerms())
    assert found.count() > 0
    for frame in (asked[0], found):
        assert "rightHint=(strategy=merge)" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_frames_beyond_the_bound_are_joined_by_a_shuffle(spark):
    few = spark.range(10).withColumnRenamed("id", "key")
    for bound, join in ((10, "BroadcastHashJoin"), (9, "SortMergeJoin")):
        joined = spark.range(10).join(broadcast_if_small(few, bound), F.col("id") == F.col("key"))
        assert join in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10
