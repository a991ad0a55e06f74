"""Registered queries: every operator over the benchmark tables or tables derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.functions import clean, text, vector
from lodestone.operators import (
    answers, audit, bm25, chunk, citations, enrich, evidence, marts, metrics, profile, quality, ranking,
    router, silver, suppliers, telemetry as tel, upsert, vectors,
)
from lodestone.plans.cleanse import cleanse
from lodestone.plans.derive import frame, raw_tables, read, silver_tables, telemetry
from lodestone.session import materialize
from lodestone.sources import documents, telemetry as telemetry_source
from lodestone.sources.schemas import AUDIT_FIELDS, RAW_FOREIGN_KEYS, RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed reference day of warranty checks.
AS_OF = "2000-06-30"
# Fixed value: copies of the service log in the analytics snapshot.
SNAPSHOT_COPIES = 100
# Base tables of the row-count report.
COUNTED = ["customer", "orders", "lineitem", "part", "supplier", "events", "documents"]


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _double(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 2).alias(name)


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ---- roll-up and snapshot


@register
def service_rollup(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", F.col("l_quantity").cast("decimal(10,2)").alias("hours"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("cost"),
    )
    out = marts.ordered_rollup(marts.service_rollup(lines, "l_returnflag", "l_shipdate", "hours", "cost"))
    return out.select(
        "service_type", _long("service_year"), _long("service_month"), "dispatch_count", _double("total_hours"),
        _double("total_labor_cost"), _double("avg_labor_cost"),
    )


@register
def snapshot_rollup(spark, sf_dir):
    copies = marts.snapshot(frame(spark, sf_dir, "service_logs"), SNAPSHOT_COPIES)
    out = marts.service_rollup(copies)
    return out.select(
        "service_type", _long("service_year"), _long("service_month"), "dispatch_count", _double("total_hours"),
        _double("total_labor_cost"),
    )


@register
def snapshot_verify(spark, sf_dir):
    # Written once, as both the copies and their check read the logs.
    logs = materialize(frame(spark, sf_dir, "service_logs").select(*marts.SNAPSHOT_COLUMNS), "logs", "zstd")
    original = marts.snapshot(logs, SNAPSHOT_COPIES)
    out = marts.verify_copy(original, materialize(original, "snapshot"))
    return out.select(
        "original_rows", "copy_rows", _double("original_total_labor"), _double("copy_total_labor"), "matches"
    )


# ---- profile


@register
def row_counts(spark, sf_dir):
    return profile.row_counts({t: read(spark, sf_dir, t) for t in COUNTED})


@register
def value_counts(spark, sf_dir):
    return profile.value_counts(frame(spark, sf_dir, "raw_equipment"), "install_date", 15)


@register
def duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register
def duplicate_profile(spark, sf_dir):
    return profile.duplicates(frame(spark, sf_dir, "raw_dispatches"), "dispatch_id")


@register
def column_profile(spark, sf_dir):
    reports = [
        profile.columns(df.drop("source_row")).select(F.lit(name).alias("table_name"), "*")
        for name, df in raw_tables(spark, sf_dir).items()
    ]
    reports.append(
        profile.columns(read(spark, sf_dir, "pages"), ["url", "html"]).select(F.lit("pages").alias("table_name"), "*")
    )
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def _per_table(spark: SparkSession, sf_dir: str, report: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """A report on each raw table that has columns for it."""
    reports = []
    for name, df in raw_tables(spark, sf_dir).items():
        found = report(df.drop("source_row"))
        if found is not None:
            reports.append(found.select(F.lit(name).alias("table_name"), "*"))
    return evidence.union(*reports)


@register
def date_formats(spark, sf_dir):
    return _per_table(spark, sf_dir, profile.date_formats)


@register
def status_values(spark, sf_dir):
    return _per_table(spark, sf_dir, profile.statuses)


@register
def currency_symbols(spark, sf_dir):
    return _per_table(spark, sf_dir, profile.currency_symbols)


@register
def untrimmed_rows(spark, sf_dir):
    return _per_table(spark, sf_dir, lambda df: profile.untrimmed_rows(df, df.columns))


@register
def table_sample(spark, sf_dir):
    return profile.sample(read(spark, sf_dir, "customer"), ["c_name"], 5)


@register
def bronze_csv(spark, sf_dir):
    """Parts written as CSV files, some names with line breaks and quotes, and read back as text with their numbers."""
    from lodestone.session import scratch
    from lodestone.sources import bronze, sinks

    path = scratch(spark, "parts")
    broken = F.when(F.col("source_row") % 7 == 0, F.concat(F.col("part_name"), F.lit('\nand "more",\n'))).otherwise(F.col("part_name"))
    parts = frame(spark, sf_dir, "raw_parts").withColumn("part_name", broken)
    sinks.write_csv(parts.repartitionByRange(4, "source_row").sortWithinPartitions("source_row").drop("source_row"), path)
    rows = bronze.read_csv(spark, path, "parts")
    return rows.select("part_id", "part_name", "supplier", "unit_cost", _long("source_row"))


# ---- cleaners


@register
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "pages", heavy=True).select("page_id", clean.text(F.col("html"), long=True).alias("body"))


@register
def clean_date(spark, sf_dir):
    raw = frame(spark, sf_dir, "raw_customers")
    return raw.select(
        "source_row", clean.date(F.col("created_date")).alias("created_date"),
        clean.date_error(F.col("created_date")).alias("problem"),
        clean.date_format_class(F.col("created_date")).alias("layout"),
    )


@register
def clean_number(spark, sf_dir):
    raw = frame(spark, sf_dir, "raw_dispatches")
    return raw.select(
        "source_row", "dispatch_id", clean.number(F.col("labor_cost")).alias("labor_cost"),
        clean.number_error(F.col("labor_cost")).alias("problem"),
    )


@register
def clean_contacts(spark, sf_dir):
    raw = frame(spark, sf_dir, "raw_customers").select(
        "source_row", *[clean.text(F.col(c)).alias(c) for c in ("phone", "country", "state", "status")]
    )
    return raw.select(
        "source_row", clean.phone(F.col("phone")).alias("phone"), clean.country(F.col("country")).alias("country"),
        clean.state(F.col("state")).alias("state"), clean.title(F.col("status")).alias("status"),
    )


# ---- cleansing with quarantine


def _cleansed(spark: SparkSession, sf_dir: str, *tables: str):
    raw = raw_tables(spark, sf_dir)
    return cleanse({t: raw[t] for t in tables or raw})


@register
def sql_cleaners(spark, sf_dir):
    """The cleaners of ``clean_contacts`` as SQL functions."""
    from lodestone.functions import surface

    surface.register(spark)
    frame(spark, sf_dir, "raw_customers").createOrReplaceTempView("contacts_to_clean")
    tidy = ", ".join(f"clean_missing(clean_tags(decode_text({c}))) AS {c}" for c in ("phone", "country", "state", "status"))
    return spark.sql(f"""SELECT source_row, clean_phone(phone) AS phone, clean_country(country) AS country, clean_state(state) AS state,
        clean_title(status) AS status FROM (SELECT source_row, {tidy} FROM contacts_to_clean)""")


@register
def cleanse_customers(spark, sf_dir):
    return _cleansed(spark, sf_dir, "customers").marked["customers"]


@register
def cleanse_equipment(spark, sf_dir):
    return _cleansed(spark, sf_dir, "customers", "equipment").marked["equipment"]


@register
def cleanse_dispatches(spark, sf_dir):
    return _cleansed(spark, sf_dir, "customers", "equipment", "dispatches").marked["dispatches"]


@register
def cleanse_parts(spark, sf_dir):
    return _cleansed(spark, sf_dir, "parts").marked["parts"]


@register
def cleanse_claims(spark, sf_dir):
    return _cleansed(spark, sf_dir).marked["warranty_claims"]


@register
def dedupe_completeness(spark, sf_dir):
    rules = RULES["dispatches"]
    cleaned = quality.clean_table(frame(spark, sf_dir, "raw_dispatches"), rules)
    full = quality.completeness(c for c in cleaned.columns if c not in ("source_row", "rejection_reason"))
    # A row's key and the number of its values are all that repeated keys are settled by.
    marked = materialize(cleaned.select("source_row", "rejection_reason", rules.key, full.alias("_full")), "cleaned", "zstd")
    kept, lost = quality.dedupe(marked, rules.key, F.col("_full"))
    return kept.select("dispatch_id", "source_row", F.lit("kept").alias("outcome")).unionByName(
        lost.select("dispatch_id", "source_row", F.col("rejection_reason").alias("outcome"))
    )


@register
def cleaning_summary(spark, sf_dir):
    return cleanse(raw_tables(spark, sf_dir)).summary()


@register
def rejection_reasons(spark, sf_dir):
    result = _cleansed(spark, sf_dir)
    out = None
    for name in result.marks:
        part = quality.reasons(result.marks[name]).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@register
def reconcile(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    result = cleanse(raw)
    return quality.reconcile(
        raw, {t: result.silver(t) for t in raw}, {t: result.rejected(t) for t in raw}
    )


@register
def residual_checks(spark, sf_dir):
    """What is left in the tables after all of them went through cleansing."""
    result = _cleansed(spark, sf_dir)
    customers, dispatches = result.accepted("customers"), result.accepted("dispatches")
    return quality.residual_checks([
        ("HTML remaining in customer company names", customers, clean.has_html(F.col("company_name"))),
        ("invalid customer created dates", customers, F.col("created_date").isNull()),
        ("HTML remaining in service summaries", dispatches, clean.has_html(F.col("resolution_summary"))),
        ("service logs without resolution", dispatches, F.col("resolution_summary").isNull()),
        ("HTML in raw pages", read(spark, sf_dir, "pages"), clean.has_html(F.col("html"))),
    ])


@register
def orphans(spark, sf_dir):
    """All relationships of the raw tables, before anything is cleansed; ids are trimmed."""
    tables = {
        name: df.select(*[F.trim(c).alias(c) for c in df.columns if c.endswith("_id")])
        for name, df in raw_tables(spark, sf_dir).items()
    }
    return quality.orphans(tables, RAW_FOREIGN_KEYS)


@register
def silver_service_logs(spark, sf_dir):
    marked = quality.clean_table(frame(spark, sf_dir, "raw_dispatches"), RULES["dispatches"])
    typed = silver.cast_to_schema(quality.accepted(marked), "service_logs")
    return typed.select(
        "dispatch_id", "equipment_id", "dispatch_date", "technician", "service_type", _double("hours_spent"),
        _double("labor_cost"), "resolution_summary", "status",
    )


@register
def silver_constraints(spark, sf_dir):
    wide = frame(spark, sf_dir, "raw_parts").select(
        "part_id", F.nullif("part_name", F.lit("red bolt")).alias("part_name"), "category",
        F.repeat("manufacturer", 20).alias("manufacturer"), "supplier", "unit_cost", "unit_price",
        "stock_quantity", "reorder_level",
    )
    return silver.check_constraints(wide, "parts_inventory").select("part_id", "rejection_reason")


# ---- context, payloads, view, change history


@register
def service_context(spark, sf_dir):
    logs = frame(spark, sf_dir, "service_logs")
    return logs.select("dispatch_id", enrich.service_context().alias("rag_service_context"))


@register
def payloads(spark, sf_dir):
    out = enrich.payloads(
        frame(spark, sf_dir, "service_logs"), frame(spark, sf_dir, "equipment_units"),
        F.lit("2024-01-01").cast("date"),
    )
    return out


@register
def payload_upsert(spark, sf_dir):
    logs, units = frame(spark, sf_dir, "service_logs"), frame(spark, sf_dir, "equipment_units")
    first = enrich.payloads(logs.filter("service_type = 'Diagnostic'"), units, F.lit("2024-01-01").cast("date"))
    stored = upsert.by_key(None, first, "dispatch_id", "payload_id")
    stored = materialize(stored, "payloads", "zstd")
    second = enrich.payloads(logs.filter("status = 'Completed'"), units, F.lit("2024-02-01").cast("date"))
    merged = upsert.by_key(stored, second, "dispatch_id", "payload_id")
    return merged.select(_long("payload_id"), "dispatch_id", "equipment_id", "prepared_at")


@register
def payload_stats(spark, sf_dir):
    return enrich.payload_stats(payloads(spark, sf_dir))


@register
def safe_view(spark, sf_dir):
    return enrich.safe_view(frame(spark, sf_dir, "service_logs"), frame(spark, sf_dir, "equipment_units"))


def _log_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Service logs before and after a day of work: some closed, some new, some untouched."""
    logs = frame(spark, sf_dir, "service_logs")
    old = logs.filter("service_type <> 'Emergency Repair'")
    closed = F.when(F.col("status") == "In Progress", "Completed").otherwise(F.col("status"))
    return old, logs.withColumn("status", closed)


@register
def audit_capture(spark, sf_dir):
    old, new = _log_states(spark, sf_dir)
    entries = audit.capture(old, new, user=F.lit("loader"), ts=F.lit("2024-01-01").cast("date"))
    return entries.select(
        "record_id", "database_user", "table_name", "operation_type", "change_description",
        *(
            F.get_json_object(f"{when}_values", f"$.{f}").cast("double" if f in ("hours_spent", "labor_cost") else "string").alias(f"{when}_{f}")
            for when in ("old", "new") for f in AUDIT_FIELDS
        ),
        F.json_object_keys("new_values").cast("string").alias("keys"),
    )


@register
def audit_change_feed(spark, sf_dir):
    old, new = _log_states(spark, sf_dir)
    feed = new.select("*", F.lit(1).alias("seq")).unionByName(
        new.filter("resolution_summary IS NULL").select(
            *[c for c in new.columns if c != "resolution_summary"], F.lit("Closed on site").alias("resolution_summary"),
            F.lit(2).alias("seq"),
        )
    )
    entries = audit.capture_changes(old, feed, ["seq"], user=F.lit("loader"), ts=F.lit("2024-01-01").cast("date"))
    # The place of an entry in its record's history, by the numbers given to the entries.
    place = F.row_number().over(Window.partitionBy("record_id").orderBy("audit_id")).cast("bigint")
    return audit.number_entries(entries, order=["seq"]).select(
        "record_id", "operation_type", place.alias("place"), F.col("event_timestamp").cast("string").alias("at"),
        F.get_json_object("old_values", "$.status").alias("old_status"),
        F.get_json_object("new_values", "$.status").alias("new_status"),
        F.get_json_object("new_values", "$.resolution_summary").alias("new_resolution"),
    )


@register
def surrogate_ids(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ranking.surrogate_id(orders, ["o_orderdate", "o_orderkey"], "row_id", partitions=16).select(
        _long("row_id"), "o_orderkey"
    )


# ---- telemetry


@register
def fault_summary(spark, sf_dir):
    out = tel.fault_summary(telemetry(spark, sf_dir))
    return out.select(
        "fault_code", "events", "n_units", "max_temperature", F.round("avg_temperature", 6).alias("avg_temperature"),
        "first_ts", "last_ts", "units", "latest_ids", "components", "latest_note",
    )


@register
def fault_summary_by_model(spark, sf_dir):
    out = tel.fault_summary(telemetry(spark, sf_dir), ["model_code"], 2)
    return out.select("model_code", "fault_code", "events", "n_units", "max_temperature", "latest_ids", "components")


@register
def fault_counts(spark, sf_dir):
    return tel.fault_counts(telemetry(spark, sf_dir))


@register
def fault_units(spark, sf_dir):
    return tel.fault_units(telemetry(spark, sf_dir))


@register
def latest_readings(spark, sf_dir):
    out = ranking.latest(telemetry(spark, sf_dir), ["equipment_id"], tel.newest_first(), 5, "position")
    return out.select("equipment_id", "log_id", _long("position"))


@register
def unit_events(spark, sf_dir):
    return tel.unit_events(telemetry(spark, sf_dir)).select("equipment_id", "log_id", _long("position"))


@register
def hottest_faults(spark, sf_dir):
    out = tel.hottest(telemetry(spark, sf_dir), ["model_code"])
    return out.select("model_code", "log_id", F.col("telemetry.temperature_c").alias("temperature_c"), _long("position"))


@register
def telemetry_counts(spark, sf_dir):
    severe = F.col("severity").isin("Critical", "Fatal", "High") & F.col("fault_code").isNotNull()
    return tel.count(telemetry(spark, sf_dir), severe, ["model_code"])


@register
def telemetry_models(spark, sf_dir):
    joined = tel.join_model(telemetry(spark, sf_dir), frame(spark, sf_dir, "equipment_units"))
    return joined.groupBy("model_code", "erp_units", "first_install").agg(F.count("*").alias("documents"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = telemetry(spark, sf_dir).select("log_id", "timestamp", "equipment_id", "status", "fault_code")
    target = docs.filter("fault_code IS NOT NULL")
    again = docs.filter("status = 'Online'").withColumn("status", F.lit("Rechecked")).withColumn("line", F.lit(1))
    twice = again.filter("fault_code IS NULL").withColumn("status", F.lit("Twice")).withColumn("line", F.lit(2))
    return target, again.unionByName(twice)


@register
def replace_by_key(spark, sf_dir):
    target, batch = _batch(spark, sf_dir)
    out = upsert.replace_by_key(target, batch, "log_id", [F.col("line").desc()])
    return out.select("log_id", "equipment_id", "status", "fault_code")


@register
def replace_counts(spark, sf_dir):
    target, batch = _batch(spark, sf_dir)
    return upsert.replace_counts(target, batch, "log_id").select("inserted", "replaced", _long("skipped"))


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry text lines, with broken, keyless and undated ones among them."""
    flat = frame(spark, sf_dir, "telemetry_flat")
    document = F.to_json(
        F.struct(
            F.when(F.col("soc_percent") != 7, F.col("log_id")).alias("log_id"),
            F.when(F.col("soc_percent") == 8, "not a date").otherwise(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
            ).alias("timestamp"),
            "equipment_id", F.concat(F.lit("Pack "), F.regexp_replace("model_code", "-", "")).alias("model"),
            "status", "fault_code", "severity", F.struct("temperature_c", "soc_percent").alias("telemetry"), "notes",
        )
    )
    broken = F.when(F.col("soc_percent") == 9, F.substring(document, 1, 30)).otherwise(document)
    return flat.select(
        broken.alias("value"), F.lit("folder/telemetry.json").alias("_file"),
        F.regexp_extract("log_id", r"\d+", 0).cast("bigint").alias("line"),
    )


@register
def parse_telemetry(spark, sf_dir):
    good, bad = telemetry_source.split_problems(telemetry_source.parse_lines(_json_lines(spark, sf_dir)))
    kept = good.select(
        "log_id", F.col("source.line").alias("line"), "model_code", "fault_code",
        F.col("telemetry.temperature_c").alias("temperature_c"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(None).cast("string").alias("problem"),
    )
    lost = bad.select(
        F.lit(None).cast("string").alias("log_id"), F.col("source.line").alias("line"),
        F.lit(None).cast("string").alias("model_code"), F.lit(None).cast("string").alias("fault_code"),
        F.lit(None).cast("double").alias("temperature_c"), F.lit(None).cast("string").alias("at"), "problem",
    )
    return kept.unionByName(lost)


# ---- parts, models, fleet


@register
def supplier_risk(spark, sf_dir):
    return suppliers.risk(frame(spark, sf_dir, "parts_inventory"), limit=None)


@register
def supplier_risk_words(spark, sf_dir):
    return suppliers.risk(frame(spark, sf_dir, "parts_inventory"), ["Cell", "Fus"])


@register
def single_source_parts(spark, sf_dir):
    return suppliers.risk(frame(spark, sf_dir, "parts_inventory"), single=True)


@register
def fleet_status(spark, sf_dir):
    return evidence.fleet(frame(spark, sf_dir, "equipment_units"), _as_of())


@register
def model_failures(spark, sf_dir):
    out = evidence.model_failures(frame(spark, sf_dir, "service_logs"), frame(spark, sf_dir, "equipment_units"), 3)
    return out.select("model", "resolution_summary", "n", "first_seen", "last_seen", _long("position"), "examples")


@register
def model_claims(spark, sf_dir):
    out = evidence.model_claims(frame(spark, sf_dir, "warranty_claims"), frame(spark, sf_dir, "equipment_units"))
    return out.select("model", "status", "n", _double("approved"), "examples")


@register
def find_units(spark, sf_dir):
    asked = router.route(frame(spark, sf_dir, "questions"))
    ids = asked.select("question_id", F.explode(F.concat("entities.equipment", "entities.serial")).alias("id"))
    return evidence.find_units(frame(spark, sf_dir, "equipment_units"), ids).select("question_id", "equipment_id")


# ---- pages, chunks, BM25


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page records; the source stands for the file, whose type is in its name."""
    types = F.array(*[F.lit(t) for t in ("ECO", "INC", "MAN", "SOP", "SPEC", "SUP", "MEMO")])
    kind = F.element_at(types, (F.regexp_extract("source", r"\d+", 0).cast("int") % 7 + 1))
    docs = read(spark, sf_dir, "documents", heavy=True).select(
        F.concat(F.lit("AB-"), kind, F.lit("-"), "source", F.lit(".pdf")).alias("source_file"),
        F.col("doc_id").alias("page_number"), F.col("text").alias("raw_text"),
    )
    return documents.page_records(docs, variant="chunks")


@register
def page_records(spark, sf_dir):
    return _pages(spark, sf_dir)


@register
def page_manifest(spark, sf_dir):
    from lodestone.sources.sinks import extraction_manifest

    return extraction_manifest(_pages(spark, sf_dir))


@register
def chunk_sliding(spark, sf_dir):
    out = chunk.sliding(_pages(spark, sf_dir))
    return out.select("chunk_id", "document_type", _long("chunk_index"), "text")


@register
def chunk_sentences(spark, sf_dir):
    out = chunk.sentences(_pages(spark, sf_dir))
    return out.select("chunk_id", "document_type", _long("chunk_index"), "text")


@register
def sql_chunks(spark, sf_dir):
    """Sentence chunks by a table function, in SQL alone."""
    from lodestone.functions import surface

    surface.register(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("pages_to_cut")
    return spark.sql("SELECT chunk_id, document_type, chunk_index, chunk_text AS text FROM chunk_sentences(TABLE(pages_to_cut))")


@register
def excerpts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.excerpt(F.col("text"), 500).alias("excerpt"))


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The documents' index, stored by term bucket and read back."""
    from lodestone.session import shared_dir
    import uuid

    path = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    bm25.write(bm25.build(read(spark, sf_dir, "documents", heavy=True), "doc_id"), path, buckets=16, spread=2)
    return bm25.read(spark, path)


@register
def bm25_terms(spark, sf_dir):
    index = bm25.build(read(spark, sf_dir, "documents", heavy=True), "doc_id")
    n, avgdl = index.corpus.select("n", "avgdl").first()
    return index.terms.select(
        "term", "df", F.round(bm25.idf(F.lit(n), F.col("df")), 6).alias("idf"), F.lit(round(avgdl, 6)).alias("avgdl")
    )


@register
def bm25_postings(spark, sf_dir):
    index = bm25.build(read(spark, sf_dir, "documents", heavy=True), "doc_id")
    return index.postings.groupBy("chunk_id", "dl").agg(
        F.count("*").alias("terms"), F.max("tf").alias("max_tf"), F.sum("tf").alias("tokens")
    ).select("chunk_id", _long("dl"), "terms", "max_tf", "tokens")


@register
def bm25_search(spark, sf_dir):
    hits = bm25.search(
        _index(spark, sf_dir), read(spark, sf_dir, "benchmark"), 5, id_col="item_id", digits=6
    )
    return hits.select("query_id", "chunk_id", "score", _long("rank"))


# ---- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean direction of its vectors."""
    parts = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # As many entries per label as the vectors have dimensions.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy("label").agg(ordered.alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


@register
def vector_topk(spark, sf_dir):
    hits = vectors.topk_exact(_centroids(spark, sf_dir), _vectors(spark, sf_dir), 5, vector_id="vec_id")
    return hits.select("query_id", "vec_id", "score", _long("rank"))


@register
def vector_topk_blocks(spark, sf_dir):
    hits = vectors.topk_blocks(
        _centroids(spark, sf_dir), _vectors(spark, sf_dir), 5, vector_id="vec_id", block_rows=200
    )
    return hits.select("query_id", "vec_id", "score", _long("rank"))


@register
def vector_normalize(spark, sf_dir):
    doubled = _vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    unit = doubled.withColumn("unit", vector.l2_normalize(F.col("embedding")))
    return unit.select(
        "vec_id", F.round(vector.norm(F.col("unit")), 4).alias("unit_norm"),
        F.round(vector.cosine(F.col("unit"), F.col("embedding")), 4).alias("self_cosine"),
    )


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a fault code in some texts, embedded."""
    docs = read(spark, sf_dir, "documents", heavy=True).select(
        F.col("doc_id").alias("vec_id"),
        F.concat("text", F.when(F.col("lang") == "en", " ERR_INV_404").when(
            F.col("lang") == "fr", " ERR_FUSE_001").otherwise("")).alias("text"), "source", "lang",
    )
    return materialize(vectors.embed(docs, vectors.HashedTerms(16)), "collection")


def _asked_documents(collection: DataFrame) -> DataFrame:
    """Every document whose id is divisible by 100, as a query."""
    return collection.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register
def build_collection(spark, sf_dir):
    embedded = _collection(spark, sf_dir)
    vectors.require_vectors(embedded, read(spark, sf_dir, "documents").count(), 16)
    out = vectors.build_collection(embedded.drop("embedding"), embedded.select("vec_id", "embedding"), "vec_id")
    return out.select("vec_id", "source", "lang", F.size("embedding").cast("bigint").alias("dimension"))


@register
def vector_filtered(spark, sf_dir):
    collection = _collection(spark, sf_dir)
    hits = vectors.search(_asked_documents(collection), collection, 5, contains="ERR_INV_404", vector_id="vec_id")
    return hits.select("query_id", "vec_id", "score", F.round("distance", 6).alias("distance"), _long("rank"), "source")


@register
def vector_by_code(spark, sf_dir):
    collection = _collection(spark, sf_dir)
    asked = _asked_documents(collection).select(
        "query_id", F.explode(F.array(F.lit("ERR_INV_404"), F.lit("ERR_FUSE_001"))).alias("code"), "embedding"
    )
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(r"ERR_[A-Z]+_\d{3}"), 0))
    hits = vectors.search_containing(asked, collection, codes, 2, vector_id="vec_id")
    return hits.select("query_id", "code", "vec_id", "score", _long("rank"))


@register
def vector_by_code_blocks(spark, sf_dir):
    """The search of ``vector_by_code`` as cogroups of blocks of a code, the way of large sets of questions."""
    collection = _collection(spark, sf_dir)
    asked = _asked_documents(collection).select(
        "query_id", F.explode(F.array(F.lit("ERR_INV_404"), F.lit("ERR_FUSE_001"))).alias("code"), "embedding"
    )
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"ERR_[A-Z]+_\d{3}"), 0))
    chunks = collection.select("vec_id", "embedding", F.explode(found).alias("code"))
    hits = vectors.topk_keyed(asked, chunks, ["code"], 2, ["query_id", "code"], "vec_id", block_rows=500)
    return hits.select("query_id", "code", "vec_id", "score", _long("rank"))


@register
def vector_fuse(spark, sf_dir):
    collection = _collection(spark, sf_dir)
    queries = _asked_documents(collection)
    first = vectors.search(queries, collection, 2, contains="ERR_FUSE_001", vector_id="vec_id")
    near = vectors.topk_exact(queries, collection, 4, vector_id="vec_id")
    columns = ["query_id", "vec_id", "score", "rank"]
    hits = first.select(*columns, F.lit(0).alias("priority")).unionByName(
        near.select(*columns, F.lit(1).alias("priority"))
    )
    out = vectors.fuse(hits, 5, vector_id="vec_id")
    return out.select("query_id", "vec_id", "score", _long("priority"), _long("position"))


@register
def embed_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    out = vectors.embed(docs, vectors.HashedTerms(16))
    return out.select("doc_id", F.posexplode_outer("embedding").alias("slot", "weight")).select(
        "doc_id", _long("slot"), F.round(F.col("weight").cast("double"), 4).alias("weight")
    )


@register
def embedding_manifest(spark, sf_dir):
    from lodestone.sources.sinks import embedding_manifest as manifest

    return manifest(_vectors(spark, sf_dir), "given", 64).select(
        "model", "normalization", _long("batch_size"), "chunk_count", _long("embedding_dimension")
    )


@register
def ann_recall(spark, sf_dir):
    """Recall of the search by random projections, asked for every vector whose id is divisible by 100."""
    vecs = _vectors(spark, sf_dir)
    queries = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.topk_exact(queries, vecs, 5, vector_id="vec_id")
    approx = vectors.topk_lsh(queries, vecs, vectors.fit_lsh(vecs), 5, vector_id="vec_id")
    return vectors.recall(exact, approx, 5, vector_id="vec_id")


# ---- questions, evidence, answers


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed questions, written once: every source filters and reads them several times."""
    return materialize(router.route(frame(spark, sf_dir, "questions")), "routed")


@register
def route_questions(spark, sf_dir):
    routed = router.route(frame(spark, sf_dir, "questions"))
    flat = {k: F.array_join(f"entities.{k}", ",").alias(k) for k in router.PATTERNS}
    return routed.select(
        "question_id", F.array_join("intents", ",").alias("intents"), *flat.values(),
        F.array_join("sources", ",").alias("sources"), "route", F.array_join("reasons", " / ").alias("reasons"),
    )


@register
def route_conversations(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    return router.route(talk).select(
        "conv_id", "turn", F.array_join("intents", ",").alias("intents"), F.array_join("sources", ",").alias("sources")
    )


def _evidence_columns(df: DataFrame) -> DataFrame:
    return df.select("question_id", "source", "database", "record_id", "document", "timestamp", "text", "verify")


@register
def evidence_units(spark, sf_dir):
    return _evidence_columns(evidence.units(_routed(spark, sf_dir), silver_tables(spark, sf_dir), _as_of()))


@register
def evidence_model(spark, sf_dir):
    return _evidence_columns(evidence.model(_routed(spark, sf_dir), silver_tables(spark, sf_dir), _as_of()))


@register
def evidence_ids(spark, sf_dir):
    return _evidence_columns(evidence.records(_routed(spark, sf_dir), silver_tables(spark, sf_dir)))


@register
def evidence_suppliers(spark, sf_dir):
    return _evidence_columns(evidence.suppliers(_routed(spark, sf_dir), silver_tables(spark, sf_dir)))


@register
def evidence_telemetry(spark, sf_dir):
    return _evidence_columns(evidence.telemetry(_routed(spark, sf_dir), silver_tables(spark, sf_dir)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of the conversations as a small document collection with vectors."""
    talk = read(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"),
        F.concat(F.lit("talk-"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("source_file"),
        (F.col("turn") + 1).alias("page_number"),
        F.concat("text", F.when(F.col("role") == "system", " steps ERR_INV_404 fault code").otherwise("")).alias("text"),
    )
    return vectors.embed(talk, vectors.HashedTerms(32))


@register
def evidence_vector(spark, sf_dir):
    return _evidence_columns(
        evidence.vector(_routed(spark, sf_dir), _chunks(spark, sf_dir), vectors.HashedTerms(32))
    )


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = silver_tables(spark, sf_dir)
    tables["collection"] = materialize(_chunks(spark, sf_dir), "collection")
    return tables


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, evidence.Apart, dict[str, DataFrame]]:
    tables = _tables(spark, sf_dir)
    routed = _routed(spark, sf_dir)
    found, _, _ = evidence.gather(routed, tables, _as_of(), vectors.HashedTerms(32))
    return routed, found, tables


@register
def evidence_tags(spark, sf_dir):
    _, found, _ = _evidence(spark, sf_dir)
    return found.whole().select("question_id", "tag", "source", "database", "record_id", "verify", _long("position"))


@register
def prompt_context(spark, sf_dir):
    routed, found, _ = _evidence(spark, sf_dir)
    return answers.build_prompt_apart(routed, found).select("question_id", "prompt")


@register
def extractive_answers(spark, sf_dir):
    routed, found, _ = _evidence(spark, sf_dir)
    return answers.extractive(routed, found.whole()).select("question_id", "answer")


@register
def verify_evidence(spark, sf_dir):
    _, found, tables = _evidence(spark, sf_dir)
    verified = evidence.verify_apart(found, tables, _as_of()).whole()
    return verified.select(
        "question_id", "tag", "source", "database", "record_id", _long("records"), _long("found"), "verified"
    )


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns with citations in every style, and the tags that are valid for them."""
    talk = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    styles = F.array(*[F.lit(s) for s in (
        "【VEC2】", "【MDB1†L3】", "(SQL1)", "[SQL 1]", "[SQL1, MDB2]", "MDB1", "[MD​B2]", "[SQL9]", "")])
    style = F.element_at(styles, (F.col("conv_id") % 9 + 1).cast("int"))
    answer = F.concat(
        F.lit("**Summary:**\n"), F.regexp_replace("text", r"\n", F.concat(F.lit(" "), style, F.lit("\n"))),
        F.lit(" "), style,
    )
    rows = talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), answer.alias("answer"))
    tags = rows.select("question_id", F.explode(F.array(*[F.lit(t) for t in ("SQL1", "MDB1", "MDB2", "VEC2")])).alias("tag"))
    return rows.withColumn("answer", citations.normalize(F.col("answer"))), tags


@register
def normalize_citations(spark, sf_dir):
    return _answers(spark, sf_dir)[0]


@register
def citation_check(spark, sf_dir):
    out = citations.check(*_answers(spark, sf_dir))
    return out.select(
        "question_id", _long("statements"), _long("cited_statements"), F.array_join("uncited", " || ").alias("uncited"),
        F.array_join("unknown_tags", ",").alias("unknown_tags"), F.array_join("used_tags", ",").alias("used_tags"),
    )


@register
def citation_provenance(spark, sf_dir):
    rows, tags = _answers(spark, sf_dir)
    out = citations.provenance(tags, citations.check(rows, tags))
    return out.groupBy("tag").agg(F.count("*").alias("records"), F.count_if("cited").alias("cited"))


@register
def strip_reasoning(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations")
    thought = F.concat(F.lit("<think>\nhm "), "text", F.lit("\n</think>\n"), "text")
    return talk.select(
        "conv_id", "turn", text.strip_reasoning(thought, F.col("role") == "assistant").alias("answer")
    )


# ---- metrics


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records: timings from the value, status from the type."""
    events = read(spark, sf_dir, "events")
    ms = F.col("value")
    return events.select(
        F.col("user_id").alias("q"),
        F.lit(0.0).alias("routing_ms"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(ms).alias("sql_ms"),
        F.when(F.col("event_type") == "click", ms * 2).otherwise(0.0).alias("document_ms"),
        (ms + 1).alias("vector_ms"), (ms + 2).alias("retrieval_ms"), F.lit(0.0).alias("prompt_ms"),
        (ms * 3).alias("generation_ms"), (ms * 40).alias("total_ms"),
        F.when(F.col("event_type") == "error", "m - HTTP 500").otherwise("m - ok").alias("llm_status"),
        F.lit(3).alias("cited_n"), F.lit(4).alias("statements_n"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("unknown_tags"),
    )


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, 6).alias(c) for c in df.columns])


@register
def latency_percentiles(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return _rounded(metrics.percentiles(events, "value", ["event_type"]), ["event_type"])


@register
def stage_report(spark, sf_dir):
    return _rounded(metrics.stage_report(metrics.answered(_runs(spark, sf_dir))), ["stage"])


@register
def slo_report(spark, sf_dir):
    return _rounded(metrics.slo(_runs(spark, sf_dir)), ["runs", "runs_under_target"])


@register
def question_medians(spark, sf_dir):
    return _rounded(metrics.by_question(_runs(spark, sf_dir)), ["q", "runs"])


@register
def citation_coverage(spark, sf_dir):
    return metrics.citation_coverage(_runs(spark, sf_dir))


# ---- streams over files written from the tables


@register
def stream_telemetry(spark, sf_dir):
    """Outdated documents first, then all documents in five files, a file a batch; the later ones win."""
    from lodestone.session import scratch
    from lodestone.streaming import ingest

    base = scratch(spark, "stream")
    lines = _json_lines(spark, sf_dir).select("value")
    stale = lines.where(F.get_json_object("value", "$.telemetry.soc_percent").cast("double") > 50)
    stale = stale.select(F.regexp_replace("value", '"temperature_c":[^,}]*', '"temperature_c":-1').alias("value"))
    for files in (stale.repartition(2), lines.repartition(5)):
        files.write.mode("append").text(f"{base}/in")
        ingest.ingest_telemetry(spark, f"{base}/in", f"{base}/log", f"{base}/checkpoint", max_files=1).awaitTermination()
    return ingest.current_telemetry(spark, f"{base}/log").select(
        "log_id", "model_code", "fault_code", F.col("telemetry.temperature_c").alias("temperature_c")
    )


@register
def stream_audit(spark, sf_dir):
    from lodestone.session import shared_dir
    from lodestone.streaming import audit as audit_stream
    import uuid

    base = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    old, new = _log_states(spark, sf_dir)
    feed = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    feed = feed.withColumn("changed_at", F.date_add("dispatch_date", F.col("seq")))
    feed.write.json(f"{base}/in", compression="gzip")
    audit_stream.audit_changes(
        spark, f"{base}/in", feed.schema, f"{base}/state", f"{base}/history", f"{base}/checkpoint", ["seq"],
        user="loader", time="changed_at",
    ).awaitTermination()
    from lodestone.sources import tables

    return tables.read_batches(spark, f"{base}/history").select(
        "record_id", "operation_type", _long("seq"), F.col("event_timestamp").cast("string").alias("at"),
        F.get_json_object("old_values", "$.status").alias("old_status"),
        F.get_json_object("new_values", "$.status").alias("new_status"),
    )
