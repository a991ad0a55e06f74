"""Evidence for questions from the relational, telemetry and chunk tables.

Every operator takes the routed questions (``question_id``, ``question``, ``intents``, ``entities``,
``sources``) and returns ``question_id``, a sortable ``ord`` array and the evidence columns. Questions
are few against the tables: tables are reduced by the ids asked for before anything else happens.

Texts that list all units of a fault or all parts of a name grow with the tables, and many questions show the
same ones. They are written once, apart from the rows (:class:`Apart`), and put into rows where rows are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import first_id
from lodestone.operators import suppliers as supplier_ops, telemetry as tel, vectors
from lodestone.operators.enrich import warranty_state
from lodestone.operators.ranking import latest, rank, top_ids
from lodestone.session import broadcast_if_small, materialize, share_long_values
from lodestone.sources.schemas import EVIDENCE_COLUMNS

# Service types that count as repairs.
REPAIR_TYPES = ["Emergency Repair", "Corrective Maintenance", "Diagnostic", "Warranty Replacement"]
# Tag prefix per source, and how many ids of a kind a question may use.
TAGS = {"sql": "SQL", "document": "MDB", "vector": "VEC"}
MAX_SERIALS, MAX_FAULTS, MAX_MODELS = 3, 2, 2
# The most frequent faults shown for a unit, and for models or the fleet.
UNIT_FAULTS, SCOPE_FAULTS = 3, 5
FLEET = "fleet"
RELATIONAL, DOCUMENTS, CHUNKS = "silver", "documents", "chunks"
# Texts apart up to this size may be broadcast; a task puts about so many bytes of texts into its rows.
BROADCAST_BYTES, TASK_BYTES = 64 << 20, 128 << 20
# Characters of a record id that rows keep for their order when the id lies apart.
ORDER_CHARS = 200


# The templates of evidence texts below are fixed values, as are the labels of their fields.
def _text(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced; NULL is written as None."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        value = values[name] if name in values else F.col(name)
        parts += [F.lit(head), F.coalesce(value.cast("string"), F.lit("None"))]
    return F.concat(*parts, F.lit(rest))


def _or(col: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit(default))


def _money(col: Column) -> Column:
    return F.format_number(F.coalesce(col.cast("decimal(38,2)"), F.lit(0)), 2)


def _quote(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def _row(
    df: DataFrame, ord_: list[Column], source: str, table: str, record_id: Column, ts: Column, text: Column,
    where: Column | None = None, document: Column | None = None, verify: Column | None = None, claim: Column | None = None,
) -> DataFrame:
    database = {"sql": RELATIONAL, "document": DOCUMENTS, "vector": CHUNKS}[source]
    if verify is None:
        verify = F.concat(F.lit(f"SELECT * FROM {database}.{table} WHERE "), where)
    return df.select(
        "question_id",
        F.array(*[o.cast("string") for o in ord_]).alias("ord"),
        F.lit(source).alias("source"),
        F.lit(f"{database}.{table}").alias("database"),
        record_id.cast("string").alias("record_id"),
        (document if document is not None else F.lit(table)).alias("document"),
        F.coalesce(ts.cast("string"), F.lit("n/a")).alias("timestamp"),
        text.alias("text"),
        verify.alias("verify"),
        F.lit("").alias("tag"),
        (F.lit(None) if claim is None else claim).cast(CLAIM).alias("claim"),
    )


@dataclass
class Apart:
    """Evidence rows, some of which share long texts that lie apart.

    A row with a ``_body`` has its record id and text in ``texts`` (``_body``, ``record_id``, ``text``; a row for each key).
    Both frames are written, as they are read several times.
    """

    rows: DataFrame
    texts: DataFrame | None = None

    def whole(self, by_text: bool = False) -> DataFrame:
        """The rows with their texts, in the columns of ``rows`` without ``_body``.

        Long results are dealt by question, for whoever gathers them by question; ``by_text`` puts rows of one text side by
        side, so that files of the result hold it once (:func:`share_long_values`).
        """
        columns = [c for c in self.rows.columns if c != "_body"]
        if self.texts is None:
            return self.rows.select(columns)
        held = self.texts.select(
            "_body", F.col("record_id").alias("_id"), F.col("text").alias("_text"),
        )
        total, result = self.bytes()
        tasks = self.rows.sparkSession.sparkContext.defaultParallelism
        if total <= BROADCAST_BYTES:
            rows = self.rows
            if result > TASK_BYTES:
                # All rows of a question in one task, so that texts need not be shuffled to be gathered by question.
                n = max(tasks, result // TASK_BYTES)
                rows = rows.repartitionByRange(n, "_body", "question_id") if by_text else rows.repartition(n, "question_id")
            found = rows.join(F.broadcast(held), "_body", "left")
            apart = F.col("_body").isNotNull()
            return found.select(*[
                F.when(apart, F.col({"record_id": "_id", "text": "_text"}[c])).otherwise(F.col(c)).alias(c)
                if c in ("record_id", "text") else F.col(c) for c in columns
            ])
        # Copies of the texts, as most rows may share one of them.
        kept = self.rows.filter("_body IS NOT NULL").drop("record_id", "text")
        dealt = kept.withColumn("_deal", F.pmod(F.xxhash64(*kept.columns), F.lit(tasks)))
        copies = held.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))))
        found = dealt.join(copies.hint("merge"), ["_body", "_deal"]).withColumnsRenamed({"_id": "record_id", "_text": "text"})
        return self.rows.filter("_body IS NULL").select(columns).unionByName(found.select(columns))

    def bytes(self) -> tuple[int, int]:
        """Bytes of all texts, and of the texts of all rows."""
        size = F.octet_length("record_id") + F.octet_length("text")
        sizes = self.texts.select("_body", F.coalesce(size, F.lit(0)).cast("bigint").alias("_size"))
        asked = self.rows.filter("_body IS NOT NULL").groupBy("_body").agg(F.count("*").alias("_n"))
        found = sizes.join(asked, "_body", "left").agg(F.sum("_size"), F.sum(F.col("_size") * F.col("_n"))).first()
        return found[0] or 0, found[1] or 0


# What a row counts, if it speaks of many records: the kind of count, and the keys of the counted group.
CLAIM = "struct<about:string,keys:array<string>>"


def _claim(about: str, *keys: Column) -> Column:
    return F.struct(F.lit(about).alias("about"), F.array(*[k.cast("string") for k in keys]).alias("keys"))


def _fleet_text(model: Column, units: Column, in_service: Column, under_warranty: Column | None = None) -> Column:
    """Without the units under warranty, the part of the text before them."""
    text = _text("ERP fleet for model {model}: {units} units, {in_service} in service, ",
                 model=model, units=units, in_service=in_service)
    return text if under_warranty is None else F.concat(text, _text("{n} still under warranty.", n=under_warranty))


def _failures_text(model: Column, resolution: Column, n: Column, examples: Column) -> Column:
    return _text(
        "{model} repair/diagnostic dispatches: '{resolution}' occurred {n} times (e.g. {examples}).",
        model=model, resolution=resolution, n=n, examples=examples,
    )


def _claims_text(model: Column, status: Column, n: Column, approved: Column, examples: Column) -> Column:
    return _text(
        "{model} warranty claims with status {status}: {n} claims, ${approved} approved (e.g. {examples}).",
        model=model, status=status, n=n, approved=approved, examples=examples,
    )


def _fault_text(fault: Column, events: Column) -> Column:
    return _text("fault {fault} logged {events} times", fault=fault, events=events)


def _stock_text(stock: Column) -> Column:
    return _text("; {stock} units in stock.", stock=stock)


def _pos(col: Column) -> Column:
    """A position as text that sorts like the number, whatever its size."""
    return F.lpad(col.cast("string"), 19, "0")


def _asks(questions: DataFrame, source: str) -> DataFrame:
    return questions.filter(F.array_contains("sources", source))


def find_units(equipment: DataFrame, ids: DataFrame) -> DataFrame:
    """Units whose equipment id or serial number is asked for: two equi-joins, each pair once.

    ``ids`` has ``question_id`` and ``id``.
    """
    asked = broadcast_if_small(ids)
    by_id = equipment.join(asked, equipment["equipment_id"] == asked["id"]).drop("id")
    by_serial = equipment.join(asked, equipment["serial_number"] == asked["id"]).drop("id")
    return by_id.unionByName(by_serial).dropDuplicates(["question_id", "equipment_id"])


def _service_rows(services: DataFrame, ord_: list[Column]) -> DataFrame:
    return _row(
        services, ord_, "sql", "service_logs", F.col("dispatch_id"), F.col("dispatch_date"),
        _text(
            "Service {dispatch_id} on {dispatch_date} for {equipment_id}: {service_type} by {technician}, "
            "{hours_spent} h, ${labor_cost} labor, status {status}. Resolution: {resolution_summary}"
        ),
        F.concat(F.lit("dispatch_id = "), _quote(F.col("dispatch_id"))),
    )


def _claim_rows(claims: DataFrame, tables: dict[str, DataFrame], ord_: list[Column]) -> DataFrame:
    parts = tables["parts_inventory"].select("part_id", "part_name")
    claims = claims.join(parts, "part_id", "left")
    denial = F.when(
        F.coalesce(F.col("denial_reason"), F.lit("")) != "", F.concat(F.lit(", denial reason: "), "denial_reason")
    ).otherwise("")
    return _row(
        claims, ord_, "sql", "warranty_claims", F.col("claim_id"), F.col("claim_date"),
        _text(
            "Warranty claim {claim_id} on {claim_date} for {equipment_id}: part {part} ({name}), dispatch "
            "{dispatch}, claimed ${claim_amount}, approved ${approved_amount}, status {status}{denial}.",
            part=_or("part_id", "n/a"), name=_or("part_name", "n/a"), dispatch=_or("dispatch_id", "n/a"),
            denial=denial,
        ),
        F.concat(F.lit("claim_id = "), _quote(F.col("claim_id"))),
    )


def units(questions: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Units asked for by id, with their latest services and claims; or one row saying none exists."""
    asked = _asks(questions, "sql").withColumn("ids", F.concat("entities.equipment", "entities.serial"))
    asked = asked.filter(F.size("ids") > 0).select("question_id", "ids")
    ids = asked.select("question_id", F.explode("ids").alias("id"))
    found = find_units(tables["equipment_units"], ids)
    customers = tables["customers"].select("customer_id", "company_name")
    found = found.join(customers, "customer_id")
    state = warranty_state(F.col("warranty_expiration"), as_of)
    unit_rows = _row(
        found, [F.lit(0), F.col("equipment_id"), F.lit(0), F.lit(0)], "sql", "equipment_units",
        F.col("equipment_id"), F.col("install_date"),
        _text(
            "Unit {equipment_id} (serial {serial_number}), model {model}, {capacity_kw} kW, status {status}, "
            "customer {company_name}, installed {install_date}, warranty expires {warranty_expiration} ({state}).",
            state=state,
        ),
        F.concat(F.lit("equipment_id = "), _quote(F.col("equipment_id"))),
    )
    wanted = broadcast_if_small(found.select("question_id", "equipment_id"))

    def newest(table: DataFrame, date: str, key: str) -> DataFrame:
        own = table.join(wanted, "equipment_id")
        order = [F.col(date).desc(), F.col(key).asc()]
        return latest(own, ["question_id", "equipment_id"], order, 5, "_rank")

    services = newest(tables["service_logs"], "dispatch_date", "dispatch_id")
    service_rows = _service_rows(services, [F.lit(0), F.col("equipment_id"), F.lit(1), _pos(F.col("_rank"))])
    claims = newest(tables["warranty_claims"], "claim_date", "claim_id")
    claim_rows = _claim_rows(claims, tables, [F.lit(0), F.col("equipment_id"), F.lit(2), _pos(F.col("_rank"))])
    # Absence is per question: none of its ids matched.
    absent = asked.join(found.select("question_id").distinct(), "question_id", "left_anti")
    listed = F.array_join(F.transform("ids", _quote), ", ")
    absent_rows = _row(
        absent, [F.lit(0), F.lit(""), F.lit(0), F.lit(0)], "sql", "equipment_units",
        F.lit("no matching row"), F.lit("n/a"),
        _text(
            "ERP lookup returned NO equipment_units record for {ids}; this unit has no ERP service or warranty "
            "history on file.",
            ids=F.array_join("ids", ", "),
        ),
        F.concat(F.lit("equipment_id IN ("), listed, F.lit(") OR serial_number IN ("), listed, F.lit(")")),
    )
    return union(unit_rows, service_rows, claim_rows, absent_rows)


def records(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Dispatches, claims and parts that a question names by id, one row for each id, also if it is unknown."""
    asked = _asks(questions, "sql")
    frames = []
    for n, (kind, table) in enumerate((("dispatch", "service_logs"), ("claim", "warranty_claims"), ("part", "parts_inventory"))):
        key = f"{kind}_id"
        ids = asked.select("question_id", F.explode(f"entities.{kind}").alias(key))
        own = tables[table].join(broadcast_if_small(ids), key)
        place = [F.lit(3), F.lit(n), F.col(key), F.lit(0)]
        if kind == "dispatch":
            frames.append(_service_rows(own, place))
        elif kind == "claim":
            frames.append(_claim_rows(own, tables, place))
        else:
            frames.append(_row(
                own, place, "sql", table, F.col(key), F.lit("current inventory"),
                _text("Part {part_id} '{name}': supplier {supplier}, manufacturer {manufacturer}, {stock_quantity} units in stock.",
                      name=F.trim("part_name")),
                F.concat(F.lit(f"{key} = "), _quote(F.col(key))),
            ))
        absent = ids.join(own.select("question_id", key), ["question_id", key], "left_anti")
        frames.append(_row(
            absent, place, "sql", table, F.lit("no matching row"), F.lit("n/a"),
            _text(f"ERP lookup returned NO {table} record for {{{key}}}."),
            F.concat(F.lit(f"{key} = "), _quote(F.col(key))),
        ))
    return union(*frames)


def fleet(equipment: DataFrame, as_of: Column) -> DataFrame:
    """Units, units in service and units under warranty per model."""
    return equipment.groupBy("model").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("status") == "In Service").alias("in_service"),
        F.count_if(F.col("warranty_expiration") >= as_of).alias("under_warranty"),
        F.min("install_date").alias("first_install"),
        F.max("install_date").alias("last_install"),
    )


def model_failures(logs: DataFrame, equipment: DataFrame, n: int = 5) -> DataFrame:
    """Per model the ``n`` most frequent resolutions of repair dispatches, with the newest ids."""
    own = materialize(_repairs(logs, equipment), "repairs", "zstd")  # read for the counts and for the newest ids
    keys = ["model", "resolution_summary"]
    counts = own.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("dispatch_date").alias("first_seen"),
        F.max("dispatch_date").alias("last_seen"),
    )
    order = [F.col("n").desc(), F.col("resolution_summary").asc()]
    best = latest(counts, ["model"], order, n, "position")
    examples = top_ids(own, keys, "dispatch_id", "dispatch_date", "examples")
    return _join_nullsafe(best, examples, keys)


def _repairs(logs: DataFrame, equipment: DataFrame) -> DataFrame:
    repairs = logs.filter(F.col("service_type").isin(REPAIR_TYPES)).select(
        "equipment_id", "resolution_summary", "dispatch_id", "dispatch_date"
    )
    return repairs.join(equipment.select("equipment_id", "model"), "equipment_id").drop("equipment_id")


def model_claims(claims: DataFrame, equipment: DataFrame) -> DataFrame:
    """Claims per model and status with approved amounts and the newest ids."""
    models = equipment.select("equipment_id", "model")
    own = claims.select("equipment_id", "status", "approved_amount", "claim_id", "claim_date").join(
        models, "equipment_id"
    )
    own = materialize(own.drop("equipment_id"), "claims", "zstd")
    keys = ["model", "status"]
    counts = own.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("approved_amount").alias("approved"))
    examples = top_ids(own, keys, "claim_id", "claim_date", "examples")
    return _join_nullsafe(counts, examples, keys)


def _join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join aggregates whose group keys may be NULL."""
    side = right.select(*[right[k].alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = [left[k].eqNullSafe(side[f"_{k}"]) for k in keys]
    return left.join(side, match).drop(*[f"_{k}" for k in keys])


def model(questions: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Fleet size of the models asked for, frequent repairs and claim totals."""
    asked = _asks(questions, "sql").select(
        "question_id", "intents", F.slice("entities.model", 1, MAX_MODELS).alias("_models")
    )
    asked = asked.select("question_id", "intents", F.explode("_models").alias("model"))
    wanted = broadcast_if_small(asked.select("model").distinct())
    equipment = tables["equipment_units"].join(wanted, "model", "left_semi")
    sizes = asked.join(fleet(equipment, as_of), "model", "left")
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("units", "in_service", "under_warranty")}
    counts = list(count.values())
    none_note = F.when(
        count["units"] == 0, " (No ERP units of this model - it appears only in telemetry/docs.)"
    ).otherwise("")
    fleet_rows = _row(
        sizes, [F.lit(1), F.col("model"), F.lit(0), F.lit(0)], "sql", "equipment_units",
        F.concat(F.lit("aggregate model="), "model"), _text("{first_install}..{last_install}"),
        F.concat(_fleet_text(F.col("model"), *counts), none_note),
        F.concat(F.lit("model = "), _quote(F.col("model"))),
        claim=_claim("fleet", F.col("model")),
    )

    def having(*names: str) -> DataFrame:
        return asked.filter(F.arrays_overlap("intents", F.array(*[F.lit(n) for n in names])))

    failures = having("failure_modes", "telemetry", "service").join(
        model_failures(tables["service_logs"], equipment), "model"
    )
    failure_rows = _row(
        failures, [F.lit(1), F.col("model"), F.lit(1), _pos(F.col("position"))], "sql", "service_logs",
        F.col("examples"), _text("{first_seen}..{last_seen}"),
        _failures_text(*[F.col(c) for c in ("model", "resolution_summary", "n", "examples")]),
        F.concat(F.lit("dispatch_id = "), _quote(first_id(F.col("examples")))),
        claim=_claim("failures", F.col("model"), F.col("resolution_summary")),
    )
    claims = rank(
        having("warranty").join(model_claims(tables["warranty_claims"], equipment), "model"),
        ["question_id", "model"], [F.col("n").desc(), F.col("status").asc()], "position",
    )
    claim_rows = _row(
        claims, [F.lit(1), F.col("model"), F.lit(2), _pos(F.col("position"))], "sql", "warranty_claims",
        F.col("examples"), F.lit("aggregate"),
        _claims_text(F.col("model"), F.col("status"), F.col("n"), _money(F.col("approved")), F.col("examples")),
        F.concat(F.lit("claim_id = "), _quote(first_id(F.col("examples")))),
        claim=_claim("claims", F.col("model"), F.col("status")),
    )
    return union(fleet_rows, failure_rows, claim_rows)


def suppliers(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The parts with the fewest suppliers among those a supply question is about."""
    rows, texts = _suppliers(questions, tables)
    return Apart(materialize(rows, "evidence-rows"), texts).whole()


def _suppliers(questions: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """:func:`suppliers` with the texts, which list all ids of a part, apart."""
    asked = _asks(questions, "sql").filter(F.array_contains("intents", "supply"))
    asked = asked.select(
        "question_id",
        F.lower("question").contains("single").alias("_single"),
        supplier_ops.question_fragments(F.col("question")).alias("_words"),
    )
    per_part = supplier_ops.supplier_counts(tables["parts_inventory"])
    # There are few kinds of question (fragment sets); the best parts are found once per kind.
    kinds = asked.select("_single", "_words").distinct()
    lower = F.lower("part")
    fragments = sorted(set(supplier_ops.COMPONENT_WORDS.values()))
    labels = [F.when(lower.contains(f.lower()), F.lit(f)) for f in fragments]
    labels += [F.when(F.col("n_suppliers") == 1, F.lit("*single")), F.lit("*any")]
    labelled = per_part.select("*", F.explode(F.array_compact(F.array(*labels))).alias("_label"))
    wanted = F.when(F.col("_single"), F.array(F.lit("*single"))).when(
        F.size("_words") == 0, F.array(F.lit("*any"))
    ).otherwise(F.col("_words"))
    order = [F.col("n_suppliers").asc(), F.col("part").asc()]
    # The best parts of a kind are among the best of each of its labels.
    short = latest(labelled, ["_label"], order, supplier_ops.PARTS_SHOWN)
    kind_labels = kinds.select("*", F.explode(wanted).alias("_label"))
    by_kind = kind_labels.join(short, "_label").drop("_label").dropDuplicates(["_single", "_words", "part"])
    best = latest(by_kind, ["_single", "_words"], order, supplier_ops.PARTS_SHOWN, "_rank").drop("n_suppliers")
    best = materialize(best, "best-parts")
    # All ids, suppliers and makers are listed for the chosen parts alone.
    chosen = broadcast_if_small(best.select(F.col("part").alias("_part")).distinct())
    parts = tables["parts_inventory"].join(chosen, F.trim("part_name") == F.col("_part"), "left_semi")
    risk = F.when(F.col("n_suppliers") == 1, "SINGLE-SOURCE RISK").otherwise(
        F.concat(F.col("n_suppliers").cast("string"), F.lit(" suppliers"))
    )
    texts = _texts(_row(
        supplier_ops.by_part(parts).withColumn("question_id", F.col("part")), [F.col("part")], "sql", "parts_inventory",
        F.col("part_ids"), F.lit("current inventory"),
        _text(
            "Part '{part}' ({part_ids}): supplied by {suppliers} [{risk}]; manufacturers {makers}{in_stock}",
            risk=risk, in_stock=_stock_text(F.col("stock")),
        ),
        F.concat(F.lit("part_id = "), _quote(first_id(F.col("part_ids")))),
        claim=_claim("stock", F.col("part")),
    ), "part", "part-texts")
    rows = asked.join(broadcast_if_small(best), ["_single", "_words"])
    rows = rows.join(_references(texts).withColumn("part", F.col("_key")[0]), "part")
    return _refer(rows, [F.lit(2), _pos(F.col("_rank")), F.lit(0), F.lit(0)]), texts.select("_body", "record_id", "text")


def _texts(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """Evidence rows that many questions may show, written once. ``question_id`` holds the key of a row, ``ord`` its parts."""
    body = F.concat(F.lit(f"{kind} "), "question_id").alias("_body")
    return materialize(rows.select(body, F.col("ord").alias("_key"), *[c for c in rows.columns if c not in ("question_id", "ord")]), name)


def _references(texts: DataFrame) -> DataFrame:
    """What rows keep of ``texts``: all but the long values. The beginning of the record id is kept for the order of rows."""
    return broadcast_if_small(texts.withColumn("record_id", F.substring("record_id", 1, ORDER_CHARS)).drop("text"))


def _refer(rows: DataFrame, ord_: list[Column]) -> DataFrame:
    """The evidence columns of rows that are joined with references."""
    return rows.select(
        "question_id", F.array(*[o.cast("string") for o in ord_]).alias("ord"), "source", "database", "record_id", "document",
        "timestamp", F.lit(None).cast("string").alias("text"), "verify", "tag", "claim", "_body",
    )


def _inline(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_body", F.lit(None).cast("string"))


def _event_rows(events: DataFrame, ord_: list[Column]) -> DataFrame:
    components = F.when(
        F.size(F.coalesce("flagged_components", F.array().cast("array<string>"))) > 0,
        F.array_join("flagged_components", ", "),
    ).otherwise("none")
    reading = {c: F.col(f"telemetry.{c}") for c in (
        "temperature_c", "voltage_v", "current_a", "soc_percent", "voltage_delta_mv")}
    return _row(
        events, ord_, "document", "telemetry", F.col("log_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        _text(
            "Telemetry {log_id} at {at} UTC, unit {equipment_id} ({model_code}): status {status}, fault {fault}, "
            "severity {severity}; {temperature_c} C, {voltage_v} V, {current_a} A, SoC {soc_percent}%, cell delta "
            "{voltage_delta_mv} mV; flagged components: {components}. Notes: {notes}",
            at=F.date_format("timestamp", "yyyy-MM-dd HH:mm"), fault=_or("fault_code", "none"),
            components=components, notes=F.coalesce("notes", F.lit("")), **reading,
        ),
        F.concat(F.lit("log_id = "), _quote(F.col("log_id"))),
    )


def _summary_rows(summary: DataFrame, ord_: list[Column], label: Column) -> DataFrame:
    def day(col: str) -> Column:
        return F.date_format(col, "yyyy-MM-dd")

    return _row(
        summary, ord_, "document", "telemetry", F.col("latest_ids"),
        F.concat(day("first_ts"), F.lit(".."), day("last_ts")),
        _text(
            "{label}: {logged} on units {units}; temperature avg {avg} C / max "
            "{max_temperature} C; components flagged: {components}; latest note: {latest_note} (e.g. {latest_ids})",
            label=label, logged=_fault_text(F.col("fault_code"), F.col("events")), avg=F.format_string("%.1f", "avg_temperature"),
            components=_or("components", "none"),
        ),
        F.concat(F.lit("fault_code = "), _quote(F.col("fault_code"))),
        claim=_claim("faults", F.col("_scope"), F.col("fault_code")),
    )


def telemetry(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Fault summaries and events by serial, by fault code, or by model or fleet.

    Each of these is a scope: a unit, a fault code, the models of a question, the fleet. The log is read
    twice whatever is asked: for the sums of all scopes, and for the few events that they show.
    """
    rows, texts = _telemetry(questions, tables)
    share_long_values(questions.sparkSession)
    return Apart(materialize(rows, "evidence-rows"), texts).whole(by_text=True)


def _telemetry(questions: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """:func:`telemetry` with the summaries of all scopes but units, which list all units of a fault, apart."""
    asked = _asks(questions, "document")
    serials = asked.select(
        "question_id", F.posexplode(F.slice("entities.serial", 1, MAX_SERIALS)).alias("_n", "equipment_id")
    ).withColumn("_scope", F.concat(F.lit("unit "), "equipment_id"))
    codes = asked.select(
        "question_id", F.posexplode(F.slice("entities.fault", 1, MAX_FAULTS)).alias("_n", "fault_code")
    ).withColumn("_scope", F.concat(F.lit("code "), "fault_code"))
    # Questions without serials and fault codes look at their models, or at the whole fleet.
    models = F.array_join("entities.model", "/")
    broad = asked.filter((F.size("entities.serial") == 0) & (F.size("entities.fault") == 0)).select(
        "question_id", F.array_contains("intents", "hot").alias("_hot"), models.alias("_models"),
        F.when(models == "", FLEET).otherwise(F.concat(F.lit("models "), models)).alias("_scope"),
        F.col("entities.model").alias("_each"),
    )
    scoped = _scoped(tables["telemetry"], serials, codes, broad)
    sums = materialize(tel.fault_sums(scoped, ["_scope", "fault_code"]), "fault-sums")
    shown = materialize(_shown_events(scoped), "shown-events")

    newest = shown.filter("_list = 'fault'")
    keys = ["_scope", "fault_code"]
    order = [F.col("events").desc(), F.col("fault_code").asc()]
    best = latest(sums.filter("fault_code IS NOT NULL"), ["_scope"], order, SCOPE_FAULTS, "_place")
    best = best.filter(~_of_unit() | (F.col("_place") <= UNIT_FAULTS))
    summary = tel.add_newest(best, newest, keys)
    texts = _fault_texts(summary.filter(~_of_unit()))
    found = _references(texts).withColumns({"_scope": F.col("_key")[0], "_place": F.col("_key")[1].cast("int")})
    few = broadcast_if_small(shown.filter(~_of_unit()))
    rows = union(
        _inline(_by_serial(serials, sums, summary.filter(_of_unit()), shown)), _by_fault(codes, found, few), _by_model(broad, found, few)
    )
    return rows, texts.select("_body", "record_id", "text")


def _fault_texts(summary: DataFrame) -> DataFrame:
    """The summaries of fault codes, models and the fleet, which are the same for all questions about them."""
    label = F.when(F.col("_scope") == FLEET, "Fleet-wide telemetry").when(
        F.col("_scope").startswith("code "), F.concat(F.lit("Fault code "), "fault_code")
    ).otherwise(F.concat(F.regexp_replace("_scope", "^models ", ""), F.lit(" telemetry")))
    keyed = summary.withColumn("question_id", F.concat("_scope", F.lit(" "), "fault_code"))
    return _texts(_summary_rows(keyed, [F.col("_scope"), F.col("_place")], label), "faults", "fault-texts")


def _of_unit() -> Column:
    return F.col("_scope").startswith("unit ")


def _scoped(log: DataFrame, serials: DataFrame, codes: DataFrame, broad: DataFrame) -> DataFrame:
    """The events of each scope asked for; events without a fault belong to the scope of their unit only."""
    def named(df: DataFrame, key: str, scope: str) -> DataFrame:
        return broadcast_if_small(df.select(key, F.col("_scope").alias(scope)).distinct())

    by_model = broad.select(F.explode("_each").alias("model_code"), "_scope").groupBy("model_code").agg(
        F.collect_set("_scope").alias("_of_models")
    )
    found = (
        log.join(named(serials, "equipment_id", "_unit"), "equipment_id", "left")
        .join(named(codes, "fault_code", "_code"), "fault_code", "left")
        .join(broadcast_if_small(by_model), "model_code", "left")
    )
    fleet_asked = not broad.filter(F.col("_scope") == FLEET).isEmpty()
    others = F.array_compact(F.array("_code", F.lit(FLEET if fleet_asked else None)))
    others = F.concat(others, F.coalesce("_of_models", F.array().cast("array<string>")))
    scopes = F.concat(
        F.array_compact(F.array("_unit")),
        F.when(F.col("fault_code").isNotNull(), others).otherwise(F.array().cast("array<string>")),
    )
    return found.select(*log.columns, F.explode(scopes).alias("_scope"))


def _shown_events(scoped: DataFrame) -> DataFrame:
    """The first events of each list: the newest of a scope's fault (3), the newest reading (1) and faults (2) of a
    unit, the hottest of other scopes (2). Columns _list and _rank are added."""
    fault = F.col("fault_code").isNotNull()
    lists = F.array(
        F.when(fault, F.lit("fault")), F.when(_of_unit(), F.lit("reading")),
        F.when(_of_unit() & fault, F.lit("faults")), F.when(~_of_unit(), F.lit("hot")),
    )
    listed = scoped.withColumn("_list", F.explode(F.array_compact(lists)))
    hot = F.col("_list") == "hot"
    listed = listed.withColumn("_fault", F.when(F.col("_list") == "fault", F.col("fault_code")))
    order = [
        F.when(hot, F.col(tel.TEMPERATURE)).desc(), F.when(hot, F.col("log_id")).asc(),
        F.when(~hot, F.col("timestamp")).desc(), F.when(~hot, F.col("log_id")).desc(),
    ]
    first = latest(listed, ["_scope", "_list", "_fault"], order, 3, "_rank").drop("_fault")
    most = F.when(F.col("_list") == "fault", 3).when(F.col("_list") == "reading", 1).otherwise(2)
    return first.filter(F.col("_rank") <= most)


def _by_serial(serials: DataFrame, sums: DataFrame, summary: DataFrame, shown: DataFrame) -> DataFrame:
    totals = sums.filter(_of_unit()).groupBy("_scope").agg(F.sum("events").alias("total"))
    known = serials.join(totals, "_scope")
    absent = serials.join(totals, "_scope", "left_anti")

    def at(part: Column, rank: Column) -> list[Column]:
        return [F.lit(0), _pos(F.col("_n")), part, rank]

    absent_rows = _row(
        absent, at(F.lit(0), F.lit(0)), "document", "telemetry", F.lit("no matching document"), F.lit("n/a"),
        _text("No telemetry documents exist for unit {equipment_id}."),
        F.concat(F.lit("equipment_id = "), _quote(F.col("equipment_id"))),
    )
    summary_rows = _summary_rows(
        known.join(summary, "_scope"), at(F.lit(1), _pos(F.col("_place"))),
        F.concat(F.lit("Unit "), "equipment_id", F.lit(" ("), F.col("total").cast("string"), F.lit(" telemetry logs)")),
    )
    # The one event of a summary is not shown again.
    alone = summary.filter("events = 1").select("_scope", F.col("latest_ids").alias("log_id")).distinct()
    position = F.when(F.col("_list") == "reading", 0).otherwise(F.col("_rank")).cast("int")
    events = shown.filter(F.col("_list").isin("reading", "faults")).withColumn("_rank", position)
    events = latest(events, ["_scope", "log_id"], [F.col("_rank").asc()], 1).join(alone, ["_scope", "log_id"], "left_anti")
    events = known.select("question_id", "_n", "_scope").join(events, "_scope")
    return union(absent_rows, summary_rows, _event_rows(events, at(F.lit(2), _pos(F.col("_rank")))))


def _by_fault(codes: DataFrame, found: DataFrame, shown: DataFrame) -> DataFrame:
    def at(part: Column, rank: Column) -> list[Column]:
        return [F.lit(1), _pos(F.col("_n")), part, rank]

    asked = codes.drop("fault_code")
    summary_rows = _refer(asked.join(found, "_scope"), at(F.lit(0), F.lit(0)))
    events = asked.join(shown.filter("_list = 'fault' AND _rank <= 2"), "_scope")
    return union(summary_rows, _inline(_event_rows(events, at(F.lit(1), _pos(F.col("_rank"))))))


def _by_model(broad: DataFrame, found: DataFrame, shown: DataFrame) -> DataFrame:
    def at(part: Column, rank: str) -> list[Column]:
        return [F.lit(2), part, _pos(F.col(rank)), F.lit(0)]

    asked = broad.drop("_each", "_models")
    summary_rows = _refer(asked.join(found, "_scope"), at(F.lit(0), "_place"))
    hot = asked.filter("_hot").join(shown.filter("_list = 'hot'"), "_scope")
    return union(summary_rows, _inline(_event_rows(hot, at(F.lit(1), "_rank"))))


def vector(
    questions: DataFrame, collection: DataFrame, embedder: vectors.Embedder, k: int = 4
) -> DataFrame:
    """Chunks that name a fault code of the question first, then the most similar chunks."""
    asked = _asks(questions, "vector").select("question_id", "question", "entities")
    embedded = vectors.embed(
        asked.select("question_id", F.col("question").alias("text")), embedder
    ).drop("text")
    codes = asked.select(
        "question_id", F.posexplode(F.slice("entities.fault", 1, MAX_FAULTS)).alias("_n", "code")
    )
    in_chunk = F.array_distinct(F.regexp_extract_all("text", F.lit(r"ERR_[A-Z]+_\d{3}"), 0))
    # There is a row for each question on either side, which are not broadcast by the size of packed files.
    exact = vectors.search_containing(
        codes.select("question_id", "code").join(embedded.hint("merge"), "question_id"), collection, in_chunk, 2,
        "question_id", "chunk_id",
    )
    exact = exact.join(codes.hint("merge"), ["question_id", "code"]).select(
        "question_id", "chunk_id", "score", "rank", F.col("_n").alias("priority"),
        F.concat(F.lit("contains "), "code").alias("how"),
    )
    near = vectors.topk_exact(embedded, collection, k, "question_id", "chunk_id").select(
        "question_id", "chunk_id", "score", "rank", F.lit(MAX_FAULTS).alias("priority"),
        F.lit("semantic").alias("how"),
    )
    hits = vectors.fuse(exact.unionByName(near), k + 1, "question_id", "chunk_id")
    meta = collection.select(
        "chunk_id", "source_file", "page_number", "text",
        F.col("indexed_at") if "indexed_at" in collection.columns else F.lit("n/a").alias("indexed_at"),
    )
    rows = hits.join(meta, "chunk_id")
    return _row(
        rows, [_pos(F.col("position"))], "vector", "collection", F.col("chunk_id"), F.col("indexed_at"),
        _text(
            "{source_file} page {page_number} ({how}, similarity {shown}): {text}",
            shown=F.format_string("%.2f", "score"),
        ),
        document=_text("{source_file} p.{page_number}"),
        verify=F.concat(F.lit(f"SELECT * FROM {CHUNKS}.collection WHERE chunk_id = "), _quote(F.col("chunk_id"))),
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def tag(evidence: DataFrame) -> DataFrame:
    """Number the rows of each source within a question: SQL1, SQL2, MDB1, ..."""
    prefix = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    numbered = rank(evidence, ["question_id", "source"], [F.col("ord").asc(), F.col("record_id").asc()], "_tag")
    label = F.concat(F.element_at(prefix, F.col("source")), F.col("_tag").cast("string"))
    body = [c for c in evidence.columns if c == "_body"]
    return numbered.withColumn("tag", label).select("question_id", *EVIDENCE_COLUMNS, F.col("_tag").alias("position"), *body)


# Tables each source needs; a source whose tables are not all there is reported and skipped.
NEEDS = {
    "sql": ["equipment_units", "customers", "service_logs", "warranty_claims", "parts_inventory"],
    "document": ["telemetry"],
    "vector": ["collection"],
}


def collect(
    questions: DataFrame, tables: dict[str, DataFrame], as_of: Column, embedder: vectors.Embedder | None = None, k: int = 4
) -> tuple[DataFrame, dict[str, str], dict[str, float]]:
    """Tagged evidence of all sources, the sources that could not be used, and the milliseconds of each source.

    Each source is written once to the shared folder. One that lacks tables or fails is reported, and the others go on.
    """
    found, errors, timings = gather(questions, tables, as_of, embedder, k, partial=True)
    return found.whole(), errors, timings


def gather(
    questions: DataFrame, tables: dict[str, DataFrame], as_of: Column, embedder: vectors.Embedder | None = None, k: int = 4,
    partial: bool = False,
) -> tuple[Apart, dict[str, str], dict[str, float]]:
    """:func:`collect` with the texts that questions share apart.

    A source that lacks tables or fails ends the run, unless ``partial`` asks for the evidence of the others; whoever does
    so has to show the errors with it.
    """
    embedder = embedder or vectors.HashedTerms()

    def sql() -> tuple[DataFrame, DataFrame]:
        rows, texts = _suppliers(questions, tables)
        return union(
            _inline(union(units(questions, tables, as_of), model(questions, tables, as_of), records(questions, tables))), rows
        ), texts

    sources = {
        "sql": sql,
        "document": lambda: _telemetry(questions, tables),
        "vector": lambda: (_inline(vector(questions, tables["collection"], embedder, k)), None),
    }
    texts = []
    frames, errors, timings = [], {}, {}
    for source, find in sources.items():
        began = time.perf_counter()
        gone = [t for t in NEEDS[source] if t not in tables]
        if gone:
            errors[source] = "missing tables: " + ", ".join(gone)
            if not partial:
                raise ValueError(f"{source}: {errors[source]}")
        else:
            try:
                rows, shared = find()
                frames.append(materialize(rows, f"evidence-{source}"))
                texts += [] if shared is None else [shared]
            except (PySparkException, Py4JError) as error:
                if not partial:
                    raise
                errors[source] = "failed: " + (str(error).strip().splitlines() or [type(error).__name__])[0]
        timings[f"{source}_ms"] = 1000 * (time.perf_counter() - began)
    if not frames:
        raise ValueError("no source is available: " + "; ".join(f"{s}: {e}" for s, e in errors.items()))
    rows = materialize(tag(union(*frames)), "evidence")
    return Apart(rows, union(*texts) if texts else None), errors, timings


def _recount_faults(log: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, fault_code, events): the faults of each scope counted from the log, which is reduced first."""
    faults = log.join(broadcast_if_small(scopes.select("fault_code").distinct()), "fault_code", "left_semi")
    counts = faults.groupBy("fault_code", "equipment_id", "model_code").agg(F.count("*").alias("n"))
    general = F.array(
        F.concat(F.lit("unit "), "equipment_id"), F.concat(F.lit("code "), "fault_code"), F.lit(FLEET)
    )
    models = scopes.filter(F.col("scope").startswith("models ")).select("scope").distinct().select(
        "scope", F.explode(F.split(F.regexp_replace("scope", "^models ", ""), "/")).alias("model_code")
    )
    columns = ["scope", "fault_code", "n"]
    parts = counts.withColumn("scope", F.explode(general)).select(columns).unionByName(
        counts.join(broadcast_if_small(models), "model_code").select(columns)
    )
    return parts.groupBy("scope", "fault_code").agg(F.sum("n").alias("events"))


def _recounted(claims: DataFrame, tables: dict[str, DataFrame], as_of: Column | None) -> DataFrame:
    """(_key, _numbers): the groups that ``claims`` are about counted again, from the tables that are given."""
    def asked(about: list[str], *names: str) -> DataFrame:
        rows = claims.filter(F.col("claim.about").isin(about))
        return rows.select(*[F.col("claim.keys")[i].alias(name) for i, name in enumerate(names)]).distinct()

    def numbers(counted: DataFrame, claim: Column, *values: Column) -> DataFrame:
        keyed = counted.select(claim.cast(CLAIM).alias("claim"), F.array(*[v.cast("string") for v in values]).alias("_numbers"))
        return keyed.select(_claim_key(), "_numbers")

    # A claim whose tables are not all given is counted by nobody.
    frames = [claims.select(_claim_key(), F.lit(None).cast("array<string>").alias("_numbers")).limit(0)]
    if "equipment_units" in tables:
        equipment = tables["equipment_units"].join(
            broadcast_if_small(asked(["fleet", "failures", "claims"], "model")), "model", "left_semi"
        )
        models = asked(["fleet"], "model")
        sizes = models.join(fleet(equipment, F.current_date() if as_of is None else as_of), "model", "left")
        counts = [F.coalesce(c, F.lit(0)) for c in ("units", "in_service", "under_warranty")]
        frames.append(numbers(sizes, _claim("fleet", F.col("model")), *counts))
        if "service_logs" in tables:
            repairs = _repairs(tables["service_logs"], equipment).groupBy("model", "resolution_summary").count()
            frames.append(numbers(repairs, _claim("failures", F.col("model"), F.col("resolution_summary")), F.col("count")))
        if "warranty_claims" in tables:
            own = tables["warranty_claims"].select("equipment_id", "status", "approved_amount").join(
                equipment.select("equipment_id", "model"), "equipment_id"
            ).groupBy("model", "status").agg(F.count("*").alias("n"), F.sum("approved_amount").alias("approved"))
            frames.append(numbers(own, _claim("claims", F.col("model"), F.col("status")), F.col("n"), _money(F.col("approved"))))
    if "parts_inventory" in tables:
        parts = tables["parts_inventory"].withColumn("part", F.trim("part_name")).join(
            broadcast_if_small(asked(["stock"], "part")), "part", "left_semi"
        ).groupBy("part").agg(F.sum("stock_quantity").alias("stock"))
        frames.append(numbers(parts, _claim("stock", F.col("part")), F.col("stock")))
    if "telemetry" in tables:
        faults = _recount_faults(tables["telemetry"], asked(["faults"], "scope", "fault_code"))
        frames.append(numbers(faults, _claim("faults", F.col("scope"), F.col("fault_code")), F.col("events")))
    return union(*frames)


def _claim_key() -> Column:
    """Kind and keys as one text; keys may be NULL."""
    return F.concat("claim.about", F.lit(" "), F.to_json("claim.keys")).alias("_key")


def _check_claims(evidence: DataFrame, tables: dict[str, DataFrame], as_of: Column | None) -> DataFrame:
    """(question_id, tag, _same, _size): whether the text of each row that counts states the numbers counted again."""
    claims = evidence.filter("claim IS NOT NULL").select("question_id", "tag", "text", "record_id", "claim", _claim_key())
    both = claims.join(_recounted(claims, tables, as_of), "_key", "left")
    about, text = F.col("claim.about"), F.col("text")
    first, second = F.col("claim.keys")[0], F.get("claim.keys", F.lit(1))
    n, other, third = (F.get("_numbers", F.lit(i)) for i in range(3))
    fleet_text = _fleet_text(first, n, other, None if as_of is None else third)
    stated = (
        F.when(about == "fleet", text.startswith(fleet_text))
        .when(about == "failures", text == _failures_text(first, second, n, F.col("record_id")))
        .when(about == "claims", text == _claims_text(first, second, n, other, F.col("record_id")))
        .when(about == "faults", text.contains(F.concat(F.lit(": "), _fault_text(second, n))))
        .when(about == "stock", text.endswith(_stock_text(n)))
    )
    same = F.col("_numbers").isNotNull() & F.coalesce(stated, F.lit(False))
    return both.select("question_id", "tag", same.alias("_same"), F.coalesce((n != "0").cast("bigint"), F.lit(0)).alias("_size"))


def verify(evidence: DataFrame, tables: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """Look the records of evidence rows up again: records named, records found, and the verdict.

    Rows that report an absence are verified by finding nothing. What a row says of many records (units of a model,
    repairs by resolution, claims by status, faults of a unit, model, code or the fleet, stock of a part) is counted
    again by the keys in ``claim``, and its text must state these counts. Units under warranty are compared if ``as_of``,
    the day of the evidence, is given. Rows that need a table that is not given are reported as not verified.
    """
    keys = {
        "equipment_units": "equipment_id", "service_logs": "dispatch_id", "warranty_claims": "claim_id",
        "parts_inventory": "part_id", "telemetry": "log_id", "collection": "chunk_id",
    }
    table = F.element_at(F.split("database", r"\."), -1)
    absence = F.col("record_id").startswith("no matching")
    fleets = F.coalesce(F.col("claim.about") == "fleet", F.lit(False))
    named = F.regexp_extract_all("verify", F.lit(r"'((?:[^']|'')+)'"), 1)
    ids = F.when(absence, F.array_distinct(named)).when(
        F.col("source") == "vector", F.array("record_id")
    ).otherwise(F.split("record_id", ", "))
    wanted = evidence.filter(~fleets).select(
        "question_id", "tag", table.alias("_table"), absence.alias("_absence"), F.explode(ids).alias("_id"),
    )
    lookups = []
    for name, key in keys.items():
        if name not in tables:
            continue
        mine = wanted.filter((F.col("_table") == name) & ~F.col("_absence"))
        lookups.append((mine, tables[name].select(F.col(key).alias("_id"))))
        gone = wanted.filter((F.col("_table") == name) & F.col("_absence"))
        if name == "equipment_units":
            either = tables[name].select(F.explode(F.array("equipment_id", "serial_number")).alias("_id"))
            lookups.append((gone, either))
        elif name == "telemetry":
            lookups.append((gone, tables[name].select(F.col("equipment_id").alias("_id"))))
        else:
            lookups.append((gone, tables[name].select(F.col(key).alias("_id"))))
    checked = []
    for mine, source in lookups:
        asked = broadcast_if_small(mine.select("_id").distinct())
        present = source.join(asked, "_id", "left_semi").distinct().withColumn("_hit", F.lit(1))
        checked.append(mine.join(present, "_id", "left").withColumn("_known", F.lit(True)))
    unknown = wanted.filter(~F.col("_table").isin([name for name in keys if name in tables]))
    checked.append(unknown.select("*", F.lit(None).cast("int").alias("_hit"), F.lit(False).alias("_known")))
    rows = union(*checked).groupBy("question_id", "tag", "_absence").agg(
        F.count("*").alias("records"), F.count("_hit").alias("found"), F.bool_and("_known").alias("_known")
    )
    verdict = F.when(F.col("_absence"), F.col("found") == 0).otherwise(F.col("found") == F.col("records"))
    claims = _check_claims(evidence, tables, as_of)
    fleet_rows = evidence.filter(fleets).select("question_id", "tag").join(claims, ["question_id", "tag"]).select(
        "question_id", "tag", F.lit(1).cast("bigint").alias("records"), F.col("_size").alias("found"),
        F.col("_same").alias("verified"),
    )
    out = rows.join(claims, ["question_id", "tag"], "left").select(
        "question_id", "tag", "records", "found",
        (F.col("_known") & verdict & F.coalesce("_same", F.lit(True))).alias("verified"),
    )
    return out.unionByName(fleet_rows)


def verify_apart(found: Apart, tables: dict[str, DataFrame], as_of: Column | None = None) -> Apart:
    """The rows of ``found`` with the columns of :func:`verify`; what several rows say alike is looked up once."""
    said = ["source", "database", "record_id", "document", "timestamp", "text", "verify", "claim", "_body"]
    key = F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256)
    rows = found.rows.withColumn("_said", key)
    once = materialize(rows.select(F.col("_said").alias("question_id"), F.lit("").alias("tag"), *said).distinct(), "said")
    verified = verify(materialize(Apart(once, found.texts).whole(), "said-whole"), tables, as_of)
    verdicts = verified.select(F.col("question_id").alias("_said"), "records", F.col("found"), "verified")
    return replace(found, rows=materialize(rows.join(verdicts, "_said").drop("_said"), "verified"))
