"""Table layouts: raw text tables, typed tables, keys and relationships (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

RAW_COLUMNS = {
    "customers": [
        "customer_id", "company_name", "contact_name", "phone", "email", "address",
        "city", "state", "zip", "country", "created_date", "status",
    ],
    "equipment": [
        "equipment_id", "customer_id", "model", "serial_number", "install_date",
        "capacity_kw", "voltage", "warranty_expiration", "status", "location_notes",
    ],
    "dispatches": [
        "dispatch_id", "equipment_id", "customer_id", "dispatch_date", "technician",
        "service_type", "hours_spent", "labor_cost", "resolution_summary", "status",
    ],
    "parts": [
        "part_id", "part_name", "category", "manufacturer", "supplier",
        "unit_cost", "unit_price", "stock_quantity", "reorder_level",
    ],
    "warranty_claims": [
        "claim_id", "equipment_id", "dispatch_id", "part_id", "claim_date",
        "claim_amount", "approved_amount", "status", "denial_reason", "claim_notes",
    ],
}


@dataclass(frozen=True)
class TableRules:
    """Cleansing rules of one raw table: key, date columns and numeric columns."""

    key: str
    dates: list[str] = field(default_factory=list)
    numerics: list[str] = field(default_factory=list)


RULES = {
    "customers": TableRules("customer_id", ["created_date"]),
    "equipment": TableRules("equipment_id", ["install_date", "warranty_expiration"], ["capacity_kw"]),
    "dispatches": TableRules("dispatch_id", ["dispatch_date"], ["hours_spent", "labor_cost"]),
    "parts": TableRules(
        "part_id", [], ["unit_cost", "unit_price", "stock_quantity", "reorder_level"]
    ),
    "warranty_claims": TableRules("claim_id", ["claim_date"], ["claim_amount", "approved_amount"]),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_key: str
    required: bool = True


RAW_FOREIGN_KEYS = [
    ForeignKey("equipment", "customer_id", "customers", "customer_id"),
    ForeignKey("dispatches", "equipment_id", "equipment", "equipment_id"),
    ForeignKey("dispatches", "customer_id", "customers", "customer_id"),
    ForeignKey("warranty_claims", "equipment_id", "equipment", "equipment_id"),
    ForeignKey("warranty_claims", "dispatch_id", "dispatches", "dispatch_id", required=False),
    ForeignKey("warranty_claims", "part_id", "parts", "part_id", required=False),
]

SILVER_FOREIGN_KEYS = [
    ForeignKey("equipment_units", "customer_id", "customers", "customer_id"),
    ForeignKey("service_logs", "equipment_id", "equipment_units", "equipment_id"),
    ForeignKey("warranty_claims", "equipment_id", "equipment_units", "equipment_id"),
    ForeignKey("warranty_claims", "dispatch_id", "service_logs", "dispatch_id", required=False),
    ForeignKey("warranty_claims", "part_id", "parts_inventory", "part_id", required=False),
]

# Raw table -> typed table.
SILVER_NAMES = {
    "customers": "customers",
    "equipment": "equipment_units",
    "dispatches": "service_logs",
    "parts": "parts_inventory",
    "warranty_claims": "warranty_claims",
}


@dataclass(frozen=True)
class TypedColumn:
    """A typed column; ``length`` is the longest allowed text, ``required`` forbids NULL."""

    name: str
    type: str
    length: int | None = None
    required: bool = False


def _text(name: str, length: int | None = None, required: bool = False) -> TypedColumn:
    return TypedColumn(name, "string", length, required)


SILVER_COLUMNS = {
    "customers": [
        _text("customer_id", 20, True), _text("company_name", 255, True),
        _text("contact_name", 255, True), _text("phone", 30), _text("email", 255),
        _text("address", 500), _text("city", 100), _text("state", 2), _text("zip", 20),
        _text("country", 2), TypedColumn("created_date", "date"), _text("status", 30),
    ],
    "equipment_units": [
        _text("equipment_id", 20, True), _text("customer_id", 20, True), _text("model", 100),
        _text("serial_number", 100), TypedColumn("install_date", "date"),
        TypedColumn("capacity_kw", "decimal(12,2)"), _text("voltage", 30),
        TypedColumn("warranty_expiration", "date"), _text("status", 30), _text("location_notes"),
    ],
    "parts_inventory": [
        _text("part_id", 20, True), _text("part_name", 255, True), _text("category", 100),
        _text("manufacturer", 150), _text("supplier", 150),
        TypedColumn("unit_cost", "decimal(12,2)"), TypedColumn("unit_price", "decimal(12,2)"),
        TypedColumn("stock_quantity", "int"), TypedColumn("reorder_level", "int"),
    ],
    "service_logs": [
        _text("dispatch_id", 20, True), _text("equipment_id", 20, True),
        TypedColumn("dispatch_date", "date"), _text("technician", 255), _text("service_type", 100),
        TypedColumn("hours_spent", "decimal(10,2)"), TypedColumn("labor_cost", "decimal(12,2)"),
        _text("resolution_summary"), _text("status", 30),
    ],
    "warranty_claims": [
        _text("claim_id", 20, True), _text("equipment_id", 20, True), _text("dispatch_id", 20),
        _text("part_id", 20), TypedColumn("claim_date", "date"),
        TypedColumn("claim_amount", "decimal(12,2)"), TypedColumn("approved_amount", "decimal(12,2)"),
        _text("status", 30), _text("denial_reason"), _text("claim_notes"),
    ],
}

# Keys of the change-log JSON documents, in order.
AUDIT_FIELDS = [
    "dispatch_id", "equipment_id", "dispatch_date", "technician", "service_type",
    "hours_spent", "labor_cost", "resolution_summary", "status",
]

# Reader-facing columns of the restricted view, in order.
SAFE_VIEW_COLUMNS = [
    "dispatch_id", "equipment_id", "equipment_model", "serial_number", "dispatch_date",
    "technician", "service_type", "resolution_summary", "status", "rag_service_context",
]

EVIDENCE_COLUMNS = [
    "source", "database", "record_id", "document", "timestamp", "text", "verify", "tag", "claim",
]

_STRING, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TELEMETRY_SCHEMA = _struct(
    log_id=_STRING, timestamp=_STRING, equipment_id=_STRING, model=_STRING, status=_STRING, fault_code=_STRING,
    severity=_STRING,
    telemetry=_struct(
        voltage_v=_DOUBLE, current_a=_DOUBLE, temperature_c=_DOUBLE, soc_percent=_DOUBLE, voltage_delta_mv=_DOUBLE
    ),
    flagged_components=T.ArrayType(_STRING), notes=_STRING,
)
PAGE_SCHEMA = _struct(
    document_id=_STRING, document_type=_STRING, source_file=_STRING, page_number=_INT, text=_STRING
)
CHUNK_SCHEMA = _struct(
    chunk_id=_STRING, document_id=_STRING, document_type=_STRING, source_file=_STRING, page_number=_INT,
    chunk_size_characters=_INT, overlap_characters=_INT, text=_STRING,
)


def all_text(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS[table]])
