"""SQL that computes the registered queries independently, over the plain table names."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.operators import answers, router, suppliers
from lodestone.operators.profile import MONEY_COLUMNS
from lodestone.plans.derive import cte
from lodestone.plans.queries import AS_OF, COUNTED
from lodestone.sources.schemas import AUDIT_FIELDS, RAW_COLUMNS, RAW_FOREIGN_KEYS, RULES

SQL: dict[str, str] = {}


def _rollup(source: str, kind: str, date: str, hours: str, cost: str, avg: bool) -> str:
    mean = f", round(avg(CAST({cost} AS DOUBLE)), 2) AS avg_labor_cost" if avg else ""
    return f"""SELECT {kind} AS service_type, CAST(year({date}) AS BIGINT) AS service_year,
    CAST(month({date}) AS BIGINT) AS service_month, count(*) AS dispatch_count,
    CAST(sum(CAST({hours} AS DECIMAL(12,2))) AS DOUBLE) AS total_hours,
    CAST(sum(CAST({cost} AS DECIMAL(12,2))) AS DOUBLE) AS total_labor_cost{mean}
FROM {source} GROUP BY 1, 2, 3"""


SQL["service_rollup"] = _rollup("lineitem", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", True)
SQL["snapshot_rollup"] = cte("service_logs") + _rollup(
    "service_logs, generate_series(1, 100)", "service_type", "dispatch_date", "hours_spent", "labor_cost", False
)
SQL["snapshot_verify"] = cte("service_logs") + """, s AS (SELECT count(*) * 100 AS n, CAST(sum(labor_cost) * 100 AS DOUBLE) AS c
    FROM service_logs)
SELECT n AS original_rows, n AS copy_rows, c AS original_total_labor, c AS copy_total_labor, true AS matches FROM s"""

SQL["row_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNTED)
SQL["value_counts"] = cte("raw_equipment") + """ SELECT install_date, count(*) AS occurrences FROM raw_equipment
GROUP BY 1 ORDER BY occurrences DESC, install_date LIMIT 15"""
SQL["duplicate_keys"] = """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""
SQL["duplicate_profile"] = cte("raw_dispatches") + """, k AS (SELECT trim(dispatch_id) AS key, count(*) AS n
    FROM raw_dispatches GROUP BY 1)
SELECT count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM k WHERE key <> ''"""

_MISSING = "upper(trim(coalesce(v, ''))) IN ('', 'NULL', 'N/A', 'NA')"


def _profile(table: str, source: str, columns: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM {source}" for c in columns)
    return f"""SELECT '{table}' AS table_name, column_name, count(*) FILTER ({_MISSING}) AS missing,
    count(*) FILTER (regexp_matches(v, '<[^>]*>')) AS html,
    count(*) FILTER (NOT ({_MISSING}) AND (v <> trim(v, ' \t\n') OR regexp_matches(v, '\\s\\s'))) AS whitespace,
    count(*) FILTER (contains(v, 'Ã') OR contains(v, 'â') OR contains(v, chr(65533))) AS encoding_flags
FROM ({long}) GROUP BY 1, 2"""


_RAW = {
    "customers": ("raw_customers", RAW_COLUMNS["customers"]),
    "equipment": ("raw_equipment", RAW_COLUMNS["equipment"]),
    "dispatches": ("raw_dispatches", RAW_COLUMNS["dispatches"]),
    "parts": ("raw_parts", RAW_COLUMNS["parts"]),
    "warranty_claims": ("raw_claims", RAW_COLUMNS["warranty_claims"]),
}
_ALL_RAW = [source for source, _ in _RAW.values()]

SQL["column_profile"] = (
    cte(*_ALL_RAW)
    + " SELECT * FROM ("
    + " UNION ALL ".join(_profile(t, s, c) for t, (s, c) in _RAW.items())
    + " UNION ALL " + _profile("pages", "pages", ["url", "html"])
    + ") WHERE missing + html + whitespace + encoding_flags > 0"
)
_LAYOUT = """CASE WHEN regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') THEN 'ISO timestamp'
    WHEN regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN 'YYYY-MM-DD'
    WHEN regexp_full_match(v, '\\d{4}/\\d{2}/\\d{2}') THEN 'YYYY/MM/DD'
    WHEN regexp_full_match(v, '\\d{2}/\\d{2}/\\d{4}') THEN 'MM/DD/YYYY'
    WHEN regexp_full_match(v, '\\d{2}-\\d{2}-\\d{4}') THEN 'MM-DD-YYYY' ELSE 'Other' END"""
def _each(wanted: Callable[[str], bool], select: Callable[[str, str, str], str]) -> str:
    """A SELECT for each column of the raw tables that is wanted, from (name of the table, its rows, column)."""
    return cte(*_ALL_RAW) + " " + " UNION ALL ".join(
        select(table, source, c) for table, (source, columns) in _RAW.items() for c in columns if wanted(c)
    )


SQL["date_formats"] = _each(
    lambda c: "date" in c or "expiration" in c,
    lambda table, source, c: f"""SELECT '{table}' AS table_name, '{c}' AS column_name, {_LAYOUT} AS format, count(*) AS occurrences
    FROM (SELECT {c} AS v FROM {source}) WHERE NOT ({_MISSING}) GROUP BY 3""",
)
SQL["status_values"] = _each(
    lambda c: c == "status",
    lambda table, source, c: f"""SELECT '{table}' AS table_name, '{c}' AS column_name, trim(v) AS value, count(*) AS occurrences
    FROM (SELECT {c} AS v FROM {source}) WHERE NOT ({_MISSING}) GROUP BY 3""",
)
SQL["currency_symbols"] = _each(
    lambda c: c in MONEY_COLUMNS,
    lambda table, source, c: f"""SELECT '{table}' AS table_name, '{c}' AS column_name,
    count(*) FILTER (contains({c}, '$')) AS with_symbol FROM {source}""",
)
SQL["untrimmed_rows"] = cte(*_ALL_RAW) + " " + " UNION ALL ".join(
    f"""SELECT '{table}' AS table_name,
    count(*) FILTER ({' OR '.join(f"coalesce({c} <> trim({c}), false)" for c in columns)}) AS rows_with_extra_whitespace,
    count(*) FILTER ({' OR '.join(f"coalesce(regexp_matches({c}, '<[^>]*>'), false)" for c in columns)}) AS rows_with_html
    FROM {source}"""
    for table, (source, columns) in _RAW.items()
)
SQL["table_sample"] = "SELECT * FROM customer ORDER BY c_name LIMIT 5"

SQL["bronze_csv"] = cte("raw_parts") + """ SELECT part_id,
    CASE WHEN source_row % 7 = 0 THEN part_name || chr(10) || 'and "more",' || chr(10) ELSE part_name END AS part_name,
    supplier, unit_cost, row_number() OVER (ORDER BY source_row) + 1 AS source_row FROM raw_parts"""

# ---- cleaners

_PAGE = "regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
SQL["clean_text"] = f"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace({_PAGE}, '<[^>]*>', '', 'g'),
    '[\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g')), '') AS body FROM pages"""


def _text(column: str) -> str:
    """The raw tables contain tags, ``&amp;`` and ASCII blanks only."""
    tidy = f"trim(regexp_replace(regexp_replace(replace({column}, '&amp;', '&'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN upper({tidy}) IN ('', 'NULL', 'N/A', 'NA') THEN NULL ELSE {tidy} END"


_FORMATS = "['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%m-%d-%Y']"


def _date(column: str) -> str:
    return f"strftime(try_strptime({column}, {_FORMATS}), '%Y-%m-%d')"


def _date_error(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL AND {_date(column)} IS NULL THEN 'unrecognized date: ' || {column} END"


def _bare(column: str) -> str:
    return f"replace(replace({column}, '$', ''), ',', '')"


def _number(column: str) -> str:
    fixed = f"CAST(try_cast({_bare(column)} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"regexp_replace(regexp_replace({fixed}, '0+$', ''), '\\.$', '')"


def _number_error(column: str) -> str:
    return f"""CASE WHEN {column} IS NOT NULL AND {_number(column)} IS NULL
        THEN 'invalid numeric value: ' || {_bare(column)} END"""


def _title(column: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({column}, '([A-Za-z]+|[^A-Za-z]+)'),
        lambda w: upper(w[1]) || lower(w[2:])), '')"""


def _phone(column: str) -> str:
    digits = f"regexp_replace({column}, '[^0-9]', '', 'g')"
    return f"""CASE WHEN length({digits}) = 10
        THEN {digits}[1:3] || '-' || {digits}[4:6] || '-' || {digits}[7:10] ELSE {column} END"""


def _country(column: str) -> str:
    return f"""CASE WHEN upper({column}) IN ('US', 'USA', 'U.S.', 'UNITED STATES') THEN 'US' ELSE upper({column}) END"""


SQL["clean_date"] = cte("raw_customers") + f""" SELECT source_row, {_date('v')} AS created_date,
    {_date_error('v')} AS problem, {_LAYOUT} AS layout
FROM (SELECT source_row, created_date AS v FROM raw_customers)"""
SQL["clean_number"] = cte("raw_dispatches") + f""" SELECT source_row, dispatch_id, {_number('labor_cost')} AS labor_cost,
    {_number_error('labor_cost')} AS problem FROM raw_dispatches"""
SQL["clean_contacts"] = cte("raw_customers") + f""", t AS (SELECT source_row, {_text('phone')} AS phone,
    {_text('country')} AS country, {_text('state')} AS state, {_text('status')} AS status FROM raw_customers)
SELECT source_row, {_phone('phone')} AS phone, {_country('country')} AS country, upper(state) AS state,
    {_title('status')} AS status FROM t"""

SQL["sql_cleaners"] = SQL["clean_contacts"]

# ---- cleansing: tidy -> parsed -> ranked -> parents

_NORMAL = {"status": _title, "state": lambda c: f"upper({c})", "country": _country, "phone": _phone}


def _marked(table: str) -> str:
    """CTEs ``<table>_marked``: cleaned rows with the reason of parse errors, missing and repeated keys."""
    source, columns = _RAW[table]
    rules = RULES[table]
    tidy = ", ".join(f"{_text(c)} AS {c}" for c in columns)
    errors = [_date_error(c) for c in rules.dates] + [_number_error(c) for c in rules.numerics]
    values = []
    for c in columns:
        normal = _date(c) if c in rules.dates else _number(c) if c in rules.numerics else None
        normal = normal or (_NORMAL[c](c) if c in _NORMAL else None)
        values.append(f"CASE WHEN reason IS NULL THEN {normal} ELSE {c} END AS {c}" if normal else c)
    full = " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)
    key = rules.key
    return f"""{table}_tidy AS (SELECT source_row, {tidy} FROM {source}),
{table}_checked AS (SELECT *, coalesce({', '.join(errors)}) AS reason FROM {table}_tidy),
{table}_normal AS (SELECT source_row, reason, {', '.join(values)} FROM {table}_checked),
{table}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}, reason IS NULL ORDER BY {full} DESC, source_row) AS rn
    FROM {table}_normal),
{table}_marked AS (SELECT source_row, {', '.join(columns)}, CASE WHEN reason IS NOT NULL THEN reason
    WHEN {key} IS NULL THEN 'missing required primary key: {key}'
    WHEN rn > 1 THEN 'duplicate {key}: ' || {key} END AS rejection_reason FROM {table}_ranked)"""


_PARENTS = {
    "equipment": (
        ["customers"],
        "t.customer_id IN (SELECT customer_id FROM customers_final WHERE rejection_reason IS NULL)",
        "'customer_id not found after cleansing: ' || coalesce(t.customer_id, '')",
    ),
    "dispatches": (
        ["customers", "equipment"],
        "t.equipment_id IN (SELECT equipment_id FROM equipment_final WHERE rejection_reason IS NULL) "
        "AND t.customer_id IN (SELECT customer_id FROM customers_final WHERE rejection_reason IS NULL)",
        "'equipment_id or customer_id not found after cleansing'",
    ),
    "warranty_claims": (
        ["customers", "equipment", "dispatches", "parts"],
        "t.equipment_id IN (SELECT equipment_id FROM equipment_final WHERE rejection_reason IS NULL) "
        "AND (t.dispatch_id IS NULL OR t.dispatch_id IN "
        "(SELECT dispatch_id FROM dispatches_final WHERE rejection_reason IS NULL)) "
        "AND (t.part_id IS NULL OR t.part_id IN (SELECT part_id FROM parts_final WHERE rejection_reason IS NULL))",
        "'equipment_id, dispatch_id, or part_id not found after cleansing'",
    ),
}


def _cleansed(*tables: str) -> str:
    """CTEs ``<table>_final`` of the tables and of all their ancestors."""
    order = ["customers", "parts", "equipment", "dispatches", "warranty_claims"]
    needed = set(tables)
    for t in tables:
        needed |= set(_PARENTS.get(t, ([],))[0])
    parts = [cte(*[_RAW[t][0] for t in order if t in needed])]
    for t in order:
        if t not in needed:
            continue
        parts.append(_marked(t))
        if t in _PARENTS:
            _, test, reason = _PARENTS[t]
            parts.append(f"""{t}_final AS (SELECT t.* EXCLUDE (rejection_reason),
    CASE WHEN rejection_reason IS NOT NULL THEN rejection_reason WHEN coalesce({test}, false) THEN NULL
    ELSE {reason} END AS rejection_reason FROM {t}_marked t)""")
        else:
            parts.append(f"{t}_final AS (SELECT * FROM {t}_marked)")
    return ",\n".join(parts)


for _name, _table in {
    "cleanse_customers": "customers", "cleanse_equipment": "equipment", "cleanse_dispatches": "dispatches",
    "cleanse_parts": "parts", "cleanse_claims": "warranty_claims",
}.items():
    SQL[_name] = _cleansed(_table) + f" SELECT * FROM {_table}_final"

SQL["dedupe_completeness"] = cte("raw_dispatches") + ",\n" + _marked("dispatches") + """
SELECT dispatch_id, source_row, coalesce(rejection_reason, 'kept') AS outcome FROM dispatches_marked"""
SQL["cleaning_summary"] = _cleansed(*_RAW) + " " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) AS input_rows, count(*) FILTER (rejection_reason IS NULL) AS clean_rows,
    count(rejection_reason) AS rejected_rows FROM {t}_final""" for t in _RAW
)
SQL["rejection_reasons"] = _cleansed(*_RAW) + " " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, split_part(rejection_reason, ': ', 1)
    || CASE WHEN rejection_reason LIKE 'missing required%' THEN '' ELSE '' END AS reason, count(*) AS rejected_rows
    FROM {t}_final WHERE rejection_reason IS NOT NULL GROUP BY 1, 2""" for t in _RAW
)
SQL["reconcile"] = _cleansed(*_RAW) + " " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) AS bronze_rows, count(*) FILTER (rejection_reason IS NULL) AS silver_rows,
    count(rejection_reason) AS quarantine_rows, true AS balanced FROM {t}_final""" for t in _RAW
)
SQL["residual_checks"] = _cleansed(*_RAW) + """
SELECT 'HTML remaining in customer company names' AS check_name,
    count(*) FILTER (regexp_matches(company_name, '<[^>]*>')) AS problem_rows
FROM customers_final WHERE rejection_reason IS NULL
UNION ALL SELECT 'invalid customer created dates', count(*) FILTER (created_date IS NULL)
FROM customers_final WHERE rejection_reason IS NULL
UNION ALL SELECT 'HTML remaining in service summaries', count(*) FILTER (regexp_matches(resolution_summary, '<[^>]*>'))
FROM dispatches_final WHERE rejection_reason IS NULL
UNION ALL SELECT 'service logs without resolution', count(*) FILTER (resolution_summary IS NULL)
FROM dispatches_final WHERE rejection_reason IS NULL
UNION ALL SELECT 'HTML in raw pages', count(*) FILTER (regexp_matches(html, '<[^>]*>')) FROM pages"""
SQL["orphans"] = cte(*_ALL_RAW) + " UNION ALL ".join(
    f""" SELECT '{fk.child} -> {fk.parent}{"" if fk.required else " (optional)"}' AS relationship_name, count(*) AS orphan_rows
FROM (SELECT trim({fk.column}) AS k FROM {_RAW[fk.child][0]}) c
LEFT JOIN (SELECT DISTINCT trim({fk.parent_key}) AS k FROM {_RAW[fk.parent][0]}) p ON p.k = c.k
WHERE p.k IS NULL{"" if fk.required else " AND c.k IS NOT NULL"}"""
    for fk in RAW_FOREIGN_KEYS
)
SQL["silver_service_logs"] = cte("raw_dispatches") + ",\n" + _marked("dispatches") + """
SELECT dispatch_id, equipment_id, CAST(dispatch_date AS DATE) AS dispatch_date, technician, service_type,
    CAST(CAST(hours_spent AS DECIMAL(10,2)) AS DOUBLE) AS hours_spent,
    CAST(CAST(labor_cost AS DECIMAL(12,2)) AS DOUBLE) AS labor_cost, resolution_summary, status
FROM dispatches_normal WHERE reason IS NULL"""
SQL["silver_constraints"] = cte("raw_parts") + """ SELECT part_id, CASE
    WHEN part_name = 'red bolt' THEN 'missing required value: part_name'
    WHEN length(repeat(manufacturer, 20)) > 150 THEN 'value too long for manufacturer: limit 150'
    WHEN try_cast(unit_cost AS DECIMAL(12,2)) IS NULL THEN 'value does not fit unit_cost'
    WHEN try_cast(reorder_level AS INT) IS NULL THEN 'value does not fit reorder_level' END AS rejection_reason
FROM raw_parts"""

# ---- context, payloads, view, change history

_CONTEXT = """concat_ws(' | ', 'Dispatch ID: ' || dispatch_id, 'Equipment ID: ' || equipment_id,
    'Service Date: ' || coalesce(CAST(dispatch_date AS VARCHAR), 'unknown'),
    'Technician: ' || coalesce(technician, 'unknown'), 'Service Type: ' || coalesce(service_type, 'unknown'),
    'Resolution: ' || coalesce(nullif(trim(resolution_summary), ''), 'No resolution recorded'),
    'Status: ' || coalesce(status, 'unknown'))"""
SQL["service_context"] = cte("service_logs") + f" SELECT dispatch_id, {_CONTEXT} AS rag_service_context FROM service_logs"
_PAYLOADS = cte("service_logs", "equipment_units") + f""", logs AS (SELECT *, {_CONTEXT} AS context FROM service_logs),
payloads AS (SELECT dispatch_id, equipment_id, 'service_logs' AS source_table, dispatch_id AS source_record_id,
    concat_ws(chr(10), 'SOURCE: silver.service_logs', 'SOURCE_RECORD_ID: ' || dispatch_id,
        'EQUIPMENT_ID: ' || equipment_id, 'EQUIPMENT_MODEL: ' || coalesce(model, 'unknown'),
        'CUSTOMER_ID: ' || customer_id, 'SERVICE_CONTEXT: ' || context, 'CLEANED_RESOLUTION: ' || coalesce(
            nullif(trim(regexp_replace(resolution_summary, '\\s+', ' ', 'g')), ''), 'No resolution recorded'))
        AS payload_text, DATE '2024-01-01' AS prepared_at, service_type, logs.status
    FROM logs JOIN equipment_units USING (equipment_id))"""
SQL["payloads"] = _PAYLOADS + " SELECT * EXCLUDE (service_type, status) FROM payloads"
SQL["payload_stats"] = _PAYLOADS + """ SELECT count(*) AS prepared_payload_count, max(prepared_at) AS last_prepared_at
FROM payloads"""
SQL["payload_upsert"] = _PAYLOADS + """, stored AS (SELECT row_number() OVER (ORDER BY dispatch_id) AS payload_id,
        dispatch_id, equipment_id FROM payloads WHERE service_type = 'Diagnostic'),
    fresh AS (SELECT dispatch_id, equipment_id FROM payloads WHERE status = 'Completed'),
    added AS (SELECT * FROM fresh WHERE dispatch_id NOT IN (SELECT dispatch_id FROM stored))
SELECT payload_id, dispatch_id, equipment_id, CASE WHEN dispatch_id IN (SELECT dispatch_id FROM fresh)
    THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS prepared_at FROM stored
UNION ALL SELECT (SELECT max(payload_id) FROM stored) + row_number() OVER (ORDER BY dispatch_id), dispatch_id,
    equipment_id, DATE '2024-02-01' FROM added"""
SQL["safe_view"] = cte("service_logs", "equipment_units") + f""", logs AS (SELECT *, {_CONTEXT} AS context FROM service_logs)
SELECT dispatch_id, equipment_id, model AS equipment_model, serial_number, dispatch_date, technician, service_type,
    resolution_summary, logs.status, context AS rag_service_context
FROM logs JOIN equipment_units USING (equipment_id)"""
_KEYS = ("[dispatch_id, equipment_id, dispatch_date, technician, service_type, hours_spent, labor_cost, "
         "resolution_summary, status]")
def _plain(field: str) -> str:
    return "DOUBLE" if field in ("hours_spent", "labor_cost") else "VARCHAR"


_FRESH = "service_type = 'Emergency Repair'"
SQL["audit_capture"] = cte("service_logs") + f""" SELECT dispatch_id AS record_id, 'loader' AS database_user,
    'service_logs' AS table_name, CASE WHEN {_FRESH} THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
    CASE WHEN {_FRESH} THEN 'New service log created'
        ELSE 'Service log changed; pre-change and post-change values captured' END AS change_description,
    {", ".join(f"CASE WHEN {_FRESH} THEN NULL ELSE CAST({f} AS {_plain(f)}) END AS old_{f}" for f in AUDIT_FIELDS)},
    {", ".join(f"CAST({f} AS {_plain(f)}) AS new_{f}" for f in AUDIT_FIELDS if f != "status")},
    'Completed' AS new_status, '{_KEYS}' AS keys
FROM service_logs WHERE {_FRESH} OR status = 'In Progress'"""
SQL["audit_change_feed"] = cte("service_logs") + """ SELECT dispatch_id AS record_id,
    CASE WHEN service_type = 'Emergency Repair' THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
    CAST(1 AS BIGINT) AS place, '2024-01-01' AS "at",
    CASE WHEN service_type = 'Emergency Repair' THEN NULL ELSE status END AS old_status,
    'Completed' AS new_status, resolution_summary AS new_resolution FROM service_logs
UNION ALL SELECT dispatch_id, 'UPDATE', 2, '2024-01-01', 'Completed', 'Completed', 'Closed on site' FROM service_logs
WHERE resolution_summary IS NULL"""
SQL["surrogate_ids"] = """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id, o_orderkey FROM orders"""

# ---- telemetry

_TEL = cte("telemetry_flat") + ", faults AS (SELECT * FROM telemetry_flat WHERE fault_code IS NOT NULL)"
_PARTS_OF = """(SELECT {k} fault_code, component_a AS component FROM faults WHERE component_a IS NOT NULL
    UNION SELECT {k} fault_code, component_b FROM faults WHERE component_b IS NOT NULL)"""
SQL["fault_summary"] = _TEL + f""",
u AS (SELECT fault_code, string_agg(equipment_id, ', ' ORDER BY equipment_id) AS units FROM (
    SELECT DISTINCT fault_code, equipment_id FROM faults) GROUP BY 1),
i AS (SELECT fault_code, string_agg(log_id, ', ' ORDER BY ts DESC, log_id DESC) AS latest_ids FROM (
    SELECT * FROM faults QUALIFY row_number() OVER (PARTITION BY fault_code ORDER BY ts DESC, log_id DESC) <= 3)
    GROUP BY 1),
c AS (SELECT fault_code, string_agg(component, ', ' ORDER BY component) AS components
    FROM {_PARTS_OF.format(k='')} GROUP BY 1)
SELECT fault_code, count(*) AS events, count(DISTINCT equipment_id) AS n_units, max(temperature_c) AS max_temperature,
    round(avg(temperature_c), 6) AS avg_temperature, min(ts) AS first_ts, max(ts) AS last_ts, any_value(units) AS units,
    any_value(latest_ids) AS latest_ids, any_value(components) AS components, arg_max(notes, ts) AS latest_note
FROM faults JOIN u USING (fault_code) JOIN i USING (fault_code) JOIN c USING (fault_code) GROUP BY fault_code"""
SQL["fault_summary_by_model"] = _TEL + f""",
i AS (SELECT model_code, fault_code, string_agg(log_id, ', ' ORDER BY ts DESC, log_id DESC) AS latest_ids FROM (
    SELECT * FROM faults
    QUALIFY row_number() OVER (PARTITION BY model_code, fault_code ORDER BY ts DESC, log_id DESC) <= 3) GROUP BY 1, 2),
c AS (SELECT model_code, fault_code, string_agg(component, ', ' ORDER BY component) AS components
    FROM {_PARTS_OF.format(k='model_code,')} GROUP BY 1, 2)
SELECT model_code, fault_code, count(*) AS events, count(DISTINCT equipment_id) AS n_units,
    max(temperature_c) AS max_temperature, any_value(latest_ids) AS latest_ids, any_value(components) AS components
FROM faults JOIN i USING (model_code, fault_code) JOIN c USING (model_code, fault_code) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY model_code ORDER BY events DESC, fault_code) <= 2"""
SQL["fault_counts"] = _TEL + """ SELECT fault_code, count(*) AS events, max(temperature_c) AS max_temperature,
    count(DISTINCT equipment_id) AS n_units FROM faults GROUP BY 1"""
SQL["fault_units"] = _TEL + " SELECT DISTINCT fault_code, equipment_id FROM faults"
SQL["latest_readings"] = _TEL + """ SELECT equipment_id, log_id,
    row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, log_id DESC) AS position
FROM telemetry_flat QUALIFY position <= 5"""
SQL["unit_events"] = _TEL + """, picked AS (
    SELECT equipment_id, log_id, 1 AS position FROM telemetry_flat
    QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, log_id DESC) = 1
    UNION ALL SELECT equipment_id, log_id, 10 + row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, log_id DESC)
    FROM faults QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, log_id DESC) <= 2),
single AS (SELECT equipment_id, max(log_id) AS log_id FROM faults GROUP BY equipment_id, fault_code HAVING count(*) = 1)
SELECT equipment_id, log_id, CAST(min(position) AS BIGINT) AS position FROM picked
WHERE (equipment_id, log_id) NOT IN (SELECT (equipment_id, log_id) FROM single) GROUP BY 1, 2"""
SQL["hottest_faults"] = _TEL + """ SELECT model_code, log_id, temperature_c,
    row_number() OVER (PARTITION BY model_code ORDER BY temperature_c DESC, log_id) AS position
FROM faults QUALIFY position <= 2"""
SQL["telemetry_counts"] = _TEL + """ SELECT model_code, count(*) AS documents FROM faults
WHERE severity IN ('Critical', 'Fatal', 'High') GROUP BY 1"""
SQL["telemetry_models"] = cte("telemetry_flat", "equipment_units") + """, m AS (
    SELECT model AS model_code, count(*) AS erp_units, min(install_date) AS first_install FROM equipment_units GROUP BY 1)
SELECT model_code, erp_units, first_install, count(*) AS documents FROM telemetry_flat JOIN m USING (model_code)
GROUP BY 1, 2, 3"""
_UPSERT = _TEL + """, target AS (SELECT log_id, equipment_id, status, fault_code FROM faults),
batch AS (SELECT log_id, equipment_id, CASE WHEN fault_code IS NULL THEN 'Twice' ELSE 'Rechecked' END AS status, fault_code
    FROM telemetry_flat WHERE status = 'Online')"""
SQL["replace_by_key"] = _UPSERT + """ SELECT * FROM batch
UNION ALL SELECT * FROM target WHERE log_id NOT IN (SELECT log_id FROM batch)"""
SQL["replace_counts"] = _UPSERT + """ SELECT count(*) FILTER (t.log_id IS NULL) AS inserted,
    count(t.log_id) AS replaced, CAST(0 AS BIGINT) AS skipped FROM batch b LEFT JOIN target t USING (log_id)"""
SQL["parse_telemetry"] = cte("telemetry_flat") + """ SELECT
    CASE WHEN p IS NULL THEN log_id END AS log_id, CAST(regexp_extract(log_id, '\\d+') AS BIGINT) AS line,
    CASE WHEN p IS NULL THEN model_code END AS model_code, CASE WHEN p IS NULL THEN fault_code END AS fault_code,
    CASE WHEN p IS NULL THEN temperature_c END AS temperature_c,
    CASE WHEN p IS NULL THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS "at", p AS problem
FROM (SELECT *, CASE soc_percent WHEN 7 THEN 'missing log_id' WHEN 8 THEN 'bad timestamp'
    WHEN 9 THEN 'undecodable line' END AS p FROM telemetry_flat)"""

# ---- parts, models, fleet

_SUPPLIERS = cte("parts_inventory") + """, by_part AS (SELECT trim(part_name) AS part,
    count(DISTINCT supplier) AS n_suppliers, string_agg(DISTINCT supplier, ', ' ORDER BY supplier) AS suppliers,
    string_agg(DISTINCT manufacturer, ', ' ORDER BY manufacturer) AS makers,
    array_to_string(list_sort(list(part_id)), ', ') AS part_ids, count(*) AS n_parts,
    CAST(sum(stock_quantity) AS BIGINT) AS stock FROM parts_inventory GROUP BY 1)"""
SQL["supplier_risk"] = _SUPPLIERS + " SELECT * FROM by_part"
SQL["supplier_risk_words"] = _SUPPLIERS + """ SELECT * FROM by_part WHERE part ILIKE '%cell%' OR part ILIKE '%fus%'
ORDER BY n_suppliers, part LIMIT 8"""
SQL["single_source_parts"] = _SUPPLIERS + """ SELECT * FROM by_part WHERE n_suppliers = 1
ORDER BY n_suppliers, part LIMIT 8"""
_FLEET = f"""SELECT model, count(*) AS units, count(*) FILTER (status = 'In Service') AS in_service,
    count(*) FILTER (warranty_expiration >= DATE '{AS_OF}') AS under_warranty, min(install_date) AS first_install,
    max(install_date) AS last_install FROM equipment_units GROUP BY 1"""
SQL["fleet_status"] = cte("equipment_units") + " " + _FLEET
_FAILURES = """own AS (SELECT model, resolution_summary, dispatch_id, dispatch_date FROM service_logs
    JOIN equipment_units USING (equipment_id) WHERE service_type IN
    ('Emergency Repair', 'Corrective Maintenance', 'Diagnostic', 'Warranty Replacement')),
failures AS (SELECT model, resolution_summary, count(*) AS n, min(dispatch_date) AS first_seen,
    max(dispatch_date) AS last_seen, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC,
        resolution_summary NULLS FIRST) AS position,
    array_to_string(list(dispatch_id ORDER BY dispatch_date DESC, dispatch_id DESC)[1:3], ', ') AS examples
    FROM own GROUP BY 1, 2)"""
SQL["model_failures"] = cte("service_logs", "equipment_units") + f", {_FAILURES} SELECT * FROM failures WHERE position <= 3"
_CLAIMS = """claims AS (SELECT model, c.status, count(*) AS n, sum(approved_amount) AS approved,
    array_to_string(list(claim_id ORDER BY claim_date DESC, claim_id DESC)[1:3], ', ') AS examples
    FROM warranty_claims c JOIN equipment_units USING (equipment_id) GROUP BY 1, 2)"""
SQL["model_claims"] = cte("warranty_claims", "equipment_units") + f""", {_CLAIMS}
SELECT model, status, n, CAST(approved AS DOUBLE) AS approved, examples FROM claims"""
_IDS = """ids AS (SELECT question_id, unnest(list_distinct(list_concat(
    regexp_extract_all(upper(question), '\\bSN-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b'),
    regexp_extract_all(upper(question), '\\bEQ-\\d{3,6}\\b')))) AS id FROM questions)"""
SQL["find_units"] = cte("questions", "equipment_units") + f""", {_IDS}
SELECT DISTINCT question_id, equipment_id FROM ids JOIN equipment_units ON equipment_id = id OR serial_number = id"""

# ---- pages, chunks, BM25

_PAGES = """pages_ AS (SELECT 'AB-' || k || '-' || source AS document_id, 'AB-' || k || '-' || source || '.pdf' AS source_file,
    CASE k WHEN 'ECO' THEN 'engineering_change_order' WHEN 'INC' THEN 'incident_report' WHEN 'MAN' THEN 'manual'
        WHEN 'SOP' THEN 'standard_operating_procedure' WHEN 'SPEC' THEN 'specification'
        WHEN 'SUP' THEN 'supply_chain_report' ELSE 'document' END AS document_type,
    doc_id AS page_number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text
    FROM (SELECT *, ['ECO', 'INC', 'MAN', 'SOP', 'SPEC', 'SUP', 'MEMO'][CAST(substr(source, 4) AS INT) % 7 + 1] AS k
        FROM documents))"""
SQL["page_records"] = f"WITH {_PAGES} SELECT document_id, document_type, source_file, page_number, text FROM pages_"
SQL["page_manifest"] = f"""WITH {_PAGES} SELECT count(DISTINCT source_file) AS document_count, count(*) AS page_count,
    count(*) FILTER (text = '') AS empty_page_count FROM pages_"""


def _window_end(start: str) -> str:
    cut = f"length(regexp_extract(substr(text, {start} + 1, 900), '(?s)^(.*[.;]) ', 1))"
    return f"""CASE WHEN {start} + 900 >= length(text) THEN length(text)
        WHEN {cut} > 451 THEN {start} + {cut} ELSE {start} + 900 END"""


SQL["chunk_sliding"] = f"""WITH RECURSIVE {_PAGES}, w AS (
    SELECT document_id || ':p' || page_number AS page, document_type, text, 1 AS k, 0 AS a, {_window_end('0')} AS z
    FROM pages_ WHERE text <> ''
    UNION ALL SELECT page, document_type, text, k, a, {_window_end('a')} FROM (
        SELECT page, document_type, text, k + 1 AS k, greatest(z - 180, a + 1) AS a FROM w WHERE z < length(text)))
SELECT page || ':c' || k AS chunk_id, document_type, CAST(k AS BIGINT) AS chunk_index,
    trim(substr(text, CAST(a AS BIGINT) + 1, CAST(z - a AS BIGINT))) AS text FROM w"""
SQL["chunk_sentences"] = f"""WITH RECURSIVE {_PAGES}, lists AS (
    SELECT document_id || ':p' || page_number AS page, document_type, list_filter(list_transform(string_split(
        regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss
    FROM pages_),
s AS (SELECT page, generate_subscripts(ss, 1) AS i, unnest(ss) AS sentence FROM lists),
r AS (
    SELECT page, 0 AS i, CAST([] AS VARCHAR[]) AS open_, CAST(NULL AS VARCHAR) AS piece FROM lists
    UNION ALL SELECT page, i, CASE WHEN full_ THEN list_append(open_[coalesce(list_min(list_filter(
                range(1, len(open_) + 1), lambda j: length(array_to_string(open_[j:], ' ')) <= 180)), len(open_) + 1):],
                sentence) ELSE list_append(open_, sentence) END,
        CASE WHEN full_ THEN array_to_string(open_, ' ') END
    FROM (SELECT r.page, s.i, r.open_, s.sentence, len(r.open_) > 0
            AND length(array_to_string(r.open_, ' ')) + 1 + length(s.sentence) > 900 AS full_
        FROM r JOIN s ON s.page = r.page AND s.i = r.i + 1)),
pieces AS (SELECT page, i, piece FROM r WHERE piece IS NOT NULL
    UNION ALL SELECT r.page, r.i + 1, array_to_string(open_, ' ') FROM r JOIN lists l
    ON l.page = r.page AND r.i = len(l.ss) WHERE len(l.ss) > 0)
SELECT page || ':c' || k AS chunk_id, document_type, k AS chunk_index, piece AS text FROM (
    SELECT page, piece, row_number() OVER (PARTITION BY page ORDER BY i) AS k FROM pieces) JOIN lists USING (page)"""
SQL["excerpts"] = """SELECT doc_id, CASE WHEN length(text) > length(rtrim(substr(text, 1, 500)))
    THEN rtrim(substr(text, 1, 500)) || '...' ELSE rtrim(substr(text, 1, 500)) END AS excerpt FROM documents"""

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_][a-z0-9]+)*')"
_BM25 = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf
    FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
SQL["bm25_terms"] = _BM25 + """ SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf,
    round(avgdl, 6) AS avgdl FROM df, corpus"""
SQL["bm25_postings"] = _BM25 + """ SELECT doc_id AS chunk_id, CAST(dl AS BIGINT) AS dl, count(*) AS terms,
    max(tf) AS max_tf, CAST(sum(tf) AS BIGINT) AS tokens FROM tf GROUP BY 1, 2"""
SQL["bm25_search"] = _BM25 + f""", q AS (SELECT item_id, term, count(*) AS qf
    FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
scores AS (SELECT item_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
    / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY 1, 2)
SELECT item_id AS query_id, doc_id AS chunk_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 5"""

# ---- vectors

_CENTROIDS = """WITH means AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS v FROM means GROUP BY 1)"""
_SCORE = "round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6)"
_TOPK = _CENTROIDS + f""" SELECT query_id, vec_id, {_SCORE} AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE} DESC, vec_id) AS rank
FROM q, embeddings QUALIFY rank <= 5"""
SQL["vector_topk"] = SQL["vector_topk_blocks"] = _TOPK
SQL["vector_normalize"] = """SELECT vec_id, CAST(1 AS DOUBLE) AS unit_norm, CAST(1 AS DOUBLE) AS self_cosine FROM embeddings"""
def _embedded(source: str, key: str, text: str, dim: int) -> str:
    """CTEs ``<source>_w``: (key, slot, weight) of the hashed-term vectors."""
    return f"""{source}_t AS (SELECT {key} AS k, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dim} AS slot, count(*) AS n
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[-_][a-z0-9]+)*')) AS t FROM {source})
    GROUP BY 1, 2),
{source}_w AS (SELECT k, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS w
    FROM {source}_t)"""


SQL["build_collection"] = "SELECT doc_id AS vec_id, source, lang, CAST(16 AS BIGINT) AS dimension FROM documents"
_COLLECTION = f"""WITH docs AS (SELECT doc_id AS vec_id, source,
    CASE lang WHEN 'en' THEN 'ERR_INV_404' WHEN 'fr' THEN 'ERR_FUSE_001' END AS code,
    text || CASE lang WHEN 'en' THEN ' ERR_INV_404' WHEN 'fr' THEN ' ERR_FUSE_001' ELSE '' END AS text FROM documents),
{_embedded('docs', 'vec_id', 'text', 16)},
norms AS (SELECT k, sqrt(sum(w * w)) AS n FROM docs_w GROUP BY 1),
dots AS (SELECT q.k AS query_id, c.k AS vec_id, sum(q.w * c.w) AS dot FROM docs_w q JOIN docs_w c USING (slot) WHERE q.k % 100 = 0
    GROUP BY 1, 2),
c AS (SELECT q.vec_id AS query_id, c.vec_id, c.source, c.code, round(coalesce(dot / (qn.n * cn.n), 0), 6) AS score
    FROM docs q JOIN docs c ON q.vec_id % 100 = 0 LEFT JOIN dots ON dots.query_id = q.vec_id AND dots.vec_id = c.vec_id
    LEFT JOIN norms qn ON qn.k = q.vec_id LEFT JOIN norms cn ON cn.k = c.vec_id)"""
SQL["vector_filtered"] = _COLLECTION + """ SELECT query_id, vec_id, score, round(1 - score, 6) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, source
FROM c WHERE code = 'ERR_INV_404' QUALIFY rank <= 5"""
SQL["vector_by_code"] = SQL["vector_by_code_blocks"] = _COLLECTION + """ SELECT query_id, code, vec_id, score,
    row_number() OVER (PARTITION BY query_id, code ORDER BY score DESC, vec_id) AS rank
FROM c WHERE code IS NOT NULL QUALIFY rank <= 2"""
SQL["vector_fuse"] = _COLLECTION + """, hits AS (
    SELECT query_id, vec_id, score, 0 AS priority, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk
    FROM c WHERE code = 'ERR_FUSE_001' QUALIFY rk <= 2
    UNION ALL SELECT query_id, vec_id, score, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk
    FROM c QUALIFY rk <= 4),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY priority, rk) = 1)
SELECT query_id, vec_id, score, CAST(priority AS BIGINT) AS priority,
    row_number() OVER (PARTITION BY query_id ORDER BY priority, rk, vec_id) AS position FROM firsts QUALIFY position <= 5"""
SQL["embed_documents"] = f"""WITH {_embedded('documents', 'doc_id', 'text', 16)}
SELECT doc_id, slot, round(coalesce(w, 0), 4) AS weight
FROM (SELECT doc_id, CAST(g AS BIGINT) AS slot FROM documents, generate_series(0, 15) AS t(g)) d
LEFT JOIN documents_w e ON e.k = d.doc_id AND e.slot = d.slot"""
SQL["embed_documents"] = SQL["embed_documents"].replace("SELECT doc_id, slot, round", "SELECT doc_id, d.slot AS slot, round")

SQL["embedding_manifest"] = """SELECT 'given' AS model, 'L2 normalized' AS normalization, CAST(64 AS BIGINT) AS batch_size,
    count(*) AS chunk_count, CAST(max(len(embedding)) AS BIGINT) AS embedding_dimension FROM embeddings"""

# ---- questions

_KINDS = router.PATTERNS
_INTENTS = {name: "|".join(words) for name, words in sorted(router.INTENT_WORDS.items())}


def _found(kind: str) -> str:
    found = f"regexp_extract_all(upper(question), '{_KINDS[kind]}')"
    if kind == "model":
        found = f"list_transform({found}, lambda m: regexp_replace(m, '^([XCG])-?', '\\1-'))"
    return f"list_sort(list_distinct({found})) AS {kind}"


def _routed(source: str) -> str:
    """CTEs up to ``routed``: every question with intents, identifier lists and sources."""
    intents = ", ".join(f"CASE WHEN regexp_matches(lower(question), '{w}') THEN '{i}' END" for i, w in _INTENTS.items())
    kinds = ", ".join(_found(k) for k in _KINDS)
    return f"""known AS (SELECT *, list_filter([{intents}], lambda x: x IS NOT NULL) AS intents, {kinds} FROM {source}),
erp AS (SELECT *, len(serial) + len(equipment) + len(model) + len(dispatch) + len(claim) + len(part) > 0 AS has_erp
    FROM known),
narrow AS (SELECT *, list_contains(intents, 'procedure') AND NOT has_erp AND len(fault) = 0 AS docs_only FROM erp),
flags AS (SELECT *, NOT docs_only AND (has_erp OR list_has_any(intents, ['service', 'warranty', 'supply'])) AS use_sql,
    NOT docs_only AND intents <> ['supply'] AND (len(serial) > 0 OR len(fault) > 0 OR list_contains(intents, 'telemetry')
        OR (len(model) > 0 AND list_contains(intents, 'failure_modes'))) AS use_document FROM narrow),
routed AS (SELECT *, list_filter([CASE WHEN use_sql THEN 'sql' END, CASE WHEN use_document THEN 'document' END, 'vector'],
    lambda x: x IS NOT NULL) AS sources FROM flags)"""


def _shown(items: str) -> str:
    return f"'[' || array_to_string(list_transform({items}, lambda x: '''' || x || ''''), ', ') || ']'"


_QUESTIONS = cte("questions") + ", " + _routed("questions")
_ENTITY_TEXT = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN len({k}) > 0 THEN '{k}=' || {_shown(k)} END" for k in _KINDS
) + "], lambda x: x IS NOT NULL), ', ')"
_ROUTE = f"""'intents=' || {_shown("CASE WHEN len(intents) = 0 THEN ['general'] ELSE intents END")} || '; entities: '
        || CASE WHEN {_ENTITY_TEXT} = '' THEN 'none' ELSE {_ENTITY_TEXT} END || '; sources=' || {_shown('sources')}"""
SQL["route_questions"] = _QUESTIONS + f""" SELECT question_id, array_to_string(intents, ',') AS intents,
    {', '.join(f"array_to_string({k}, ',') AS {k}" for k in _KINDS)}, array_to_string(sources, ',') AS sources,
    {_ROUTE} AS route,
    concat_ws(' / ', CASE WHEN docs_only THEN '{router.REASON_DOCS_ONLY}' END,
        CASE WHEN use_sql THEN '{router.REASON_SQL}' END, CASE WHEN use_document THEN '{router.REASON_DOCUMENT}' END,
        '{router.REASON_VECTOR}'
        || CASE WHEN len(fault) > 0 THEN ', and those of the named codes first: ' || {_shown('fault')} ELSE '' END) AS reasons
FROM routed"""
SQL["route_conversations"] = f"""WITH talk AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
{_routed('talk')} SELECT conv_id, turn, array_to_string(intents, ',') AS intents,
    array_to_string(sources, ',') AS sources FROM routed"""

# ---- evidence


def _evidence(*tables: str) -> str:
    return cte("questions", *tables) + ", " + _routed("questions")


# Besides the compared columns a row has the condition that looks it up (cond) and its place in its source (ord, as text).
def _is(column: str, value: str) -> str:
    return f"'{column} = ''' || {value} || ''''"


def _nth(number: str) -> str:
    return f"lpad(CAST({number} AS VARCHAR), 19, '0')"


def _first(ids: str) -> str:
    return f"string_split({ids}, ', ')[1]"


_SERVICE_TEXT = """format('Service {} on {} for {}: {} by {}, {} h, ${} labor, status {}. Resolution: {}', dispatch_id,
        dispatch_date::VARCHAR, equipment_id, service_type, technician, hours_spent::VARCHAR, labor_cost::VARCHAR, status,
        coalesce(resolution_summary, 'None'))"""
_CLAIM_TEXT = """format('Warranty claim {} on {} for {}: part {} ({}), dispatch {}, claimed ${}, approved ${}, status {}{}.',
        claim_id, claim_date::VARCHAR, equipment_id, coalesce(part_id, 'n/a'), coalesce(part_name, 'n/a'),
        coalesce(dispatch_id, 'n/a'), claim_amount::VARCHAR, coalesce(approved_amount::VARCHAR, 'None'), status,
        CASE WHEN denial_reason IS NULL THEN '' ELSE ', denial reason: ' || denial_reason END)"""
SQL["evidence_units"] = _evidence(
    "customers", "equipment_units", "service_logs", "warranty_claims", "parts_inventory"
) + f""", asked AS (SELECT question_id, list_concat(equipment, serial) AS ids FROM routed
    WHERE use_sql AND len(equipment) + len(serial) > 0),
found AS (SELECT DISTINCT question_id, e.*, company_name FROM (SELECT question_id, unnest(ids) AS id FROM asked)
    JOIN equipment_units e ON equipment_id = id OR serial_number = id JOIN customers USING (customer_id)),
services AS (SELECT question_id, s.*, row_number() OVER (PARTITION BY question_id, equipment_id
    ORDER BY dispatch_date DESC, dispatch_id) AS nth FROM found JOIN service_logs s USING (equipment_id) QUALIFY nth <= 5),
claims AS (SELECT question_id, w.*, part_name, row_number() OVER (PARTITION BY question_id, equipment_id
    ORDER BY claim_date DESC, claim_id) AS nth FROM found JOIN warranty_claims w USING (equipment_id)
    LEFT JOIN parts_inventory p ON p.part_id = w.part_id QUALIFY nth <= 5),
absent AS (SELECT question_id, ids, '(' || array_to_string(list_transform(ids, lambda x: '''' || x || ''''), ', ') || ')' AS listed
    FROM asked WHERE question_id NOT IN (SELECT question_id FROM found))
SELECT question_id, equipment_id AS record_id, 'equipment_units' AS document, CAST(install_date AS VARCHAR) AS "timestamp",
    format('Unit {{}} (serial {{}}), model {{}}, {{}} kW, status {{}}, customer {{}}, installed {{}}, warranty expires {{}} ({{}}).',
        equipment_id, serial_number, model, capacity_kw::VARCHAR, status, company_name, install_date::VARCHAR,
        warranty_expiration::VARCHAR, CASE WHEN warranty_expiration >= DATE '{AS_OF}' THEN 'ACTIVE' ELSE 'EXPIRED' END) AS text,
    {_is('equipment_id', 'equipment_id')} AS cond, ['0', equipment_id, '0', '0'] AS ord
FROM found
UNION ALL SELECT question_id, dispatch_id, 'service_logs', CAST(dispatch_date AS VARCHAR),
    {_SERVICE_TEXT}, {_is('dispatch_id', 'dispatch_id')}, ['0', equipment_id, '1', {_nth('nth')}] FROM services
UNION ALL SELECT question_id, claim_id, 'warranty_claims', CAST(claim_date AS VARCHAR),
    {_CLAIM_TEXT}, {_is('claim_id', 'claim_id')}, ['0', equipment_id, '2', {_nth('nth')}] FROM claims
UNION ALL SELECT question_id, 'no matching row', 'equipment_units', 'n/a',
    'ERP lookup returned NO equipment_units record for ' || array_to_string(ids, ', ')
    || '; this unit has no ERP service or warranty history on file.',
    'equipment_id IN ' || listed || ' OR serial_number IN ' || listed, ['0', '', '0', '0'] FROM absent"""
SQL["evidence_ids"] = _evidence("service_logs", "warranty_claims", "parts_inventory") + f""",
d AS (SELECT question_id, unnest(dispatch) AS id FROM routed WHERE use_sql),
c AS (SELECT question_id, unnest(claim) AS id FROM routed WHERE use_sql),
p AS (SELECT question_id, unnest(part) AS id FROM routed WHERE use_sql),
rows_ AS (
    SELECT question_id, id, 'service_logs' AS document, dispatch_id AS found, CAST(dispatch_date AS VARCHAR) AS "timestamp",
        {_SERVICE_TEXT} AS text, 'dispatch_id' AS key, '0' AS kind
    FROM d LEFT JOIN service_logs ON dispatch_id = id
    UNION ALL SELECT question_id, id, 'warranty_claims', claim_id, CAST(claim_date AS VARCHAR), {_CLAIM_TEXT}, 'claim_id', '1'
    FROM c LEFT JOIN (SELECT w.*, part_name FROM warranty_claims w LEFT JOIN parts_inventory i ON i.part_id = w.part_id) ON claim_id = id
    UNION ALL SELECT question_id, id, 'parts_inventory', part_id, 'current inventory',
        format('Part {{}} ''{{}}'': supplier {{}}, manufacturer {{}}, {{}} units in stock.', part_id, trim(part_name), supplier,
            manufacturer, stock_quantity), 'part_id', '2'
    FROM p LEFT JOIN parts_inventory ON part_id = id)
SELECT question_id, coalesce(found, 'no matching row') AS record_id, document,
    CASE WHEN found IS NULL THEN 'n/a' ELSE "timestamp" END AS "timestamp",
    CASE WHEN found IS NULL THEN 'ERP lookup returned NO ' || document || ' record for ' || id || '.' ELSE text END AS text,
    key || ' = ''' || id || '''' AS cond, ['3', kind, id, '0'] AS ord
FROM rows_"""
SQL["evidence_model"] = _evidence("equipment_units", "service_logs", "warranty_claims") + f""",
asked AS (SELECT question_id, intents, unnest(model[1:2]) AS model FROM routed WHERE use_sql),
fleet AS ({_FLEET}), {_FAILURES}, {_CLAIMS}
SELECT question_id, 'aggregate model=' || model AS record_id, 'equipment_units' AS document,
    coalesce(first_install::VARCHAR, 'None') || '..' || coalesce(last_install::VARCHAR, 'None') AS "timestamp",
    format('ERP fleet for model {{}}: {{}} units, {{}} in service, {{}} still under warranty.{{}}', model, coalesce(units, 0),
        coalesce(in_service, 0), coalesce(under_warranty, 0), CASE WHEN units IS NULL
        THEN ' (No ERP units of this model - it appears only in telemetry/docs.)' ELSE '' END) AS text,
    {_is('model', 'model')} AS cond, ['1', model, '0', '0'] AS ord
FROM asked LEFT JOIN fleet USING (model)
UNION ALL SELECT question_id, examples, 'service_logs', first_seen::VARCHAR || '..' || last_seen::VARCHAR,
    format('{{}} repair/diagnostic dispatches: ''{{}}'' occurred {{}} times (e.g. {{}}).', model,
        coalesce(resolution_summary, 'None'), n, examples),
    {_is('dispatch_id', _first('examples'))}, ['1', model, '1', {_nth('position')}]
FROM asked JOIN failures USING (model) WHERE position <= 5 AND list_has_any(intents, ['failure_modes', 'telemetry', 'service'])
UNION ALL SELECT question_id, examples, 'warranty_claims', 'aggregate',
    format('{{}} warranty claims with status {{}}: {{}} claims, ${{:,.2f}} approved (e.g. {{}}).', model, status, n,
        coalesce(approved, 0)::DOUBLE, examples), {_is('claim_id', _first('examples'))},
    ['1', model, '2', {_nth('row_number() OVER (PARTITION BY question_id, model ORDER BY n DESC, status NULLS FIRST)')}]
FROM asked JOIN claims USING (model) WHERE list_contains(intents, 'warranty')"""
_WORDS = {word: fragment.lower() for word, fragment in suppliers.COMPONENT_WORDS.items()}
_ASKED_WORDS = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(question), '{w}') THEN '{f}' END" for w, f in _WORDS.items()
) + "], lambda x: x IS NOT NULL)"
SQL["evidence_suppliers"] = _evidence() + ", " + _SUPPLIERS[5:] + f""", asked AS (
    SELECT question_id, contains(lower(question), 'single') AS single, {_ASKED_WORDS} AS words
    FROM routed WHERE use_sql AND list_contains(intents, 'supply')),
kinds AS (SELECT DISTINCT single, words FROM asked),
best AS (SELECT single, words, by_part.*, row_number() OVER (PARTITION BY single, words ORDER BY n_suppliers, part) AS nth FROM kinds, by_part WHERE CASE WHEN single THEN n_suppliers = 1
    WHEN len(words) = 0 THEN true ELSE len(list_filter(words, lambda w: contains(lower(part), w))) > 0 END
    QUALIFY nth <= 8)
SELECT question_id, part_ids AS record_id, 'parts_inventory' AS document, 'current inventory' AS "timestamp",
    format('Part ''{{}}'' ({{}}): supplied by {{}} [{{}}]; manufacturers {{}}; {{}} units in stock.', part, part_ids, suppliers,
        CASE WHEN n_suppliers = 1 THEN 'SINGLE-SOURCE RISK' ELSE n_suppliers || ' suppliers' END, makers, stock) AS text,
    {_is('part_id', _first('part_ids'))} AS cond, ['2', {_nth('nth')}, '0', '0'] AS ord
FROM asked JOIN best USING (single, words)"""


def _summaries(name: str, source: str, key: str, limit: int) -> str:
    """CTEs ``<name>``: the most frequent faults per ``key`` of ``source`` with their texts."""
    return f"""{name}_ids AS (SELECT {key}, fault_code, string_agg(log_id, ', ' ORDER BY ts DESC, log_id DESC) AS ids,
        arg_max(notes, struct_pack(a := ts, b := log_id)) AS note FROM (SELECT * FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {key}, fault_code ORDER BY ts DESC, log_id DESC) <= 3) GROUP BY 1, 2),
{name}_units AS (SELECT {key}, fault_code, string_agg(equipment_id, ', ' ORDER BY equipment_id) AS units
    FROM (SELECT DISTINCT {key}, fault_code, equipment_id FROM {source}) GROUP BY 1, 2),
{name}_parts AS (SELECT {key}, fault_code, string_agg(DISTINCT component, ', ' ORDER BY component) AS parts FROM (
    SELECT {key}, fault_code, unnest([component_a, component_b]) AS component FROM {source}) WHERE component IS NOT NULL
    GROUP BY 1, 2),
{name} AS (SELECT {key}, fault_code, count(*) AS events, any_value(ids) AS ids,
    strftime(min(ts), '%Y-%m-%d') || '..' || strftime(max(ts), '%Y-%m-%d') AS span,
    format('fault {{}} logged {{}} times on units {{}}; temperature avg {{}} C / max {{}} C; components flagged: {{}}; '
        || 'latest note: {{}} (e.g. {{}})', fault_code, count(*), any_value(units),
        CAST(CAST(avg(temperature_c) AS DECIMAL(18,9)) AS DECIMAL(18,1))::VARCHAR, max(temperature_c)::VARCHAR,
        coalesce(any_value(parts), 'none'), any_value(note), any_value(ids)) AS body,
    row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, fault_code) AS nth
    FROM {source} JOIN {name}_ids USING ({key}, fault_code) JOIN {name}_units USING ({key}, fault_code)
    LEFT JOIN {name}_parts USING ({key}, fault_code) GROUP BY 1, 2
    QUALIFY nth <= {limit})"""


_EVENT = """format('Telemetry {} at {} UTC, unit {} ({}): status {}, fault {}, severity {}; {} C, 800.0 V, 12.5 A, SoC {}%, '
    || 'cell delta 3.0 mV; flagged components: {}. Notes: {}', log_id, strftime(ts, '%Y-%m-%d %H:%M'), equipment_id,
    model_code, status, coalesce(fault_code, 'none'), severity, temperature_c::VARCHAR, soc_percent::VARCHAR,
    coalesce(nullif(concat_ws(', ', component_a, component_b), ''), 'none'), notes)"""
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
SQL["evidence_telemetry"] = _evidence("telemetry_flat") + f""",
faults AS (SELECT *, equipment_id AS unit, fault_code AS code FROM telemetry_flat WHERE fault_code IS NOT NULL),
serials AS (SELECT question_id, unnest(serial[1:3]) AS unit, unnest(range(len(serial[1:3]))) AS i FROM routed WHERE use_document),
totals AS (SELECT equipment_id AS unit, count(*) AS total FROM telemetry_flat GROUP BY 1),
{_summaries('by_unit', 'faults', 'unit', 3)},
unit_logs AS (SELECT unit, log_id, min(nth) AS nth FROM (
    SELECT equipment_id AS unit, log_id, 0 AS nth FROM telemetry_flat
    QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, log_id DESC) = 1
    UNION ALL SELECT unit, log_id, row_number() OVER (PARTITION BY unit ORDER BY ts DESC, log_id DESC) AS n FROM faults QUALIFY n <= 2)
    WHERE (unit, log_id) NOT IN (SELECT (unit, ids) FROM by_unit) GROUP BY 1, 2),
{_summaries('by_code', 'faults', 'code', 1)},
codes AS (SELECT question_id, unnest(fault[1:2]) AS code, unnest(range(len(fault[1:2]))) AS i FROM routed WHERE use_document),
broad AS (SELECT question_id, list_contains(intents, 'hot') AS hot, array_to_string(model, '/') AS scope, model FROM routed
    WHERE use_document AND len(serial) = 0 AND len(fault) = 0),
scopes AS (SELECT DISTINCT scope, model FROM broad),
scoped AS (SELECT scope, faults.* FROM scopes JOIN faults ON len(model) = 0 OR list_contains(model, model_code)),
{_summaries('by_scope', 'scoped', 'scope', 5)},
hot_logs AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY temperature_c DESC, log_id) AS nth FROM scoped
    QUALIFY nth <= 2),
code_logs AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC, log_id DESC) AS nth FROM faults QUALIFY nth <= 2)
SELECT question_id, 'no matching document' AS record_id, 'telemetry' AS document, 'n/a' AS "timestamp",
    'No telemetry documents exist for unit ' || unit || '.' AS text, {_is('equipment_id', 'unit')} AS cond,
    ['0', {_nth('i')}, '0', '0'] AS ord FROM serials WHERE unit NOT IN (SELECT unit FROM totals)
UNION ALL SELECT question_id, ids, 'telemetry', span, format('Unit {{}} ({{}} telemetry logs): {{}}', unit, total, body),
    {_is('fault_code', 'fault_code')}, ['0', {_nth('i')}, '1', {_nth('nth')}]
FROM serials JOIN totals USING (unit) JOIN by_unit USING (unit)
UNION ALL SELECT question_id, log_id, 'telemetry', {_AT}, {_EVENT}, {_is('log_id', 'log_id')}, ['0', {_nth('i')}, '2', {_nth('nth')}]
FROM serials JOIN unit_logs USING (unit) JOIN telemetry_flat USING (log_id)
UNION ALL SELECT question_id, ids, 'telemetry', span, 'Fault code ' || code || ': ' || body, {_is('fault_code', 'code')},
    ['1', {_nth('i')}, '0', '0'] FROM codes JOIN by_code USING (code)
UNION ALL SELECT question_id, log_id, 'telemetry', {_AT}, {_EVENT}, {_is('log_id', 'log_id')}, ['1', {_nth('i')}, '1', {_nth('nth')}]
FROM codes JOIN code_logs USING (code)
UNION ALL SELECT question_id, ids, 'telemetry', span,
    CASE WHEN scope = '' THEN 'Fleet-wide' ELSE scope END || ' telemetry: ' || body, {_is('fault_code', 'fault_code')},
    ['2', '0', {_nth('nth')}, '0'] FROM broad JOIN by_scope USING (scope)
UNION ALL SELECT question_id, log_id, 'telemetry', {_AT}, {_EVENT}, {_is('log_id', 'log_id')}, ['2', '1', {_nth('nth')}, '0']
FROM broad JOIN hot_logs USING (scope) WHERE hot"""
SQL["evidence_vector"] = _evidence() + f""",
chunks AS (SELECT conv_id || ':' || turn AS chunk_id, 'talk-' || conv_id || '.txt' AS source_file, turn + 1 AS page_number,
    text || CASE WHEN role = 'system' THEN ' steps ERR_INV_404 fault code' ELSE '' END AS text, role = 'system' AS coded
    FROM conversations),
{_embedded('routed', 'question', 'question', 32).replace('routed_t', 'q_t').replace('routed_w', 'q_w')},
{_embedded('chunks', 'chunk_id', 'text', 32)},
texts AS (SELECT DISTINCT question, fault FROM routed),
dots AS (SELECT q.k AS question, c.k AS chunk_id, sum(q.w * c.w) AS dot FROM q_w q JOIN chunks_w c USING (slot) GROUP BY 1, 2),
qn AS (SELECT k AS question, sqrt(sum(w * w)) AS qn FROM q_w GROUP BY 1),
cn AS (SELECT k AS chunk_id, sqrt(sum(w * w)) AS cn FROM chunks_w GROUP BY 1),
scored AS (SELECT question, fault, chunk_id, coded, round(coalesce(dot / (qn * cn), 0), 6) AS score
    FROM texts CROSS JOIN chunks LEFT JOIN dots USING (question, chunk_id) LEFT JOIN qn USING (question)
    LEFT JOIN cn USING (chunk_id)),
hits AS (SELECT question, chunk_id, score, 0 AS priority, 'contains ERR_INV_404' AS how,
        row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rk
    FROM scored WHERE coded AND list_contains(fault, 'ERR_INV_404') QUALIFY rk <= 2
    UNION ALL SELECT question, chunk_id, score, 2, 'semantic',
        row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rk FROM scored QUALIFY rk <= 4),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question, chunk_id ORDER BY priority, rk) = 1),
capped AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY priority, rk, chunk_id) AS nth FROM firsts QUALIFY nth <= 5)
SELECT question_id, chunk_id AS record_id, source_file || ' p.' || page_number AS document, 'n/a' AS "timestamp",
    format('{{}} page {{}} ({{}}, similarity {{}}): {{}}', source_file, page_number, how,
        CAST(CAST(score AS DECIMAL(12,6)) AS DECIMAL(12,2))::VARCHAR, text) AS text,
    {_is('chunk_id', 'chunk_id')} AS cond, [{_nth('nth')}] AS ord
FROM routed JOIN capped USING (question) JOIN chunks USING (chunk_id)"""

# The rows of each source, without what the source alone decides.
_ROWS = {
    "evidence_units": ("sql", "'silver.' || document"), "evidence_model": ("sql", "'silver.' || document"),
    "evidence_ids": ("sql", "'silver.' || document"), "evidence_suppliers": ("sql", "'silver.' || document"),
    "evidence_telemetry": ("document", "'documents.telemetry'"), "evidence_vector": ("vector", "'chunks.collection'"),
}
_ORDERED = {
    name: f"""SELECT *, '{source}' AS source, {database} AS database, 'SELECT * FROM ' || {database} || ' WHERE ' || cond AS verify
    FROM ({SQL[name]})""" for name, (source, database) in _ROWS.items()
}
SQL |= {name: f"SELECT * EXCLUDE (cond, ord) FROM ({sql})" for name, sql in _ORDERED.items()}
# Names that an evidence row leads to; a row that reports an absence names what was asked for, and finds nothing.
_NAMED = {
    "evidence_units": "CASE WHEN absent THEN len(list_distinct(list_concat(equipment, serial))) ELSE 1 END",
    "evidence_model": "len(string_split(record_id, ', '))", "evidence_ids": "1", "evidence_suppliers": "len(string_split(record_id, ', '))",
    "evidence_telemetry": "CASE WHEN absent THEN 1 ELSE len(string_split(record_id, ', ')) END", "evidence_vector": "1",
}
_TAGGED = _evidence() + ", rows_ AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS gathered, question_id, source, database, record_id, document, "timestamp", text, verify, ord FROM ({sql})"""
    for name, sql in _ORDERED.items()
) + """), numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY ord, record_id) AS position FROM rows_),
tagged AS (SELECT *, CASE source WHEN 'sql' THEN 'SQL' WHEN 'document' THEN 'MDB' ELSE 'VEC' END || position AS tag,
    starts_with(record_id, 'no matching') AS absent,
    row_number() OVER (PARTITION BY question_id ORDER BY list_position(['sql', 'document', 'vector'], source), position) AS nth
    FROM numbered)"""
_LOOKED_UP = "CASE gathered " + " ".join(f"WHEN '{name}' THEN {count}" for name, count in _NAMED.items()) + " END"
SQL["verify_evidence"] = _TAGGED + f""", counted AS (SELECT *, CAST({_LOOKED_UP} AS BIGINT) AS records
    FROM tagged JOIN (SELECT question_id, equipment, serial FROM routed) USING (question_id))
SELECT question_id, tag, source, database, record_id, records, true AS verified,
    CASE WHEN absent OR contains(text, ': 0 units, ') THEN 0 ELSE records END AS found FROM counted"""
SQL["evidence_tags"] = _TAGGED + " SELECT question_id, tag, source, database, record_id, verify, position FROM tagged"
_PROMPT = "'" + answers.PROMPT.replace("'", "''") + "'"
SQL["prompt_context"] = _TAGGED + f""", contexts AS (SELECT question_id, string_agg(format('[{{}}] ({{}} | record {{}} | {{}} | {{}})'
    || chr(10) || '{{}}', tag, database, record_id, document, "timestamp", text), chr(10) || chr(10) ORDER BY nth) AS context
    FROM tagged GROUP BY 1)
SELECT question_id, replace(replace(replace({_PROMPT}, '{{question}}', question), '{{route}}', {_ROUTE}), '{{context}}',
    coalesce(context, '')) AS prompt FROM routed LEFT JOIN contexts USING (question_id)"""
SQL["extractive_answers"] = _TAGGED + f""", quoted AS (SELECT question_id, string_agg('- [' || tag || '] '
    || substring(text, 1, {answers.SHOWN_CHARS}), chr(10) ORDER BY nth) AS lines FROM tagged WHERE nth <= {answers.SHOWN_ROWS} GROUP BY 1)
SELECT question_id, coalesce('**Summary:** LLM unavailable (no model configured); showing the retrieved evidence verbatim instead.'
    || chr(10) || lines, '{answers.NOTHING_FOUND}') AS answer FROM routed LEFT JOIN quoted USING (question_id)"""

# ---- citations

_STYLES = ["[VEC2]", "[MDB1]", "[SQL1]", "[SQL1]", "[SQL1][MDB2]", "[MDB1]", "[MDB2]", "[SQL9]", ""]
_ANSWERS = f"""WITH styled AS (SELECT *, [{', '.join(f"'{s}'" for s in _STYLES)}][conv_id % 9 + 1] AS style
    FROM conversations WHERE role = 'assistant'),
answers AS (SELECT conv_id * 1000 + turn AS question_id, '**Summary:**' || chr(10)
    || replace(text, chr(10), ' ' || style || chr(10)) || ' ' || style AS answer FROM styled)"""
SQL["normalize_citations"] = _ANSWERS + " SELECT * FROM answers"
_CHECKED = _ANSWERS + """, lines AS (SELECT question_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls), ' ' || chr(9)) AS line
    FROM (SELECT question_id, string_split(answer, chr(10)) AS ls FROM answers)),
claims AS (SELECT *, list_has_any(regexp_extract_all(line, '\\[((?:SQL|MDB|VEC)\\d+)\\]', 1), ['SQL1', 'MDB1', 'MDB2', 'VEC2'])
    AS ok FROM lines WHERE length(regexp_replace(line, '\\[[A-Z]+\\d+\\]|[*#\\-:\\s]', '', 'g')) > 15
    AND NOT regexp_full_match(line, '[*#\\s]*(Summary|Recommended next step)[*:\\s]*')),
totals AS (SELECT question_id, count(*) AS statements, count(*) FILTER (ok) AS cited_statements,
    coalesce(string_agg(line, ' || ' ORDER BY i) FILTER (NOT ok), '') AS uncited FROM claims GROUP BY 1),
used AS (SELECT question_id, list_sort(list_distinct(regexp_extract_all(answer, '\\[((?:SQL|MDB|VEC)\\d+)\\]', 1))) AS tags
    FROM answers)"""
SQL["citation_check"] = _CHECKED + """ SELECT question_id, coalesce(statements, 0) AS statements,
    coalesce(cited_statements, 0) AS cited_statements, coalesce(uncited, '') AS uncited,
    CASE WHEN list_contains(tags, 'SQL9') THEN 'SQL9' ELSE '' END AS unknown_tags,
    array_to_string(list_filter(tags, lambda t: t <> 'SQL9'), ',') AS used_tags
FROM used LEFT JOIN totals USING (question_id)"""
SQL["citation_provenance"] = _CHECKED + """ SELECT tag, count(*) AS records, count(*) FILTER (list_contains(tags, tag)) AS cited
FROM used, (SELECT unnest(['SQL1', 'MDB1', 'MDB2', 'VEC2']) AS tag) GROUP BY 1"""
SQL["strip_reasoning"] = """SELECT conv_id, turn, trim(text, ' ' || chr(10)) || CASE WHEN role = 'assistant'
    THEN chr(10) || chr(10) || '*(Answer truncated at the token limit.)*' ELSE '' END AS answer FROM conversations"""

# ---- metrics

_RUNS = """WITH runs AS (SELECT user_id AS q, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS sql_ms,
    CASE WHEN event_type = 'click' THEN value * 2 ELSE 0.0 END AS document_ms, value + 1 AS vector_ms,
    value + 2 AS retrieval_ms, value * 3 AS generation_ms, value * 40 AS total_ms, event_type <> 'error' AS ok,
    CAST(event_type = 'view' AS INT) AS unknown FROM events)"""
SQL["latency_percentiles"] = """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1"""
_STAGES = ["sql_ms", "document_ms", "vector_ms", "retrieval_ms", "generation_ms", "total_ms"]
SQL["stage_report"] = _RUNS + ", ok_runs AS (SELECT * FROM runs WHERE ok) " + " UNION ALL ".join(
    f"""SELECT '{s}' AS stage, round(avg({s}), 6) AS mean, round(quantile_cont({s}, 0.5), 6) AS p50,
    round(quantile_cont({s}, 0.95), 6) AS p95, round(quantile_cont({s}, 0.99), 6) AS p99, round(max({s}), 6) AS max,
    round(round(avg({s}) / (SELECT avg(total_ms) FROM ok_runs) * 100, 6), 0) AS share_of_total FROM ok_runs WHERE {s} > 0"""
    for s in _STAGES
) + "".join(
    f" UNION ALL SELECT '{s}', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"
    for s in ("routing_ms", "prompt_ms")
)
SQL["slo_report"] = _RUNS + """ SELECT count(*) FILTER (total_ms < 5000) AS runs_under_target, count(*) AS runs,
    round(avg(CASE WHEN total_ms < 5000 THEN 1.0 ELSE 0.0 END), 6) AS share_under_target FROM runs"""
SQL["question_medians"] = _RUNS + """, chosen AS (SELECT * FROM runs QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY q))
SELECT q, count(*) AS runs, round(median(retrieval_ms), 6) AS median_retrieval_ms,
    round(median(generation_ms), 6) AS median_generation_ms, round(median(total_ms), 6) AS median_total_ms
FROM chosen GROUP BY 1"""
SQL["citation_coverage"] = _RUNS + """ SELECT count(*) * 3 AS cited_statements, count(*) * 4 AS statements,
    CAST(sum(unknown) AS BIGINT) AS unknown_tags FROM runs"""

# ---- streams

SQL["stream_telemetry"] = cte("telemetry_flat") + """ SELECT log_id, model_code, fault_code, temperature_c
FROM telemetry_flat WHERE soc_percent NOT IN (7, 8, 9)"""
SQL["stream_audit"] = cte("service_logs") + """ SELECT dispatch_id AS record_id, 'INSERT' AS operation_type,
    CAST(CASE WHEN service_type = 'Emergency Repair' THEN 2 ELSE 1 END AS BIGINT) AS seq,
    CAST(dispatch_date + CASE WHEN service_type = 'Emergency Repair' THEN 2 ELSE 1 END AS VARCHAR) AS "at",
    CAST(NULL AS VARCHAR) AS old_status, CASE WHEN service_type = 'Emergency Repair' THEN 'Completed' ELSE status END AS new_status
FROM service_logs
UNION ALL SELECT dispatch_id, 'UPDATE', 2, CAST(dispatch_date + 2 AS VARCHAR), status, 'Completed' FROM service_logs WHERE service_type <> 'Emergency Repair'"""
SQL["sql_chunks"] = SQL["chunk_sentences"]
