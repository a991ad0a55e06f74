"""ERP-shaped tables computed from the benchmark tables.

Each entry is one SELECT in the common part of Spark SQL and ANSI SQL, so that the Spark queries and the
SQL that checks them start from the same rows. Table names are written ``{lineitem}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.session import spread


def read(spark: SparkSession, sf_dir: str, table: str, heavy: bool = False, key: str | None = None) -> DataFrame:
    """A base table; ``heavy`` spreads a small file over the cores ahead of costly per-row work, by ``key`` if a join by it follows."""
    scan = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spread(scan, key) if heavy else scan


def _two(expr: str) -> str:
    return f"lpad(cast({expr} as string), 2, '0')"


def _dates(y: str, m: str, d: str, pick: str) -> str:
    """The same day written in one of five layouts."""
    return f"""CASE {pick}
        WHEN 0 THEN concat({y}, '-', {_two(m)}, '-', {_two(d)})
        WHEN 1 THEN concat({y}, '-', {_two(m)}, '-', {_two(d)}, 'T08:30:00Z')
        WHEN 2 THEN concat({y}, '/', {_two(m)}, '/', {_two(d)})
        WHEN 3 THEN concat({m}, '/', {d}, '/', {y})
        ELSE concat({_two(m)}, '-', {_two(d)}, '-', {y}) END"""


def _day(expr: str, pick: str) -> str:
    return _dates(f"year({expr})", f"month({expr})", f"day({expr})", pick)


_MODEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'X-5200' WHEN '2-HIGH' THEN 'G-3100'
        WHEN '3-MEDIUM' THEN 'C-1400' WHEN '5-LOW' THEN 'X-7700' ELSE 'G-4800' END"""
_UNIT = "concat('EQ-', lpad(cast(o_orderkey as string), 6, '0'))"
_UNIT_OF_LINE = "concat('EQ-', lpad(cast(l_orderkey as string), 6, '0'))"
_DISPATCH = "concat('DISP-', l_orderkey * 10 + l_linenumber)"
_SERVICE = """CASE l_returnflag WHEN 'R' THEN 'Emergency Repair' WHEN 'A' THEN 'Preventive Maintenance'
        ELSE 'Diagnostic' END"""
_MONEY = "cast(cast({} as decimal(12,2)) as string)"

SQL = {
    # ---- raw text tables with the usual dirt
    "raw_customers": f"""
WITH base AS (
    SELECT c_custkey + 2 AS source_row, c_mktsegment, c_acctbal, c_custkey,
        CASE WHEN c_acctbal < -900 THEN 'N/A' ELSE concat(' CUST-', c_custkey) END AS customer_id,
        CASE WHEN c_mktsegment = 'BUILDING' THEN concat('<b>', c_name, '</b>')
             WHEN c_mktsegment = 'MACHINERY' THEN concat(c_name, ' &amp; Sons') ELSE c_name END AS company_name,
        concat('  Contact   ', c_custkey, ' ') AS contact_name,
        CASE c_nationkey % 3
            WHEN 0 THEN concat('(', 200 + c_nationkey, ') 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'))
            WHEN 1 THEN concat('1-', 200 + c_nationkey, '-555-', lpad(cast(c_custkey % 10000 as string), 4, '0'))
            ELSE 'na' END AS phone,
        concat('c', c_custkey, '@example.com') AS email, concat(c_custkey, ' <u>Main</u> St') AS address,
        concat('City  ', c_nationkey) AS city, lpad(cast(c_custkey as string), 5, '0') AS zip,
        CASE c_nationkey % 4 WHEN 0 THEN 'tx' WHEN 1 THEN 'Ca' ELSE 'NY' END AS state,
        CASE c_nationkey % 5 WHEN 0 THEN 'usa' WHEN 1 THEN 'U.S.' WHEN 2 THEN 'United  States'
            WHEN 3 THEN 'ca' ELSE 'NULL' END AS country,
        CASE WHEN c_acctbal > 9000 THEN '2021-02-30' WHEN c_acctbal > 8500 THEN '13 March 2020'
            ELSE {_dates('1995 + c_nationkey', '1 + c_custkey % 12', '1 + c_custkey % 28', 'c_custkey % 5')}
            END AS created_date,
        CASE c_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'INACTIVE' WHEN 2 THEN 'in-progress'
            ELSE '' END AS status
    FROM {{customer}})
SELECT source_row, customer_id, company_name, contact_name, phone, email, address, city, state, zip, country, created_date, status
FROM base
UNION ALL
SELECT source_row + 1000000000, customer_id, company_name, contact_name, '', email, address, city, state, zip, country,
    created_date, status
FROM base WHERE c_mktsegment = 'FURNITURE'
UNION ALL
SELECT source_row + 2000000000, customer_id, concat(company_name, ' II'), contact_name, phone, email, address, city, state,
    zip, country,
    created_date, status
FROM base WHERE c_mktsegment = 'AUTOMOBILE'""",
    "raw_equipment": f"""
WITH base AS (
    SELECT o_orderkey + 2 AS source_row, o_orderstatus,
        {_UNIT} AS equipment_id, concat('CUST-', o_custkey) AS customer_id, {_MODEL} AS model,
        concat('SN-X7-', o_orderkey) AS serial_number,
        {_day('o_orderdate', 'o_orderkey % 5')} AS install_date,
        CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 'abc'
             WHEN o_orderpriority = '1-URGENT' THEN concat('$', {_MONEY.format('o_totalprice')})
             ELSE {_MONEY.format('o_totalprice')} END AS capacity_kw,
        '480V' AS voltage,
        {_day("(o_orderdate + INTERVAL '3' YEAR)", '(o_orderkey + 1) % 5')} AS warranty_expiration,
        CASE o_orderstatus WHEN 'O' THEN 'in service' WHEN 'F' THEN 'Decommissioned' ELSE 'STANDBY' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN concat('<i>Bay</i> ', o_custkey) WHEN '2-HIGH' THEN 'NULL'
            ELSE concat(' Roof  ', o_custkey) END AS location_notes
    FROM {{orders}})
SELECT source_row, equipment_id, customer_id, model, serial_number, install_date, capacity_kw, voltage,
    warranty_expiration, status, location_notes
FROM base
UNION ALL
SELECT source_row + 1000000000000, equipment_id, customer_id, model, 'N/A', install_date, capacity_kw, voltage,
    warranty_expiration, status, location_notes
FROM base WHERE o_orderstatus = 'P'""",
    "raw_dispatches": f"""
SELECT CAST(round(l_extendedprice * 100) AS BIGINT) * 100000 + l_suppkey AS source_row,
    {_DISPATCH} AS dispatch_id, {_UNIT_OF_LINE} AS equipment_id, concat('CUST-', o_custkey) AS customer_id,
    {_day('l_shipdate', 'l_linenumber % 5')} AS dispatch_date,
    CASE WHEN l_tax = 0 THEN 'n/a' ELSE concat(' Tech  ', l_suppkey) END AS technician,
    {_SERVICE} AS service_type,
    cast(cast(l_quantity as int) as string) AS hours_spent,
    CASE WHEN l_discount > 0.095 AND l_tax > 0.075 THEN 'unknown'
        ELSE concat('$', {_MONEY.format('l_extendedprice')}) END AS labor_cost,
    CASE l_linenumber WHEN 1 THEN '<p>Replaced fuse block</p>' WHEN 2 THEN 'Firmware  updated &amp; tested'
        WHEN 3 THEN '' WHEN 4 THEN 'Cleaned heat exchanger' ELSE concat('Replaced sensor ', l_suppkey % 5) END
        AS resolution_summary,
    CASE l_linestatus WHEN 'O' THEN 'in progress' ELSE 'COMPLETED' END AS status
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "raw_parts": f"""
SELECT p_partkey + 2 AS source_row, concat('PRT-', p_partkey) AS part_id,
    CASE WHEN p_size < 10 THEN concat(' ', p_name, '  kit') ELSE p_name END AS part_name,
    p_type AS category, concat('Maker ', p_size % 7) AS manufacturer, p_brand AS supplier,
    concat('$', {_MONEY.format('p_retailprice')}) AS unit_cost, {_MONEY.format('p_retailprice * 2')} AS unit_price,
    cast(p_size as string) AS stock_quantity,
    CASE WHEN p_size > 48 THEN 'low' ELSE cast(p_size * 2 as string) END AS reorder_level
FROM {{part}}""",
    "raw_claims": f"""
SELECT CAST(round(l_extendedprice * 100) AS BIGINT) * 100000 + l_suppkey AS source_row,
    concat('CLM-', l_orderkey * 10 + l_linenumber) AS claim_id, {_UNIT_OF_LINE} AS equipment_id,
    CASE WHEN l_tax < 0.02 THEN 'N/A' ELSE {_DISPATCH} END AS dispatch_id,
    CASE WHEN l_tax > 0.05 THEN '' ELSE concat('PRT-', l_partkey) END AS part_id,
    {_day('l_shipdate', 'l_linenumber % 5')} AS claim_date,
    {_MONEY.format('l_extendedprice')} AS claim_amount,
    CASE WHEN l_linestatus = 'O' THEN 'na' ELSE {_MONEY.format('l_extendedprice - 1')} END
        AS approved_amount,
    CASE l_linestatus WHEN 'O' THEN 'Under review' ELSE 'APPROVED' END AS status,
    CASE WHEN l_discount > 0.08 THEN '<i>late</i> filing' ELSE '' END AS denial_reason,
    concat('  claim  for  ', l_partkey) AS claim_notes
FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    # ---- typed tables
    "customers": "SELECT concat('CUST-', c_custkey) AS customer_id, c_name AS company_name FROM {customer}",
    "equipment_units": f"""
SELECT {_UNIT} AS equipment_id, concat('CUST-', o_custkey) AS customer_id, {_MODEL} AS model,
    concat('SN-X7-', o_orderkey) AS serial_number, cast(o_orderdate as date) AS install_date,
    cast(o_totalprice as decimal(12,2)) AS capacity_kw, '480V' AS voltage,
    cast(o_orderdate + INTERVAL '3' YEAR as date) AS warranty_expiration,
    CASE o_orderstatus WHEN 'O' THEN 'In Service' WHEN 'F' THEN 'Decommissioned' ELSE 'Standby' END AS status,
    concat('Roof ', o_custkey) AS location_notes
FROM {{orders}}""",
    "service_logs": f"""
SELECT {_DISPATCH} AS dispatch_id, {_UNIT_OF_LINE} AS equipment_id, cast(max(l_shipdate) as date) AS dispatch_date,
    concat('Tech ', max(l_suppkey)) AS technician, max({_SERVICE}) AS service_type,
    cast(max(l_quantity) as decimal(10,2)) AS hours_spent, cast(max(l_extendedprice) as decimal(12,2)) AS labor_cost,
    CASE WHEN l_linenumber = 1 THEN 'Replaced fuse block' WHEN l_linenumber = 2 THEN '  Firmware  updated '
        WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN '   ' ELSE 'Replaced sensor' END
        AS resolution_summary,
    CASE max(l_linestatus) WHEN 'O' THEN 'In Progress' ELSE 'Completed' END AS status
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    "warranty_claims": f"""
SELECT concat('CLM-', l_orderkey * 10 + l_linenumber) AS claim_id, {_UNIT_OF_LINE} AS equipment_id,
    CASE WHEN l_linenumber < 3 THEN {_DISPATCH} ELSE NULL END AS dispatch_id,
    CASE WHEN l_linenumber > 4 THEN NULL ELSE concat('PRT-', max(l_partkey)) END AS part_id,
    cast(max(l_shipdate) as date) AS claim_date, cast(max(l_extendedprice) as decimal(12,2)) AS claim_amount,
    CASE WHEN max(l_linestatus) = 'O' THEN NULL ELSE cast(max(l_extendedprice) - 1 as decimal(12,2)) END
        AS approved_amount,
    CASE WHEN max(l_linestatus) = 'O' THEN 'Under Review' ELSE 'Approved' END AS status,
    CASE WHEN max(l_discount) > 0.08 THEN 'late filing' ELSE NULL END AS denial_reason,
    'filed' AS claim_notes
FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber""",
    "parts_inventory": """
SELECT concat('PRT-', p_partkey) AS part_id,
    CASE WHEN p_size < 10 THEN concat(' ', p_name, ' Cell') WHEN p_size < 20 THEN concat(p_name, ' Fuse ')
        WHEN p_size = 20 THEN concat(p_name, ' Sensor ', p_partkey) ELSE p_name END AS part_name,
    p_type AS category, concat('Maker ', p_size % 7) AS manufacturer, p_brand AS supplier,
    p_size AS stock_quantity
FROM {part}""",
    "telemetry_flat": """
SELECT concat('TLM-', event_id) AS log_id, ts, concat('SN-X7-', user_id) AS equipment_id,
    CASE user_id % 3 WHEN 0 THEN 'X-5200' WHEN 1 THEN 'G-3100' ELSE 'C-1400' END AS model_code,
    CASE WHEN value > 50 THEN 'Tripped' ELSE 'Online' END AS status,
    CASE event_type WHEN 'error' THEN 'ERR_INV_404' WHEN 'purchase' THEN 'ERR_COOL_302'
        WHEN 'click' THEN 'ERR_FUSE_001' ELSE NULL END AS fault_code,
    CASE WHEN value > 50 THEN 'Critical' ELSE 'Low' END AS severity,
    value AS temperature_c, cast(regexp_extract(props, '[0-9]+', 0) as double) AS soc_percent,
    CASE WHEN value > 20 THEN concat('CMP-', cast(regexp_extract(props, '[0-9]+', 0) as int) % 7) ELSE NULL END
        AS component_a,
    CASE WHEN value > 40 THEN concat('CMP-', user_id % 5) ELSE NULL END AS component_b,
    concat('note ', event_type, ' ', props) AS notes
FROM {events}""",
    # ---- questions that mention the ids above
    "questions": f"""
SELECT c_custkey AS question_id,
    CASE c_custkey % 8
    WHEN 0 THEN concat('What are common failure modes for Model ', CASE c_nationkey % 3 WHEN 0 THEN 'X5200'
        WHEN 1 THEN 'G-3100' ELSE 'Z-9999 or X-9999' END, ' batteries in high-temperature environments?')
    WHEN 1 THEN CASE c_nationkey % 3 WHEN 0 THEN 'Which suppliers provide battery cells for our commercial units?'
        WHEN 1 THEN 'Which vendors supply fuses and sensors?' ELSE 'Which manufacturer should we procure from?' END
    WHEN 2 THEN concat('Show me service history for equipment unit SN-X7-', c_custkey * 20, ' and related warranty claims')
    WHEN 3 THEN concat('Show service history and warranty claims for equipment EQ-',
        lpad(cast(c_custkey * 7 as string), 6, '0'), ' of ', c_name)
    WHEN 4 THEN concat('What does fault code ', CASE c_nationkey % 2 WHEN 0 THEN 'ERR_INV_404' ELSE 'err_fuse_001' END,
        ' mean and which units reported it?')
    WHEN 5 THEN concat('Why is unit SN-X7-', c_nationkey, ' raising cooling faults and what should the technician check?')
    WHEN 6 THEN 'Which parts have a single-source supplier risk?'
    ELSE CASE c_nationkey % 3 WHEN 0 THEN 'What are the emergency response steps for a confirmed thermal runaway event?'
        WHEN 1 THEN 'Which units show overheating alarms?'
        ELSE concat('Warranty claims of model C-1400, CLM-', c_custkey, ', DISP-', c_custkey * 10 + 1, ' and PRT-', c_custkey,
            '?') END
    END AS question
FROM {{customer}}""",
}


def tables_in(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy frame. Raw tables are about to be cleaned value by value, questions to be matched with
    many patterns, and events to be dealt to many lists."""
    heavy = {"lineitem", "customer", "part"} if name.startswith("raw_") else set()
    heavy = {"raw_equipment": {"orders"}, "questions": {"customer"}, "telemetry_flat": {"events"}}.get(name, heavy)
    joined = {("raw_dispatches", "lineitem"): "l_orderkey"}
    return spark.sql(SQL[name], **{t: read(spark, sf_dir, t, t in heavy, joined.get((name, t))) for t in tables_in(name)})


def cte(*names: str) -> str:
    """The derived tables as the head of a SQL statement over the plain table names."""
    bodies = []
    for name in names:
        body = SQL[name]
        for table in tables_in(name):
            body = body.replace("{" + table + "}", table)
        bodies.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(bodies)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as nested telemetry documents."""
    flat = frame(spark, sf_dir, "telemetry_flat")
    components = F.array_compact(F.array("component_a", "component_b"))
    return flat.select(
        "log_id", F.col("ts").alias("timestamp"), "equipment_id", "model_code", "status", "fault_code", "severity",
        F.struct(
            F.lit(800.0).alias("voltage_v"), F.lit(12.5).alias("current_a"), F.col("temperature_c"),
            F.col("soc_percent"), F.lit(3.0).alias("voltage_delta_mv"),
        ).alias("telemetry"),
        F.when(F.size(components) > 0, components).alias("flagged_components"),
        "notes",
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = {
        "customers": "raw_customers", "equipment": "raw_equipment", "dispatches": "raw_dispatches",
        "parts": "raw_parts", "warranty_claims": "raw_claims",
    }
    return {table: frame(spark, sf_dir, name) for table, name in names.items()}


def silver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["customers", "equipment_units", "service_logs", "warranty_claims", "parts_inventory"]
    out = {name: frame(spark, sf_dir, name) for name in names}
    out["telemetry"] = telemetry(spark, sf_dir)
    return out
