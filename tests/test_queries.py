"""Registered queries against their SQL on the smallest data set; tools/compare.py runs all of them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

SAMPLE = [
    "service_rollup", "duplicate_profile", "cleanse_equipment", "orphans", "safe_view", "audit_capture", "fault_summary",
    "unit_events", "supplier_risk", "chunk_sliding", "chunk_sentences", "vector_topk", "route_questions", "evidence_units",
    "citation_check", "latency_percentiles",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
