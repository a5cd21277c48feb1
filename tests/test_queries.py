"""Registered queries against their SQL twins. PULSEFRAME_FULL=1 runs all of them, else one per area."""

import os

import pytest

import __spark_entry__ as E
from pulseframe.queries import ORACLES, QUERIES
from tests.check_oracles import compare

SF = os.environ.get("PULSEFRAME_SF", "/root/testdata/sf0.001")
FEW = ["series_compact", "series_file_scan", "clean", "clean_stats", "baseline_robust_slot", "all_findings", "stats_grouping_sets", "suggestions",
       "asof_change", "closure", "stream_sessions", "stream_bucket_merge", "window_scan",
       "replace_dataset", "write_if_changed", "alert_files", "evidence_document", "trailing_stats", "distinct_sketch"]
NAMES = list(QUERIES) if os.environ.get("PULSEFRAME_FULL") else FEW


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, message = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, message


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["run_id", "rank", "anomaly_id", "level", "deviation_score"] and df.count() > 0
