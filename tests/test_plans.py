"""Plan-shape checks for scale: no per-row Python, no cross products, the
range join is an equi-join, scans are pruned."""
import pytest

import __spark_entry__ as E
from tarpit.operators import geo as G
from tarpit.operators.sessionize import session_pieces, sessionize
from tarpit.sources import fixtures

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sessions_batch", "geo_range_join", "campaigns", "kpis", "distributions",
                                  "daily_activity", "country_risk", "silhouette", "adjusted_rand",
                                  "best_threshold", "median_flags", "enriched_rule"])
def test_no_row_python_or_cross_products(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)


def test_range_join_is_bucketed_equi_join(spark):
    s = G.with_ip_scope(sessionize(fixtures.raw_events(spark, SF)))
    plan = plan_of(G.geo_enrich(s, fixtures.geo_ranges(spark, SF)))
    assert "_bucket" in plan and ("BroadcastHashJoin" in plan or "SortMergeJoin" in plan)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_event_scan_is_pruned(spark):
    plan = plan_of(session_pieces(fixtures.raw_events(spark, SF)))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "events.parquet" in line]
    assert scans and all("value:" not in s for s in scans)  # the unused `value` column is never read


def test_raw_events_are_read_and_moved_once(spark):
    plan = plan_of(session_pieces(fixtures.raw_events(spark, SF)))
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 1


def test_sessionizer_has_no_single_partition_window(spark):
    plan = plan_of(sessionize(fixtures.raw_events(spark, SF)))
    # The only single-partition exchange allowed is none: every window is
    # partitioned by key and chunk (rows) or key (per-chunk totals).
    assert "SinglePartition" not in plan
