"""Registered queries against their checking SQL on the smallest tables.

``python tests/oracle_check.py`` runs all of them at any scale.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import oracle_check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = [
    "minute_rollup", "top_devices_by_volume", "all_device_top_peers", "activity_heatmap", "search_flows",
    "packets_to_flows", "syslog_parse", "ids_alerts", "device_baselines", "device_window_metrics", "beaconing",
    "nighttime", "new_destination", "floods", "dedup_alerts", "apply_policies", "device_risk",
    "security_summary", "route_notifications", "apply_rule_changes", "device_profile_change",
    "new_internal_communication", "detect_all", "audit_log",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    rows, _, problem = oracle_check.compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF
    )
    assert not problem or problem.startswith("slow"), problem


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    own = {n for n in queries if not n.startswith("op") and n != "pipeline"}
    assert len(own) > 100 and own <= set(sql) and set(sql) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "bytes", "packets", "flows"]


def test_plans_have_no_nested_loops(spark):
    for name in ("match_policies", "route_notifications", "activity_heatmap", "security_summary", "share"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_rank_filters_reach_below_the_shuffle(spark):
    plan = entry.queries()["all_device_top_peers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
