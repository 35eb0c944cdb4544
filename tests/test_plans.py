"""Physical-plan properties: filters reach the scan, unused columns are pruned,
no cartesian products."""

import __spark_entry__ as E
from conftest import SF001

Q = E.queries()


def _plan(spark, name):
    df = Q[name](spark, SF001)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filter_pushed_to_parquet_scan(spark):
    plan = _plan(spark, "r03_anomalies_daily")
    assert "PushedFilters" in plan and "EqualTo(event_type,error)" in plan


def test_unused_columns_not_read(spark):
    for name in ("r02_telemetry_daily", "r08_asset_daily_summary", "q06_loss_by_reason"):
        plan = _plan(spark, name)
        for line in plan.splitlines():
            if line.strip().startswith("ReadSchema:") and "event_id" in line:
                assert "props" not in line, (name, line)


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("q08_outage_price_impact", "q10_causal_chain", "w02_first_time_fix_90d",
                 "c12_threshold_bands", "x12_maint_region_type", "v01_fk_orphans"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
