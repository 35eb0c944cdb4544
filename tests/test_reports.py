"""Order of reports, status of broken measures, rebuilt tables, plan shapes."""

import shutil

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from gridkit.operators import quality as Q
from gridkit.operators import rollups as R
from gridkit.plans import registry
from gridkit.sources import sinks
from gridkit.sources.bindings import load

registry.load_all()
# query -> (column, descending) in order
ORDERS = {
    "q01_asset_mix": [("n", True)], "q02_site_mix": [("region_name", False), ("generation_type", False)],
    "q03_price_by_month": [("region_name", False), ("month", False)], "q04_price_by_hour": [("hour", False)],
    "q05_anomaly_outage_buckets": [("anomaly_bucket", False)], "q06_loss_by_reason": [("total_lost_mwh", True)],
    "q07_wo_linkage": [("n", True)], "q08_outage_price_impact": [("total_revenue_loss_usd", True)],
    "q09_age_vs_financials": [("age_bucket", False)], "q11_overdue_vs_outages": [("overdue_bucket", False)],
    "n03_monthly_outages": [("month", False), ("total_lost_mwh", True)],
    "n04_vendor_reliability": [("total_lost_mwh", True)], "n07_region_pnl": [("net_profit", False)],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_reports_are_sorted(spark, name):
    rows = registry.QUERIES[name](spark, SF001).collect()
    want = list(rows)
    for c, down in reversed(ORDERS[name]):
        # a stable sort; missing totals come last
        want.sort(key=lambda r: (0 if down else r[c]) if r[c] is None else r[c], reverse=down)
        if down:
            want.sort(key=lambda r: r[c] is None)
    assert [[r[c] for c, _ in ORDERS[name]] for r in rows] == [[r[c] for c, _ in ORDERS[name]] for r in want]


def test_broken_view_reports_error(spark):
    good = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, c double")
    status = Q.measure_status({"ok": (good, ["a", "b", "c"]),
                               "bad": (lambda: good.select("missing"), ["x", "y"]),
                               "none": (good.limit(0), ["a"])})
    got = {(r["view"], r["measure"]): r["status"] for r in status.collect()}
    assert got == {("ok", "a"): "OK", ("ok", "b"): "ZERO", ("ok", "c"): "NULL", ("bad", "x"): "ERROR",
                   ("bad", "y"): "ERROR", ("none", "a"): "EMPTY"}
    total = {r["view"]: (r["ok"], r["warn"], r["error"]) for r in Q.status_summary(status).collect()}
    assert total == {"ok": (1, 2, 0), "bad": (0, 0, 2), "none": (0, 1, 0)}


def test_rollup_tables_follow_new_data(spark, tmp_path):
    for t in ("region", "nation", "customer", "supplier"):
        shutil.copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    events = spark.read.parquet(f"{SF001}/events.parquet")
    path = str(tmp_path / "events.parquet")
    events.where("event_id % 2 = 0").write.parquet(path)
    one = R.asset_daily_table(load(spark, str(tmp_path)))
    assert R.asset_daily_table(load(spark, str(tmp_path))).inputFiles() == one.inputFiles()
    half = one.agg(F.sum("revenue_usd")).first()[0]
    events.where("event_id % 2 = 1").write.mode("append").parquet(path)
    whole = R.asset_daily_table(load(spark, str(tmp_path))).agg(F.sum("revenue_usd")).first()[0]
    assert whole == pytest.approx(events.agg(F.sum("value")).first()[0]) and whole > half


def test_asset_day_spine_is_exchanged_once_per_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.asset_daily_summary(load(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.splitlines() if "SortMergeJoin" in x or "Exchange hashpartitioning" in x]
    # from the top: the capacity join, one exchange of the joined days, then the
    # five rollup joins with no exchange between them
    assert "asset_id" in lines[0] and "date" not in lines[0].split("]")[0]
    assert "Exchange" in lines[1]
    assert all("SortMergeJoin" in x and "date" in x for x in lines[2:7])


def test_clustered_table_has_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).select((F.col("id") % 4).alias("day"), "id")
    sinks.create_table_as(spark, df, str(tmp_path / "t"), ["day"])
    assert sum(1 for _ in (tmp_path / "t").glob("data/*/day=*/part-*")) <= 8


def test_repeated_join_keys_are_refused(spark):
    from fixtures import ASSETS, REGION, SITES, tables

    from gridkit.plans.views import all_views
    view = all_views()["maintenance_workforce_metrics"]
    good = tables(spark, regions=REGION, sites=SITES, assets=ASSETS)
    assert view.query(good, ["asset_type"], ["work_order_count"], check_keys=True).count() == 0
    twice = tables(spark, regions=REGION, sites=SITES, assets=[*ASSETS, ASSETS[0]])
    with pytest.raises(ValueError, match="asset 10"):
        view.query(twice, ["asset_type"], ["work_order_count"], check_keys=True)


def test_every_dimension_is_queried():
    from gridkit.plans import q_metrics as M
    named = {(v.name, d.name) for v in M.views().values() for d in v.dimensions}
    assert len(named) == 48 and M.QUERIED <= named
    # p08's flag is one of them; what is left is asked in a filter only
    assert named - M.QUERIED == set()
