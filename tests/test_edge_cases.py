"""Literal-row tests for the edge cases of the rollups, views and derivations."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import ASSETS, D, REGION, SITES, T, tables
from gridkit.operators import derive as Dv
from gridkit.operators import quality as Q
from gridkit.operators import rollups as R
from gridkit.operators.joins import window_after_join
from gridkit.plans.views import all_views


def _fin(asset, day, rev, opex=100.0, maint=0.0):
    return (asset, day, rev, opex, maint, 0.0)


def test_no_telemetry_and_non_generation(spark):
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS,
               asset_financials=[_fin(10, D(2024, 1, 1), 1000.0, 100.0, 50.0),
                                 _fin(11, D(2024, 1, 1), 500.0)],
               telemetry=[(1, 11, T(2024, 1, 1, 5), 480.0, 20.0, 1.0, 2.0, 90.0, False)])
    rows = {r.asset_id: r for r in R.asset_daily_summary(t).collect()}
    a = rows[10]
    assert a.has_telemetry is False and a.theoretical_max_daily_mwh is None
    assert a.alarm_count is None and a.anomaly_count == 0 and a.outage_count == 0
    assert abs(a.profit_margin_pct - 85.0) < 1e-9
    assert abs(a.asset_capacity_mw - 50.0) < 1e-9          # 100 MW / 2 assets at site 1
    trf = rows[11]
    assert trf.has_telemetry is True and trf.theoretical_max_daily_mwh is None  # not generation
    # NULL alarm count: "alarm_count > 10" is UNKNOWN, the CASE falls through to Healthy
    v = all_views()["grid_operations_metrics"]
    h = {r.asset_id: r.asset_health_status for r in
         v.query(t, ["asset_id", "asset_health_status"], ["outage_count"]).collect()}
    assert h[10] == "Healthy"


def test_zero_denominators_and_revenue_margin(spark):
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS,
               asset_financials=[_fin(10, D(2024, 1, 1), 0.0), _fin(20, D(2024, 1, 1), -5.0)])
    ads = {r.asset_id: r for r in R.asset_daily_summary(t).collect()}
    assert ads[10].profit_margin_pct == -100.0 and ads[20].profit_margin_pct == -100.0
    g = all_views()["grid_operations_metrics"].query(t, ["asset_id"], ["mttr_hours", "mtbf_hours",
                                                                      "capacity_factor_pct"])
    for r in g.collect():
        assert r.mttr_hours is None and r.mtbf_hours is None and r.capacity_factor_pct is None


def test_null_margin_is_high_margin(spark):
    from gridkit.sources.bindings import Tables
    base = tables(spark, regions=REGION, sites=SITES, assets=ASSETS)
    af = spark.createDataFrame(
        [(10, D(2024, 1, 1), 10.0, 1.0, 0.0, 0.0, None)],
        "asset_id long, date date, revenue_usd double, opex_usd double, "
        "maintenance_cost_usd double, curtailed_mwh double, profit_margin_pct double")
    frames = {n: base[n] for n in ("regions", "sites", "assets", "telemetry", "sensor_anomalies",
                                   "outages", "maintenance_schedule", "work_orders",
                                   "technicians", "market_prices", "power_sales",
                                   "safety_incidents")}
    frames["asset_financials"] = af
    t = Tables.from_frames(spark, frames)
    out = all_views()["financial_performance_metrics"].query(
        t, ["profitability_band"], ["total_revenue_usd"]).collect()
    assert [r.profitability_band for r in out] == ["High Margin"]


def test_interval_allocation_edges(spark):
    outages = [
        (1, 10, 1, T(2024, 1, 1, 22), T(2024, 1, 2, 2), "weather", False, 8.0),   # crosses midnight
        (2, 10, 1, T(2024, 1, 3, 10, 10), T(2024, 1, 3, 10, 50), "weather", False, 4.0),  # sub-hour
        (3, 20, 2, T(2024, 12, 31, 22), T(2025, 1, 1, 3), "weather", True, 6.0),  # past year end
    ]
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=outages)
    per_day = {(r.asset_id, r.date): r.lost_mwh for r in Dv.loss_per_day(t).collect()}
    assert per_day[(10, D(2024, 1, 1))] == 4.0 and per_day[(10, D(2024, 1, 2))] == 4.0
    assert abs(sum(per_day.values()) - 18.0) < 1e-9         # allocation conserves the loss
    per_hour = Dv.loss_per_hour(t, dt.datetime(2024, 1, 1), 366 * 24).collect()
    by_site = {}
    for r in per_hour:
        by_site.setdefault(r.site_id, []).append((r.hour, r.lost_mwh))
    assert [h.hour for h, _ in sorted(by_site[1])] == [22, 23, 0, 1]   # 4 whole hours; sub-hour outage none
    assert by_site[2] == [(T(2024, 12, 31, 22), 6.0)]                  # clipped to the year


def test_preventive_orders_have_no_outage_reason(spark):
    outages = [(1, 10, 1, T(2024, 1, 1, 0), T(2024, 1, 2, 6), "overheating", True, 10.0),
               (2, 10, 1, T(2024, 1, 5, 0), T(2024, 1, 5, 6), "weather", False, 3.0)]
    sched = [(7, 10, D(2024, 1, 9), "quarterly_inspection", True, False)]
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=outages,
               maintenance_schedule=sched)
    wo = {r.work_order_id: r for r in Dv.work_orders_from_events(
        t["outages"], t["maintenance_schedule"]).collect()}
    assert wo[2].work_order_type == "emergency" and wo[2].priority == "P1" and wo[2].outage_id == 1
    assert wo[4].work_order_type == "preventive" and wo[4].outage_id is None
    assert wo[15].work_order_type == "inspection" and wo[15].priority == "P4"
    t2 = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=outages,
                work_orders=[(r.work_order_id, r.asset_id, r.technician_id, r.outage_id,
                              r.work_order_type, r.priority, r.created_ts, r.completed_ts,
                              r.labor_hours, r.parts_cost_usd, r.status) for r in wo.values()],
                technicians=[(1, 1, "Tech", "Senior")])
    mv = all_views()["maintenance_workforce_metrics"]
    rows = mv.query(t2, ["outage_reason"], ["work_order_count"],
                    where="outage_reason IS NOT NULL").collect()
    assert [(r.outage_reason, r.work_order_count) for r in rows] == [("overheating", 1)]


def test_safety_fanout_as_written_and_deduplicated(spark):
    fin = [_fin(10, D(2024, 1, 1), 100.0), _fin(20, D(2024, 1, 1), 100.0)]
    inc = [(1, 1, 1, T(2024, 1, 1, 9), "minor", False)]
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, asset_financials=fin,
               safety_incidents=inc)
    written = R.region_daily_summary(t).agg(F.sum("safety_incident_count")).first()[0]
    dedup = R.region_daily_summary(t, dedup_safety=True).agg(
        F.sum("safety_incident_count")).first()[0]
    assert (written, dedup) == (2, 1)


def test_orphans(spark):
    t = tables(spark, regions=REGION, sites=SITES,
               assets=ASSETS + [(99, 42, "X", "inverter", "OEM-0", D(2015, 1, 1), 20, 1.0),
                                (98, None, "Y", "inverter", "OEM-0", D(2015, 1, 1), 20, 1.0)])
    rows = {(r.child, r.column): r.orphans for r in Q.fk_orphans(t).collect()}
    assert rows[("assets", "site_id")] == 1


def test_anomaly_outage_window_edges(spark):
    an = spark.createDataFrame([(1, 10, T(2024, 1, 1, 0))], "anomaly_id long, asset_id long, anom_ts timestamp_ntz")
    ou = spark.createDataFrame(
        [(1, 10, T(2024, 1, 1, 0)), (2, 10, T(2024, 1, 3, 0)), (3, 10, T(2024, 1, 3, 0, 0, 1))],
        "outage_id long, asset_id long, outage_start_ts timestamp_ntz")
    got = sorted(r.outage_id for r in
                 window_after_join(an, ou, "asset_id", "anom_ts", "outage_start_ts", 48).collect())
    assert got == [1, 2]


def test_round_double_is_decimal_rounding(spark):
    import random

    from pyspark.sql import functions as F

    from gridkit.functions.scalars import rnd, round_double
    r = random.Random(5)
    xs = [0.0, -0.0, 1.005, -1.005, 406.755, 406.75499999999994, 2.5, -2.5, 0.125, 1e12, -1e300, float("inf"),
          float("nan"), None, 1e-12, -1e-12, 999999999.995, 1e9]
    xs += [r.uniform(-1e4, 1e4) for _ in range(3000)] + [round(r.uniform(-1e3, 1e3), 3) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    fine = (F.abs("x") < 1e20) & ~F.isnan("x")
    for row in df.where(fine).select("x", round_double("x", 2).alias("a"), rnd("x", 2).alias("b")).collect():
        assert row.a == row.b and str(row.a) != "-0.0", row
    for row in df.select("x", round_double("x", 6, F.round).alias("a"), F.round("x", 6).alias("b")).collect():
        assert row.a == row.b or (row.a != row.a and row.b != row.b), row
