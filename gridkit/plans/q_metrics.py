"""Registered metric-view queries: validation x01-x17, analyst g-queries,
measure status report v03/v04.

The oracle side states each view as plain SQL: flattened left joins
(source -> asset -> site -> region, technician, outage_ref) and the
dimension / measure expressions in DuckDB dialect.
"""

from __future__ import annotations

from ..sources.bindings import load
from .oracle_sql import with_bindings
from .q_rollups import ADS_CTES, RDS_CTES
from .registry import register
from .views import all_views

# Registered forms bind the exposure levels to region names of the supplied data.
BOUND_EXPOSURE = (("AMERICA", "High"), ("EUROPE", "High"), ("ASIA", "Medium"))

_VIEWS = None


def views():
    global _VIEWS
    if _VIEWS is None:
        _VIEWS = all_views(BOUND_EXPOSURE)
    return _VIEWS


# ---------------------------------------------------------------- oracle
# The same metric definitions in DuckDB dialect (paths
# flattened to the joined table aliases).
_TIME = {
    "date": "source.date",
    "month": "CAST(date_trunc('month', source.date) AS TIMESTAMP)",
    "quarter": "CAST(date_trunc('quarter', source.date) AS TIMESTAMP)",
    "year": "CAST(year(source.date) AS INTEGER)",
}


def _band(m):
    return (f"CASE WHEN {m} < 0 THEN 'Negative' WHEN {m} < 10 THEN 'Low Margin' "
            f"WHEN {m} < 30 THEN 'Moderate Margin' ELSE 'High Margin' END")


_ASSET_SQL_DIMS = {
    "asset_id": "source.asset_id", "asset_tag": "asset.asset_tag",
    "asset_type": "asset.asset_type", "manufacturer": "asset.manufacturer",
    "site_name": "site.site_name", "generation_type": "site.generation_type",
    "region_name": "region.region_name",
}

_EXPO = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BOUND_EXPOSURE)

SQL_DIMS = {
    "grid_operations_metrics": {
        **_ASSET_SQL_DIMS, **_TIME,
        "asset_health_status": (
            "CASE WHEN source.forced_outage_count > 0 AND source.anomaly_count >= 2 THEN 'Critical' "
            "WHEN source.avg_efficiency_pct IS NOT NULL AND source.avg_efficiency_pct < 80 THEN 'Degrading' "
            "WHEN source.anomaly_count > 0 OR source.alarm_count > 10 THEN 'Watchlist' ELSE 'Healthy' END"),
        "operational_risk_level": (
            "CASE WHEN source.forced_outage_count > 0 AND source.anomaly_count >= 5 THEN 'Critical' "
            "WHEN source.anomaly_count >= 2 OR source.alarm_count > 50 THEN 'High' "
            "WHEN source.anomaly_count >= 1 OR source.alarm_count > 10 THEN 'Medium' ELSE 'Low' END"),
    },
    "financial_performance_metrics": {
        **{k: v for k, v in _ASSET_SQL_DIMS.items() if k not in ("asset_tag", "manufacturer")},
        **_TIME,
        "profitability_band": _band("source.profit_margin_pct"),
        "market_exposure_level": f"CASE region.region_name {_EXPO} ELSE 'Low' END",
        "forced_outage_flag": "source.forced_outage_count > 0",
    },
    "maintenance_workforce_metrics": {
        "technician_id": "source.technician_id", "technician_name": "technician.technician_name",
        "certification_level": "technician.certification_level",
        "asset_id": "source.asset_id", "asset_type": "asset.asset_type",
        "site_name": "site.site_name", "region_name": "region.region_name",
        "work_order_type": "source.work_order_type", "priority": "source.priority",
        "status": "source.status", "created_date": "CAST(source.created_ts AS DATE)",
        "created_month": "CAST(date_trunc('month', source.created_ts) AS TIMESTAMP)",
        "outage_reason": "outage_ref.outage_reason",
        "forced_outage_flag": "outage_ref.forced_outage_flag",
    },
    "executive_summary_metrics": {
        "region_name": "source.region_name", "generation_type": "source.generation_type", **_TIME,
        "profitability_band": _band("source.avg_profit_margin_pct"),
        "regional_operational_health": (
            "CASE WHEN source.total_forced_outage_count > 5 OR source.avg_efficiency_pct < 75 THEN 'Critical' "
            "WHEN source.total_forced_outage_count > 2 OR source.avg_efficiency_pct < 85 THEN 'Stressed' "
            "WHEN source.total_forced_outage_count > 0 THEN 'Watch' ELSE 'Healthy' END"),
        "executive_risk_level": (
            "CASE WHEN source.total_forced_outage_count > 3 AND source.avg_profit_margin_pct < 0 THEN 'Critical' "
            "WHEN source.total_forced_outage_count > 1 OR source.avg_profit_margin_pct < 10 THEN 'High' "
            "WHEN source.total_anomaly_count > 5 OR source.total_overdue_maintenance_count > 2 THEN 'Medium' "
            "ELSE 'Low' END"),
    },
}


def _isum(c):
    return f"CAST(SUM({c}) AS BIGINT)"


def _cnt(cond):
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


_D = "CAST({} AS DOUBLE)"

SQL_MEASURES = {
    "grid_operations_metrics": {
        "avg_temperature": "AVG(source.avg_temperature)",
        "max_temperature": "MAX(source.max_temperature)",
        "avg_vibration": "AVG(source.avg_vibration)",
        "avg_efficiency_pct": "AVG(source.avg_efficiency_pct)",
        "total_power_generated_mwh": "SUM(source.total_power_mwh)",
        "anomaly_count": _isum("source.anomaly_count"),
        "outage_count": _isum("source.outage_count"),
        "forced_outage_count": _isum("source.forced_outage_count"),
        "total_downtime_hours": "SUM(source.total_downtime_hours)",
        "mttr_hours": "SUM(source.total_downtime_hours) / NULLIF(SUM(source.outage_count), 0)",
        "mtbf_hours": "(CAST(8760 AS DOUBLE) * COUNT(DISTINCT source.asset_id)) / NULLIF(SUM(source.outage_count), 0)",
        "capacity_factor_pct": ("CAST(100 AS DOUBLE) * SUM(source.total_power_mwh) "
                                "/ NULLIF(SUM(source.theoretical_max_daily_mwh), 0)"),
        "alarm_count": _isum("source.alarm_count"),
        "overdue_maintenance_count": _isum("source.overdue_maintenance_count"),
        "grid_instability_risk_score": (
            "CAST(100 AS DOUBLE) * (CAST(0.30 AS DOUBLE) * COALESCE(AVG(source.voltage_stddev), 0) / 20 "
            "+ CAST(0.30 AS DOUBLE) * COALESCE(AVG(source.avg_vibration), 0) / 5 "
            "+ CAST(0.20 AS DOUBLE) * COALESCE(AVG(source.max_severity_score), 0) / 10 "
            "+ CAST(0.20 AS DOUBLE) * LEAST(CAST(1 AS DOUBLE), SUM(source.forced_outage_count) "
            "/ GREATEST(COUNT(DISTINCT source.asset_id), 1) / CAST(5 AS DOUBLE)))"),
    },
    "financial_performance_metrics": {
        "total_revenue_usd": "SUM(source.revenue_usd)",
        "total_opex_usd": "SUM(source.opex_usd)",
        "total_maintenance_cost_usd": "SUM(source.finance_maintenance_cost_usd)",
        "net_profit_usd": "SUM(source.net_profit_usd)",
        "profit_margin_pct": ("CAST(100 AS DOUBLE) * SUM(source.net_profit_usd) "
                              "/ NULLIF(SUM(source.revenue_usd), 0)"),
        "revenue_loss_from_outages_usd": ("SUM(source.total_lost_mwh) * (SUM(source.revenue_usd) "
                                          "/ NULLIF(SUM(source.total_power_mwh), 0))"),
        "curtailment_loss_mwh": "SUM(source.curtailed_mwh)",
        "revenue_per_mwh": "SUM(source.revenue_usd) / NULLIF(SUM(source.total_power_mwh), 0)",
        "total_lost_mwh": "SUM(source.total_lost_mwh)",
    },
    "maintenance_workforce_metrics": {
        "work_order_count": "COUNT(source.work_order_id)",
        "preventive_maintenance_count": _cnt("source.work_order_type = 'preventive'"),
        "reactive_maintenance_count": _cnt("source.work_order_type IN ('reactive','emergency')"),
        "inspection_count": _cnt("source.work_order_type = 'inspection'"),
        "emergency_count": _cnt("source.work_order_type = 'emergency'"),
        "preventive_to_reactive_ratio": (
            _cnt("source.work_order_type = 'preventive'") + " / NULLIF("
            + _cnt("source.work_order_type IN ('reactive','emergency')") + ", 0)"),
        "avg_repair_duration_hours": ("AVG((floor(epoch(source.completed_ts)) - floor(epoch(source.created_ts))) "
                                      "/ CAST(3600 AS DOUBLE))"),
        "avg_labor_hours": "AVG(source.labor_hours)",
        "total_labor_hours": "SUM(source.labor_hours)",
        "total_parts_cost_usd": "SUM(source.parts_cost_usd)",
        "completed_count": _cnt("source.status = 'completed'"),
        "in_progress_count": _cnt("source.status = 'in_progress'"),
        "assets_serviced": "COUNT(DISTINCT source.asset_id)",
        "technicians_active": "COUNT(DISTINCT source.technician_id)",
        "repeat_failure_assets": ("COUNT(DISTINCT CASE WHEN source.work_order_type IN ('reactive','emergency') "
                                  "THEN source.asset_id END)"),
    },
    "executive_summary_metrics": {
        "total_revenue_usd": "SUM(source.total_revenue_usd)",
        "net_profit_usd": "SUM(source.net_profit_usd)",
        "profit_margin_pct": ("CAST(100 AS DOUBLE) * SUM(source.net_profit_usd) "
                              "/ NULLIF(SUM(source.total_revenue_usd), 0)"),
        "maintenance_cost_usd": "SUM(source.total_maintenance_cost_usd)",
        "total_generation_mwh": "SUM(source.total_power_mwh)",
        "avg_efficiency_pct": "AVG(source.avg_efficiency_pct)",
        "capacity_factor_pct": ("CAST(100 AS DOUBLE) * SUM(source.total_power_mwh) "
                                "/ NULLIF(SUM(source.total_theoretical_max_mwh), 0)"),
        "outage_count": _isum("source.total_outage_count"),
        "forced_outage_count": _isum("source.total_forced_outage_count"),
        "total_downtime_hours": "SUM(source.total_downtime_hours)",
        "total_lost_mwh": "SUM(source.total_lost_mwh)",
        "preventive_to_reactive_ratio": (
            "SUM(source.total_preventive_wo_count) / NULLIF(SUM(source.total_reactive_wo_count) "
            "+ SUM(source.total_emergency_wo_count), 0)"),
        "safety_incident_count": _isum("source.safety_incident_count"),
        "lost_time_incident_count": _isum("source.lost_time_incident_count"),
        "total_anomaly_count": _isum("source.total_anomaly_count"),
        "grid_instability_risk_score": (
            "CAST(100 AS DOUBLE) * LEAST(CAST(1 AS DOUBLE), ("
            "CAST(0.4 AS DOUBLE) * SUM(source.total_forced_outage_count) / GREATEST(COUNT(*), 1) / 2 "
            "+ CAST(0.3 AS DOUBLE) * SUM(source.total_anomaly_count) / GREATEST(COUNT(*), 1) / 10 "
            "+ CAST(0.3 AS DOUBLE) * (100 - COALESCE(AVG(source.avg_efficiency_pct), 100)) / 30))"),
    },
}

_ASSET_JOINS = ("LEFT JOIN assets asset ON source.asset_id = asset.asset_id "
                "LEFT JOIN sites site ON asset.site_id = site.site_id "
                "LEFT JOIN regions region ON site.region_id = region.region_id")
SQL_FROM = {
    "grid_operations_metrics": ("asset_daily_summary source " + _ASSET_JOINS, ADS_CTES),
    "financial_performance_metrics": ("asset_daily_summary source " + _ASSET_JOINS, ADS_CTES),
    "maintenance_workforce_metrics": (
        "work_orders source " + _ASSET_JOINS
        + " LEFT JOIN technicians technician ON source.technician_id = technician.technician_id"
        " LEFT JOIN outages outage_ref ON source.outage_id = outage_ref.outage_id", []),
    "executive_summary_metrics": ("region_daily_summary source", RDS_CTES),
}


def metric_sql(view, dims, measures, where=None, order_by=None, limit=None):
    """Oracle text of ``views()[view].query(...)``."""
    body, ctes = metric_parts(view, dims, measures, where, order_by, limit)
    return with_bindings(body, ctes)


def metric_parts(view, dims, measures, where=None, order_by=None, limit=None):
    """(statement, extra CTEs) of a metric query in plain SQL."""
    dsql, msql = SQL_DIMS[view], SQL_MEASURES[view]
    meas = [(m, m) if isinstance(m, str) else tuple(m) for m in measures]
    sel = [f"{dsql[d]} AS {d}" for d in dims] + [f"{msql[m]} AS {a}" for m, a in meas]
    frm, ctes = SQL_FROM[view]
    sql = f"SELECT {', '.join(sel)} FROM {frm}"
    if where:
        sql += " WHERE " + where.format(**dsql)
    if dims:
        sql += " GROUP BY " + ", ".join(dsql[d] for d in dims)
    keys = []
    for o in order_by or []:
        p = o.split()
        keys.append(f"{p[0]} DESC NULLS LAST" if len(p) > 1 and p[1].upper() == "DESC"
                    else f"{p[0]} ASC NULLS FIRST")
    if limit is not None:
        keys += [f"{d} ASC NULLS FIRST" for d in dims]
    if keys:
        sql += " ORDER BY " + ", ".join(keys)
    if limit is not None:
        sql += f" LIMIT {limit}"
    return sql, list(ctes)


def _spark_where(where):
    """The Spark filter text: dimension names stand for themselves."""
    if not where:
        return None
    return where.format(**{d: d for v in SQL_DIMS.values() for d in v})


#: (view, dimension) of every registered metric query
QUERIED: set[tuple[str, str]] = set()


def metric_query(name, view, dims, measures, where=None, order_by=None, limit=None):
    """Register one metric query under ``name`` with its oracle."""
    def run(spark, sf_dir):
        return views()[view].query(load(spark, sf_dir), dims, measures,
                                   _spark_where(where), order_by, limit)
    run.__name__ = name
    QUERIED.update((view, d) for d in dims)
    register(name, metric_sql(view, dims, measures, where, order_by, limit))(run)
    return run


# ------------------------------------------------ validation x01-x17
GO = "grid_operations_metrics"
FIN = "financial_performance_metrics"
MW = "maintenance_workforce_metrics"
EX = "executive_summary_metrics"

# every measure of a view, in the view's own order
GO_MEASURES, FIN_MEASURES, MW_MEASURES, EX_MEASURES = (
    [m.name for m in views()[v].measures] for v in (GO, FIN, MW, EX))

# The validation suite as (name, view, dims, measures, order_by, limit).
VALIDATION = [
    ("x01_grid_by_asset_type", GO, ["asset_type"], GO_MEASURES, ["asset_type"], 5),
    ("x02_grid_health_risk", GO, ["asset_health_status", "operational_risk_level"],
     ["outage_count", "anomaly_count", "avg_efficiency_pct"],
     ["asset_health_status", "operational_risk_level"], 10),
    ("x03_grid_by_region", GO, ["region_name"],
     ["total_power_generated_mwh", "outage_count", "capacity_factor_pct"], ["region_name"], 5),
    ("x04_grid_by_month", GO, ["month"],
     ["total_power_generated_mwh", "outage_count", "avg_efficiency_pct"], ["month"], 12),
    ("x05_fin_by_region", FIN, ["region_name"], FIN_MEASURES, ["region_name"], 5),
    ("x06_fin_by_band", FIN, ["profitability_band"],
     ["total_revenue_usd", "net_profit_usd", "profit_margin_pct"], ["profitability_band"], 5),
    ("x07_fin_by_exposure", FIN, ["market_exposure_level"],
     ["total_revenue_usd", "revenue_per_mwh", "revenue_loss_from_outages_usd"],
     ["market_exposure_level"], 5),
    ("x08_fin_gen_quarter", FIN, ["generation_type", "quarter"],
     ["total_revenue_usd", "net_profit_usd", "curtailment_loss_mwh"],
     ["generation_type", "quarter"], 20),
    ("x09_maint_by_type", MW, ["work_order_type"], MW_MEASURES, ["work_order_type"], 5),
    ("x10_maint_priority_status", MW, ["priority", "status"],
     ["work_order_count", "avg_repair_duration_hours", "total_parts_cost_usd"],
     ["priority", "status"], 20),
    ("x11_maint_by_certification", MW, ["certification_level"],
     ["work_order_count", "avg_labor_hours", "total_parts_cost_usd"],
     ["certification_level"], 5),
    ("x12_maint_region_type", MW, ["region_name", "work_order_type"],
     ["work_order_count", "total_parts_cost_usd"], ["region_name", "work_order_type"], 30),
    ("x13_maint_by_outage_reason", MW, ["outage_reason"],
     ["work_order_count", "avg_repair_duration_hours"], ["outage_reason"], 5),
    ("x14_exec_by_region", EX, ["region_name"], EX_MEASURES, ["region_name"], 5),
    ("x15_exec_by_health", EX, ["regional_operational_health"],
     ["outage_count", "total_revenue_usd", "avg_efficiency_pct"],
     ["regional_operational_health"], 5),
    ("x16_exec_risk_gen", EX, ["executive_risk_level", "generation_type"],
     ["total_revenue_usd", "net_profit_usd", "forced_outage_count"],
     ["executive_risk_level", "generation_type"], 20),
    ("x17_exec_quarter_gen", EX, ["quarter", "generation_type"],
     ["total_revenue_usd", "total_generation_mwh", "safety_incident_count"],
     ["quarter", "generation_type"], 20),
]

for _n, _v, _d, _m, _o, _l in VALIDATION:
    metric_query(_n, _v, _d, _m, order_by=_o, limit=_l)

# ------------------------------------------------ analyst g-queries
metric_query("g01_top_outage_assets", GO, ["asset_tag", "asset_type", "region_name"],
             [("outage_count", "outages"), ("total_downtime_hours", "downtime_hours"),
              ("avg_efficiency_pct", "efficiency_pct")], order_by=["downtime_hours DESC"], limit=20)
metric_query("g02_region_instability", GO, ["region_name"],
             [("grid_instability_risk_score", "risk_score"), ("outage_count", "outages"),
              ("anomaly_count", "anomalies")], order_by=["risk_score DESC"])
metric_query("g03_capacity_factor_trend", GO, ["month", "generation_type"],
             [("capacity_factor_pct", "capacity_factor"),
              ("total_power_generated_mwh", "power_mwh")],
             where="{generation_type} IN ('solar','wind','battery')",
             order_by=["month", "generation_type"])
metric_query("g04_mtbf_mttr", GO, ["asset_type"],
             [("mtbf_hours", "mtbf"), ("mttr_hours", "mttr"), ("outage_count", "outages")],
             order_by=["mtbf"])
metric_query("g05_risky_assets", GO,
             ["asset_tag", "asset_type", "site_name", "region_name", "operational_risk_level",
              "asset_health_status"],
             [("anomaly_count", "anomalies"), ("outage_count", "outages"),
              ("avg_efficiency_pct", "efficiency")],
             where="{operational_risk_level} IN ('Critical','High')",
             order_by=["anomalies DESC"], limit=50)
metric_query("g07_asset_profitability", FIN, ["asset_id", "asset_type", "site_name", "region_name"],
             [("total_revenue_usd", "revenue"), ("net_profit_usd", "net_profit"),
              ("profit_margin_pct", "margin_pct")], order_by=["net_profit DESC"], limit=20)
metric_query("g08_region_revenue_loss", FIN, ["region_name", "market_exposure_level"],
             [("revenue_loss_from_outages_usd", "rev_loss"), ("total_lost_mwh", "lost_mwh"),
              ("total_revenue_usd", "revenue")], order_by=["rev_loss DESC"])
metric_query("g09_margin_by_quarter", FIN, ["generation_type", "quarter"],
             [("total_revenue_usd", "revenue"), ("net_profit_usd", "profit"),
              ("profit_margin_pct", "margin")], order_by=["quarter", "generation_type"])
metric_query("g11_profit_bands", FIN, ["profitability_band"],
             [("total_revenue_usd", "revenue"), ("net_profit_usd", "net_profit"),
              ("profit_margin_pct", "avg_margin_pct")], order_by=["profitability_band"])
metric_query("g13_pm_ratio", MW, ["region_name"],
             [("preventive_maintenance_count", "preventive"),
              ("reactive_maintenance_count", "reactive"),
              ("preventive_to_reactive_ratio", "ratio"), ("emergency_count", "emergency")],
             order_by=["ratio"])
metric_query("g14_technician_load", MW, ["technician_name", "certification_level", "region_name"],
             [("work_order_count", "wo_count"), ("total_labor_hours", "labor_hrs"),
              ("total_parts_cost_usd", "parts_cost")], order_by=["wo_count DESC"], limit=30)
metric_query("g18_repair_duration", MW, ["priority", "outage_reason"],
             [("work_order_count", "wo_count"), ("avg_repair_duration_hours", "avg_repair_hrs"),
              ("avg_labor_hours", "avg_labor_hrs")],
             where="{outage_reason} IS NOT NULL", order_by=["avg_repair_hrs DESC"])

# ------------------------------------------------ the other dimensions
metric_query("y01_grid_dimensions", GO, ["asset_id", "manufacturer", "date", "quarter", "year"],
             ["anomaly_count", "outage_count", "alarm_count"])
metric_query("y02_fin_dimensions", FIN, ["date", "month", "year", "forced_outage_flag"],
             ["total_revenue_usd", "curtailment_loss_mwh"])
metric_query("y03_maint_dimensions", MW,
             ["technician_id", "asset_id", "asset_type", "site_name", "created_date", "created_month",
              "forced_outage_flag"], ["work_order_count", "total_labor_hours"])
metric_query("y04_exec_dimensions", EX, ["date", "month", "year", "profitability_band"],
             ["total_revenue_usd", "outage_count", "safety_incident_count"])
