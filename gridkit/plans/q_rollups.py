"""Registered rollup queries r01-r09."""

from __future__ import annotations

from ..operators import rollups as R
from ..sources.bindings import load
from ..sources.raw import read_raw
from .oracle_sql import with_bindings
from .registry import register

# The daily tables as one declaration: stage, source, day, and its columns as
# (name, kind, expression, value on days without a row).  The oracle adds up the
# contributions of single rows: each source row is one row of the day's group.
MISSING, ZERO = None, "0"
STAGES = [
    ("_telemetry_daily", "telemetry", "timestamp", [
        ("avg_temperature", "avg", "temperature", MISSING), ("max_temperature", "max", "temperature", MISSING),
        ("avg_vibration", "avg", "vibration", MISSING), ("max_vibration", "max", "vibration", MISSING),
        ("avg_efficiency_pct", "avg", "efficiency_pct", MISSING),
        ("total_power_mwh", "day", "power_output_mw", MISSING), ("alarm_count", "rows", "alarm_flag", MISSING),
        ("voltage_stddev", "stddev_samp", "voltage", MISSING), ("has_telemetry", "some", "true", "false")]),
    ("_anomalies_daily", "sensor_anomalies", "timestamp", [
        ("anomaly_count", "rows", "true", ZERO), ("max_severity_score", "max", "severity_score", MISSING)]),
    ("_outages_daily", "outages", "outage_start_ts", [
        ("outage_count", "ids", "outage_id", ZERO),
        ("forced_outage_count", "ids", "CASE WHEN forced_outage_flag THEN outage_id END", ZERO),
        ("total_downtime_hours", "hours", "floor(epoch(outage_end_ts)) - floor(epoch(outage_start_ts))", ZERO),
        ("total_lost_mwh", "sum", "lost_generation_mwh", ZERO)]),
    ("_work_orders_daily", "work_orders", "created_ts", [
        ("work_order_count", "rows", "true", ZERO),
        *[(f"{k}_wo_count", "rows", f"work_order_type = '{k}'", ZERO)
          for k in ("emergency", "reactive", "preventive", "inspection")],
        ("total_labor_hours", "sum", "labor_hours", ZERO), ("total_parts_cost", "sum", "parts_cost_usd", ZERO)]),
    ("_maintenance_daily", "maintenance_schedule", "planned_date", [
        ("overdue_maintenance_count", "rows", "overdue_flag", ZERO), ("scheduled_count", "rows", "true", ZERO)]),
]
KINDS = {"rows": "count_if({})::BIGINT", "ids": "count(DISTINCT {})", "some": "bool_or({})",
         "day": "24 * avg({})", "hours": "sum({}) / 3600.0"}
RENAMED = {"total_parts_cost": "wo_total_parts_cost"}


def _aggregates(columns):
    return ", ".join(f"{KINDS.get(k, k + '({})').format(e)} AS {n}" for n, k, e, _ in columns)


def _stage_sql(source, day, columns):
    return (f"SELECT asset_id, CAST({day} AS DATE) AS date, {_aggregates(columns)} "
            f"FROM {source} GROUP BY asset_id, CAST({day} AS DATE)")


_CAP_SQL = """
SELECT asset_id, site_id, capacity_mw / nullif(count(*) OVER (PARTITION BY site_id), 0) AS asset_capacity_mw,
       asset_type IN ('wind_turbine', 'inverter', 'battery_unit') AS is_generation_asset
FROM assets JOIN (SELECT site_id, capacity_mw FROM sites) USING (site_id)"""
_SAFETY_SQL = """
SELECT region_id, CAST(incident_ts AS DATE) AS date, count(*) AS safety_incident_count,
       count_if(lost_time_flag)::BIGINT AS lost_time_incident_count
FROM safety_incidents JOIN sites USING (site_id) GROUP BY region_id, CAST(incident_ts AS DATE)"""

# The asset-day row: what the finance table gives, then each stage's columns.
_NET = "revenue_usd - opex_usd - maintenance_cost_usd"
_DAY_COLUMNS = [
    ("asset_capacity_mw", "asset_capacity_mw"), ("is_generation_asset", "is_generation_asset"),
    ("theoretical_max_daily_mwh", "CASE WHEN has_telemetry AND is_generation_asset THEN 24 * asset_capacity_mw END"),
    ("revenue_usd", "revenue_usd"), ("opex_usd", "opex_usd"),
    ("finance_maintenance_cost_usd", "maintenance_cost_usd"), ("curtailed_mwh", "curtailed_mwh"),
    ("net_profit_usd", _NET),
    ("profit_margin_pct", f"CAST(CASE WHEN revenue_usd > 0 THEN CAST(100 AS DOUBLE) * ({_NET}) / revenue_usd "
                          "ELSE -100 END AS DOUBLE)"),
    *[(RENAMED.get(n, n), n if missing is None else f"coalesce({n}, {missing})")
      for _, _, _, columns in STAGES for n, _, _, missing in columns],
]
_ADS_SQL = ("SELECT asset_id, date, " + ", ".join(f"{e} AS {n}" for n, e in _DAY_COLUMNS)
            + " FROM asset_financials JOIN (SELECT asset_id, asset_capacity_mw, is_generation_asset "
              "FROM _asset_cap) USING (asset_id) "
            + " ".join(f"LEFT JOIN {n} USING (asset_id, date)" for n, _, _, _ in STAGES))

STAGE_CTES = [("_asset_cap", _CAP_SQL), *[(n, _stage_sql(*rest)) for n, *rest in STAGES],
              ("_safety_daily_region", _SAFETY_SQL)]
ADS_CTES = STAGE_CTES + [("asset_daily_summary", _ADS_SQL)]


def _region_aggregate(column, fn, name):
    whole = "::BIGINT" if column.endswith("_count") else ""
    return f"{fn.__name__}({column}){whole} AS {name}"


# From the same list of (column, aggregate, name) as the rollup itself.
_RDS_SQL = f"""
SELECT * REPLACE (coalesce(safety_incident_count, 0) AS safety_incident_count,
                  coalesce(lost_time_incident_count, 0) AS lost_time_incident_count)
FROM (SELECT region_id, region_name, generation_type, date,
             {", ".join(_region_aggregate(*a) for a in R.REGION_AGGREGATES)}
      FROM asset_daily_summary JOIN (SELECT asset_id, region_id, region_name, generation_type FROM assets
        JOIN sites USING (site_id) JOIN regions USING (region_id)) USING (asset_id)
      GROUP BY region_id, region_name, generation_type, date)
LEFT JOIN _safety_daily_region USING (region_id, date)"""

RDS_CTES = ADS_CTES + [("region_daily_summary", _RDS_SQL)]


def _stage(name):
    return with_bindings(f"SELECT * FROM {name}", STAGE_CTES)


@register("r01_asset_capacity", _stage("_asset_cap"))
def r01(spark, sf_dir):
    return R.asset_capacity(load(spark, sf_dir))


@register("r02_telemetry_daily", _stage("_telemetry_daily"))
def r02(spark, sf_dir):
    return R.telemetry_daily(load(spark, sf_dir))


@register("r03_anomalies_daily", _stage("_anomalies_daily"))
def r03(spark, sf_dir):
    return R.anomalies_daily(load(spark, sf_dir))


@register("r04_outages_daily", _stage("_outages_daily"))
def r04(spark, sf_dir):
    return R.outages_daily(load(spark, sf_dir))


@register("r05_work_orders_daily", _stage("_work_orders_daily"))
def r05(spark, sf_dir):
    return R.work_orders_daily(load(spark, sf_dir))


@register("r06_maintenance_daily", _stage("_maintenance_daily"))
def r06(spark, sf_dir):
    return R.maintenance_daily(load(spark, sf_dir))


@register("r07_safety_daily_region", _stage("_safety_daily_region"))
def r07(spark, sf_dir):
    return R.safety_daily_region(load(spark, sf_dir))


@register("r08_asset_daily_summary", with_bindings("SELECT * FROM asset_daily_summary", ADS_CTES))
def r08(spark, sf_dir):
    return R.asset_daily_summary(load(spark, sf_dir))


@register("r09_region_daily_summary", with_bindings("SELECT * FROM region_daily_summary", RDS_CTES))
def r09(spark, sf_dir):
    return R.region_daily_summary(load(spark, sf_dir))


@register("r09b_region_daily_safety_dedup", with_bindings("""
SELECT region_id, generation_type, date, safety_incident_count AS as_written_incidents,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY region_id, date ORDER BY generation_type) = 1
       THEN safety_incident_count ELSE 0 END AS dedup_incidents
FROM region_daily_summary""", RDS_CTES))
def r09b(spark, sf_dir):
    """Q1: the as-written safety count next to the de-duplicated one."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rds = R.region_daily_summary(load(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("region_id", "date")
                                .orderBy("generation_type")) == 1
    return rds.select(
        "region_id", "generation_type", "date",
        F.col("safety_incident_count").alias("as_written_incidents"),
        F.when(first, F.col("safety_incident_count")).otherwise(F.lit(0).cast("long"))
         .alias("dedup_incidents"))


# ------------------------------------------------------ rollups that follow new data
def _appended(spark, sf_dir):
    """A store filled before the last day and the late purchases of a day before came
    in, then refreshed with them: ``(store, what each refresh computed)``."""
    import uuid
    from functools import partial

    from pyspark.sql import functions as F

    from ..operators.rollup_store import RollupStore
    from ..session import scratch_path
    from ..sources import bindings as B

    lake = scratch_path(spark, f"lake-{uuid.uuid4().hex[:10]}")
    for name in B.SOURCES:
        if name != B.FACT_SOURCE:
            read_raw(spark, sf_dir, name).write.parquet(f"{lake}/{name}.parquet")
    events = read_raw(spark, sf_dir, B.FACT_SOURCE)
    last = events.agg(F.to_date(F.max("ts")).alias("day")).first()["day"]
    day = F.to_date("ts")
    late = (day == F.lit(last)) | ((day == F.date_sub(F.lit(last), 10)) & (F.col("event_type") == "purchase"))
    store, done = RollupStore(spark, f"{lake}-rollups"), []
    for rows in (events.where(~F.coalesce(late, F.lit(False))), events.where(late)):
        rows.write.mode("append").parquet(f"{lake}/{B.FACT_SOURCE}.parquet")
        done.append(store.refresh(load(spark, lake), B.source_files(spark, lake), partial(B.load_files, spark, lake)))
    return store, done


@register("r08_incremental_asset_days", with_bindings("SELECT * FROM asset_daily_summary", ADS_CTES))
def r08_incremental(spark, d):
    """The asset-day table after an appended day and late rows: only their days are computed."""
    return _appended(spark, d)[0].asset_day()


@register("r09_incremental_region_days", with_bindings("SELECT * FROM region_daily_summary", RDS_CTES))
def r09_incremental(spark, d):
    """The region-day table after an appended day and late rows."""
    return _appended(spark, d)[0].region_day()
