"""Declared schemas of the 13 logical tables (DDL strings).

Used to build literal fixtures and to bind a deployment's own tables
(``Tables.from_frames``) with the expected column names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "regions": "region_id long, region_name string",
    "sites": ("site_id long, region_id long, site_name string, generation_type string, "
              "capacity_mw double, commission_date date"),
    "assets": ("asset_id long, site_id long, asset_tag string, asset_type string, "
               "manufacturer string, install_date date, expected_life_years int, "
               "criticality_score double"),
    "technicians": ("technician_id long, region_id long, technician_name string, "
                    "certification_level string"),
    "market_prices": "region_id long, timestamp timestamp_ntz, real_time_price_mwh double",
    "telemetry": ("telemetry_id long, asset_id long, timestamp timestamp_ntz, voltage double, "
                  "temperature double, vibration double, power_output_mw double, "
                  "efficiency_pct double, alarm_flag boolean"),
    "sensor_anomalies": ("anomaly_id long, asset_id long, timestamp timestamp_ntz, "
                         "anomaly_type string, severity_score double"),
    "outages": ("outage_id long, asset_id long, site_id long, outage_start_ts timestamp_ntz, "
                "outage_end_ts timestamp_ntz, outage_reason string, forced_outage_flag boolean, "
                "lost_generation_mwh double"),
    "maintenance_schedule": ("schedule_id long, asset_id long, planned_date date, "
                             "maintenance_type string, completed_flag boolean, overdue_flag boolean"),
    "work_orders": ("work_order_id long, asset_id long, technician_id long, outage_id long, "
                    "work_order_type string, priority string, created_ts timestamp_ntz, "
                    "completed_ts timestamp_ntz, labor_hours double, parts_cost_usd double, "
                    "status string"),
    "asset_financials": ("asset_id long, date date, revenue_usd double, opex_usd double, "
                         "maintenance_cost_usd double, curtailed_mwh double"),
    "power_sales": ("site_id long, timestamp timestamp_ntz, energy_sold_mwh double, "
                    "market_price double"),
    "safety_incidents": ("incident_id long, site_id long, technician_id long, "
                         "incident_ts timestamp_ntz, severity string, lost_time_flag boolean"),
}


def frame(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """A logical table from literal rows (tests, small lookups)."""
    return spark.createDataFrame(rows, SCHEMAS[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
