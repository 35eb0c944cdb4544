"""Registered derivations (d01-d15) and window rules (w02-w07)."""

from __future__ import annotations

import datetime as dt

from ..operators import derive as D
from ..operators import windows as W
from ..sources.bindings import load
from .oracle_sql import with_bindings
from .registry import register

# The rules clip to a calendar year: the one of the supplied events.
YEAR_START = dt.datetime(2024, 1, 1)
YEAR_END = dt.date(2024, 12, 31)
FIRST_DAY = YEAR_START.date()
HOURS_IN_YEAR = ((YEAR_END - FIRST_DAY).days + 1) * 24

_CAP = """SELECT s.site_id, GREATEST(1, COALESCE(n.n, 0)) AS n_assets,
  s.capacity_mw / GREATEST(1, COALESCE(n.n, 0)) AS asset_capacity_mw
  FROM sites s LEFT JOIN (SELECT site_id, COUNT(*) AS n FROM assets GROUP BY site_id) n
  ON s.site_id = n.site_id"""


@register("d01_alarm_flag", with_bindings("""
SELECT telemetry_id, asset_id, timestamp, (temperature > 70 OR vibration > 4) AS alarm_flag
FROM telemetry"""))
def d01(spark, d):
    return D.alarm_flag(load(spark, d).telemetry)


@register("d02_assets_per_site", with_bindings("SELECT * FROM cap", [("cap", _CAP)]))
def d02(spark, d):
    return D.assets_per_site(load(spark, d))


@register("d03_outage_duration_loss", with_bindings("""
SELECT o.outage_id,
  (floor(epoch(o.outage_end_ts)) - floor(epoch(o.outage_start_ts))) / CAST(3600 AS DOUBLE) AS duration_hours,
  (floor(epoch(o.outage_end_ts)) - floor(epoch(o.outage_start_ts))) / CAST(3600 AS DOUBLE)
    * c.asset_capacity_mw * CASE WHEN o.forced_outage_flag THEN 0.35 ELSE 0.30 END AS derived_lost_mwh
FROM outages o JOIN cap c ON o.site_id = c.site_id""", [("cap", _CAP)]))
def d03(spark, d):
    return D.outage_duration_loss(load(spark, d))


_LPD = """SELECT asset_id, d AS date, SUM(lost_generation_mwh / n) AS lost_mwh FROM (
  SELECT asset_id, lost_generation_mwh,
         CAST(unnest(generate_series(CAST(outage_start_ts AS DATE), CAST(outage_end_ts AS DATE),
                                     INTERVAL 1 DAY)) AS DATE) AS d,
         date_diff('day', CAST(outage_start_ts AS DATE), CAST(outage_end_ts AS DATE)) + 1 AS n
  FROM outages) GROUP BY asset_id, d"""


@register("d04_loss_per_day", with_bindings("SELECT * FROM lpd", [("lpd", _LPD)]))
def d04(spark, d):
    return D.loss_per_day(load(spark, d))


def _lph(y0, hours):
    return f"""SELECT site_id, h AS hour, SUM(lost_generation_mwh / n) AS lost_mwh FROM (
  SELECT site_id, lost_generation_mwh,
    unnest(generate_series(h0, h1 - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h,
    (floor(epoch(h1)) - floor(epoch(h0))) / CAST(3600 AS DOUBLE) AS n
  FROM (SELECT site_id, lost_generation_mwh,
          GREATEST(date_trunc('hour', outage_start_ts), TIMESTAMP '{y0}') AS h0,
          LEAST(date_trunc('hour', outage_end_ts), TIMESTAMP '{y0}' + to_hours({hours - 1})) AS h1
        FROM outages) WHERE h1 > h0) GROUP BY site_id, h"""


@register("d05_loss_per_hour", with_bindings(
    "SELECT * FROM lph", [("lph", _lph(YEAR_START, HOURS_IN_YEAR))]))
def d05(spark, d):
    return D.loss_per_hour(load(spark, d), YEAR_START, HOURS_IN_YEAR)


_CPD = """SELECT asset_id, CAST(created_ts AS DATE) AS date, SUM(parts_cost_usd) AS parts_cost_usd
  FROM work_orders GROUP BY asset_id, CAST(created_ts AS DATE)"""


@register("d06_cost_per_day", with_bindings("SELECT * FROM cpd", [("cpd", _CPD)]))
def d06(spark, d):
    return D.cost_per_day(load(spark, d))


_RDP = """SELECT region_id, CAST(timestamp AS DATE) AS date, ROUND(eavg(real_time_price_mwh), 9) AS avg_price
  FROM market_prices GROUP BY region_id, CAST(timestamp AS DATE)"""


@register("d07_asset_pnl", with_bindings(f"""
SELECT asset_id, date, gen AS gen_mwh, net AS net_gen_mwh, rev AS revenue_usd, opex AS opex_usd,
  maint AS maintenance_cost_usd,
  CASE WHEN rev > 0 THEN ROUND((rev - opex - maint) / rev * 100, 2) ELSE CAST(-100 AS DOUBLE) END
    AS profit_margin_pct,
  CASE WHEN avg_price < 30 THEN gen * CAST(0.075 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS curtailed_mwh
FROM (
  SELECT asset_id, date, gen, net, ROUND(net * avg_price, 2) AS rev, cap * 8 AS opex,
         ROUND(COALESCE(parts_cost_usd, 0), 2) AS maint, avg_price
  FROM (
    SELECT sp.asset_id, sp.date, sp.cap, p.avg_price, c.parts_cost_usd,
      sp.cap * 24 * CAST(0.30 AS DOUBLE) * COALESCE(e.eff, CAST(0.92 AS DOUBLE)) AS gen,
      GREATEST(CAST(0 AS DOUBLE), sp.cap * 24 * CAST(0.30 AS DOUBLE) * COALESCE(e.eff, CAST(0.92 AS DOUBLE))
               - COALESCE(l.lost_mwh, 0)) AS net
    FROM spine sp
    LEFT JOIN (SELECT asset_id, AVG(efficiency_pct) / 100 AS eff FROM telemetry GROUP BY asset_id) e
      ON sp.asset_id = e.asset_id
    LEFT JOIN lpd l ON sp.asset_id = l.asset_id AND sp.date = l.date
    LEFT JOIN rdp p ON sp.region_id = p.region_id AND sp.date = p.date
    LEFT JOIN cpd c ON sp.asset_id = c.asset_id AND sp.date = c.date))""", [
    ("cap", _CAP), ("lpd", _LPD), ("rdp", _RDP), ("cpd", _CPD),
    ("spine", f"""SELECT a.asset_id, s.region_id, c.asset_capacity_mw AS cap,
        CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{YEAR_END}', INTERVAL 1 DAY)) AS DATE) AS date
        FROM assets a JOIN sites s ON a.site_id = s.site_id JOIN cap c ON a.site_id = c.site_id""")]))
def d07(spark, d):
    return D.asset_pnl(load(spark, d), FIRST_DAY, YEAR_END)


@register("d08_curtailment", with_bindings(f"""
SELECT sp.asset_id, sp.date,
  CASE WHEN p.avg_price < 30 THEN sp.cap * 24 * CAST(0.30 AS DOUBLE) * COALESCE(e.eff, CAST(0.92 AS DOUBLE))
       * CAST(0.075 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS curtailed_mwh
FROM spine sp
LEFT JOIN (SELECT asset_id, AVG(efficiency_pct) / 100 AS eff FROM telemetry GROUP BY asset_id) e
  ON sp.asset_id = e.asset_id
LEFT JOIN rdp p ON sp.region_id = p.region_id AND sp.date = p.date""", [
    ("cap", _CAP), ("rdp", _RDP),
    ("spine", f"""SELECT a.asset_id, s.region_id, c.asset_capacity_mw AS cap,
        CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{YEAR_END}', INTERVAL 1 DAY)) AS DATE) AS date
        FROM assets a JOIN sites s ON a.site_id = s.site_id JOIN cap c ON a.site_id = c.site_id""")]))
def d08(spark, d):
    return D.asset_pnl(load(spark, d), FIRST_DAY, YEAR_END).select(
        "asset_id", "date", "curtailed_mwh")


@register("d09_power_sales", with_bindings(f"""
SELECT site_id, timestamp, ROUND(net, 3) AS energy_sold_mwh, ROUND(p, 2) AS market_price,
       ROUND(net * p, 2) AS total_revenue
FROM (SELECT sp.site_id, sp.timestamp,
        GREATEST(CAST(0 AS DOUBLE), sp.capacity_mw * (CASE
          WHEN sp.generation_type = 'solar' THEN GREATEST(0, sin(pi() * (hour(sp.timestamp) - 6) / 12)) * 0.85
          WHEN sp.generation_type = 'wind' THEN GREATEST(LEAST(0.35 + 0.15 * sin(2 * pi()
               * CAST(trunc((floor(epoch(sp.timestamp)) - floor(epoch(TIMESTAMP '{YEAR_START}'))) / 3600) AS BIGINT)
               / (24 * 7)), 1.0), 0.0)
          ELSE GREATEST(LEAST(0.4 + 0.3 * sin(2 * pi() * hour(sp.timestamp) / 24 * 2), 1.0), 0.0) END)
          - COALESCE(l.lost_mwh, 0)) AS net,
        COALESCE(mp.real_time_price_mwh, 0) AS p
      FROM spine sp
      LEFT JOIN lph l ON sp.site_id = l.site_id AND sp.timestamp = l.hour
      LEFT JOIN market_prices mp ON sp.region_id = mp.region_id AND sp.timestamp = mp.timestamp)""", [
    ("lph", _lph(YEAR_START, HOURS_IN_YEAR)),
    ("spine", f"""SELECT site_id, region_id, generation_type, capacity_mw,
        unnest(generate_series(TIMESTAMP '{YEAR_START}', TIMESTAMP '{YEAR_START}' + to_hours({HOURS_IN_YEAR - 1}),
                               INTERVAL 1 HOUR)) AS timestamp FROM sites""")]))
def d09(spark, d):
    return D.power_sales(load(spark, d), YEAR_START, HOURS_IN_YEAR)


@register("d10_region_day_price", with_bindings("SELECT * FROM rdp", [("rdp", _RDP)]))
def d10(spark, d):
    return D.region_day_price(load(spark, d))


@register("d11_work_order_class", with_bindings("SELECT * FROM work_orders"))
def d11(spark, d):
    t = load(spark, d)
    return D.work_orders_from_events(t.outages, t.maintenance_schedule)


@register("d12_overdue_flag", with_bindings(f"""
SELECT schedule_id, asset_id, planned_date, (NOT completed_flag AND planned_date < DATE '{YEAR_END}')
  AS overdue_flag FROM maintenance_schedule"""))
def d12(spark, d):
    return D.overdue_flag(load(spark, d).maintenance_schedule, YEAR_END)


@register("d13_dense_calendar", with_bindings("""
SELECT sp.asset_id, sp.date, COALESCE(dl.readings, 0) AS readings
FROM (SELECT asset_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT asset_id, MIN(CAST(timestamp AS DATE)) AS d0, MAX(CAST(timestamp AS DATE)) AS d1
            FROM telemetry GROUP BY asset_id)) sp
LEFT JOIN (SELECT asset_id, CAST(timestamp AS DATE) AS date, COUNT(*) AS readings
           FROM telemetry GROUP BY asset_id, CAST(timestamp AS DATE)) dl
  ON sp.asset_id = dl.asset_id AND sp.date = dl.date"""))
def d13(spark, d):
    return D.daily_spine(load(spark, d))


@register("d14_anomaly_probability", with_bindings("""
SELECT anomaly_id, 1 / (1 + exp(-((severity_score - 5) * 0.5))) AS predicted_failure_probability
FROM sensor_anomalies"""))
def d14(spark, d):
    return D.anomaly_probability(load(spark, d).sensor_anomalies)


@register("d15_lost_time_flag", with_bindings("""
SELECT incident_id, severity IN ('recordable', 'serious') AS lost_time_flag FROM safety_incidents"""))
def d15(spark, d):
    return D.lost_time_flag(load(spark, d).safety_incidents)


# ------------------------------------------------------------------ windows
@register("w02_first_time_fix_90d", with_bindings("""
SELECT COUNT(*) AS emergency_repairs,
       CAST(SUM(CASE WHEN refail THEN 0 ELSE 1 END) AS BIGINT) AS fixed_first_time,
       CAST(100 AS DOUBLE) * SUM(CASE WHEN refail THEN 0 ELSE 1 END) / COUNT(*) AS first_time_fix_pct
FROM (SELECT w.work_order_id, EXISTS (SELECT 1 FROM outages o WHERE o.asset_id = w.asset_id
        AND o.forced_outage_flag AND o.outage_start_ts > w.created_ts
        AND o.outage_start_ts <= w.created_ts + INTERVAL 90 DAY) AS refail
      FROM work_orders w WHERE w.work_order_type = 'emergency')"""))
def w02(spark, d):
    return W.first_time_fix(load(spark, d))


@register("w03_third_outage_escalation", with_bindings("""
SELECT asset_id, outage_id AS escalation_outage_id, outage_start_ts AS escalation_ts,
       CAST(CAST(outage_start_ts AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date,
       CAST(date_diff('day', CAST(window_first_ts AS DATE), CAST(outage_start_ts AS DATE)) AS INTEGER)
         AS days_to_escalation
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY outage_start_ts, outage_id) AS rk
      FROM (SELECT asset_id, outage_id, outage_start_ts,
              COUNT(*) OVER w AS n_trailing, MIN(outage_start_ts) OVER w AS window_first_ts
            FROM (SELECT *, floor(epoch(outage_start_ts)) AS ep FROM outages WHERE forced_outage_flag)
            WINDOW w AS (PARTITION BY asset_id ORDER BY ep RANGE BETWEEN 31536000 PRECEDING AND CURRENT ROW))
      WHERE n_trailing >= 3) WHERE rk = 1"""))
def w03(spark, d):
    return W.third_outage_escalation(load(spark, d))


@register("w04_trailing_12m_count", with_bindings("""
SELECT work_order_id, asset_id, created_ts, trailing_12m_count, trailing_12m_count >= 5 AS at_or_over_limit
FROM (SELECT work_order_id, asset_id, created_ts,
        COUNT(*) OVER (PARTITION BY asset_id ORDER BY floor(epoch(created_ts))
                       RANGE BETWEEN 31536000 PRECEDING AND CURRENT ROW) AS trailing_12m_count
      FROM work_orders WHERE work_order_type = 'emergency')"""))
def w04(spark, d):
    return W.trailing_deployments(load(spark, d))


@register("w05_sustained_72h", with_bindings("""
SELECT telemetry_id, asset_id, timestamp, window_min,
       (window_min >= 3.5 AND (floor(epoch(timestamp)) - floor(epoch(window_first_ts))) / CAST(3600 AS DOUBLE) >= 71)
         AS sustained
FROM (SELECT telemetry_id, asset_id, timestamp, MIN(vibration) OVER w AS window_min,
        MIN(timestamp) OVER w AS window_first_ts
      FROM (SELECT *, floor(epoch(timestamp)) AS ep FROM telemetry)
      WINDOW w AS (PARTITION BY asset_id ORDER BY ep RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW))"""))
def w05(spark, d):
    return W.sustained_exceedance(load(spark, d))


@register("w06_running_mean_24h", with_bindings("""
SELECT telemetry_id, asset_id, timestamp, vibration, AVG(vibration) OVER w AS running_mean,
       COUNT(*) OVER w AS n_readings
FROM (SELECT *, floor(epoch(timestamp)) AS ep FROM telemetry)
WINDOW w AS (PARTITION BY asset_id ORDER BY ep RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"""))
def w06(spark, d):
    return W.running_mean(load(spark, d))


@register("w07_consecutive_days", with_bindings("""
SELECT l.technician_id, l.longest_streak_days, w.weeks_over_limit, w.max_week_hours
FROM longest l JOIN weeks w ON l.technician_id = w.technician_id""", [
    ("days", """SELECT technician_id, CAST(created_ts AS DATE) AS day, SUM(labor_hours) AS hours
                FROM work_orders GROUP BY technician_id, CAST(created_ts AS DATE)"""),
    ("isl", """SELECT technician_id,
                 day - CAST(ROW_NUMBER() OVER (PARTITION BY technician_id ORDER BY day) AS INTEGER) AS grp
               FROM days"""),
    ("longest", """SELECT technician_id, MAX(n) AS longest_streak_days
               FROM (SELECT technician_id, grp, COUNT(*) AS n FROM isl GROUP BY technician_id, grp)
               GROUP BY technician_id"""),
    ("weeks", """SELECT technician_id, CAST(SUM(CASE WHEN wh > 60 THEN 1 ELSE 0 END) AS BIGINT) AS weeks_over_limit,
                 MAX(wh) AS max_week_hours
               FROM (SELECT technician_id, date_trunc('week', day) AS wk, SUM(hours) AS wh
                     FROM days GROUP BY technician_id, date_trunc('week', day))
               GROUP BY technician_id""")]))
def w07(spark, d):
    return W.workload_streaks(load(spark, d))


@register("f14_derived_tags", with_bindings("""
SELECT a.asset_id, printf('%s-%05d', upper(substr(a.asset_type, 1, 3)), a.asset_id) AS derived_tag,
       printf('%s-%s-%03d', r.region_name, upper(s.generation_type), s.site_id) AS site_label
FROM assets a JOIN sites s ON a.site_id = s.site_id JOIN regions r ON s.region_id = r.region_id"""))
def f14(spark, d):
    """Zero-padded asset tags and site labels derived from the dimensions."""
    from ..functions.scalars import asset_tag, site_label
    t = load(spark, d)
    s = t.sites.join(t.regions, "region_id")
    return (t.assets.join(s, "site_id")
            .select("asset_id", asset_tag("asset_type", "asset_id").alias("derived_tag"),
                    site_label("region_name", "generation_type", "site_id").alias("site_label")))


@register("r04m_merged_outages", with_bindings("""
SELECT asset_id, min(outage_start_ts) AS merged_start, max(outage_end_ts) AS merged_end,
       count(*) AS outages, sum(lost_generation_mwh) AS lost_mwh,
       (floor(epoch(max(outage_end_ts))) - floor(epoch(min(outage_start_ts)))) / 3600.0 AS downtime_hours
FROM (SELECT *, sum(IF(prev_end IS NULL OR outage_start_ts > prev_end, 1, 0))
                  OVER (PARTITION BY asset_id ORDER BY outage_start_ts, outage_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT *, max(outage_end_ts) OVER (PARTITION BY asset_id ORDER BY outage_start_ts, outage_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
            FROM outages))
GROUP BY asset_id, island"""))
def r04m(spark, d):
    """Overlapping outages of an asset merged into single intervals."""
    return W.merged_outages(load(spark, d))
