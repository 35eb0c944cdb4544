"""Deterministic derivations (d01-d15) a utility runs on its own tables.

Interval allocations (d04, d05) are difference arrays (``intervals.spread``): a rate
is added at an outage's first day or hour and taken back after its last, so what is
shuffled follows the number of outages and not their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (add_hours, case_ladder, dbl, epoch_seconds, exact_avg, hours_between, rnd,
                                 round_double, sigmoid, trunc_ts)
from .intervals import spread

def _memo(fn):
    """Cache a derivation per bound Tables object."""
    import functools

    @functools.wraps(fn)
    def run(tables, *args, **kw):
        if args or kw or not hasattr(tables, "memo"):
            return fn(tables, *args, **kw)
        return tables.memo((fn.__name__,), lambda: fn(tables))
    return run


# Fixed values of the derivation rules.
FORCED_LOSS_FACTOR = 0.35
PLANNED_LOSS_FACTOR = 0.30
EMERGENCY_MIN_HOURS = 24
BASE_CAPACITY_FACTOR = 0.30
CURTAILMENT_PRICE_CEILING = 30.0
CURTAILED_SHARE = 0.075
DEFAULT_EFFICIENCY = 0.92
OPEX_PER_MW_DAY = 8
SOLAR_PEAK, SOLAR_SUNRISE, SOLAR_DAYLIGHT_HOURS = 0.85, 6, 12
WIND_MEAN, WIND_SWING, WIND_PERIOD_HOURS = 0.35, 0.15, 24 * 7
BATTERY_MEAN, BATTERY_SWING = 0.4, 0.3
ALARM_TEMPERATURE = 70.0
ALARM_VIBRATION = 4.0
LOST_TIME_SEVERITIES = ("recordable", "serious")


def classify_work_order(forced: F.Column, start: F.Column, end: F.Column):
    """d11: (type, priority) of an outage-driven work order: planned ->
    preventive/P3, forced and longer than 24 h -> emergency/P1, other
    forced -> reactive/P2."""
    long_outage = end > add_hours(start, EMERGENCY_MIN_HOURS)
    wtype = case_ladder([(~forced, "preventive"), (long_outage, "emergency")], "reactive")
    prio = case_ladder([(~forced, "P3"), (long_outage, "P1")], "P2")
    return wtype, prio


def work_orders_from_events(outages: DataFrame, schedule: DataFrame) -> DataFrame:
    """d11 + u02: outage-driven work orders UNION ALL schedule-driven ones.

    Forced outages longer than 24 h -> emergency/P1, other forced ->
    reactive/P2, planned -> preventive/P3 with no outage link; completed
    schedule items -> inspection/P4 or preventive/P3.  The id, technician,
    time offsets, labour, parts and status columns follow the data binding's
    fixed rule (ids, ``% 10`` technicians, +created/+completed hours).
    """
    o = outages
    forced = F.col("forced_outage_flag")
    wtype, prio = classify_work_order(forced, F.col("outage_start_ts"), F.col("outage_end_ts"))
    m20 = F.col("outage_id") % 20
    from_outages = o.select(
        (F.col("outage_id") * 2).alias("work_order_id"),
        "asset_id",
        (F.col("outage_id") % 10).alias("technician_id"),
        F.when(forced, F.col("outage_id")).alias("outage_id"),
        wtype.alias("work_order_type"),
        prio.alias("priority"),
        add_hours("outage_start_ts", F.col("outage_id") % 4).alias("created_ts"),
        add_hours("outage_end_ts", 4).alias("completed_ts"),
        (F.col("lost_generation_mwh") / 10).alias("labor_hours"),
        (F.col("lost_generation_mwh") * 100).alias("parts_cost_usd"),
        case_ladder([(m20 < 17, "completed"), (m20 < 19, "in_progress")],
                    "cancelled").alias("status"))
    m = schedule.filter(F.col("completed_flag"))
    insp = F.col("maintenance_type").contains("inspection")
    planned = F.col("planned_date").cast("timestamp_ntz")
    from_schedule = m.select(
        (F.col("schedule_id") * 2 + 1).alias("work_order_id"),
        "asset_id",
        (F.col("schedule_id") % 10).alias("technician_id"),
        F.lit(None).cast("long").alias("outage_id"),
        F.when(insp, F.lit("inspection")).otherwise(F.lit("preventive")).alias("work_order_type"),
        F.when(insp, F.lit("P4")).otherwise(F.lit("P3")).alias("priority"),
        planned.alias("created_ts"),
        add_hours(planned, 8).alias("completed_ts"),
        dbl(6).alias("labor_hours"),
        dbl(500).alias("parts_cost_usd"),
        F.lit("completed").alias("status"))
    return from_outages.unionByName(from_schedule)


# ------------------------------------------------------------------ d01-d15
def alarm_flag(telemetry: DataFrame) -> DataFrame:
    """d01: ``temperature > 70 OR vibration > 4`` per reading."""
    return telemetry.select(
        "telemetry_id", "asset_id", "timestamp",
        ((F.col("temperature") > ALARM_TEMPERATURE) | (F.col("vibration") > ALARM_VIBRATION))
        .alias("alarm_flag"))


@_memo
def assets_per_site(tables) -> DataFrame:
    """d02: assets per site (at least 1) and the capacity slice per asset."""
    n = tables["assets"].groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    s = tables["sites"].select("site_id", "capacity_mw")
    j = s.join(n, "site_id", "left")
    n_assets = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("n"), F.lit(0).cast("long")))
    return j.select("site_id", n_assets.alias("n_assets"),
                    (F.col("capacity_mw") / n_assets).alias("asset_capacity_mw"))


def outage_duration_loss(tables) -> DataFrame:
    """d03: lost MWh = duration h x capacity slice x 0.35 (forced) / 0.30 (planned)."""
    o = tables["outages"].select("outage_id", "site_id", "outage_start_ts", "outage_end_ts",
                                 "forced_outage_flag")
    cap = assets_per_site(tables).select("site_id", "asset_capacity_mw")
    dur = hours_between("outage_start_ts", "outage_end_ts")
    factor = F.when(F.col("forced_outage_flag"), dbl(FORCED_LOSS_FACTOR)) \
              .otherwise(dbl(PLANNED_LOSS_FACTOR))
    return (o.join(cap, "site_id")
             .select("outage_id", dur.alias("duration_hours"),
                     (dur * F.col("asset_capacity_mw") * factor).alias("derived_lost_mwh")))


@_memo
def loss_per_day(tables) -> DataFrame:
    """d04: each outage's loss spread evenly over its start..end days
    (inclusive), summed per asset-day."""
    day = lambda ts: F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    lost = spread(tables["outages"], ["asset_id"], day("outage_start_ts"), day("outage_end_ts") + 1,
                  "lost_generation_mwh")
    return lost.select("asset_id", F.date_from_unix_date(F.col("step").cast("int")).alias("date"),
                       F.col("total").alias("lost_mwh"))


def loss_per_hour(tables, year_start, hours_in_year: int) -> DataFrame:
    """d05: each outage's loss spread over its whole hours [start, end)
    clipped to the year, empty spans dropped, summed per site-hour."""
    o = tables["outages"]
    y0 = F.lit(year_start).cast("timestamp_ntz")
    ylast = add_hours(y0, hours_in_year - 1)
    hours = lambda ts: F.floor(epoch_seconds(ts) / 3600)
    h0 = F.greatest(trunc_ts("HOUR", "outage_start_ts"), y0)
    h1 = F.least(trunc_ts("HOUR", "outage_end_ts"), ylast)
    lost = spread(o, ["site_id"], hours(h0), hours(h1), "lost_generation_mwh", chunk=168)
    return lost.select("site_id", F.timestamp_seconds(F.col("step") * 3600).cast("timestamp_ntz").alias("hour"),
                       F.col("total").alias("lost_mwh"))


@_memo
def cost_per_day(tables) -> DataFrame:
    """d06: work-order parts cost per asset and created day."""
    w = tables["work_orders"]
    return (w.groupBy("asset_id", F.to_date("created_ts").alias("date"))
             .agg(F.sum("parts_cost_usd").alias("parts_cost_usd")))


@_memo
def region_day_price(tables) -> DataFrame:
    """d10: mean of the hourly prices per region-day."""
    mp = tables["market_prices"]
    # prices are reported to 1e-9: both engines then agree bit for bit
    return (mp.groupBy("region_id", F.to_date("timestamp").alias("date"))
              .agg(rnd(exact_avg("real_time_price_mwh"), 9).alias("avg_price")))


def asset_pnl(tables, start_date, end_date, curtail_share: float = CURTAILED_SHARE,
              default_efficiency: float = DEFAULT_EFFICIENCY) -> DataFrame:
    """d07 + d08: per asset-day generation, revenue, opex, maintenance, margin.

    gen = capacity slice x 24 x 0.30 x efficiency (asset's mean telemetry
    efficiency, else the default), net = max(0, gen - d04 loss), revenue =
    net x region-day price (d10), opex = capacity slice x 8, maintenance =
    d06 cost, margin = 100 (rev - opex - maint) / rev or -100 when revenue
    <= 0; curtailment = share x gen only on days priced under 30.

    An asset's losses and costs are gathered as maps by day, and a region's prices as
    an array of the days: at most one entry per day of the calendar.  These meet the
    assets, and only then is a row's day generated (``posexplode(sequence)``), so the
    asset x day rows are neither shuffled nor sorted.
    """
    first, last = (F.lit(d).cast("date") for d in (start_date, end_date))

    def by_day(df, key, value, name):
        return (df.where(F.col(key).isNotNull() & F.col("date").between(first, last)).groupBy(key)
                  .agg(F.map_from_entries(F.collect_list(F.struct("date", value))).alias(name)))

    a = tables["assets"].select("asset_id", "site_id")
    sites = tables["sites"].select("site_id", "region_id")
    cap = assets_per_site(tables).select("site_id", "asset_capacity_mw")
    eff = (tables["telemetry"].groupBy("asset_id")
           .agg((F.avg("efficiency_pct") / 100).alias("eff")))
    prices = by_day(region_day_price(tables), "region_id", "avg_price", "prices").select(
        "region_id", F.transform(F.sequence(first, last), lambda d: F.try_element_at("prices", d)).alias("prices"))
    held = (a.join(sites, "site_id").join(cap, "site_id")
             .join(eff, "asset_id", "left")
             .join(by_day(loss_per_day(tables), "asset_id", "lost_mwh", "losses"), "asset_id", "left")
             .join(by_day(cost_per_day(tables), "asset_id", "parts_cost_usd", "costs"), "asset_id", "left")
             .join(prices, "region_id", "left"))
    j = (held.select("*", F.posexplode(F.sequence(first, last)).alias("day", "date"))
             .select("asset_id", "date", "asset_capacity_mw", "eff", F.get("prices", F.col("day")).alias("avg_price"),
                     F.try_element_at("losses", F.col("date")).alias("lost_mwh"),
                     F.try_element_at("costs", F.col("date")).alias("parts_cost_usd")))
    # one projection per step, so that no branch computes a rounded value again
    capc = F.col("asset_capacity_mw")
    gen = capc * 24 * dbl(BASE_CAPACITY_FACTOR) * F.coalesce("eff", dbl(default_efficiency))
    j = j.select("asset_id", "date", "avg_price", "lost_mwh", gen.alias("gen_mwh"),
                 (capc * OPEX_PER_MW_DAY).alias("opex_usd"),
                 round_double(F.coalesce("parts_cost_usd", dbl(0)), 2).alias("maintenance_cost_usd"))
    net = F.greatest(dbl(0), F.col("gen_mwh") - F.coalesce("lost_mwh", dbl(0)))
    curtailed = F.when(F.col("avg_price") < CURTAILMENT_PRICE_CEILING,
                       F.col("gen_mwh") * dbl(curtail_share)).otherwise(dbl(0))
    j = j.withColumns({"net_gen_mwh": net, "curtailed_mwh": curtailed})
    j = j.withColumn("revenue_usd", round_double(F.col("net_gen_mwh") * F.col("avg_price"), 2))
    rev = F.col("revenue_usd")
    share = (rev - F.col("opex_usd") - F.col("maintenance_cost_usd")) / rev * 100
    margin = F.when(rev > 0, round_double(share, 2)).otherwise(dbl(-100))
    return j.select("asset_id", "date", "gen_mwh", "net_gen_mwh", "revenue_usd", "opex_usd",
                    "maintenance_cost_usd", margin.alias("profit_margin_pct"), "curtailed_mwh")


def capacity_factor_by_hour(gen_type: F.Column, ts: F.Column, y0: F.Column) -> F.Column:
    """Hourly capacity factor profile per generation type (d09)."""
    hour = F.hour(ts)
    h_idx = ((F.unix_timestamp(ts) - F.unix_timestamp(y0)) / 3600).cast("long")
    pi = F.lit(3.141592653589793)
    solar = F.greatest(dbl(0), F.sin(pi * (hour - SOLAR_SUNRISE) / SOLAR_DAYLIGHT_HOURS)) * dbl(SOLAR_PEAK)
    wind = clip_col(dbl(WIND_MEAN) + dbl(WIND_SWING) * F.sin(2 * pi * h_idx / WIND_PERIOD_HOURS), 0.0, 1.0)
    battery = clip_col(dbl(BATTERY_MEAN) + dbl(BATTERY_SWING) * F.sin(2 * pi * hour / 24 * 2), 0.0, 1.0)
    return (F.when(gen_type == "solar", solar).when(gen_type == "wind", wind)
             .otherwise(battery))


def clip_col(x, lo, hi):
    return F.greatest(F.least(x, dbl(hi)), dbl(lo))


def power_sales(tables, year_start, hours_in_year: int) -> DataFrame:
    """d09: site x hour sales: net = max(0, capacity x cf - d05 loss),
    revenue = net x region price of that hour (0 when unpriced)."""
    s = tables["sites"].select("site_id", "region_id", "generation_type", "capacity_mw")
    y0 = F.lit(year_start).cast("timestamp_ntz")
    spine = s.select("*", F.explode(F.sequence(y0, add_hours(y0, hours_in_year - 1),
                                               F.expr("INTERVAL 1 HOUR"))).alias("timestamp"))
    loss = loss_per_hour(tables, year_start, hours_in_year).withColumnRenamed("hour", "timestamp")
    price = tables["market_prices"].select("region_id", "timestamp", "real_time_price_mwh")
    j = (spine.join(loss, ["site_id", "timestamp"], "left")
              .join(price, ["region_id", "timestamp"], "left"))
    gen = F.col("capacity_mw") * capacity_factor_by_hour(F.col("generation_type"),
                                                         F.col("timestamp"), y0)
    net = F.greatest(dbl(0), gen - F.coalesce("lost_mwh", dbl(0)))
    p = F.coalesce("real_time_price_mwh", dbl(0))
    return j.select("site_id", "timestamp", rnd(net, 3).alias("energy_sold_mwh"),
                    rnd(p, 2).alias("market_price"),
                    rnd(net * p, 2).alias("total_revenue"))


def overdue_flag(schedule: DataFrame, year_end) -> DataFrame:
    """d12: not completed and planned before the year end."""
    return schedule.select(
        "schedule_id", "asset_id", "planned_date",
        ((~F.col("completed_flag")) & (F.col("planned_date") < F.lit(year_end).cast("date")))
        .alias("overdue_flag"))


def daily_spine(tables) -> DataFrame:
    """d13: dense per-asset daily calendar between each asset's first and
    last telemetry day, with the readings count (0 on gap days)."""
    t = tables["telemetry"].select("asset_id", F.to_date("timestamp").alias("date"))
    daily = t.groupBy("asset_id", "date").agg(F.count(F.lit(1)).alias("readings"))
    bounds = daily.groupBy("asset_id").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    spine = bounds.select("asset_id", F.explode(F.sequence("d0", "d1")).alias("date"))
    return (spine.join(daily, ["asset_id", "date"], "left")
                 .select("asset_id", "date",
                         F.coalesce("readings", F.lit(0).cast("long")).alias("readings")))


def anomaly_probability(anomalies: DataFrame) -> DataFrame:
    """d14: failure probability = sigmoid((severity - 5) x 0.5)."""
    return anomalies.select("anomaly_id", sigmoid((F.col("severity_score") - 5) * dbl(0.5))
                            .alias("predicted_failure_probability"))


def lost_time_flag(incidents: DataFrame) -> DataFrame:
    """d15: lost-time incident = severity recordable or serious."""
    return incidents.select("incident_id", F.col("severity").isin(*LOST_TIME_SEVERITIES)
                            .alias("lost_time_flag"))
