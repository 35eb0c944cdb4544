"""Analyst queries over the logical tables (q01-q12, n01-n08, g06/g10/g12/g15-g17).

General shape: facts are filtered and aggregated *per entity key* before
they meet dimension rows, so the large side shrinks to one row per key
before any join, and the dimension lookup (asset -> site -> region) runs on
the aggregate.  Fan-out joins used in the original statements for
``COUNT(DISTINCT)`` (anomalies x outages per asset) are replaced by one
pre-aggregate per side, which gives the same numbers without producing
all pairs inside an asset.  Top-k reports keep their limit (it is the
feature) and carry a unique tie-break key so the cut is deterministic.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (EXACT, case_ladder, count_if, dbl, epoch_seconds, exact_avg, exact_sum,
                                 hours_between, rnd, safe_div, sum_if, trunc_ts)
from ..operators.joins import asset_dims, window_after_join
from ..operators.rollups import financial_spine
from ..operators.windows import cumulative_sums, micros, trailing_on

# Region filters of the original reports, and report constants.
PRICE_REPORT_REGIONS = ("CAISO", "ERCOT", "NYISO")
HOURLY_PRICE_REGION = "CAISO"
FOCUS_REGION = "NW-PowerPool"
EST_PRICE_PER_MWH = 60
CAUSAL_WINDOW_HOURS = 48
BIG_OUTAGE_MWH = 200
REACTIVE_TYPES = ("emergency", "reactive")


def _forced(tables) -> DataFrame:
    return tables["outages"].filter(F.col("forced_outage_flag"))


# ---------------------------------------------------------------- q01-q12
def asset_mix(tables) -> DataFrame:
    """q01: assets by type with average criticality."""
    return (tables["assets"].groupBy("asset_type")
            .agg(F.count(F.lit(1)).alias("n"),
                 rnd(exact_avg("criticality_score"), 2).alias("avg_crit"))
            .orderBy(F.desc("n"), "asset_type"))


def site_mix(tables) -> DataFrame:
    """q02: sites per region x generation type with total MW."""
    s = tables["sites"].join(tables["regions"], "region_id")
    return (s.groupBy("region_name", "generation_type")
             .agg(F.count(F.lit(1)).alias("n_sites"),
                  rnd(exact_sum("capacity_mw"), 0).alias("total_mw"))
            .orderBy("region_name", "generation_type"))


def price_by_month(tables, regions: Sequence[str] = PRICE_REPORT_REGIONS) -> DataFrame:
    """q03: monthly average real-time price for some regions."""
    r = tables["regions"].filter(F.col("region_name").isin(*regions))
    mp = tables["market_prices"].join(r, "region_id")
    return (mp.groupBy("region_name", F.month("timestamp").alias("month"))
              .agg(rnd(exact_avg("real_time_price_mwh"), 2).alias("avg_price"))
            .orderBy("region_name", "month"))


def price_by_hour(tables, region: str = HOURLY_PRICE_REGION) -> DataFrame:
    """q04: hour-of-day average price for one region."""
    r = tables["regions"].filter(F.col("region_name") == region)
    mp = tables["market_prices"].join(r, "region_id")
    return (mp.groupBy(F.hour("timestamp").alias("hour"))
              .agg(rnd(exact_avg("real_time_price_mwh"), 2).alias("avg_price"))
            .orderBy("hour"))


def anomaly_outage_buckets(tables) -> DataFrame:
    """q05: assets bucketed by anomaly count vs average forced outages."""
    an = (tables["sensor_anomalies"].groupBy("asset_id")
          .agg(F.countDistinct("anomaly_id").alias("anomalies")))
    fo = (_forced(tables).groupBy("asset_id")
          .agg(F.countDistinct("outage_id").alias("outages")))
    per_asset = (tables["assets"].select("asset_id")
                 .join(an, "asset_id", "left").join(fo, "asset_id", "left")
                 .select("asset_id",
                         F.coalesce("anomalies", F.lit(0).cast("long")).alias("anomalies"),
                         F.coalesce("outages", F.lit(0).cast("long")).alias("outages")))
    a = F.col("anomalies")
    bucket = case_ladder([(a == 0, "0"), (a <= 2, "1-2"), (a <= 5, "3-5"),
                          (a <= 15, "6-15")], "16+")
    return (per_asset.groupBy(bucket.alias("anomaly_bucket"))
            .agg(F.count(F.lit(1)).alias("n_assets"),
                 rnd(exact_avg("outages"), 2).alias("avg_forced_outages"))
            .orderBy("anomaly_bucket"))


def loss_by_reason(tables) -> DataFrame:
    """q06: outage count and lost generation by reason."""
    return (tables["outages"].groupBy("outage_reason")
            .agg(F.count(F.lit(1)).alias("n_outages"),
                 rnd(exact_avg("lost_generation_mwh"), 1).alias("avg_lost_mwh"),
                 rnd(exact_sum("lost_generation_mwh"), 0).alias("total_lost_mwh"))
            .orderBy(F.desc("total_lost_mwh"), "outage_reason"))


def wo_linkage(tables) -> DataFrame:
    """q07: work-order type stats and share linked to an outage."""
    return (tables["work_orders"].groupBy("work_order_type")
            .agg(F.count(F.lit(1)).alias("n"),
                 rnd(exact_avg("labor_hours"), 1).alias("avg_labor"),
                 rnd(exact_avg("parts_cost_usd"), 0).alias("avg_parts_cost"),
                 rnd(dbl(100) * sum_if(F.col("outage_id").isNotNull())
                         / F.count(F.lit(1)), 1).alias("pct_with_outage_link"))
            .orderBy(F.desc("n"), "work_order_type"))


def outage_price_impact(tables) -> DataFrame:
    """q08: average market price while each outage lasted -> price bucket."""
    o = tables["outages"].select("outage_id", "asset_id", "outage_start_ts",
                                 "outage_end_ts", "lost_generation_mwh")
    oh = o.join(asset_dims(tables, ["region_id"]), "asset_id")
    # the prices from one time to another are the difference of two running sums
    # of the region; a bound comes before the prices of its own time
    ends = F.explode(F.array(
        F.struct(trunc_ts("HOUR", "outage_start_ts").alias("ts"), F.lit(-1).alias("sign")),
        F.struct(F.col("outage_end_ts").alias("ts"), F.lit(1).alias("sign"))))
    bounds = oh.select("region_id", "outage_id", "lost_generation_mwh", ends.alias("b")).select(
        "region_id", "outage_id", "lost_generation_mwh", micros("b.ts").alias("_e"), "b.sign")
    prices = tables["market_prices"].select(
        "region_id", micros("timestamp").alias("_e"), F.lit(0).alias("sign"),
        F.col("real_time_price_mwh").cast(EXACT).alias("_price"),
        F.col("real_time_price_mwh").isNotNull().cast("long").alias("_n"))
    both = bounds.unionByName(prices, allowMissingColumns=True).withColumns({
        "_price": F.coalesce("_price", F.lit(0).cast(EXACT)), "_n": F.coalesce("_n", F.lit(0))})
    run = cumulative_sums(both, "region_id", "_e", ["_e", F.abs("sign").desc(), "outage_id", "sign"],
                          {"_sum": "_price", "_count": "_n"}, chunk_s=86400 * 1_000_000)
    n = F.sum(F.col("sign") * F.col("_count"))
    pao = (run.filter("sign <> 0").groupBy("outage_id", "lost_generation_mwh")
              .agg((F.sum(F.col("sign") * F.col("_sum")).cast("double")
                    / F.when(n > 0, n)).alias("avg_price_during"))
              .filter(F.col("avg_price_during").isNotNull()))
    p = F.col("avg_price_during")
    bucket = case_ladder([(p < 35, "low (<$35)"), (p < 50, "mid ($35-50)"),
                          (p < 65, "high ($50-65)")], "peak ($65+)")
    loss = F.col("lost_generation_mwh") * p
    return (pao.groupBy(bucket.alias("price_bucket"))
               .agg(F.count(F.lit(1)).alias("n_outages"),
                    rnd(exact_avg("lost_generation_mwh"), 1).alias("avg_lost_mwh"),
                    rnd(exact_avg(loss), 0).alias("avg_revenue_loss_usd"),
                    rnd(exact_sum(loss), 0).alias("total_revenue_loss_usd"))
            .orderBy(F.desc("total_revenue_loss_usd"), "price_bucket"))


def age_vs_financials(tables, as_of: _dt.date) -> DataFrame:
    """q09: asset age bucket vs margin, revenue and maintenance cost."""
    a = tables["assets"].select("asset_id", "install_date")
    f = financial_spine(tables).select("asset_id", "profit_margin_pct", "revenue_usd",
                                       "maintenance_cost_usd")
    age = F.datediff(F.lit(as_of), F.col("install_date")) / 365
    bucket = case_ladder([(age < 5, "<5y"), (age < 10, "5-10y"), (age < 15, "10-15y")], "15y+")
    return (a.join(f, "asset_id").groupBy(bucket.alias("age_bucket"))
             .agg(F.countDistinct("asset_id").alias("n_assets"),
                  rnd(exact_avg("profit_margin_pct"), 1).alias("avg_margin"),
                  rnd(exact_avg("revenue_usd"), 0).alias("avg_daily_rev"),
                  rnd(exact_avg("maintenance_cost_usd"), 0).alias("avg_daily_maint"))
            .orderBy("age_bucket"))


def causal_chain(tables, window_hours: int = CAUSAL_WINDOW_HOURS, k: int = 15) -> DataFrame:
    """q10: anomaly -> forced outage within the window -> work order, top k."""
    an = tables["sensor_anomalies"].select(
        "anomaly_id", "asset_id", F.col("timestamp").alias("anom_ts"), "severity_score")
    wo = tables["work_orders"].filter(F.col("outage_id").isNotNull()).select(
        "outage_id", "work_order_id", "work_order_type", "created_ts")
    fo = (_forced(tables).select("outage_id", "asset_id", "outage_start_ts")
          .join(wo.select("outage_id"), "outage_id", "left_semi"))
    # the k first anomalies that any such outage follows hold the k first rows:
    # only these are paired
    both = an.select("asset_id", micros("anom_ts").alias("_at"), "anomaly_id", "severity_score").unionByName(
        fo.select("asset_id", micros("outage_start_ts").alias("_at")), allowMissingColumns=True)
    hit = trailing_on(both, "asset_id", -F.col("_at"), window_hours * 3_600_000_000,
                      {"_next": ("min", F.when(F.col("anomaly_id").isNull(), F.col("_at")))})
    first = (hit.filter(F.col("anomaly_id").isNotNull() & F.col("_next").isNotNull())
             .orderBy(F.desc("severity_score"), "anomaly_id").limit(k).select("anomaly_id"))
    top = an.join(F.broadcast(first), "anomaly_id")   # k rows
    ato = window_after_join(top, fo, "asset_id", "anom_ts", "outage_start_ts", window_hours)
    ato = ato.withColumn("lag_hours", ((epoch_seconds("outage_start_ts")
                                        - epoch_seconds("anom_ts")) / 3600).cast("int"))
    j = ato.join(wo, "outage_id")   # left join + "type IS NOT NULL" == inner join
    j = j.withColumn("wo_lag_hours", ((epoch_seconds("created_ts")
                                       - epoch_seconds("outage_start_ts")) / 3600).cast("int"))
    return (j.orderBy(F.desc("severity_score"), "anomaly_id", "outage_id", "work_order_id")
             .limit(k).select("severity_score", "lag_hours", "work_order_type", "wo_lag_hours"))


def overdue_vs_outages(tables) -> DataFrame:
    """q11: overdue-maintenance bucket vs average forced outages."""
    ms = (tables["maintenance_schedule"].groupBy("asset_id")
          .agg(sum_if(F.col("overdue_flag")).alias("overdue_n")))
    oc = _forced(tables).groupBy("asset_id").agg(F.count(F.lit(1)).alias("forced_outages"))
    j = ms.join(oc, "asset_id", "left")
    n = F.col("overdue_n")
    bucket = case_ladder([(n == 0, "none overdue"), (n <= 1, "1 overdue"),
                          (n <= 3, "2-3 overdue")], "4+ overdue")
    return (j.groupBy(bucket.alias("overdue_bucket"))
             .agg(F.count(F.lit(1)).alias("n_assets"),
                  rnd(exact_avg(F.coalesce("forced_outages", F.lit(0).cast("long"))), 2)
                  .alias("avg_forced_outages"))
            .orderBy("overdue_bucket"))


def outage_context(tables, min_mwh: float = BIG_OUTAGE_MWH, k: int = 10) -> DataFrame:
    """q12: large outages with their dimensions and work order, top k."""
    o = tables["outages"].filter(F.col("lost_generation_mwh") > min_mwh)
    dims = asset_dims(tables, ["asset_type", "site_name", "region_name"])
    wo = tables["work_orders"].filter(F.col("outage_id").isNotNull()).select(
        "outage_id", "work_order_id", "work_order_type", "priority")
    j = o.join(dims, "asset_id").join(wo, "outage_id", "left")
    return (j.orderBy(F.desc("lost_generation_mwh"), "outage_id", "work_order_id").limit(k)
             .select("outage_id", "asset_type", "site_name", "region_name", "outage_start_ts",
                     "outage_reason", rnd("lost_generation_mwh", 1).alias("lost_mwh"),
                     "work_order_type", "priority"))


# ---------------------------------------------------------------- n01-n08
_ASSET_DIMS = ["asset_tag", "asset_type", "manufacturer", "site_name",
               "generation_type", "region_name"]


def problem_assets(tables, k: int = 25) -> DataFrame:
    """n01: forced-outage assets by lost MWh with reactive work-order count."""
    per_asset = (_forced(tables).groupBy("asset_id")
                 .agg(F.countDistinct("outage_id").alias("forced_outages"),
                      exact_sum("lost_generation_mwh").alias("_lost"),
                      exact_sum(F.col("lost_generation_mwh") * EST_PRICE_PER_MWH).alias("_loss")))
    wc = (tables["work_orders"].filter(F.col("work_order_type").isin(*REACTIVE_TYPES))
          .groupBy("asset_id").agg(F.count(F.lit(1)).alias("_wos")))
    j = per_asset.join(asset_dims(tables, _ASSET_DIMS), "asset_id").join(wc, "asset_id", "left")
    out = j.select("asset_id", *_ASSET_DIMS, "forced_outages",
                   rnd("_lost", 0).alias("total_lost_mwh"),
                   rnd("_loss", 0).alias("est_revenue_loss_usd"),
                   F.coalesce("_wos", F.lit(0).cast("long")).alias("reactive_emergency_wos"))
    return out.orderBy(F.desc("total_lost_mwh"), "asset_id").limit(k)


def _duration_h():
    return hours_between("outage_start_ts", "outage_end_ts").cast("int")


def region_outages(tables, region: str = FOCUS_REGION, k: int = 20) -> DataFrame:
    """n02: one region's worst forced outages."""
    dims = asset_dims(tables, ["asset_tag", "asset_type", "manufacturer", "site_name",
                               "region_name"]).filter(F.col("region_name") == region)
    j = _forced(tables).join(dims, "asset_id")
    return (j.orderBy(F.desc("lost_generation_mwh"), "outage_id").limit(k)
             .select(F.to_date("outage_start_ts").alias("outage_date"), "asset_tag",
                     "asset_type", "manufacturer", "site_name", "outage_reason",
                     _duration_h().alias("duration_h"),
                     rnd("lost_generation_mwh", 1).alias("lost_mwh"), "outage_id"))


def monthly_outages(tables) -> DataFrame:
    """n03: forced outages per month x region."""
    j = _forced(tables).join(asset_dims(tables, ["region_name"]), "asset_id")
    return (j.groupBy(trunc_ts("MONTH", "outage_start_ts").alias("month"), "region_name")
             .agg(F.countDistinct("outage_id").alias("forced_outages"),
                  rnd(exact_sum("lost_generation_mwh"), 0).alias("total_lost_mwh"))
            .orderBy("month", F.desc("total_lost_mwh"), "region_name"))


def vendor_reliability(tables) -> DataFrame:
    """n04: manufacturer x asset type reliability with manufacturer WO cost.

    The manufacturer-level work-order totals repeat on every asset-type
    row of that manufacturer (as in the original report).
    """
    a = tables["assets"].select("asset_id", "manufacturer", "asset_type")
    wo = (tables["work_orders"].filter(F.col("work_order_type").isin(*REACTIVE_TYPES))
          .select("asset_id", "parts_cost_usd").join(a, "asset_id")
          .groupBy("manufacturer")
          .agg(F.count(F.lit(1)).alias("emergency_reactive_wo"),
               rnd(exact_sum("parts_cost_usd"), 0).alias("emergency_parts_cost_usd")))
    base = a.groupBy("manufacturer", "asset_type").agg(
        F.countDistinct("asset_id").alias("asset_count"))
    out = (_forced(tables).select("outage_id", "asset_id", "lost_generation_mwh")
           .join(a, "asset_id").groupBy("manufacturer", "asset_type")
           .agg(F.countDistinct("outage_id").alias("_n"),
                exact_sum("lost_generation_mwh").alias("_sum"),
                exact_avg("lost_generation_mwh").alias("_avg")))
    j = (base.join(out, ["manufacturer", "asset_type"], "left")
             .join(wo, "manufacturer", "left"))
    return j.select("manufacturer", "asset_type", "asset_count",
                    F.coalesce("_n", F.lit(0).cast("long")).alias("forced_outages"),
                    rnd("_sum", 0).alias("total_lost_mwh"),
                    rnd("_avg", 1).alias("avg_lost_per_outage"),
                    "emergency_reactive_wo", "emergency_parts_cost_usd") \
            .orderBy(F.desc_nulls_last("total_lost_mwh"), "manufacturer", "asset_type")


def worst_outages(tables, k: int = 30) -> DataFrame:
    """n05: worst forced outages with dimensions."""
    dims = asset_dims(tables, ["asset_tag", "asset_type", "manufacturer", "site_name",
                               "region_name"])
    j = _forced(tables).join(dims, "asset_id")
    return (j.orderBy(F.desc("lost_generation_mwh"), "outage_id").limit(k)
             .select("outage_id", F.to_date("outage_start_ts").alias("outage_date"),
                     "outage_start_ts", "outage_end_ts", "asset_id", "asset_tag",
                     "asset_type", "manufacturer", "site_name", "region_name",
                     "outage_reason", _duration_h().alias("duration_h"),
                     rnd("lost_generation_mwh", 1).alias("lost_mwh")))


def region_sites(tables, region: str = FOCUS_REGION) -> DataFrame:
    """n06: a region's sites by commission date."""
    r = tables["regions"].filter(F.col("region_name") == region)
    return (tables["sites"].join(r, "region_id")
            .select("site_id", "site_name", "generation_type", "capacity_mw",
                    "commission_date").orderBy("commission_date", "site_id"))


def region_pnl(tables) -> DataFrame:
    """n07: revenue, costs, profit and margin by region."""
    f = financial_spine(tables)
    per_asset = f.groupBy("asset_id").agg(
        exact_sum("revenue_usd").alias("rev"), exact_sum("opex_usd").alias("opex"),
        exact_sum("maintenance_cost_usd").alias("maint"),
        exact_sum(F.col("revenue_usd") - F.col("opex_usd") - F.col("maintenance_cost_usd"))
        .alias("net"))
    j = per_asset.join(asset_dims(tables, ["region_name"]), "asset_id")
    g = j.groupBy("region_name").agg(*[F.sum(c).alias(c) for c in ("rev", "opex", "maint", "net")])
    return g.select(
        "region_name", rnd("rev", 0).alias("revenue"), rnd("opex", 0).alias("opex"),
        rnd("maint", 0).alias("maint_cost"), rnd("net", 0).alias("net_profit"),
        rnd(safe_div(dbl(100) * F.col("net").cast("double"), F.col("rev").cast("double")), 1)
        .alias("margin_pct")).orderBy("net_profit", "region_name")


def repeat_offenders(tables, min_outages: int = 3, k: int = 20) -> DataFrame:
    """n08: assets with at least ``min_outages`` distinct forced outages."""
    per_asset = (_forced(tables).groupBy("asset_id")
                 .agg(F.countDistinct("outage_id").alias("forced_outages"),
                      F.min(F.to_date("outage_start_ts")).alias("first_outage"),
                      F.max(F.to_date("outage_start_ts")).alias("last_outage"),
                      rnd(exact_sum("lost_generation_mwh"), 0).alias("total_lost_mwh"))
                 .filter(F.col("forced_outages") >= min_outages))
    dims = asset_dims(tables, ["asset_tag", "asset_type", "manufacturer", "site_name",
                               "region_name"])
    return (per_asset.join(dims, "asset_id")
            .orderBy(F.desc("forced_outages"), F.desc("total_lost_mwh"), "asset_id").limit(k)
            .select("asset_id", "asset_tag", "asset_type", "manufacturer", "site_name",
                    "region_name", "forced_outages", "first_outage", "last_outage",
                    "total_lost_mwh"))


# ------------------------------------------------- table-level g queries
def loss_root_causes(tables) -> DataFrame:
    """g06: outage reasons by lost generation."""
    return (tables["outages"].groupBy("outage_reason")
            .agg(F.count(F.lit(1)).alias("n_outages"),
                 rnd(exact_sum("lost_generation_mwh"), 0).alias("total_lost_mwh"),
                 rnd(exact_avg("lost_generation_mwh"), 1).alias("avg_lost_mwh")))


def price_volatility(tables) -> DataFrame:
    """g10: region x hour-of-day average and standard deviation of price."""
    mp = tables["market_prices"].join(tables["regions"], "region_id")
    return (mp.groupBy("region_name", F.hour("timestamp").alias("hour_of_day"))
              .agg(rnd(exact_avg("real_time_price_mwh"), 2).alias("avg_price"),
                   rnd(F.stddev("real_time_price_mwh"), 2).alias("price_volatility")))


def costliest_outages(tables, k: int = 10) -> DataFrame:
    """g12: top outages by lost generation."""
    dims = asset_dims(tables, ["asset_type", "site_name", "region_name"])
    j = tables["outages"].join(dims, "asset_id")
    return (j.orderBy(F.desc("lost_generation_mwh"), "outage_id").limit(k)
             .select("outage_id", "asset_type", "site_name", "region_name", "outage_reason",
                     rnd("lost_generation_mwh", 1).alias("lost_mwh"),
                     F.to_date("outage_start_ts").alias("outage_date")))


def repeat_failures(tables, min_wos: int = 3, k: int = 30) -> DataFrame:
    """g15: assets with at least ``min_wos`` reactive/emergency work orders."""
    per_asset = (tables["work_orders"].filter(F.col("work_order_type").isin(*REACTIVE_TYPES))
                 .groupBy("asset_id").agg(F.count(F.lit(1)).alias("reactive_emergency_wos"))
                 .filter(F.col("reactive_emergency_wos") >= min_wos))
    dims = asset_dims(tables, ["asset_tag", "asset_type", "site_name", "region_name"])
    return (per_asset.join(dims, "asset_id")
            .orderBy(F.desc("reactive_emergency_wos"), "asset_id").limit(k)
            .select("asset_id", "asset_tag", "asset_type", "site_name", "region_name",
                    "reactive_emergency_wos"))


def maintenance_backlog(tables) -> DataFrame:
    """g16: overdue share by asset type x region."""
    ms = tables["maintenance_schedule"].select("asset_id", "overdue_flag")
    j = ms.join(asset_dims(tables, ["asset_type", "region_name"]), "asset_id")
    g = j.groupBy("asset_type", "region_name").agg(
        count_if(F.col("overdue_flag")).alias("overdue_count"),
        F.count(F.lit(1)).alias("total_scheduled"))
    return g.withColumn("overdue_pct", rnd(dbl(100) * F.col("overdue_count")
                                               / F.col("total_scheduled"), 1))


def safety_by_region(tables) -> DataFrame:
    """g17: incidents by region x severity."""
    s = tables["sites"].select("site_id", "region_id").join(
        tables["regions"], "region_id")
    j = tables["safety_incidents"].join(s, "site_id")
    return (j.groupBy("region_name", "severity")
             .agg(F.count(F.lit(1)).alias("incident_count"),
                  sum_if(F.col("lost_time_flag")).alias("lost_time_incidents")))


def top_critical_assets(tables, k: int = 100,
                        types=("wind_turbine", "inverter", "battery_unit")) -> DataFrame:
    """t05: the k most critical assets among the given types (ties by id)."""
    a = tables["assets"].filter(F.col("asset_type").isin(*types))
    return (a.orderBy(F.desc("criticality_score"), "asset_id").limit(k)
             .select("asset_id", "asset_type", "criticality_score"))
