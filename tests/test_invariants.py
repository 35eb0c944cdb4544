"""Invariants on the supplied data (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF001
from gridkit.operators import derive as Dv
from gridkit.operators import rollups as R
from gridkit.sources.bindings import load


def test_asset_daily_summary_one_row_per_spine_key(spark):
    t = load(spark, SF001)
    ads = R.asset_daily_summary(t)
    spine = t.asset_financials.join(t.assets.select("asset_id"), "asset_id")
    assert ads.count() == spine.count()
    assert ads.select("asset_id", "date").distinct().count() == ads.count()


def test_daily_loss_allocation_conserves_loss(spark):
    t = load(spark, SF001)
    total = t.outages.agg(F.sum("lost_generation_mwh")).first()[0]
    spread = Dv.loss_per_day(t).agg(F.sum("lost_mwh")).first()[0]
    assert abs(total - spread) < 1e-6 * max(1.0, total)


def test_region_rollup_preserves_additive_totals(spark):
    t = load(spark, SF001)
    ads = R.asset_daily_summary(t)
    rds = R.region_daily_summary(t)
    a = ads.agg(F.sum("revenue_usd"), F.sum("outage_count")).first()
    b = rds.agg(F.sum("total_revenue_usd"), F.sum("total_outage_count")).first()
    assert abs(a[0] - b[0]) < 1e-6 * max(1.0, abs(a[0])) and a[1] == b[1]
