"""Metric-view compiler behaviour: join pruning, errors, metadata."""

import pytest

from conftest import SF001
from gridkit.plans.views import all_views
from gridkit.sources.bindings import load


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_joins_are_pruned(spark):
    t = load(spark, SF001)
    mv = all_views()["maintenance_workforce_metrics"]
    narrow = mv.query(t, ["work_order_type"], ["work_order_count"])
    assert "supplier" not in _plan(narrow) and "s_suppkey" not in _plan(narrow)
    wide = mv.query(t, ["certification_level"], ["work_order_count"])
    assert "s_suppkey" in _plan(wide)


def test_unknown_names_raise(spark):
    mv = all_views()["grid_operations_metrics"]
    with pytest.raises(KeyError):
        mv.query(load(spark, SF001), ["no_such_dim"], ["outage_count"])
    with pytest.raises(KeyError):
        mv.query(load(spark, SF001), [], ["no_such_measure"])


def test_global_aggregate_and_additivity(spark):
    t = load(spark, SF001)
    mv = all_views()["grid_operations_metrics"]
    total = mv.query(t, [], ["outage_count"]).collect()
    assert len(total) == 1
    by_type = mv.query(t, ["asset_type"], ["outage_count"]).collect()
    assert sum(r.outage_count for r in by_type) == total[0].outage_count


def test_field_metadata(spark):
    views = all_views()
    assert sum(len(v.measures) for v in views.values()) == 55
    assert sum(len(v.dimensions) for v in views.values()) == 48
    d = {r.field: r for r in views["grid_operations_metrics"].describe(spark).collect()}
    assert "MTBF" in d["mtbf_hours"].synonyms
    fin = {r.field: r for r in views["financial_performance_metrics"].describe(spark).collect()}
    assert fin["total_revenue_usd"].format == "currency:USD"
    assert fin["profit_margin_pct"].format is None


def test_synonyms_and_formats(spark):
    import pytest as _pt
    views = all_views()
    g = views["grid_operations_metrics"]
    assert g.resolve("MTBF") == "mtbf_hours"
    assert g.resolve("Capacity Factor (%)") == "capacity_factor_pct"
    with _pt.raises(ValueError):
        views["maintenance_workforce_metrics"].resolve("labor hours")   # two measures
    with _pt.raises(KeyError):
        g.resolve("no such thing")
    fin = views["financial_performance_metrics"].query(
        load(spark, SF001), ["region_name"], ["total_revenue_usd", "profit_margin_pct"])
    md = {f.name: f.metadata for f in fin.schema.fields}
    assert md["total_revenue_usd"]["format"] == "currency:USD"
    assert "format" not in md["profit_margin_pct"]


def test_readme_usage_example(spark):
    from gridkit.operators import rollups
    from gridkit.sources.bindings import Tables
    bound = load(spark, SF001)
    t = Tables.from_frames(spark, bound.as_dict())
    assert rollups.asset_daily_summary(t).count() > 0
    grid = all_views()["grid_operations_metrics"]
    out = grid.query(t, ["region_name", "month"],
                     ["outage_count", "mtbf_hours", "capacity_factor_pct"],
                     where="asset_health_status = 'Critical'",
                     order_by=["outage_count DESC"], limit=20)
    assert out.columns == ["region_name", "month", "outage_count", "mtbf_hours",
                           "capacity_factor_pct"]
    out.collect()
    assert grid.resolve("MTBF") == "mtbf_hours"
