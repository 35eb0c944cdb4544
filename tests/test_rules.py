"""Rules without cuts and reports without drift, on literal rows."""

import datetime as dt

import pytest
from fixtures import ASSETS, REGION, SITES, tables

from gridkit.functions.scalars import exact_avg, exact_sum, rnd
from gridkit.operators import corpus as C
from gridkit.operators import derive as D
from gridkit.operators import windows as W

T, DAY = dt.datetime, dt.date


@pytest.mark.parametrize("value,scale,want", [
    (60_000_000_000.0, 0, 60_000_000_000.0), (60_000_000_000.5, 0, 60_000_000_001.0),
    (123_456_789.12, 2, 123_456_789.12), (60_000_000_000.125, 2, 60_000_000_000.13),
    (2.675, 2, 2.68), (-2.5, 0, -3.0), (1.005, 2, 1.01)])
def test_rounding_at_any_magnitude(spark, value, scale, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(rnd("x", scale)).first()[0] == want


def test_sums_do_not_depend_on_the_order(spark):
    rows = [(0.1,)] * 100_000 + [(6e10,), (0.5,), (-1e9,), (1e9,)]
    df = spark.createDataFrame(rows, "x double")
    for n in (1, 7):
        got = df.repartition(n).agg(rnd(exact_sum("x"), 0), rnd(exact_sum("x"), 2), exact_avg("x")).first()
        assert got[0] == 60_000_010_001.0 and got[1] == 60_000_010_000.5
        assert got[2] == 60_000_010_000.5 / len(rows)


def test_outage_across_the_month_end_keeps_its_hours(spark):
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=[
        (1, 10, 1, T(2024, 1, 31, 22), T(2024, 2, 1, 2), "w", True, 8.0),
        (2, 10, 1, T(2024, 12, 31, 20), T(2025, 1, 1, 4), "w", True, 6.0)])
    got = {r["hour"]: r["lost_mwh"] for r in D.loss_per_hour(t, T(2024, 1, 1), 366 * 24).collect()}
    assert {h: got[h] for h in sorted(got)[:4]} == {T(2024, 1, 31, 22): 2.0, T(2024, 1, 31, 23): 2.0,
                                                    T(2024, 2, 1, 0): 2.0, T(2024, 2, 1, 1): 2.0}
    assert sum(got.values()) == 14.0 and max(got) < T(2025, 1, 1)


def test_deferrals_count_however_long_ago(spark):
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=[
        (1, 10, 1, T(2025, 5, 31), T(2025, 6, 1), "w", True, 1.0),
        (2, 11, 1, T(2025, 5, 31), T(2025, 6, 1), "w", True, 1.0)],
        maintenance_schedule=[(1, 10, DAY(2025, 1, 22), "oil_change", False, True),
                              (2, 10, DAY(2025, 5, 31), "oil_change", False, True),
                              (3, 10, DAY(2025, 6, 1), "oil_change", False, True),
                              (4, 10, DAY(2025, 1, 1), "oil_change", True, False)])
    got = {r["outage_id"]: r["deferred_items"] for r in C.deferred_before_failure(t).collect()}
    assert got == {1: 2, 2: 0}


def test_first_time_fix_window_ends(spark):
    wo = lambda i, ts: (i, 10, 1, None, "emergency", "P1", ts, ts, 1.0, 1.0, "completed")
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS,
               outages=[(1, 10, 1, T(2024, 4, 1), T(2024, 4, 2), "w", True, 1.0)],
               work_orders=[wo(1, T(2024, 4, 1)), wo(2, T(2024, 1, 2)), wo(3, T(2024, 1, 1, 23, 59, 59)),
                            wo(4, T(2024, 3, 31))])
    got = W.first_time_fix(t).first()
    assert (got["emergency_repairs"], got["fixed_first_time"]) == (4, 2)  # the outage itself, and 90 days + 1 s


def test_invoice_amounts_of_any_size(spark):
    docs = spark.createDataFrame([("I-1", "| a | $12,345,678,901.25 |\n| b | $0.5 |\n| Total | $12,345,678,901.75 |\n"
                                          "| c | $ n/a |")], "doc_id string, text string")
    got = C.invoice_check(C.invoice_lines(docs)).first()
    assert (got["line_sum"], got["stated_total"], got["difference"]) == (12345678901.75, 12345678901.75, 0.0)


def test_topk_takes_queries_in_blocks(spark):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    queries = [(q, [1.0, q / 300.0]) for q in range(600)]
    got = C.topk_by_cosine(emb, queries, 2)
    assert got.count() == 1200 and got.select("query").distinct().count() == 600
    assert got.filter("query = 0 and rank = 1").first()["vec_id"] == 4
    assert C.topk_by_cosine(emb, [], 2, query_type="long").count() == 0


def test_trailing_is_one_exchange_without_a_join(spark):
    from gridkit.sources.bindings import load

    from conftest import SF001
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = load(spark, SF001)
        for df in (W.sustained_exceedance(t), W.running_mean(t)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        # w02 orders rows by time inside chunks; its only joins attach an outage's site
        plan = W.first_time_fix(t)._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(sequence" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
