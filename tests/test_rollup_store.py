"""Rollup tables follow new files: the days touched, nothing else, same rows as a rebuild."""

import datetime as dt
from functools import partial

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from gridkit.operators import rollup_store as S
from gridkit.operators import rollups as R
from gridkit.plans import q_rollups
from gridkit.session import scratch_path
from gridkit.sources import bindings as B
from gridkit.sources.raw import read_raw


def rows(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


def lake(spark, name, keep):
    path = scratch_path(spark, name)
    for t in B.SOURCES:
        df = read_raw(spark, SF001, t)
        (df.where(keep) if t == B.FACT_SOURCE else df).coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return path


def refresh(spark, store, path):
    return store.refresh(B.load(spark, path), B.source_files(spark, path), partial(B.load_files, spark, path))


def whole(spark, path):
    t = B.Tables(spark, path)
    return rows(R.asset_daily_summary(t)), rows(R.region_daily_summary(t))


DAY = "2024-01-30"


@pytest.mark.parametrize("grain", ["day", "month"])
def test_appended_rows_touch_their_days_only(spark, grain):
    path = lake(spark, f"lake-{grain}", F.to_date("ts") != DAY)
    store = S.RollupStore(spark, f"{path}-store", grain)
    assert refresh(spark, store, path) == {"asset_day": None, "region_day": None}
    before = store._asset_day.manifest().parts
    assert refresh(spark, store, path) == {"asset_day": [], "region_day": []}
    read_raw(spark, SF001, "events").where(F.to_date("ts") == DAY).write.mode("append").parquet(f"{path}/events.parquet")
    done = refresh(spark, store, path)
    # an outage late in the evening has its work order on the day after
    assert dt.date(2024, 1, 30) in done["asset_day"] and done["asset_day"] == done["region_day"]
    after = store._asset_day.manifest().parts
    if grain == "day":
        assert set(done["asset_day"]) <= {dt.date(2024, 1, 30), dt.date(2024, 1, 31)}
        assert {p for p in before if before[p] == after.get(p)} == set(before) - {f"period={DAY}"}
    assert (rows(store.asset_day()), rows(store.region_day())) == whole(spark, path)


def test_registered_refresh_computes_the_late_days(spark):
    _, (first, second) = q_rollups._appended(spark, SF001)
    assert first["asset_day"] is None
    assert {dt.date(2024, 1, 20), dt.date(2024, 1, 30)} <= set(second["asset_day"])
    assert len(second["asset_day"]) <= 4


def test_changed_files_and_dimensions_compute_everything(spark):
    path = lake(spark, "lake-changed", F.lit(True))
    store = S.RollupStore(spark, f"{path}-store")
    refresh(spark, store, path)
    read_raw(spark, SF001, "nation").withColumn("n_regionkey", (F.col("n_regionkey") + 1) % 5).write.mode(
        "overwrite").parquet(f"{path}/nation.parquet")
    assert refresh(spark, store, path)["asset_day"] is None
    assert rows(store.region_day()) == whole(spark, path)[1]
    read_raw(spark, SF001, "events").where("event_id % 2 = 0").write.mode("overwrite").parquet(f"{path}/events.parquet")
    assert refresh(spark, store, path) == {"asset_day": None, "region_day": None}
    assert (rows(store.asset_day()), rows(store.region_day())) == whole(spark, path)


def test_a_refresh_that_dies_between_the_tables_is_finished(spark):
    path = lake(spark, "lake-dies", F.to_date("ts") != DAY)
    store = S.RollupStore(spark, f"{path}-store")
    refresh(spark, store, path)
    read_raw(spark, SF001, "events").where(F.to_date("ts") == DAY).write.mode("append").parquet(f"{path}/events.parquet")
    broken = S.RollupStore(spark, f"{path}-store")
    broken._region_rows = lambda *a: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        refresh(spark, broken, path)
    done = refresh(spark, store, path)
    assert done["asset_day"] == [] and dt.date(2024, 1, 30) in done["region_day"]
    assert (rows(store.asset_day()), rows(store.region_day())) == whole(spark, path)


def test_runs_of_days():
    d = dt.date(2024, 2, 28)
    days = {d, d + S.ONE_DAY, d + 2 * S.ONE_DAY, d + 5 * S.ONE_DAY}
    assert S.runs(days) == [(d, dt.date(2024, 3, 2)), (dt.date(2024, 3, 4), dt.date(2024, 3, 5))]
    assert S.runs([]) == []


def test_days_reach_the_scan(spark):
    t = S.restricted(B.load(spark, SF001), {dt.date(2024, 1, 5), dt.date(2024, 1, 6)})
    plan = t.telemetry._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
