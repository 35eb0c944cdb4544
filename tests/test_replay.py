"""Replays in small steps equal the batch; state is dropped when its lifetime ends."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from gridkit.plans import registry
from gridkit.streaming import replay as P
from gridkit.streaming import streams as S


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def split(tmp_path, by_time, n=5):
    """The events in files named at random, each a stretch of time or a mix of all."""
    table = pq.read_table(f"{SF001}/events.parquet").sort_by("ts")
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    names = random.Random(4).sample(range(100), n)
    size = -(-table.num_rows // n)
    for i, name in enumerate(names):
        part = table.slice(i * size, size) if by_time else table.take(list(range(i, table.num_rows, n)))
        pq.write_table(part, folder / f"part-{name:05d}.parquet")
    return str(tmp_path)


def test_lateness_of_orders():
    r = [P.FileRange("a", 0, 10), P.FileRange("b", 5, 20), P.FileRange("c", 21, 30), P.FileRange("d", 12, 13)]
    assert P.lateness(r[:3]) == 5 and P.lateness(r) == 18 and P.lateness(r, 2) == 8 and P.lateness([]) == 0


@pytest.mark.parametrize("by_time", [True, False])
def test_one_file_a_step_gives_the_batch(spark, tmp_path, by_time):
    registry.load_all()
    folder = split(tmp_path, by_time)
    late = P.lateness(P.file_ranges(spark, f"{folder}/events.parquet"))
    assert (late < 2 * 86400 * 10**6) == by_time
    cust = spark.read.parquet(f"{SF001}/customer.parquet")
    upd = P.replay(spark, folder, lambda read, delay: S.daily_rollup_stream(read(), delay), "d", "update",
                   least_delay=86400)
    assert upd.select("_batch").distinct().count() >= 5
    got = S.latest_versions(upd, ["window", "asset_id"]).select(
        "asset_id", F.to_date("window.start"), "readings", "avg_temperature", "max_vibration", "alarm_count")
    assert rows(got) == rows(registry.QUERIES["st02_daily_rollup_stream"](spark, SF001))
    joined = P.replay(spark, folder, lambda read, delay: S.anomaly_outage_join_stream(
        read(), read(), cust, watermark=delay), "j", least_delay=48 * 3600)
    assert rows(joined) == rows(registry.QUERIES["st03_anomaly_outage_join_stream"](spark, SF001))
    ttl = P.replay(spark, folder, lambda read, delay: S.ttl_expiring_stream(read(), watermark=delay), "t", close=True)
    assert rows(ttl) == rows(registry.QUERIES["st04_ttl_dedupe_stream"](spark, SF001))


def test_state_is_dropped_after_its_lifetime(spark, tmp_path, monkeypatch):
    """Two hundred keys of one hour each: never more than a few hours' keys are held."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    start = dt.datetime(2024, 1, 1)
    for h in range(8):
        n = 25
        ts = [start + dt.timedelta(hours=3 * h, minutes=i) for i in range(n)]
        pq.write_table(pa.table({"event_id": list(range(h * n, h * n + n)), "ts": pa.array(ts, pa.timestamp("us")),
                                 "user_id": list(range(h * n, h * n + n)), "event_type": ["view"] * n}),
                       folder / f"part-{7 - h}.parquet")
    held = []
    real = S.run_available_now

    def watched(spark, df, name, mode="append", paths=None):
        out = real(spark, df, name, mode, paths)
        state = spark.read.format("statestore").load(paths[1])
        held.append(state.count())
        return out

    monkeypatch.setattr(S, "run_available_now", watched)
    got = P.replay(spark, str(tmp_path), lambda read, delay: S.ttl_expiring_stream(read(), watermark=delay), "s",
                   close=True)
    assert got.count() == 200
    assert max(held[:-1]) <= 50 and held[-1] <= 1, held  # the marker's own row at most


def test_empty_and_timeless_files(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                        ("event_type", pa.string())])
    pq.write_table(pa.table({"event_id": [1], "ts": [None], "user_id": [1], "event_type": ["view"]}, schema),
                   folder / "part-0.parquet")
    pq.write_table(schema.empty_table(), folder / "part-1.parquet")
    ranges = P.file_ranges(spark, str(folder))
    assert [f.name for f in ranges] == ["part-0.parquet"]
