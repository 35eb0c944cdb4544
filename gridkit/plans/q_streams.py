"""Registered streaming queries st01-st04 (run with ``availableNow``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import replay as P
from ..streaming import streams as S
from .registry import ORACLE, register


@register("st01_alarm_stream", """
SELECT event_id AS telemetry_id, user_id AS asset_id, ts AS timestamp, value/5 AS temperature,
       (event_id % 100)/CAST(20 AS DOUBLE) AS vibration
FROM events WHERE value/5 > 70 OR (event_id % 100)/CAST(20 AS DOUBLE) > 4""")
def st01(spark, d):
    out = S.run_available_now(spark, S.alarm_stream(S.event_stream(spark, d)), "alarm")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("st02_daily_rollup_stream", """
SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, COUNT(*) AS readings,
       AVG(value/5) AS avg_temperature, MAX((event_id % 100)/CAST(20 AS DOUBLE)) AS max_vibration,
       CAST(SUM(CASE WHEN value/5 > 70 OR (event_id % 100)/CAST(20 AS DOUBLE) > 4 THEN 1 ELSE 0 END) AS BIGINT)
         AS alarm_count
FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def st02(spark, d):
    agg = S.daily_rollup_stream(S.event_stream(spark, d))
    upd = S.run_available_now(spark, agg, "daily", mode="update")
    latest = S.latest_versions(upd, ["window", "asset_id"])
    return latest.select("asset_id", F.to_date(F.col("window.start")).alias("date"),
                         "readings", "avg_temperature", "max_vibration", "alarm_count")


@register("st03_anomaly_outage_join_stream", """
SELECT a.event_id AS anomaly_id, o.event_id AS outage_id, a.user_id AS asset_id,
       CAST(trunc((floor(epoch(o.ts)) - floor(epoch(a.ts))) / 3600) AS INTEGER) AS lag_hours
FROM events a JOIN events o ON a.user_id = o.user_id
JOIN customer c ON o.user_id = c.c_custkey
WHERE a.event_type = 'error' AND o.event_type = 'purchase' AND o.event_id % 4 < 2
  AND o.ts BETWEEN a.ts AND a.ts + INTERVAL 48 HOURS""")
def st03(spark, d):
    cust = spark.read.parquet(f"{d}/customer.parquet")
    j = S.anomaly_outage_join_stream(S.event_stream(spark, d), S.event_stream(spark, d), cust)
    return S.run_available_now(spark, j, "anomaly_outage")


@register("st04_ttl_dedupe_stream", """
WITH RECURSIVE ev AS (SELECT DISTINCT user_id, event_type, ts FROM events),
stored(user_id, event_type, ts) AS (
  SELECT user_id, event_type, min(ts) FROM ev GROUP BY user_id, event_type
  UNION ALL
  SELECT s.user_id, s.event_type, n.ts FROM stored s,
    LATERAL (SELECT min(e.ts) AS ts FROM ev e WHERE e.user_id = s.user_id AND e.event_type = s.event_type
               AND e.ts > s.ts + INTERVAL 1 HOUR) n WHERE n.ts IS NOT NULL)
SELECT * FROM stored""")
def st04(spark, d):
    return S.run_available_now(spark, S.ttl_dedupe_stream(S.event_stream(spark, d)), "dedupe")


# ---------------------------------------------- one file at a time, in no order
def _scattered(spark, d, files: int = 5) -> str:
    """The events dealt by hash over the files of a folder, so that every file mixes
    all times."""
    lake = scratch_path(spark, f"scattered-{uuid.uuid4().hex[:10]}")
    spark.read.parquet(f"{d}/events.parquet").repartition(files, "event_id").write.parquet(f"{lake}/events.parquet")
    return lake


@register("st02_replay_daily", ORACLE["st02_daily_rollup_stream"])
def st02_replay(spark, d):
    """st02 with one file per step: the watermark waits for what is not yet read."""
    upd = P.replay(spark, _scattered(spark, d), lambda read, delay: S.daily_rollup_stream(read(), delay),
                   "daily", "update", least_delay=86400)
    latest = S.latest_versions(upd, ["window", "asset_id"])
    return latest.select("asset_id", F.to_date(F.col("window.start")).alias("date"),
                         "readings", "avg_temperature", "max_vibration", "alarm_count")


@register("st03_replay_join", ORACLE["st03_anomaly_outage_join_stream"])
def st03_replay(spark, d):
    """st03 with one file per step."""
    cust = spark.read.parquet(f"{d}/customer.parquet")
    return P.replay(spark, _scattered(spark, d), lambda read, delay: S.anomaly_outage_join_stream(
        read(), read(), cust, watermark=delay), "join", least_delay=48 * 3600)


@register("st04_replay_ttl", ORACLE["st04_ttl_dedupe_stream"])
def st04_replay(spark, d):
    """st04 with one file per step and state that expires."""
    return P.replay(spark, _scattered(spark, d), lambda read, delay: S.ttl_expiring_stream(read(), watermark=delay),
                    "ttl", close=True)
