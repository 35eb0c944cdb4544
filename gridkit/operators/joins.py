"""Join building blocks: dimension lookups and exact interval joins.

Interval joins (range predicates on timestamps) are turned into equi-joins
on a time bucket plus the exact residual predicate, so the physical plan is
a hash / sort-merge join partitioned on ``(key, bucket)`` instead of a join
on the bare entity key.  With a hot entity (one asset / region holding a
large share of rows) the bucket spreads its rows over many partitions, and
AQE's skew-join handling can split what remains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asset_dims(tables, cols: Sequence[str]) -> DataFrame:
    """``asset_id`` + the requested columns of asset -> site -> region.

    No side is hinted: small dimensions are broadcast by their known or
    measured size, and a deployment with many sites joins by shuffle.
    """
    a_cols = {"asset_id", "site_id", "asset_tag", "asset_type", "manufacturer",
              "install_date", "expected_life_years", "criticality_score"}
    s_cols = {"site_name", "generation_type", "capacity_mw", "commission_date", "region_id"}
    r_cols = {"region_name"}
    want = list(dict.fromkeys(cols))
    need_s = any(c in s_cols or c in r_cols for c in want)
    need_r = any(c in r_cols for c in want)
    a = tables["assets"].select(*({"asset_id", "site_id"} | (set(want) & a_cols)))
    out = a
    if need_s:
        s = tables["sites"].select("site_id", *(set(want) & s_cols - {"region_id"}),
                                   "region_id")
        out = out.join(s, "site_id")
    if need_r:
        r = tables["regions"].select("region_id", "region_name")
        out = out.join(r, "region_id")
    return out.select("asset_id", *[c for c in want if c != "asset_id"])


def time_window_join(points: DataFrame, events: DataFrame, key: str, point_ts: str,
                     event_ts: str, after_s: int, bucket_s: int = 86400,
                     include_start: bool = True) -> DataFrame:
    """Pairs with equal ``key`` and ``event_ts`` in ``[point_ts, point_ts +
    after_s]`` (``(point_ts, ...]`` when ``include_start`` is False).

    Points are replicated into the ``bucket_s``-wide time buckets their
    window touches (at most ``after_s / bucket_s + 2`` copies), events go to
    their own bucket, and the join runs on ``(key, bucket)`` with the exact
    residual; each matching pair meets in exactly one bucket.
    """
    pe = F.unix_timestamp(F.col(point_ts))
    ee = F.unix_timestamp(F.col(event_ts))
    p = points.withColumn("_b", F.explode(F.sequence(F.floor(pe / bucket_s),
                                                      F.floor((pe + after_s) / bucket_s))))
    e = events.withColumn("_b", F.floor(ee / bucket_s))
    j = p.join(e, [key, "_b"]).drop("_b")
    # exact residual on the timestamps themselves (buckets only route)
    et, pt = F.col(event_ts), F.col(point_ts)
    lower = (et >= pt) if include_start else (et > pt)
    return j.filter(lower & (et <= F.timestamp_add("SECOND", F.lit(after_s), pt)))


def window_after_join(points: DataFrame, events: DataFrame, key: str,
                      point_ts: str, event_ts: str, hours: int) -> DataFrame:
    """Pairs with ``point_ts <= event_ts <= point_ts + hours`` (day buckets)."""
    return time_window_join(points, events, key, point_ts, event_ts, hours * 3600)
