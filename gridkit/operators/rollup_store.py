"""Rollup tables that follow new data day by day (r08, r09).

The asset-day and the region-day summary are versioned tables partitioned by date.
``refresh`` compares the files of the source with those of the last commit, reads the
new files only to learn which days their rows touch, computes these days again from
all rows of these days, and swaps their partitions; the files of all other days stay
as they are.  Days are a set of at most one entry per calendar day, so they are held
by the driver.  A changed or removed file, or a changed dimension table, leaves no
way to tell the days, and everything is computed again.

A refresh that dies between the two tables is finished by the next one: each table's
manifest notes the source state that it was built from.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bindings import LOGICAL_TABLES, Tables
from ..sources.versioned import VersionedTable
from . import rollups as R

#: facts of the rollups and the column that gives a row's day
DAY_OF = {"telemetry": "timestamp", "sensor_anomalies": "timestamp", "outages": "outage_start_ts",
          "work_orders": "created_ts", "maintenance_schedule": "planned_date", "asset_financials": "date",
          "safety_incidents": "incident_ts"}
ONE_DAY = dt.timedelta(days=1)


def days_of(tables: Tables) -> set[dt.date]:
    """The days that any fact row of ``tables`` belongs to."""
    found = [tables[name].select(F.to_date(c).alias("day")).distinct() for name, c in DAY_OF.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return {r["day"] for r in out.distinct().collect() if r["day"] is not None}  # one row per calendar day


def runs(days: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """[first, end) of each run of days that follow one another."""
    out: list[tuple[dt.date, dt.date]] = []
    for d in sorted(days):
        if out and out[-1][1] == d:
            out[-1] = (out[-1][0], d + ONE_DAY)
        else:
            out.append((d, d + ONE_DAY))
    return out


def on_days(column: str, days: Iterable[dt.date]) -> Column:
    """Whether a date or time lies on one of ``days``: ranges, which reach the scan."""
    c = F.col(column)
    test = F.lit(False)
    for low, high in runs(days):
        test = test | ((c >= F.lit(low)) & (c < F.lit(high)))
    return test


def restricted(tables: Tables, days: Iterable[dt.date]) -> Tables:
    """``tables`` with the facts of ``days`` only."""
    days = list(days)
    frames = {n: tables[n].where(on_days(DAY_OF[n], days)) if n in DAY_OF else tables[n] for n in LOGICAL_TABLES}
    return Tables.from_frames(tables.spark, frames)


class RollupStore:
    """Asset-day and region-day summaries under ``path``, in partitions of a day or
    (for small data, where a file a day is too little) of a month."""

    def __init__(self, spark, path: str, grain: str = "day"):
        if grain not in ("day", "month"):
            raise ValueError(f"unknown grain {grain!r}")
        self.spark, self.grain = spark, grain
        self._asset_day = VersionedTable(spark, f"{path}/asset_day")
        self._region_day = VersionedTable(spark, f"{path}/region_day")

    def _period(self) -> Column:
        return F.date_format("date", "yyyy-MM-dd" if self.grain == "day" else "yyyy-MM")

    def _widened(self, days: set[dt.date]) -> set[dt.date]:
        """All days of the periods that hold ``days``."""
        if self.grain == "day":
            return days
        out = set()
        for first in {d.replace(day=1) for d in days}:
            d = first
            while d.month == first.month:
                out.add(d)
                d += ONE_DAY
        return out

    # ------------------------------------------------------------- refresh
    def refresh(self, tables: Tables, source: dict[str, dict], bind_new) -> dict[str, list[dt.date] | None]:
        """Bring both tables to the state ``source``.

        ``source`` maps "facts" and "dimensions" to ``{file: [length, time]}``;
        ``bind_new(files)`` binds the logical tables to those fact files alone.
        Returns the days computed per table; None when the whole was.
        """
        source = json.loads(json.dumps(source))  # as a manifest gives it back
        done: dict[str, list[dt.date] | None] = {}
        for name, table, build in (("asset_day", self._asset_day, self._asset_rows),
                                   ("region_day", self._region_day, self._region_rows)):
            held = table.manifest().note.get("source")
            if held == source:
                done[name] = []
                continue
            days = self._changed(held, source, bind_new)
            days = days if days is None else self._widened(days)
            rows = build(tables, days).withColumn("period", self._period())
            stamp = hashlib.sha256(json.dumps([held, source], sort_keys=True).encode()).hexdigest()
            note = {"source": source}
            if days is None:
                table.commit(rows, partition_by=["period"], batch=stamp, note=note)
            else:
                form = "%Y-%m-%d" if self.grain == "day" else "%Y-%m"
                table.commit(rows, "partitions", batch=stamp, note=note,
                             replace=sorted({f"period={d.strftime(form)}" for d in days}))
            done[name] = None if days is None else sorted(days)
        return done

    def _asset_rows(self, tables: Tables, days: set[dt.date] | None) -> DataFrame:
        return R.asset_daily_summary(tables if days is None else restricted(tables, days))

    def _region_rows(self, tables: Tables, days: set[dt.date] | None) -> DataFrame:
        """From the written asset days; of these only the days asked are read."""
        if days is None:
            return R.region_daily_summary(tables, self.asset_day())
        return R.region_daily_summary(restricted(tables, days), self.asset_day(days))

    @staticmethod
    def _changed(held: dict | None, source: dict, bind_new) -> set[dt.date] | None:
        if held is None or held["dimensions"] != source["dimensions"]:
            return None
        if any(source["facts"].get(f) != state for f, state in held["facts"].items()):
            return None
        new = sorted(set(source["facts"]) - set(held["facts"]))
        return days_of(bind_new(new)) if new else set()

    # --------------------------------------------------------------- reads
    def _read(self, table: VersionedTable, days: set[dt.date] | None) -> DataFrame:
        df = table.read()
        if days is not None:
            form = "%Y-%m-%d" if self.grain == "day" else "%Y-%m"
            df = df.where(F.col("period").isin(sorted({d.strftime(form) for d in days})) & on_days("date", days))
        return df.drop("period")

    def asset_day(self, days: set[dt.date] | None = None) -> DataFrame:
        return self._read(self._asset_day, days)

    def region_day(self, days: set[dt.date] | None = None) -> DataFrame:
        return self._read(self._region_day, days)
