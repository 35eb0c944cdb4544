"""Bindings of the 13 logical operations tables onto the supplied data.

The supplied data is a TPC-H-like star schema plus an ``events`` stream; the
operations tables (regions, sites, assets, technicians, telemetry, anomalies,
outages, maintenance schedule, work orders, prices, financials, power sales,
safety incidents) are projected from it with the fixed mapping below, written
as DataFrame transformations so that every derived table stays a lazy plan
over the parquet scans (column pruning and filter pushdown reach the files).

Join strategy: no hints.  A side is broadcast when its file size, or at run
time its measured shuffle size, is under the threshold; otherwise it is a
sort-merge join (with skew splitting).

A real deployment binds :class:`Tables` to its own 13 tables instead
(``Tables.from_frames``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import add_hours, case_value, dbl, trunc_ts
from .files import Files
from .raw import read_files, read_raw

LOGICAL_TABLES = (
    "regions sites assets technicians market_prices telemetry sensor_anomalies "
    "outages maintenance_schedule work_orders asset_financials power_sales "
    "safety_incidents"
).split()

# Fixed values of the projection (must equal the oracle's mapping).
GENERATION_TYPE_BY_MOD3 = [(0, "solar"), (1, "wind")]  # else battery
ASSET_TYPE_BY_SEGMENT = [
    ("FURNITURE", "wind_turbine"),
    ("MACHINERY", "inverter"),
    ("BUILDING", "battery_unit"),
    ("AUTOMOBILE", "transformer"),
]  # else substation_equipment
CERTIFICATION_BY_MOD4 = [(0, "Junior"), (1, "Mid"), (2, "Senior")]  # else Master
ANOMALY_TYPE_BY_MOD5 = [(0, "overheating"), (1, "voltage_instability"),
                        (2, "vibration_excess"), (3, "efficiency_decline")]  # else soc_drift
OUTAGE_REASON_BY_MOD4 = [(0, "overheating"), (1, "vibration_excess"),
                         (2, "weather")]  # else scheduled_maintenance
SEVERITY_BY_MOD4 = [(0, "near_miss"), (1, "minor"), (2, "recordable")]  # else serious


class Tables:
    """Lazy accessors for the logical tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 frames: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames = dict(frames or {})
        self._raw: dict[str, DataFrame] = {}
        self._memo: dict[tuple, DataFrame] = {}

    def memo(self, key: tuple, build) -> DataFrame:
        """A derived frame built once per binding (plans are immutable)."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Tables":
        return cls(spark, None, frames)

    def raw(self, name: str) -> DataFrame:
        # one scan definition per supplied table (listing + footer read once)
        if name not in self._raw:
            self._raw[name] = read_raw(self.spark, self.sf_dir, name)
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if name not in LOGICAL_TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {t: self[t] for t in LOGICAL_TABLES}

    # ---- dimensions -----------------------------------------------------
    def _events(self) -> DataFrame:
        return self.raw("events")

    def _nation(self) -> DataFrame:
        return self.raw("nation")

    @cached_property
    def regions(self) -> DataFrame:
        if "regions" in self._frames:
            return self._frames["regions"]
        return self.raw("region").select(
            F.col("r_regionkey").alias("region_id"),
            F.col("r_name").alias("region_name"))

    @cached_property
    def sites(self) -> DataFrame:
        if "sites" in self._frames:
            return self._frames["sites"]
        n = self.raw("nation")
        k = F.col("n_nationkey")
        return n.select(
            k.alias("site_id"),
            F.col("n_regionkey").alias("region_id"),
            F.col("n_name").alias("site_name"),
            case_value(k % 3, GENERATION_TYPE_BY_MOD3, "battery").alias("generation_type"),
            (F.lit(50) + F.lit(10) * k).cast("double").alias("capacity_mw"),
            F.date_add(F.lit("2010-01-01").cast("date"), k * 100).alias("commission_date"))

    @cached_property
    def assets(self) -> DataFrame:
        if "assets" in self._frames:
            return self._frames["assets"]
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("asset_id"),
            F.col("c_nationkey").alias("site_id"),
            F.col("c_name").alias("asset_tag"),
            case_value("c_mktsegment", ASSET_TYPE_BY_SEGMENT,
                       "substation_equipment").alias("asset_type"),
            F.concat(F.lit("OEM-"), (k % 4).cast("string")).alias("manufacturer"),
            F.date_add(F.lit("2010-01-01").cast("date"),
                       (k % 5000).cast("int")).alias("install_date"),
            F.lit(20).cast("int").alias("expected_life_years"),
            (F.lit(1) + k % 10).cast("double").alias("criticality_score"))

    @cached_property
    def technicians(self) -> DataFrame:
        if "technicians" in self._frames:
            return self._frames["technicians"]
        s = self.raw("supplier")
        n = self._nation().select("n_nationkey", "n_regionkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("technician_id"),
            F.col("n_regionkey").alias("region_id"),
            F.col("s_name").alias("technician_name"),
            case_value(F.col("s_suppkey") % 4, CERTIFICATION_BY_MOD4,
                       "Master").alias("certification_level"))

    # ---- facts --------------------------------------------------------------
    @cached_property
    def telemetry(self) -> DataFrame:
        if "telemetry" in self._frames:
            return self._frames["telemetry"]
        e = self._events()
        k = F.col("event_id") % 100
        vib = k / dbl(20)
        temp = F.col("value") / 5
        return e.select(
            F.col("event_id").alias("telemetry_id"),
            F.col("user_id").alias("asset_id"),
            F.col("ts").alias("timestamp"),
            (F.lit(480) + F.col("value") / 100).alias("voltage"),
            temp.alias("temperature"),
            vib.alias("vibration"),
            (F.col("value") / 100).alias("power_output_mw"),
            (F.lit(60) + k * dbl(0.4)).alias("efficiency_pct"),
            ((temp > 70) | (vib > 4)).alias("alarm_flag"))

    @cached_property
    def sensor_anomalies(self) -> DataFrame:
        if "sensor_anomalies" in self._frames:
            return self._frames["sensor_anomalies"]
        e = self._events().filter(F.col("event_type") == "error")
        return e.select(
            F.col("event_id").alias("anomaly_id"),
            F.col("user_id").alias("asset_id"),
            F.col("ts").alias("timestamp"),
            case_value(F.col("event_id") % 5, ANOMALY_TYPE_BY_MOD5,
                       "soc_drift").alias("anomaly_type"),
            ((F.col("event_id") % 100) / dbl(10)).alias("severity_score"))

    @cached_property
    def outages(self) -> DataFrame:
        if "outages" in self._frames:
            return self._frames["outages"]
        e = self._events().filter(F.col("event_type") == "purchase")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        j = e.join(c, e.user_id == c.c_custkey)
        m4 = F.col("event_id") % 4
        return j.select(
            F.col("event_id").alias("outage_id"),
            F.col("user_id").alias("asset_id"),
            F.col("c_nationkey").alias("site_id"),
            F.col("ts").alias("outage_start_ts"),
            add_hours("ts", F.col("event_id") % 100 + 1).alias("outage_end_ts"),
            case_value(m4, OUTAGE_REASON_BY_MOD4,
                       "scheduled_maintenance").alias("outage_reason"),
            (m4 < 2).alias("forced_outage_flag"),
            F.col("value").alias("lost_generation_mwh"))

    @cached_property
    def maintenance_schedule(self) -> DataFrame:
        if "maintenance_schedule" in self._frames:
            return self._frames["maintenance_schedule"]
        e = self._events().filter(F.col("event_type") == "signup")
        m10 = F.col("event_id") % 10
        return e.select(
            F.col("event_id").alias("schedule_id"),
            F.col("user_id").alias("asset_id"),
            F.to_date("ts").alias("planned_date"),
            F.when(F.col("event_id") % 2 == 0, F.lit("quarterly_inspection"))
             .otherwise(F.lit("oil_change")).alias("maintenance_type"),
            (m10 < 8).alias("completed_flag"),
            (m10 >= 8).alias("overdue_flag"))

    @cached_property
    def market_prices(self) -> DataFrame:
        if "market_prices" in self._frames:
            return self._frames["market_prices"]
        e = self._events().filter(F.col("event_type") == "view")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self._nation().select("n_nationkey", "n_regionkey")
        j = e.join(c, e.user_id == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
        return (j.groupBy(F.col("n_regionkey").alias("region_id"),
                          trunc_ts("HOUR", "ts").alias("timestamp"))
                 .agg((F.avg("value") / 4).alias("real_time_price_mwh")))

    @cached_property
    def asset_financials(self) -> DataFrame:
        if "asset_financials" in self._frames:
            return self._frames["asset_financials"]
        e = self._events()
        zero = dbl(0)
        return (e.groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"))
                 .agg(F.sum("value").alias("revenue_usd"),
                      (F.count(F.lit(1)) * dbl(20)).alias("opex_usd"),
                      F.sum(F.when(F.col("event_type") == "click", F.col("value"))
                             .otherwise(zero)).alias("maintenance_cost_usd"),
                      (F.sum(F.when(F.col("event_type") == "view", F.col("value"))
                              .otherwise(zero)) / 50).alias("curtailed_mwh")))

    @cached_property
    def power_sales(self) -> DataFrame:
        if "power_sales" in self._frames:
            return self._frames["power_sales"]
        e = self._events()
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        j = e.join(c, e.user_id == c.c_custkey)
        return (j.groupBy(F.col("c_nationkey").alias("site_id"),
                          trunc_ts("HOUR", "ts").alias("timestamp"))
                 .agg((F.sum("value") / 100).alias("energy_sold_mwh"),
                      (F.avg("value") / 4).alias("market_price")))

    @cached_property
    def safety_incidents(self) -> DataFrame:
        if "safety_incidents" in self._frames:
            return self._frames["safety_incidents"]
        e = self._events().filter(F.col("event_type") == "click")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        j = e.join(c, e.user_id == c.c_custkey)
        m4 = F.col("event_id") % 4
        return j.select(
            F.col("event_id").alias("incident_id"),
            F.col("c_nationkey").alias("site_id"),
            (F.col("event_id") % 10).alias("technician_id"),
            F.col("ts").alias("incident_ts"),
            case_value(m4, SEVERITY_BY_MOD4, "serious").alias("severity"),
            (m4 >= 2).alias("lost_time_flag"))

    @cached_property
    def work_orders(self) -> DataFrame:
        if "work_orders" in self._frames:
            return self._frames["work_orders"]
        from ..operators.derive import work_orders_from_events
        return work_orders_from_events(self.outages, self.maintenance_schedule)


_LOADED: dict[tuple[int, str], Tables] = {}
#: tables of the data directory that the logical tables are bound to
SOURCES = ("region", "nation", "customer", "supplier", "events")
#: of these, the one that holds the rows of all facts
FACT_SOURCE = "events"


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Length, number of files and time of each source table (file or folder),
    so that tables derived from them are rebuilt after new data."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in SOURCES:
        p = path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = p.getFileSystem(conf)
        held = fs.getContentSummary(p)
        out.append((held.getLength(), held.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Bound tables of one data directory, memoised per session.

    The frames are lazy plans, so reusing them across queries only saves
    file listing, footer reads and analysis on the driver; a changed source
    is bound anew.
    """
    key = (id(getattr(spark, "_jsparkSession", spark)), sf_dir)
    t, state = _LOADED.get(key), source_state(spark, sf_dir)
    if t is None or t.spark is not spark or t.state != state:
        t = _LOADED[key] = Tables(spark, sf_dir)
        t.state = state
    return t


def source_files(spark: SparkSession, sf_dir: str) -> dict[str, dict]:
    """``{file: (length, time)}`` of the fact and of the dimension files."""
    files, root = Files(spark), sf_dir.rstrip("/")
    dims = {f: s for n in SOURCES if n != FACT_SOURCE for f, s in files.states(f"{root}/{n}.parquet").items()}
    return {"facts": files.states(f"{root}/{FACT_SOURCE}.parquet"), "dimensions": dims}


def load_files(spark: SparkSession, sf_dir: str, fact_files: list[str]) -> Tables:
    """The logical tables over some of the fact files."""
    t = Tables(spark, sf_dir)
    t._raw[FACT_SOURCE] = read_files(spark, fact_files)
    return t
