"""Data-quality queries: FK orphans (v01), row counts (v02), measure
status report over the metric views (v03) and its summary (v04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bindings import LOGICAL_TABLES

# The 15 foreign keys checked (child, column, parent, key).
FK_CHECKS = [
    ("sites", "region_id", "regions", "region_id"),
    ("assets", "site_id", "sites", "site_id"),
    ("technicians", "region_id", "regions", "region_id"),
    ("telemetry", "asset_id", "assets", "asset_id"),
    ("sensor_anomalies", "asset_id", "assets", "asset_id"),
    ("outages", "asset_id", "assets", "asset_id"),
    ("outages", "site_id", "sites", "site_id"),
    ("work_orders", "asset_id", "assets", "asset_id"),
    ("work_orders", "technician_id", "technicians", "technician_id"),
    ("market_prices", "region_id", "regions", "region_id"),
    ("maintenance_schedule", "asset_id", "assets", "asset_id"),
    ("asset_financials", "asset_id", "assets", "asset_id"),
    ("power_sales", "site_id", "sites", "site_id"),
    ("safety_incidents", "site_id", "sites", "site_id"),
    ("safety_incidents", "technician_id", "technicians", "technician_id"),
]


def fk_orphans(tables, checks=FK_CHECKS) -> DataFrame:
    """v01: child rows whose non-NULL key has no parent, per FK.

    Checks against the same parent key are answered together: the child
    keys of those checks are unioned (tagged with the check) and counted per
    (check, key) before anything is shuffled, so a hot key is one row; the
    counts are probed with one left-anti join against the parent and summed
    per check.  Checks without orphans report 0.
    """
    from collections import defaultdict

    spark = tables["regions"].sparkSession
    by_parent = defaultdict(list)
    for i, (child, ck, parent, pk) in enumerate(checks):
        by_parent[(parent, pk)].append((i, child, ck))
    counts = []
    for (parent, pk), items in by_parent.items():
        keys = reduce(DataFrame.unionByName, [
            tables[child].select(F.lit(i).alias("check"), F.col(ck).cast("long").alias("_k"))
            .filter(F.col("_k").isNotNull()) for i, child, ck in items])
        p = tables[parent].select(F.col(pk).cast("long").alias("_k"))
        held = keys.groupBy("check", "_k").agg(F.count(F.lit(1)).alias("_n"))
        counts.append(held.join(p, "_k", "left_anti").groupBy("check")
                      .agg(F.sum("_n").alias("orphans")))
    found = reduce(DataFrame.unionByName, counts)
    meta = spark.createDataFrame([(i, c, ck, p) for i, (c, ck, p, _) in enumerate(checks)],
                                 "check int, child string, column string, parent string")
    return (meta.join(found, "check", "left")
                .select("child", "column", "parent",
                        F.coalesce("orphans", F.lit(0).cast("long")).alias("orphans")))


def row_counts(tables, names=LOGICAL_TABLES) -> DataFrame:
    """v02 / s08: row count of every logical table."""
    parts = [tables[t].agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in names]
    return reduce(DataFrame.unionByName, parts)


def measure_status(first_rows: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """v03: status per measure from the first row of a grouped metric query.

    ``first_rows`` maps view name -> (query result, measure names).  NULL ->
    'NULL', 0 -> 'ZERO', no row -> 'EMPTY', else 'OK'.  In place of a result
    there can be a function that builds it: a view whose query cannot be built
    or analysed reports every measure as 'ERROR' and the others go on.
    """
    parts = []
    for view, (df, measures) in first_rows.items():
        if callable(df):
            try:
                df = df()
                df.schema
            except Exception:  # reported, one row per measure
                spark = SparkSession.active()
                parts.append(spark.createDataFrame([(view, m, None, "ERROR") for m in measures],
                                                   "view string, measure string, value double, status string"))
                continue
        one = df.limit(1)
        stack = "stack({}, {}) AS (measure, value)".format(
            len(measures), ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in measures))
        vals = one.select(F.expr(stack))
        names = one.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
        j = names.join(vals.withColumn("_row", F.lit(True)), "measure", "left")
        status = (F.when(F.col("_row").isNull(), "EMPTY")
                   .when(F.col("value").isNull(), "NULL")
                   .when(F.col("value") == 0, "ZERO").otherwise("OK"))
        parts.append(j.select(F.lit(view).alias("view"), "measure", "value",
                              status.alias("status")))
    return reduce(DataFrame.unionByName, parts)


def status_summary(status: DataFrame) -> DataFrame:
    """v04: OK / WARN / ERROR totals per view."""
    s = F.col("status")
    return status.groupBy("view").agg(
        F.count_if(s == "OK").alias("ok"),
        F.count_if(s.isin("NULL", "ZERO", "EMPTY")).alias("warn"),
        F.count_if(s == "ERROR").alias("error"),
        F.count(F.lit(1)).alias("measures"))
