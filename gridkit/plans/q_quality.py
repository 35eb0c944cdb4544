"""Registered quality queries (v01-v04) and sink round trips (s04, s05)."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import rollups as R
from ..session import scratch_path
from ..sources import sinks
from ..sources.bindings import LOGICAL_TABLES, load
from . import q_metrics as M
from .oracle_sql import with_bindings
from .q_rollups import ADS_CTES
from .registry import register

_FK_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{ck}' AS \"column\", '{p}' AS parent, COUNT(*) AS orphans "
    f"FROM {c} ch LEFT JOIN {p} pa ON ch.{ck} = pa.{pk} WHERE pa.{pk} IS NULL AND ch.{ck} IS NOT NULL"
    for c, ck, p, pk in Q.FK_CHECKS)


@register("v01_fk_orphans", with_bindings(_FK_SQL))
def v01(spark, d):
    return Q.fk_orphans(load(spark, d))


@register("v02_row_counts", with_bindings(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in LOGICAL_TABLES)))
def v02(spark, d):
    return Q.row_counts(load(spark, d))


# v03: the first row of each view's all-measures validation query.
_STATUS_QUERIES = [
    ("grid_operations_metrics", "x01_grid_by_asset_type", M.GO_MEASURES),
    ("financial_performance_metrics", "x05_fin_by_region", M.FIN_MEASURES),
    ("maintenance_workforce_metrics", "x09_maint_by_type", M.MW_MEASURES),
    ("executive_summary_metrics", "x14_exec_by_region", M.EX_MEASURES),
]


def _v03_sql():
    spec = {n: (v, d, m, o, lim) for n, v, d, m, o, lim in M.VALIDATION}
    ctes, seen, parts = [], set(), []
    for i, (view, qname, measures) in enumerate(_STATUS_QUERIES):
        v, dims, ms, order, _ = spec[qname]
        body, extra = M.metric_parts(v, dims, ms, order_by=order, limit=1)
        for n, q in extra:
            if n not in seen:
                seen.add(n)
                ctes.append((n, q))
        ctes.append((f"first_{i}", body))
        ctes.append((f"vals_{i}", " UNION ALL ".join(
            f"SELECT '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM first_{i}"
            for m in measures)))
        names = " UNION ALL ".join(f"SELECT '{m}' AS measure" for m in measures)
        parts.append(
            f"SELECT '{view}' AS view, n.measure, v.value, CASE WHEN v.measure IS NULL THEN 'EMPTY' "
            f"WHEN v.value IS NULL THEN 'NULL' WHEN v.value = 0 THEN 'ZERO' ELSE 'OK' END AS status "
            f"FROM ({names}) n LEFT JOIN vals_{i} v ON n.measure = v.measure")
    return " UNION ALL ".join(parts), ctes


def _status(spark, d):
    t = load(spark, d)
    spec = {n: (v, dd, m, o, lim) for n, v, dd, m, o, lim in M.VALIDATION}
    first = {}
    for view, qname, measures in _STATUS_QUERIES:
        v, dims, ms, order, _ = spec[qname]
        first[view] = (partial(M.views()[v].query, t, dims, ms, order_by=order, limit=1), measures)
    return Q.measure_status(first)


_V03_BODY, _V03_CTES = _v03_sql()


@register("v03_measure_status", with_bindings(_V03_BODY, _V03_CTES))
def v03(spark, d):
    return _status(spark, d)


@register("v04_status_summary", with_bindings(f"""
SELECT view, COUNT(*) FILTER (WHERE status = 'OK') AS ok,
       COUNT(*) FILTER (WHERE status IN ('NULL','ZERO','EMPTY')) AS warn,
       COUNT(*) FILTER (WHERE status = 'ERROR') AS error, COUNT(*) AS measures
FROM ({_V03_BODY}) GROUP BY view""", _V03_CTES))
def v04(spark, d):
    return Q.status_summary(_status(spark, d))


@register("s04_ctas_asset_daily", with_bindings("SELECT * FROM asset_daily_summary", ADS_CTES))
def s04(spark, d):
    """Materialise the asset-day rollup (partitioned by date) and scan it back."""
    import uuid
    path = scratch_path(spark, f"asset_daily_summary-{uuid.uuid4().hex[:8]}")
    return sinks.create_table_as(spark, R.asset_daily_summary(load(spark, d)), path,
                                 partition_by=["date"])


@register("s05_temp_view_sql", with_bindings("""
SELECT outage_reason, COUNT(*) AS n_outages, ROUND(esum(lost_generation_mwh), 0) AS total_lost_mwh
FROM outages WHERE forced_outage_flag GROUP BY outage_reason"""))
def s05(spark, d):
    """The same kind of report through temp views and ``spark.sql``."""
    sinks.register_views(load(spark, d), ["outages"])
    return spark.sql("""
        SELECT outage_reason, COUNT(*) AS n_outages,
               CAST(ROUND(SUM(CAST(lost_generation_mwh AS DECIMAL(28, 9))), 0) AS DOUBLE) AS total_lost_mwh
        FROM outages WHERE forced_outage_flag GROUP BY outage_reason""")


def _scratch(spark, name):
    import uuid
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


@register("s02_overwrite_table", with_bindings("SELECT outage_id, asset_id, lost_generation_mwh FROM outages"))
def s02(spark, d):
    """Overwrite a table with another schema and scan it back."""
    t, path = load(spark, d), _scratch(spark, "s02")
    sinks.write_table(t.sites, path)
    sinks.write_table(t.outages.select("outage_id", "asset_id", "lost_generation_mwh"), path)
    return sinks.read_table(spark, path)


@register("s03_append_table", with_bindings("""
SELECT asset_id, outage_start_ts AS ts, 'outage' AS kind FROM outages
UNION ALL SELECT asset_id, created_ts, 'work order' FROM work_orders"""))
def s03(spark, d):
    """Append two sources to one table, one of them sent twice, and scan it back."""
    t, path = load(spark, d), _scratch(spark, "s03")
    for df, ts, kind in ((t.outages, "outage_start_ts", "outage"), (t.work_orders, "created_ts", "work order"),
                         (t.outages, "outage_start_ts", "outage")):
        sinks.write_table(df.select("asset_id", F.col(ts).alias("ts"), F.lit(kind).alias("kind")), path, "append",
                          batch=kind)
    return sinks.read_table(spark, path)



# Comments of the s06 round trip; the quote tests the escaping.
SITE_COMMENT = "Sites and what each can generate"
SITE_COLUMNS = {"site_id": "the site's number", "capacity_mw": "nameplate capacity in MW"}


@register("s06_catalog_comments", with_bindings("""
SELECT c.col_name, c.comment, (SELECT count(*) FROM sites) AS n_rows
FROM (VALUES ('sites_commented', 'Sites and what each can generate'), ('site_id', 'the site''s number'),
             ('capacity_mw', 'nameplate capacity in MW')) AS c(col_name, comment)"""))
def s06(spark, d):
    """A catalog table of the sites with comments, read back from the catalog."""
    import uuid
    table = f"sites_commented_{uuid.uuid4().hex[:8]}"
    load(spark, d).sites.write.option("path", _scratch(spark, "s06")).saveAsTable(table)
    said = sinks.comment_table(spark, table, SITE_COMMENT, SITE_COLUMNS)
    n = spark.table(table).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_all", F.lit(1))
    name = F.when(F.col("col_name") == table, "sites_commented").otherwise(F.col("col_name"))
    return (said.select(name.alias("col_name"), "comment", F.lit(1).alias("_all"))
            .join(F.broadcast(n), "_all").drop("_all"))


@register("s07_json_extract", with_bindings("""
SELECT outage_id, strftime(outage_start_ts, '%Y-%m-%dT%H:%M:%S') AS outage_start_ts,
       strftime(CAST(outage_start_ts AS DATE), '%Y-%m-%d') AS outage_date, forced_outage_flag, outage_reason
FROM outages"""))
def s07(spark, d):
    """Outages as JSON lines with ISO dates, read back as text fields."""
    path = _scratch(spark, "s07")
    sinks.write_json_extract(load(spark, d).outages.select(
        "outage_id", "outage_start_ts", F.to_date("outage_start_ts").alias("outage_date"),
        "forced_outage_flag", "outage_reason"), path)
    return spark.read.schema("outage_id long, outage_start_ts string, outage_date string, "
                             "forced_outage_flag boolean, outage_reason string").json(path)


_JOINED = [(v.name, path, j.table, j.key) for v in M.views().values() for path, j in v.all_joins()]


@register("v05_join_keys", with_bindings(" UNION ALL ".join(
    f"SELECT '{view}' AS view, '{path}' AS \"join\", count(*) AS repeated_keys FROM "
    f"(SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    for view, path, table, key in _JOINED)))
def v05(spark, d):
    """Keys that a many-to-one join of a metric view would multiply, per join."""
    t = load(spark, d)
    parts = []
    for v in M.views().values():
        for path, _ in v.all_joins():
            parts.append(v.repeated_keys(t, path).agg(F.count(F.lit(1)).alias("repeated_keys"))
                         .select(F.lit(v.name).alias("view"), F.lit(path).alias("join"), "repeated_keys"))
    return reduce(DataFrame.unionByName, parts)


#: a task writes and reads about so many files: what they cost follows their number, not their bytes
FILES_A_TASK = 2000


@register("s09_corpus_read", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS md5
FROM documents WHERE text IS NOT NULL""")
def s09(spark, d):
    """Every document as a file of its own, read back: files of more than 32 KB in parts."""
    table, path = spark.read.parquet(f"{d}/documents.parquet"), _scratch(spark, "s09")
    # as many as all rows need: their number is known without the texts
    tasks = max(1, -(-table.count() // FILES_A_TASK))
    # a folder per writing task; rows of one id share a file
    sinks.write_corpus(table.where("text IS NOT NULL").select("doc_id", "text"), path, tasks)
    read = sinks.read_corpus(spark, path, sinks.CORPUS_FILES, large=32 << 10, name=sinks.CORPUS_NAME, tasks=tasks)
    # the writer ended each file with a line feed, which parts are without
    whole = read.where("NOT cut").select("doc_id", F.substring("text", F.lit(1), F.length("text") - 1).alias("text"))
    # a part is at most 32 KB, so a document's parts are few
    inside = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = read.where("cut").groupBy("doc_id").agg(
        F.array_join(F.transform(inside, lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))
