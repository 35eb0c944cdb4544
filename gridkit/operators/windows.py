"""Rolling-window rules (w02-w07) stated in the operating documents.

Trailing-window aggregates (``trailing``) cut time into chunks, the lookback or a
part of it.  The window ``[t - lookback, t]`` of a row is the part of its own chunk up
to ``t``, the whole chunks before, and the part of one chunk from ``t - lookback`` on.
So each row is copied into the chunk in which it leaves the window, at that time; in a
chunk, a running aggregate forwards over the own rows and one backwards over the copies
meet at every row.  What the whole chunks between hold comes from one summary row per
(entity, chunk), which enters the chunk as a row at its start.  One exchange by (entity,
chunk), linear work per chunk, no pairs and no join back.  The width sets how many rows
of a hot entity meet in one task (``packed_width`` finds it from a bound on rows).
Works for count / sum / min / max (and avg as sum / count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dbl, sum_if

DAY = 86400
# Fixed values of the rules.
FIRST_FIX_DAYS = 90
ESCALATION_COUNT = 3
ESCALATION_LOOKBACK_DAYS = 365
ESCALATION_DUE_DAYS = 30
DEPLOYMENT_COUNT = 5
SUSTAINED_HOURS = 72
SUSTAINED_THRESHOLD = 3.5          # mm/s RMS (other documents: 4.5 / 6.0 / 10.0)
RUNNING_MEAN_HOURS = 24
WEEKLY_HOURS_LIMIT = 60
#: chunk of the rules that look back for months: a hot asset's days meet in one task
CHUNK_DAYS = 5


def _chunk(days: int) -> int:
    """Days of a chunk: ``CHUNK_DAYS`` where it divides the lookback, else the whole."""
    return CHUNK_DAYS if days % CHUNK_DAYS == 0 else days


def _agg(kind: str, c: Column) -> Column:
    return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind](c)


def _merge(kind: str, cols: list[Column]) -> Column:
    if kind in ("count", "sum"):
        zero = F.lit(0) if kind == "count" else None
        parts = [F.coalesce(c, zero) if zero is not None else c for c in cols]
        if kind == "sum":       # NULL only when every part is NULL
            total = F.coalesce(*cols).isNull()
            s = parts[0]
            for c in parts[1:]:
                s = F.coalesce(s, F.lit(0)) + F.coalesce(c, F.lit(0))
            return F.when(~total, s)
        s = parts[0]
        for c in parts[1:]:
            s = s + c
        return s
    return (F.least if kind == "min" else F.greatest)(*cols)


def trailing_on(df: DataFrame, key: str, at: Column, lookback: int,
                aggs: dict[str, tuple[str, Column | str]], width: int | None = None) -> DataFrame:
    """Add ``aggs`` over the rows of ``key`` with ``at`` in ``[at - lookback, at]``.

    ``aggs`` maps output name -> (kind, value) with kind in count / sum /
    min / max; ``value`` is a column (name) evaluated per row (for count,
    rows with a NULL value are not counted).  ``at`` is a whole number.
    ``width`` (a divisor of ``lookback``) is the length of a chunk.
    """
    width = width or lookback
    if lookback % width:
        raise ValueError(f"a chunk of {width} does not divide the lookback of {lookback}")
    parts = lookback // width
    vals = {n: (kind, F.col(v) if isinstance(v, str) else v) for n, (kind, v) in aggs.items()}
    own = df.select("*", at.alias("_e"), *[c.alias(f"_v_{n}") for n, (_, c) in vals.items()])
    x = own.withColumn("_copy", F.explode(F.array(F.lit(False), F.lit(True))))
    copy = F.col("_copy")
    x = (x.withColumn("_chunk", F.floor(F.col("_e") / width) + copy.cast("int") * parts)
          .withColumn("_t", F.col("_e") + copy.cast("int") * F.lit(lookback)))
    if parts > 1:
        summary = own.groupBy(F.col(key).alias(key), F.floor(F.col("_e") / width).alias("_chunk")).agg(
            *[_agg(kind, F.col(f"_v_{n}")).alias(f"_m_{n}") for n, (kind, _) in vals.items()])
        between = Window.partitionBy(key).orderBy("_chunk").rangeBetween(-(parts - 1), -1)
        whole = summary.select(key, "_chunk", (F.col("_chunk") * width).alias("_t"), *[
            _agg("sum" if kind == "count" else kind, F.col(f"_m_{n}")).over(between).alias(f"_m_{n}")
            for n, (kind, _) in vals.items()])
        x = x.unionByName(whole, allowMissingColumns=True)
    part = Window.partitionBy(key, "_chunk")
    span = (Window.unboundedPreceding, Window.currentRow)
    up = part.orderBy("_t").rangeBetween(*span)
    down = part.orderBy(F.desc("_t")).rangeBetween(*span)
    out = x.select(*df.columns, "_copy", *[
        _merge(kind, [_agg(kind, F.when(~copy, F.col(f"_v_{n}"))).over(up),
                      _agg(kind, F.when(copy, F.col(f"_v_{n}"))).over(down),
                      *([F.max(f"_m_{n}").over(up)] if parts > 1 else [])]).alias(n)
        for n, (kind, _) in vals.items()])
    return out.filter(~copy).drop("_copy")


#: rows of one entity that a task of a trailing window should hold at most
ROWS_PER_CHUNK = 1_000_000


def packed_width(df: DataFrame, key: str, at: Column, lookback: int, rows: int = ROWS_PER_CHUNK) -> int:
    """The longest chunk (a divisor of ``lookback``) of which the fullest lookback of any
    ``key`` makes parts of about ``rows`` rows, if they lie evenly."""
    most = (df.groupBy(F.col(key), F.floor(at / lookback).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n")).first()[0] or 0)
    parts = max(1, -(-most // rows))
    while lookback % parts:
        parts += 1
    return lookback // parts


def trailing(df: DataFrame, key: str, ts: str, lookback_s: int,
             aggs: dict[str, tuple[str, Column | str]], width: int | None = None) -> DataFrame:
    """``trailing_on`` in whole epoch seconds of the timestamp ``ts``."""
    return trailing_on(df, key, F.unix_timestamp(F.col(ts)), lookback_s, aggs, width)


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def first_time_fix(tables, days: int = FIRST_FIX_DAYS) -> DataFrame:
    """w02: share of emergency repairs not followed by a forced outage on the
    same asset within ``days`` after the work order was created: backwards in
    time, the latest outage of the window is after the repair."""
    em = (tables["work_orders"].filter(F.col("work_order_type") == "emergency")
          .select("asset_id", micros("created_ts").alias("_at"), F.lit(True).alias("_repair")))
    fo = (tables["outages"].filter(F.col("forced_outage_flag"))
          .select("asset_id", micros("outage_start_ts").alias("_at"), F.lit(False).alias("_repair")))
    seen = trailing_on(em.unionByName(fo), "asset_id", -F.col("_at"), days * DAY * 1_000_000,
                       {"_last": ("max", F.when(~F.col("_repair"), F.col("_at")))},
                       _chunk(days) * DAY * 1_000_000)
    fixed = F.coalesce(F.col("_last") <= F.col("_at"), F.lit(True))
    return seen.filter("_repair").agg(
        F.count(F.lit(1)).alias("emergency_repairs"),
        sum_if(fixed).alias("fixed_first_time"),
        (dbl(100) * sum_if(fixed) / F.count(F.lit(1))).alias("first_time_fix_pct"))


def third_outage_escalation(tables, n: int = ESCALATION_COUNT,
                            lookback_days: int = ESCALATION_LOOKBACK_DAYS,
                            due_days: int = ESCALATION_DUE_DAYS) -> DataFrame:
    """w03: per asset, the first forced outage that is the n-th within the
    trailing window, the escalation due date, and the days from the first
    outage of that window to the escalation."""
    fo = (tables["outages"].filter(F.col("forced_outage_flag"))
          .select("asset_id", "outage_id", "outage_start_ts"))
    c = trailing(fo, "asset_id", "outage_start_ts", lookback_days * DAY,
                 {"n_trailing": ("count", F.lit(1)),
                  "_first_e": ("min", F.unix_timestamp("outage_start_ts"))}, _chunk(lookback_days) * DAY)
    c = c.withColumn("window_first_ts", F.timestamp_seconds("_first_e").cast("timestamp_ntz"))
    esc = c.filter(F.col("n_trailing") >= n)
    first = esc.groupBy("asset_id").agg(
        F.min(F.struct("outage_start_ts", "outage_id", "window_first_ts")).alias("e"))
    return first.select(
        "asset_id", F.col("e.outage_id").alias("escalation_outage_id"),
        F.col("e.outage_start_ts").alias("escalation_ts"),
        F.date_add(F.to_date("e.outage_start_ts"), due_days).alias("due_date"),
        F.datediff(F.to_date("e.outage_start_ts"), F.to_date("e.window_first_ts"))
        .alias("days_to_escalation"))


def trailing_deployments(tables, lookback_days: int = ESCALATION_LOOKBACK_DAYS,
                         n: int = DEPLOYMENT_COUNT) -> DataFrame:
    """w04: emergency work orders per asset in the trailing 12 months, with
    the flag for the n-th (or later) deployment."""
    em = (tables["work_orders"].filter(F.col("work_order_type") == "emergency")
          .select("work_order_id", "asset_id", "created_ts"))
    c = trailing(em, "asset_id", "created_ts", lookback_days * DAY,
                 {"trailing_12m_count": ("count", F.lit(1))}, _chunk(lookback_days) * DAY)
    return c.select("work_order_id", "asset_id", "created_ts", "trailing_12m_count",
                    (F.col("trailing_12m_count") >= n).alias("at_or_over_limit"))


def sustained_exceedance(tables, column: str = "vibration",
                         threshold: float = SUSTAINED_THRESHOLD,
                         hours: int = SUSTAINED_HOURS,
                         coverage_gap_hours: float = 1.0) -> DataFrame:
    """w05: a reading is a sustained exceedance when the running minimum
    over the trailing ``hours`` is at or above ``threshold`` and the asset
    has a reading within ``coverage_gap_hours`` of the window start (the
    window is covered)."""
    t = tables["telemetry"].select("telemetry_id", "asset_id", "timestamp", column)
    c = trailing(t, "asset_id", "timestamp", hours * 3600,
                 {"window_min": ("min", column),
                  "_first_e": ("min", F.unix_timestamp("timestamp"))})
    covered = ((F.unix_timestamp("timestamp") - F.col("_first_e")) / dbl(3600)
               >= dbl(hours - coverage_gap_hours))
    return c.select("telemetry_id", "asset_id", "timestamp", "window_min",
                    ((F.col("window_min") >= threshold) & covered).alias("sustained"))


def running_mean(tables, column: str = "vibration", hours: int = RUNNING_MEAN_HOURS) -> DataFrame:
    """w06: trailing ``hours`` running mean of a telemetry column."""
    t = tables["telemetry"].select("telemetry_id", "asset_id", "timestamp", column)
    c = trailing(t, "asset_id", "timestamp", hours * 3600,
                 {"_sum": ("sum", column), "_n": ("count", column),
                  "n_readings": ("count", F.lit(1))})
    return c.select("telemetry_id", "asset_id", "timestamp", column,
                    (F.col("_sum") / F.when(F.col("_n") > 0, F.col("_n"))).alias("running_mean"),
                    "n_readings")


def workload_streaks(tables, weekly_limit: float = WEEKLY_HOURS_LIMIT) -> DataFrame:
    """w07: per technician, the longest run of consecutive working days and
    the number of weeks over ``weekly_limit`` labour hours.

    Gaps-and-islands on the distinct working days: ``date - row_number``
    is constant inside a run.  The window input is one row per technician
    day, so its size is bounded by the calendar, not by the work volume.
    """
    w = tables["work_orders"].select("technician_id", F.to_date("created_ts").alias("day"),
                                     "labor_hours")
    days = w.groupBy("technician_id", "day").agg(F.sum("labor_hours").alias("hours"))
    rn = F.row_number().over(Window.partitionBy("technician_id").orderBy("day"))
    isl = days.withColumn("_grp", F.date_sub(F.col("day"), rn.cast("int")))
    runs = isl.groupBy("technician_id", "_grp").agg(F.count(F.lit(1)).alias("run_days"))
    longest = runs.groupBy("technician_id").agg(F.max("run_days").alias("longest_streak_days"))
    weeks = (days.groupBy("technician_id", F.date_trunc("WEEK", "day").alias("_wk"))
                 .agg(F.sum("hours").alias("week_hours"))
                 .groupBy("technician_id")
                 .agg(sum_if(F.col("week_hours") > weekly_limit).alias("weeks_over_limit"),
                      F.max("week_hours").alias("max_week_hours")))
    return longest.join(weeks, "technician_id")


def cumulative_sums(df: DataFrame, key: str, epoch_col: str, order: list, sums: dict[str, str],
                    chunk_s: int = DAY) -> DataFrame:
    """Running sums (output name -> column) per ``key`` in the total order
    ``order`` (which starts with ``epoch_col``), inclusive of the row itself.

    Chunked prefix sum: running sum inside each (key, time chunk) plus the
    sum of all earlier chunks from per-chunk summaries (windowed per key,
    at most one row per key and chunk) -- no task sees a key's whole
    history.
    """
    x = df.withColumn("_c", F.floor(F.col(epoch_col) / chunk_s))
    w_in = (Window.partitionBy(key, "_c").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_prev = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    whole = x.groupBy(key, "_c").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    prev = whole.select(key, "_c", *[F.coalesce(F.sum(f"_s_{n}").over(w_prev), F.lit(0)).alias(f"_p_{n}")
                                     for n in sums])
    x = x.withColumns({f"_r_{n}": F.sum(c).over(w_in) for n, c in sums.items()})
    return x.join(prev, [key, "_c"]).select(
        *df.columns, *[(F.col(f"_p_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums])


def cumulative_sum(df: DataFrame, key: str, epoch_col: str, order: list, value: str,
                   out: str, chunk_s: int = DAY) -> DataFrame:
    return cumulative_sums(df, key, epoch_col, order, {out: value}, chunk_s)


def merged_outages(tables) -> DataFrame:
    """Q5 variant: overlapping (or touching) outages of an asset merged into
    one interval, with the outages and lost MWh they cover.

    Sweep: +1 at each start, -1 at each end (starts before ends at equal
    times, so touching intervals merge).  An island starts where the
    running count before a +1 is 0; the island number of every event is
    the running count of island starts.  Both running sums are chunked
    prefix sums, so a hot asset is never one task.
    """
    o = tables["outages"].select("asset_id", "outage_id", "outage_start_ts", "outage_end_ts",
                                 "lost_generation_mwh")
    starts = o.select("asset_id", "outage_id", F.col("outage_start_ts").alias("ts"),
                      F.lit(0).alias("_ord"), F.lit(1).alias("_d"), "lost_generation_mwh")
    ends = o.select("asset_id", "outage_id", F.col("outage_end_ts").alias("ts"),
                    F.lit(1).alias("_ord"), F.lit(-1).alias("_d"),
                    F.lit(None).cast("double").alias("lost_generation_mwh"))
    ev = starts.unionByName(ends).withColumn("_e", F.unix_micros(F.col("ts").cast("timestamp")))
    order = ["_e", "_ord", "outage_id"]
    ev = cumulative_sum(ev, "asset_id", "_e", order, "_d", "_open", chunk_s=DAY * 1_000_000)
    ev = ev.withColumn("_start", ((F.col("_d") == 1) & (F.col("_open") == 1)).cast("int"))
    ev = cumulative_sum(ev, "asset_id", "_e", order, "_start", "_island", chunk_s=DAY * 1_000_000)
    g = ev.groupBy("asset_id", "_island").agg(
        F.min(F.when(F.col("_d") == 1, F.col("ts"))).alias("merged_start"),
        F.max(F.when(F.col("_d") == -1, F.col("ts"))).alias("merged_end"),
        F.count_if(F.col("_d") == 1).alias("outages"),
        F.sum("lost_generation_mwh").alias("lost_mwh"))
    return g.select("asset_id", "merged_start", "merged_end", "outages", "lost_mwh",
                    ((F.unix_timestamp("merged_end") - F.unix_timestamp("merged_start")) / dbl(3600))
                    .alias("downtime_hours"))
