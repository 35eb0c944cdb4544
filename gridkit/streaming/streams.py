"""Structured Streaming forms of the alarm filter, the daily rollup, the
anomaly -> outage interval join and the TTL de-duplication.

Sources are file streams over the events parquet; event time is cast from
zone-less to TIMESTAMP (watermarks need it).  Sinks are parquet folders
with checkpoints under the shared ``spark.checkpoint.dir``, so a restarted
query resumes exactly-once from its checkpoint.  ``run_available_now``
drains everything currently in the source and stops (batch-equivalent
runs, used by tests and the registered queries).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sum_if
from ..session import scratch_path

EVENTS = "events.parquet"


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None,
                 name: str = EVENTS, schema=None) -> DataFrame:
    """Streaming read of the table ``name`` in ``sf_dir``: one file, a folder of
    part files, or a glob (schema taken from the files unless given).

    Without ``files_per_trigger`` a drain takes all files that are there in one
    micro-batch.  The watermark moves between micro-batches only, so the drain
    is complete whatever order the files are in; with a limit, rows behind the
    watermark of earlier files are late and dropped.
    """
    folder, path = sf_dir.rstrip("/"), f"{sf_dir.rstrip('/')}/{name}"
    if schema is None:
        schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema)
    if "*" in name or _is_file(spark, path):  # a file source takes folders
        s, path = s.option("pathGlobFilter", name), folder
    if files_per_trigger:
        s = s.option("maxFilesPerTrigger", files_per_trigger)
    return s.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def alarm_stream(events: DataFrame, temp_limit: float = 70.0, vib_limit: float = 4.0) -> DataFrame:
    """st01: telemetry readings that raise an alarm (stateless filter)."""
    k = F.col("event_id") % 100
    temp = F.col("value") / 5
    vib = k / F.lit(20.0)
    return (events.select(F.col("event_id").alias("telemetry_id"),
                          F.col("user_id").alias("asset_id"), F.col("ts").alias("timestamp"),
                          temp.alias("temperature"), vib.alias("vibration"))
            .filter((F.col("temperature") > temp_limit) | (F.col("vibration") > vib_limit)))


def daily_rollup_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """st02: tumbling one-day rollup per asset with a watermark."""
    k = F.col("event_id") % 100
    temp = F.col("value") / 5
    vib = k / F.lit(20.0)
    alarm = (temp > 70) | (vib > 4)
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), F.col("user_id").alias("asset_id"))
            .agg(F.count(F.lit(1)).alias("readings"), F.avg(temp).alias("avg_temperature"),
                 F.max(vib).alias("max_vibration"), sum_if(alarm).alias("alarm_count")))


def anomaly_outage_join_stream(events_a: DataFrame, events_o: DataFrame, customers: DataFrame,
                               hours: int = 48, watermark: str = "48 hours") -> DataFrame:
    """st03: stream-stream inner join anomaly -> forced outage on the same
    asset starting within ``hours`` after the anomaly.  Watermarks on both
    sides plus the time-range condition bound the join state."""
    an = (events_a.filter(F.col("event_type") == "error")
          .select(F.col("event_id").alias("anomaly_id"), F.col("user_id").alias("a_asset"),
                  F.col("ts").alias("anom_ts"))
          .withWatermark("anom_ts", watermark))
    cust = customers.select(F.col("c_custkey").alias("o_asset"))
    ou = (events_o.filter((F.col("event_type") == "purchase") & (F.col("event_id") % 4 < 2))
          .select(F.col("event_id").alias("outage_id"), F.col("user_id").alias("o_asset"),
                  F.col("ts").alias("outage_start_ts"))
          .join(cust, "o_asset")
          .withWatermark("outage_start_ts", watermark))
    cond = ((F.col("a_asset") == F.col("o_asset"))
            & (F.col("outage_start_ts") >= F.col("anom_ts"))
            & (F.col("outage_start_ts") <= F.col("anom_ts") + F.expr(f"INTERVAL {hours} HOURS")))
    j = an.join(ou, F.expr("a_asset = o_asset") & cond, "inner")
    return j.select("anomaly_id", "outage_id", F.col("a_asset").alias("asset_id"),
                    ((F.unix_timestamp("outage_start_ts") - F.unix_timestamp("anom_ts")) / 3600)
                    .cast("int").alias("lag_hours"))


TTL_SECONDS = 3600


def _stores(ttl_us: int):
    """State per key: the time of the last stored event."""

    def run(key, frames, state):
        import numpy as np
        import pandas as pd
        times = [f["ts"].to_numpy(dtype="datetime64[us]").astype("int64") for f in frames]
        times = np.unique(np.concatenate(times))
        last = state.get[0] if state.exists else None
        kept, at = [], 0
        while True:  # from one stored event to the first one past its lifetime
            if last is not None:
                at = int(np.searchsorted(times, last + ttl_us, side="right"))
            if at >= len(times):
                break
            last = int(times[at])
            kept.append(last)
        if kept:
            state.update((last,))
        yield pd.DataFrame({**{f"k{i}": [k] * len(kept) for i, k in enumerate(key)},
                            "ts": np.array(kept, "int64").astype("datetime64[us]")})
    return run


def ttl_dedupe_stream(events: DataFrame, keys=("user_id", "event_type"),
                      ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """st04: an event is stored unless its key was stored at most the TTL before;
    repeats inside the TTL are dropped and do not refresh the stored time.

    The state of a key is one time; a micro-batch hands a key's times over as
    Arrow chunks (8 bytes a row, no other columns).
    """
    rows = events.select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"))
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([f"k{i} {t}" for i, t in enumerate(kinds)] + ["ts timestamp_ntz"])
    out = rows.groupBy(*keys).applyInPandasWithState(
        _stores(ttl_seconds * 1_000_000), schema, "last long", "append", "NoTimeout")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "ts")


#: states of ``ttl_expiring_stream``: each holds the keys of one hash
BUCKETS = 4096


def _expiring(ttl_us: int):
    """State per bucket of keys, as an Arrow table: the last stored time of its keys, and
    times that the watermark has not passed."""

    def run(key, frames, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        names, times, stored = [], [], []
        if state.exists:
            held = pa.ipc.open_stream(state.get[0]).read_all()
            names.append(held.column("name").to_pandas())
            times.append(held.column("at").to_numpy())
            stored.append(held.column("stored").to_numpy())
        if not state.hasTimedOut:
            for f in frames:
                names.append(f["name"])
                times.append(f["ts"].to_numpy(dtype="datetime64[us]").astype("int64"))
                stored.append(np.zeros(len(f), bool))
        if not names:
            return
        code, name = pd.factorize(pd.concat(names, ignore_index=True))
        at, was = np.concatenate(times), np.concatenate(stored)
        passed = state.getCurrentWatermarkMs() * 1000
        last = dict(zip(code[was].tolist(), at[was].tolist()))
        ready = ~was & (at <= passed)
        order = np.lexsort((at[ready], code[ready]))
        kept_code, kept_at = [], []
        for c, t in zip(code[ready][order].tolist(), at[ready][order].tolist()):
            before = last.get(c)
            if before is None or t > before + ttl_us:
                last[c] = t
                kept_code.append(c)
                kept_at.append(t)
        # called again when the next time can be decided, or when a last one is forgotten
        later = ~was & (at > passed)
        last = {c: t for c, t in last.items() if t + ttl_us > passed}
        wakes = ([int(at[later].min())] if later.any() else []) + [t + ttl_us for t in last.values()]
        if wakes:
            table = pa.table({
                "name": pa.array(name[np.concatenate([code[later], np.array(list(last), "int64")])], pa.string()),
                "at": np.concatenate([at[later], np.array(list(last.values()), "int64")]),
                "stored": np.arange(int(later.sum()) + len(last)) >= int(later.sum())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(-(-min(wakes) // 1000), passed // 1000) + 1)
        elif state.exists:
            state.remove()
        if kept_at:
            yield pd.DataFrame({"name": name[kept_code], "ts": np.array(kept_at, "int64").astype("datetime64[us]")})
    return run


def ttl_expiring_stream(events: DataFrame, keys=("user_id", "event_type"),
                        ttl_seconds: int = TTL_SECONDS, watermark: str = "0 seconds") -> DataFrame:
    """st04 over any number of micro-batches: the rule of ``ttl_dedupe_stream`` in the
    order of event time, whatever the order of arrival within the watermark.

    A time is decided when the watermark has passed it.  Kept for a key are its last
    stored time and the times still waiting; they are dropped once the watermark has passed
    the end of the last one's lifetime, so state follows the keys of one lifetime and
    not those of all time.  Keys share ``BUCKETS`` states by hash, so a micro-batch makes
    that many calls at most, however many keys it has.  A key travels as the JSON text of
    its values; nulls are a value.
    """
    rows = events.where("ts IS NOT NULL").withWatermark("ts", watermark)
    name = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    out = rows.select(name.alias("name"), bucket.alias("bucket"), "ts").groupBy("bucket").applyInPandasWithState(
        _expiring(ttl_seconds * 1_000_000), "name string, ts timestamp_ntz", "held binary", "append",
        "EventTimeTimeout")
    values = F.from_json("name", "array<string>")
    return out.select(*[F.get(values, F.lit(i)).cast(rows.schema[k].dataType).alias(k) for i, k in enumerate(keys)],
                      "ts")


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    tag = f"{name}-{uuid.uuid4().hex[:10]}"
    return scratch_path(spark, f"stream-{tag}/data"), scratch_path(spark, f"stream-{tag}/_checkpoint")


def run_available_now(spark: SparkSession, df: DataFrame, name: str,
                      mode: str = "append", paths: tuple[str, str] | None = None) -> DataFrame:
    """Drain the source into a parquet sink and return a batch scan of it.

    ``append`` writes rows as they become final; ``update`` writes every
    micro-batch's changed rows into its own ``_batch=<id>`` folder, and
    ``latest_versions`` keeps the newest version of each grouping key.
    ``paths`` = (sink, checkpoint) resumes an earlier run exactly-once.
    """
    out, ckpt = paths or _paths(spark, name)
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # one directory per micro-batch, overwritten: a re-executed batch
        # (after a failure) replaces its own output instead of duplicating it
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    # The trailing no-data micro-batch is kept: it is the batch that records
    # the advanced watermark in the offset log, so that a restarted query
    # still drops rows that arrive behind it.
    q = (df.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema.add("_batch", "long")).parquet(out)


def latest_versions(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Reconcile update-mode output: newest row per key."""
    vals = [c for c in updates.columns if c not in keys and c != "_batch"]
    g = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*vals), F.col("_batch")).alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])
