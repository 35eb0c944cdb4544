"""Event-time replay: drain files in small steps and lose no row to the watermark.

A drain that takes a few files at a time is right only if no row lies behind the
watermark of the files before it.  ``file_ranges`` reads the event time of each file
(one column), ``steps`` puts the files in the order of their earliest time, and
``lateness`` is the most that a file then reaches back behind rows read before it.  The
watermark is held back by that much: files cut by time need nothing, files that mix
all times are held to the end, and every case gives the rows of the whole batch.

A replay is one streaming query with one checkpoint, resumed for each step with that
step's files.  ``close`` ends it: a marker row past all times moves the watermark over
the last rows, so that operators which wait for the watermark give their rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import streams as S

MICROS = 1_000_000


@dataclass(frozen=True)
class FileRange:
    name: str
    low: int   # microseconds since the epoch
    high: int


def file_ranges(spark: SparkSession, folder: str, ts: str = "ts") -> list[FileRange]:
    """Event times per data file, earliest first (files without a time have no rows to
    wait for and come first)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = (spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("name"), at.alias("at"))
            .groupBy("name").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect())  # one a file
    known = [FileRange(r["name"], r["low"], r["high"]) for r in rows if r["low"] is not None]
    empty = [FileRange(r["name"], -(1 << 62), -(1 << 62)) for r in rows if r["low"] is None]
    return sorted(empty, key=lambda f: f.name) + sorted(known, key=lambda f: (f.low, f.high, f.name))


def steps(ranges: Sequence[FileRange], files: int) -> Iterator[list[FileRange]]:
    for i in range(0, len(ranges), files):
        yield list(ranges[i: i + files])


def lateness(ranges: Sequence[FileRange], files: int = 1) -> int:
    """Microseconds that a step's rows lie behind rows of the steps before it, at most."""
    seen, worst = None, 0
    for step in steps(ranges, files):
        low, high = min(f.low for f in step), max(f.high for f in step)
        if seen is not None:
            worst = max(worst, seen - low)
        seen = high if seen is None else max(seen, high)
    return worst


def _held_back(micros: int) -> str:
    return f"{-(-micros // MICROS)} seconds"


def replay(spark: SparkSession, sf_dir: str, build: Callable[..., DataFrame], name: str,
           mode: str = "append", files: int = 1, least_delay: int = 0, close: bool = False,
           table: str = S.EVENTS) -> DataFrame:
    """Drain ``table`` of ``sf_dir`` (a folder of files), ``files`` at a time in the order
    of event time, through ``build(read, delay)``: ``read()`` is the stream of the step
    and ``delay`` the watermark's.  Returns the sink's rows."""
    folder = f"{sf_dir.rstrip('/')}/{table}"
    schema = spark.read.parquet(folder).schema
    ranges = file_ranges(spark, folder)
    delay = max(least_delay * MICROS, lateness(ranges, files))
    tag = f"replay-{name}-{uuid.uuid4().hex[:10]}"
    paths = (scratch_path(spark, f"{tag}/data"), scratch_path(spark, f"{tag}/_checkpoint"))
    marks = scratch_path(spark, f"{tag}/marks")
    if close:
        spark.createDataFrame([], schema).write.parquet(marks)

    def reader(step: Sequence[FileRange]):
        names = "{" + ",".join(f.name for f in step) + "}"

        def read() -> DataFrame:
            s = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
            if close:
                s = s.unionByName(spark.readStream.schema(schema).parquet(marks))
            return s.withColumn("ts", F.col("ts").cast("timestamp"))
        return read

    out = None
    for step in steps(ranges, files):
        out = S.run_available_now(spark, build(reader(step), _held_back(delay)), name, mode, paths)
    if close and ranges:
        end = max(f.high for f in ranges) + 2 * delay + 10 * 365 * 86400 * MICROS
        end = end // 1000 * 1000 + 1  # the watermark, in whole milliseconds, never passes the marker itself
        mark = F.timestamp_micros(F.lit(end)).cast(schema["ts"].dataType)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else mark.alias("ts") for f in schema]
        spark.range(1).select(*empty).write.mode("append").parquet(marks)
        out = S.run_available_now(spark, build(reader(ranges[-1:]), _held_back(delay)), name, mode, paths)
    return out if out is not None else spark.createDataFrame([], build(reader([]), "0 seconds").schema)
