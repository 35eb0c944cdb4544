"""Values of intervals spread over the steps they cover, without a row per interval and
step.

Each interval adds its rate at its first step and takes it back after its last; the
running sum of these changes is the total of a step.  Changes are summed per step
before the shuffle.  Time is cut into chunks of ``chunk`` steps: a chunk's carry is the
sum of all changes in earlier chunks (from one row per key and chunk), and inside a
chunk the running sum is a window over at most ``chunk`` change points.  So shuffled
rows follow the number of intervals (and of chunks a key is covered in), whatever their
lengths; the steps of a stretch without a change are written out last, in place.

Rates are summed as exact decimals: after the last interval of a stretch nothing is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = "decimal(38,12)"


def spread(df: DataFrame, keys: Sequence[str], start: Column, stop: Column, value: str,
           chunk: int = 64) -> DataFrame:
    """(keys, step, total): every row gives ``value / (stop - start)`` to each whole step
    in [start, stop); only covered steps have a row.  Rows whose interval is empty or
    null are left out; a step covered by null values alone has a null total."""
    keys = list(keys)
    rate = (F.col(value) / (F.col("_b") - F.col("_a"))).cast(RATE)
    rows = (df.select(*keys, value, start.cast("long").alias("_a"), stop.cast("long").alias("_b"))
            .where("_b > _a").select(*keys, "_a", "_b", F.coalesce(rate, F.lit(0).cast(RATE)).alias("_rate"),
                                     F.col(value).isNotNull().cast("long").alias("_known")))
    ends = F.array(*[F.struct(F.col(at).alias("step"), (F.col("_rate") * sign).cast(RATE).alias("d_rate"),
                              F.lit(sign).cast("long").alias("d_n"), (F.col("_known") * sign).alias("d_known"))
                     for at, sign in (("_a", 1), ("_b", -1))])
    deltas = ("d_rate", "d_n", "d_known")
    change = (rows.select(*keys, F.inline(ends))
              .groupBy(*keys, F.floor(F.col("step") / chunk).alias("_c"), "step")
              .agg(*[F.sum(d).cast(RATE if d == "d_rate" else "long").alias(d) for d in deltas]))
    # one row per key and chunk that has changes, with what earlier chunks leave running
    per_chunk = change.groupBy(*keys, "_c").agg(*[F.sum(d).alias(d) for d in deltas])
    by_key = Window.partitionBy(*keys).orderBy("_c")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carry = per_chunk.select(
        *keys, "_c", F.lead("_c").over(by_key).alias("_next"),
        *[F.coalesce(F.sum(d).over(before), zero).alias(f"_in_{d}") for d in deltas],
        *[F.sum(d).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_out_{d}") for d in deltas])
    # chunks without a change in the middle of an interval
    between = carry.where((F.col("_out_d_n") > 0) & (F.col("_next") > F.col("_c") + 1)).select(
        *keys, F.explode(F.sequence(F.col("_c") + 1, F.col("_next") - 1)).alias("_c"),
        *[F.col(f"_out_{d}").alias(d) for d in deltas])
    openings = carry.select(*keys, "_c", *[F.col(f"_in_{d}").alias(d) for d in deltas]).unionByName(between)
    points = change.unionByName(openings.select(
        *keys, "_c", (F.col("_c") * chunk).alias("step"), *deltas), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_c").orderBy("step")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = points.select(
        *keys, "step", F.coalesce(F.lead("step").over(inside), (F.col("_c") + 1) * chunk).alias("_end"),
        *[F.sum(d).over(upto).alias(d) for d in deltas]).where((F.col("d_n") > 0) & (F.col("_end") > F.col("step")))
    return runs.select(*keys, F.explode(F.sequence(F.col("step"), F.col("_end") - 1)).alias("step"),
                       F.when(F.col("d_known") > 0, F.col("d_rate").cast("double")).alias("total"))
