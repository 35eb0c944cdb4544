"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` from a hash of (row id, child) and the least
draw wins, so a child gets rows in proportion to its weight.  A draw depends
on the row and the child alone: when a weight changes, rows move only into or
out of the child that it belongs to, on each level of its path, and all other
subtrees keep their rows in place.

Edge cases: a null id is hashed as a value of its own (all such rows share a
shard), a null text has size 1 and crc 0, rows that repeat an id share its
shard and take slots of their own; equal draws go to the child named first; very long
texts count whole; only doc_id and text are read, so other columns may have any name;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 16, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """The first ``base`` shards fill regions of ``racks`` racks of ``per_rack``
    shards; every later shard opens a region of its own, so that it takes rows
    only into itself."""
    leaves = [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(min(n_shards, base))]
    first = leaves[-1].region + 1 if leaves else 0
    return leaves + [Leaf(first + i, 1_000_000 + s, s) for i, s in enumerate(range(base, n_shards))]


def _children(leaves: list[Leaf]) -> dict[tuple, list[tuple[int, float]]]:
    """Path -> its children with the weights of all leaves below them."""
    out: dict[tuple, dict[int, float]] = {}
    for leaf in leaves:
        path = (leaf.region, leaf.rack, leaf.shard)
        for depth in range(3):
            kids = out.setdefault(path[:depth], {})
            kids[path[depth]] = kids.get(path[depth], 0.0) + leaf.weight
    return {k: sorted(v.items()) for k, v in out.items()}


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    h = F.xxhash64(key, F.lit(level), F.lit(child))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
    return F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(child).alias("child"))


def _pick(key: Column, level: int, kids: list[tuple[int, float]]) -> Column:
    live = [(c, w) for c, w in kids if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.least(*[_draw(key, level, c, w) for c, w in live])["child"]


def descend(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """Add the leaf that each row reaches; no shuffle, inside code generation.
    The expressions grow with the number of nodes, not with the data."""
    kids, path, drop = _children(leaves), "", []
    cols = df.columns
    for level in range(3):
        name = f"__{out}_{LEVELS[level]}"
        paths = [p for p in kids if len(p) == level]
        expr = None
        for p in sorted(paths):
            value = _pick(F.col(key), level, kids[p])
            if level == 0:
                expr = value
            else:  # the parent's name alone tells the path: names are unique per level
                cond = F.col(path) == p[-1]
                expr = F.when(cond, value) if expr is None else expr.when(cond, value)
        df = df.withColumn(name, expr)
        path = name
        drop.append(name)
    return df.select(*cols, F.col(path).cast("int").alias(out))


def number_slots(df: DataFrame, shard: str, key: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """Gapless slots from 0 in each shard, without one task per shard: rows are
    numbered in hash parts of a shard, parts start where the one before ends."""
    spark = df.sparkSession
    n = df.count()
    parts = max(8, -(-n // rows_per_task))
    part = F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(parts)).cast("int")
    df = df.withColumn("__part", part)
    counts = df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("__s"), F.col("__part").alias("__p"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__part").orderBy(key, "size", "text_crc32")
    numbered = df.withColumn("__i", F.row_number().over(within) - 1)
    return (numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p")))
            .withColumn("slot", (F.col("__start") + F.col("__i")).cast("long")))


def shard_documents(docs: DataFrame, n_shards: int = 16, grown: int | None = None,
                    base: int = 16) -> DataFrame:
    """Place every row by its id: one row each with size, crc and slot."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    df = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"),
                     F.crc32(raw).cast("long").alias("text_crc32"))
    df = descend(df, "doc_id", topology(n_shards, base), "shard")
    df = descend(df, "doc_id", topology(grown or n_shards + 1, base), "grown_shard")
    df = number_slots(stored(df, "shards"), "shard", "doc_id")
    return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                     "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
