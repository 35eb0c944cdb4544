"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Join every node's neighbours to the least node near it: the larger
    neighbours in a large star, the smaller ones (and the node) in a small star."""
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component) with the least node as component, for
    every node that has a link.  Each pass is written to the shared folder; the
    minimum is combined before the shuffle, and a hub's rows are split by the
    adaptive skew join."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both, True), "cc")
        nxt = stored(_star(large, False), "cc")
        discard(edges, large)
        edges = nxt
        now = edges.agg(F.count("*").alias("n"),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (now["n"], now["s"])
