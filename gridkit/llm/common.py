"""Helpers shared by the operators: tables, shared scratch, heavy-key joins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: ``[\x20\x09-\x0D]``, the white space of every text rule here
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at
    files that outlive any executor, and computes Python stages once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for df in frames:
        delete(df.sparkSession, df._llm_path)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, UPPER.lower())


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: a key is heavy when it holds at least this share of the rows, so there are
#: at most HEAVY heavy keys, whatever the size of the data
HEAVY = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str,
                 total: int) -> DataFrame:
    """Left join with ``right`` unique on ``keys``, where ``n`` is the number of
    rows of ``left`` that hold the key and ``total`` their sum.

    Keys with ``n >= total / HEAVY`` are at most ``HEAVY`` and are broadcast, so
    no hot key is shuffled; all other keys meet in a shuffled join.
    """
    least = max(2, total // HEAVY)
    heavy = right.where(F.col(n) >= least)
    light = right.where(F.col(n) < least)
    kinds = [c for c in right.columns if c not in keys]
    a = left.join(F.broadcast(heavy), keys, "inner")
    b = (left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
         .join(light, keys, "left"))
    return a.select(*left.columns, *kinds).unionByName(b.select(*left.columns, *kinds))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


#: so many ids are broadcast at most (8 MB); more meet in a shuffled join
ID_BOUND = 1 << 20


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, ...) whose id is in ``ids`` (doc_id), which is
    counted first: only a bounded list is broadcast."""
    ids = stored(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= ID_BOUND else ids, "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (a null matches a null).
    The ids are counted first: only a bounded list is broadcast."""
    ids = stored(ids.select(F.col("doc_id").cast("long").alias("__id")).distinct(), "dropped")
    small = F.broadcast(ids) if ids.count() <= ID_BOUND else ids
    return docs.join(small, same(F.col("doc_id"), F.col("__id")), "left_anti")
