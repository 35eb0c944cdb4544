"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes all that the stage before kept and writes Parquet for the next.
All but the last return the columns of ``documents``; the last returns the
packed pieces.

Edge cases: null texts are empty texts; very long texts are handled whole in every
stage; of rows that are equal in id and text one stays; of equal or near texts the
smallest doc_id stays, which leaves no ties; other columns of documents travel along
whatever their names, up to packing, whose result has its own; an empty input gives
empty stages.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkit.llm import (exact_dedup, lsh_forest, pairwise_quality, qgram_decontam,
                         retrieval_packing)
from gridkit.llm.common import discard, same, table, without
from gridkit.session import apply_core_conf, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality model accepts."""
    scored = pairwise_quality.score(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 0"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, snapshots = exact_dedup.dedup(docs)
    for s in snapshots:  # the stage keeps no store between runs
        discard(s.exact, s.filters)
    dropped = rows.where(~F.col("kept"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without(docs, dropped)
    # an id that repeats: its rows are told apart by their text
    sha = F.unhex(F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))
    gone = dropped.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__gone")).distinct()
    keyed = docs.withColumn("__sha", sha)
    kept = keyed.join(gone, same(F.col("doc_id"), F.col("__id")) & (F.col("__sha") == F.col("__gone")),
                      "left_anti")
    return kept.dropDuplicates(["doc_id", "__sha"]).drop("__sha")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without(docs, lsh_forest.near_duplicates(docs).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return qgram_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in windows of 2048 tokens, with the ids of each piece."""
    pieces = retrieval_packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "ids")


def _configured(stage):
    """The stage under the library's session settings."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_core_conf(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [("quality", _configured(quality)), ("exact_dedup", _configured(exact)),
          ("near_dedup", _configured(near)), ("decontaminate", _configured(decontaminate)),
          ("pack", _configured(pack))]

#: scores, signatures and packing cannot be said in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
