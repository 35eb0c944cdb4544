"""Reads of the supplied parquet tables.

Only ``spark.read.parquet``; projection and filters placed on the returned
frames reach the scan (``PushedFilters`` / ``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``s01_table_scan``: one supplied table."""
    if name not in RAW_TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Some of a table's files."""
    return spark.read.parquet(*files)


def read_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_raw(spark, sf_dir, t) for t in RAW_TABLES}
