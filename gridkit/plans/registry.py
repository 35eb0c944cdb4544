"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each registration may carry the DuckDB oracle text for the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_rollups, q_analyst, q_metrics, q_derive,  # noqa: F401
                   q_quality, q_corpus, q_trace, q_streams, q_cubes)


# Reported precision of DOUBLE outputs.  Spark and the SQL oracle add the
# same doubles in different orders, so results can differ in the last bits;
# reporting both at 1e-6 makes them identical for ordinary magnitudes, far
# below any business precision.  (Plain rounding: a relative tie-nudge
# would itself show at this precision on large values.)
REPORT_DECIMALS = 6


def finalize(name: str, df: DataFrame) -> DataFrame:
    """Round the DOUBLE output columns of a registered query for reporting."""
    from pyspark.sql import functions as F

    from ..functions.scalars import round_double
    from .float_columns import FLOAT_COLUMNS
    cols = set(FLOAT_COLUMNS.get(name, ())) & set(df.columns)
    if not cols:
        return df
    return df.select(*[round_double(c, REPORT_DECIMALS, F.round).alias(c, metadata=df.schema[c].metadata)
                       if c in cols else c for c in df.columns])


def finalize_sql(name: str, sql: str) -> str:
    """The oracle text with the same reporting precision."""
    from .float_columns import FLOAT_COLUMNS
    cols = FLOAT_COLUMNS.get(name)
    if not cols:
        return sql
    rep = ", ".join(f'ROUND("{c}", {REPORT_DECIMALS}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _oracle"
