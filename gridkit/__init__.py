"""gridkit: operations analytics for asset-heavy utilities, on Spark.

Layers
------
sources    raw table reads, logical-table bindings, sinks
functions  reusable Column expressions (safe division, epoch hours, bands)
operators  rollups, derivations, windows rules, interval joins, quality,
           document-corpus and answer-trace jobs
plans      the metric layer (MetricView) and the registered analyst queries
streaming  Structured Streaming forms of the alarm / rollup / join / dedupe
"""

__version__ = "0.1.0"
