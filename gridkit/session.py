"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on.  Timestamps in the inputs are
# zone-less, so the session zone is pinned to UTC; ANSI mode makes silent
# overflow / division by zero an error, so every ratio goes through
# ``functions.safe_div``.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle output to the advisory size instead of keeping one
    # partition per core: fewer, fuller tasks.  A task that joins several sorted
    # sides or aggregates holds about 30 bytes per byte that it reads, so the
    # size is what bounds its memory
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # tasks that list folders: by default every folder may be one
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "100",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows handed to Python at once; there is no bound on their bytes, and a
    # row can be a long text
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "gridkit",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    On a cluster leave ``master`` unset so spark-submit decides; locally
    pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_core_conf(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Apply the SQL settings to a session someone else built.  All of them can
    be changed at run time; one that cannot raises."""
    for k, v in CORE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    and the master is local (tests) a fresh private folder is created and
    registered -- on a cluster an unset folder is an error, never a
    machine-local temp directory.
    """
    try:
        sc = spark.sparkContext
    except Exception:       # Spark Connect: the server owns the checkpoint folder
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = sc.master if sc else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="gridkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)
