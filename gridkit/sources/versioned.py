"""Versioned tables: parquet folders named by a manifest that is written last.

Layout under the table's path::

    data/version_folder=<id>/[<partition>=<value>/]*.parquet   never changed once written
    manifests/<version>.json                             one per commit, never changed
    batches/<digest>                                     one per committed batch id

A commit writes its rows to a folder of its own and then publishes the next manifest
by a rename that fails when the version exists, so a reader sees a whole version or
the one before, a job that dies midway changes nothing, and of two writers one is
told to try again (``Conflict``).  A manifest lists, for each partition, the folders
that hold its rows: replacing some partitions leaves the files of all others as they
are.  A batch id that was committed is not committed again.

The folder must be on a file system whose rename refuses an existing target (HDFS,
or a local disk with one writer); the rows themselves are written and read by Spark.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import Files

#: the folder column of the layout
FOLDER = "version_folder"


class Conflict(RuntimeError):
    """Another writer published this version first; read anew and commit again."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: dict | None = None
    partition_by: tuple[str, ...] = ()
    #: partition folder name ("" for an unpartitioned table) -> folder ids
    parts: dict[str, list[str]] = field(default_factory=dict)
    batch: str | None = None
    #: what the writer wants to find again (the state of its sources, say)
    note: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark)

    # ------------------------------------------------------------ manifests
    def versions(self) -> list[int]:
        names = self.files.names(f"{self.path}/manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The named version, or the last; version 0 is the table before any commit."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        held = json.loads(self.files.read(self._manifest_path(version)))
        return Manifest(**{**held, "partition_by": tuple(held["partition_by"])})

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def _marker(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def committed(self, batch: str) -> bool:
        last = self.manifest()
        return last.batch == batch or self.files.exists(self._marker(batch))

    def _publish(self, last: Manifest, new: Manifest) -> None:
        # the marker of the version before may be missing if its writer died
        if last.batch is not None and not self.files.exists(self._marker(last.batch)):
            self.files.write(self._marker(last.batch), str(last.version))
        if not self.files.publish(self._manifest_path(new.version), json.dumps(new.__dict__)):
            raise Conflict(f"{self.path}: version {new.version} exists")
        if new.batch is not None:
            self.files.write(self._marker(new.batch), str(new.version))

    # --------------------------------------------------------------- writes
    def _write(self, df: DataFrame, partition_by: Sequence[str]) -> dict[str, list[str]]:
        folder = uuid.uuid4().hex
        root = f"{self.path}/data/{FOLDER}={folder}"
        if partition_by:
            df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(root)
            return {p: [folder] for p in self.files.leaves(root, len(partition_by))}
        df.write.parquet(root)
        return {"": [folder]}

    def commit(self, df: DataFrame, mode: str = "overwrite", partition_by: Sequence[str] = (),
               batch: str | None = None, replace: Sequence[str] | None = None,
               note: dict | None = None) -> int:
        """Write ``df`` as the next version and return its number.

        ``overwrite`` replaces all rows and the schema; ``append`` adds rows (same
        columns); ``partitions`` replaces the partitions that ``df`` holds and those
        named by ``replace`` (``"date=2025-01-31"``), which may have no rows left.
        A ``batch`` committed before is skipped.
        """
        if mode not in ("overwrite", "append", "partitions"):
            raise ValueError(f"unknown mode {mode!r}")
        last = self.manifest()
        if batch is not None and self.committed(batch):
            return last.version
        keep = mode != "overwrite" and last.version > 0
        if keep:
            partition_by = last.partition_by
            columns = StructType.fromJson(last.schema).names
            if sorted(columns) != sorted(df.columns):
                raise ValueError(f"{self.path}: columns {df.columns} are not those of the table, {columns}")
            old = {f.name: f.dataType for f in StructType.fromJson(last.schema)}
            df = df.select(*[df[c].cast(old[c]) for c in columns])
        if mode == "partitions" and not (partition_by or last.partition_by):
            raise ValueError(f"{self.path}: the table has no partitions to replace")
        parts = self._write(df, partition_by)
        if keep:
            gone = set(replace or ()) | set(parts) if mode == "partitions" else set()
            held = {p: f for p, f in last.parts.items() if p not in gone}
            parts = {p: held.get(p, []) + parts.get(p, []) for p in {**held, **parts}}
        schema = last.schema if keep else json.loads(df.schema.json())
        self._publish(last, Manifest(last.version + 1, schema, tuple(partition_by), parts, batch,
                                     note if note is not None else (last.note if keep else {})))
        return last.version + 1

    def compact(self) -> int:
        """One folder a partition again, after many appends; the rows stay the same."""
        last = self.manifest()
        many = [p for p, folders in last.parts.items() if len(folders) > 1]
        if not many:
            return last.version
        parts = self._write(self._read(last, many), last.partition_by)
        self._publish(last, Manifest(last.version + 1, last.schema, last.partition_by,
                                     {**last.parts, **parts}, None, last.note))
        return last.version + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions names, and their
        manifests.  No writer and no reader of older versions may be at work."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for fs in self.manifest(v).parts.values() for f in fs}
        gone = [n for n in self.files.names(f"{self.path}/data")
                if n.startswith(f"{FOLDER}=") and n[len(FOLDER) + 1:] not in used]
        for v in versions[:-keep]:
            self.files.delete(self._manifest_path(v))
        for name in gone:
            self.files.delete(f"{self.path}/data/{name}")
        return gone

    # ---------------------------------------------------------------- reads
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a scan, so filters and partition values prune it."""
        m = self.manifest(version)
        if m.version == 0:
            raise FileNotFoundError(f"{self.path}: no version was committed")
        return self._read(m, list(m.parts))

    def _read(self, m: Manifest, names: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        paths = [f"{self.path}/data/{FOLDER}={f}" + (f"/{p}" if p else "") for p in names for f in m.parts[p]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = StructType(schema.fields).add(FOLDER, "string")
        return (self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths)
                .select(*schema.names))
