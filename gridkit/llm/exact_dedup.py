"""Exact dedup of batches against immutable snapshots.

A snapshot holds the distinct texts of all documents committed with it: exact
buckets (bucket of the digest, digest, text, first document, documents) and per
bucket a static binary-fuse filter of the digests.  Neither changes after it is
written.  A new batch groups its own duplicates by SHA-256 and length, one row
per distinct text; these are screened by the filter of their bucket, and only
positives fetch their text and join the exact bucket on the digest, where the
bytes decide.  What no snapshot holds can be committed as the next snapshot.

Every stage after the first works on one row per distinct text, so a text that
a third of all rows share is one row there; in the last join such a text is
broadcast.

Edge cases: a null text is an empty one; of rows that repeat a doc_id all are
members and one id stays; a null doc_id stays only in a group without ids (then
keep_id is null and kept is true); of equal texts the smallest doc_id stays, which has
no ties but for rows that repeat it; very long texts are hashed and compared whole; only
doc_id and text are read, so other columns may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID_BOUND, WHITE_CLASS, join_counted, same, stored, table, union_all
from .fuse import Filter, build

#: distinct texts per bucket, and so per filter
KEYS_PER_BUCKET = 1 << 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", " ")


def digests(docs: DataFrame, order: Column) -> DataFrame:
    """(doc_id, batch, sha, size, digest) of every row."""
    text = normalised(F.col("text")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("batch"), text.alias("t"))
    rows = rows.select("doc_id", "batch", F.unhex(F.sha2("t", 256)).alias("sha"),
                       F.octet_length("t").alias("size"))
    return rows.withColumn("digest", F.xxhash64("sha"))


def group_batch(rows: DataFrame) -> DataFrame:
    """The duplicates inside a batch: one row per distinct text."""
    return rows.groupBy("sha", "size", "digest").agg(F.min("doc_id").alias("first"),
                                                     F.count("*").alias("n"))


def fetch_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes with the normalised text of their first document; classes of
    rows without an id have the text looked up by its digest."""
    ids = classes.where("first is not null").select(F.col("first").alias("doc_id"))
    n = ids.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = texts.join(F.broadcast(ids) if n <= ID_BOUND else ids, "doc_id", "left_semi")
    if not classes.where("first is null").isEmpty():
        wanted = wanted.unionByName(texts.where("doc_id is null"))
    found = (wanted.select(normalised(F.col("text")).alias("text"))
             .withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    return classes.join(found, "sha").dropDuplicates(["sha", "size"])


def _filter_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    f = build(part["digest"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [key[0]], "seed": [int(np.uint64(f.seed).view(np.int64))],
                         "segment": [f.segment], "segments": [f.segments], "slots": [f.slots.tobytes()]})


def _screen(key: tuple, part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Rows of a batch's bucket that the snapshot's filter lets through."""
    if not len(filters) or not len(part):
        return part.iloc[:0]
    row = filters.iloc[0]
    f = Filter(int(np.int64(row["seed"]).view(np.uint64)), int(row["segment"]), int(row["segments"]),
               np.frombuffer(row["slots"], np.uint8))
    return part[f.contains(part["digest"].to_numpy(np.int64).view(np.uint64))]


@dataclass
class Snapshot:
    """Immutable: exact buckets, their filters and the number of buckets."""

    buckets: int
    exact: DataFrame
    filters: DataFrame

    @staticmethod
    def commit(classes: DataFrame, docs: DataFrame) -> Snapshot:
        n = max(1, -(-classes.count() // KEYS_PER_BUCKET))
        placed = classes.withColumn("bucket", F.pmod("digest", F.lit(n)).cast("long"))
        exact = stored(fetch_texts(docs, placed), "exact")
        filters = stored(exact.select("bucket", "digest").groupBy("bucket").applyInPandas(
            _filter_of, "bucket long, seed long, segment long, segments long, slots binary"), "filters")
        return Snapshot(n, exact, filters)

    def known(self, classes: DataFrame, docs: DataFrame) -> DataFrame:
        """The classes of a batch whose text the snapshot holds, byte for byte;
        ``root`` is the SHA-256 of the snapshot's class."""
        placed = classes.withColumn("bucket", F.pmod("digest", F.lit(self.buckets)).cast("long"))
        cols = ["sha", "size", "digest", "first", "n", "bucket"]
        passed = (placed.select(*cols).groupBy("bucket").cogroup(self.filters.groupBy("bucket"))
                  .applyInPandas(_screen, placed.select(*cols).schema))
        positive = fetch_texts(docs, stored(passed, "positives"))
        old = self.exact.select("bucket", "digest", F.col("text").alias("old_text"),
                                F.col("sha").alias("root"))
        return (positive.join(old, ["bucket", "digest"])
                .where(F.col("text").cast("binary") == F.col("old_text").cast("binary"))
                .select("sha", "size", "digest", "first", "n", "root"))


def dedup(docs: DataFrame, batches: int = 2, commit_last: bool = False
          ) -> tuple[DataFrame, list[Snapshot]]:
    """Every row (doc_id, sha, size) with keep_id, group_size and kept; and the
    snapshots written.

    Rows go in batches (by hash of the id); each batch is screened against the
    snapshots of the batches before it and leaves what is new as a snapshot.  A
    class of a batch belongs to the snapshot that holds its text, or else to its own
    batch; nothing else links it to other batches.
    """
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)).cast("int")
    rows = stored(digests(docs, order), "digests")
    kinds = ["sha", "size", "first", "n"]
    snapshots: list[Snapshot] = []
    parts: list[DataFrame] = []
    for b in range(batches):
        fresh = stored(group_batch(rows.where(F.col("batch") == b)), "batch-classes")
        of_batch = docs.where(order == b)
        for origin, s in enumerate(snapshots):
            known = stored(s.known(fresh, of_batch), "known")
            parts.append(known.select(F.lit(b).alias("batch"), F.lit(origin).alias("origin"), "root", *kinds))
            fresh = fresh.join(known.select("sha", "size"), ["sha", "size"], "left_anti")
        if snapshots:
            fresh = stored(fresh, "fresh")
        parts.append(fresh.select(F.lit(b).alias("batch"), F.lit(b).alias("origin"), F.col("sha").alias("root"),
                                  *kinds))
        if b + 1 < batches or commit_last:
            snapshots.append(Snapshot.commit(fresh, of_batch))
    classes = stored(union_all(parts), "classes")
    groups = classes.groupBy("origin", "root", "size").agg(F.min("first").alias("keep_id"),
                                                           F.sum("n").alias("group_size"))
    groups = stored(classes.join(groups, ["origin", "root", "size"])
                    .select("batch", "sha", "size", "n", "keep_id", "group_size"), "groups")
    out = join_counted(rows.select("doc_id", "batch", "sha", "size"), groups, ["batch", "sha", "size"], "n",
                       rows.count())
    out = out.select("doc_id", "sha", "size", "keep_id", "group_size")
    return out.withColumn("kept", same(F.col("doc_id"), F.col("keep_id"))), snapshots


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS k FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k)
"""
