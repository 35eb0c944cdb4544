"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of rising doc_id.  A run is a table of line hashes
with the document that owns each (the smallest that holds it), bucketed and
sorted by hash.  A batch groups its own lines by hash, merge-anti-joins the
runs to find the lines nobody had before, and adds these as a new run on level
0; as soon as a level holds ``fan_out`` runs they are merged into one run of the
next level.  Since batches rise by doc_id, the owner in the runs is final.

A line loses its place when its key has an owner other than its document.
Keys are held by 128-bit hash; everything runs as DataFrame operations.

Edge cases: null or empty text is one empty line; keys under ``min_chars`` code
points never drop; rows that repeat a doc_id count as one document; a null
doc_id sorts after all others (and owns a line only if nobody else has it); of the
documents that hold a line the smallest owns it, so there are no ties; very long texts
and lines are hashed whole; only doc_id and text are read, so other columns may have any
name; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import (WHITE, ascii_lower, delete, discard, join_counted, n_shuffle, stored, table,
                     union_all)

#: stands for a null doc_id while batches are formed
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def explode_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, version, pos, hash): hash is null where the key is too short.
    ``version`` tells rows apart that repeat a doc_id with another text."""
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"),
                       F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line")))
    digest = F.unhex(F.md5(F.col("key").cast("binary")))
    return rows.select("doc", "version", "pos",
                       F.when(F.char_length("key") >= min_chars, digest).alias("hash"))


class Runs:
    """Runs by level; each a table bucketed and sorted by hash, so that the
    merge join of a batch reads it without an exchange or a sort."""

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.levels: dict[int, list[str]] = {}
        self.n = n_shuffle(spark)
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame) -> str:
        name = f"llm_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        (df.repartition(self.n, "hash").write.option("path", path)
         .bucketBy(self.n, "hash").sortBy("hash").saveAsTable(name))
        self.paths[name] = path
        return name

    def add(self, df: DataFrame) -> None:
        """A new run on level 0; full levels are merged upwards."""
        level = 0
        self.levels.setdefault(0, []).append(self.write(df))
        while len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            merged = self.write(union_all([self.spark.table(t) for t in full]))
            self._drop(full)
            level += 1
            self.levels.setdefault(level, []).append(merged)

    def _drop(self, names: list[str]) -> None:
        for t in names:
            self.spark.sql(f"DROP TABLE {t}")
            delete(self.spark, self.paths.pop(t))

    def close(self) -> None:
        """Drop all runs; a store that takes further batches keeps them."""
        self._drop(list(self.paths))
        self.levels = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels.values() for t in level]


def merge_batch(keys: DataFrame, runs: Runs) -> tuple[DataFrame, list[DataFrame]]:
    """Split a batch's keys into those that no run holds and those of each run."""
    fresh, seen = keys, []
    for run in runs.tables():
        owner = run.select("hash", F.col("owner").alias("run_owner"))
        seen.append(keys.join(owner.hint("merge"), "hash")
                    .select("hash", F.col("run_owner").alias("owner"), "n"))
        fresh = fresh.join(owner.hint("merge"), "hash", "left_anti")
    return fresh, seen


def dropped_keys(lines: DataFrame, batches: int, fan_out: int = 2) -> DataFrame:
    """(hash, owner, n) of every key that two documents hold, through the runs."""
    spark = lines.sparkSession
    marks = [i / batches for i in range(1, batches)]
    cuts = lines.select(F.percentile_approx("doc", marks, 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    runs, hits = Runs(spark, fan_out), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = lines.where("hash is not null")
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        keys = stored(part.groupBy("hash").agg(F.min("doc").alias("owner"),
                                               F.max("doc").alias("last"),
                                               F.count("*").alias("n")), "line-keys")
        fresh, seen = merge_batch(keys, runs)
        if seen:
            hits.append(stored(union_all(seen), "line-hits"))
        runs.add(fresh.select("hash", "owner", "n", (F.col("last") > F.col("owner")).alias("shared")))
        discard(keys)
    found = [r.where("shared").select("hash", "owner", "n") for r in runs.tables()] + hits
    drops = stored(union_all(found).groupBy("hash").agg(F.min("owner").alias("owner"),
                                                        F.sum("n").alias("n")), "line-drops")
    runs.close()
    discard(*hits)
    return drops


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4,
                fan_out: int = 2) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) with ``kept`` text, n_lines, n_dropped."""
    lines = stored(explode_lines(docs, min_chars), "lines")
    drops = dropped_keys(lines, batches, fan_out)
    total = drops.agg(F.sum("n")).first()[0] or 0
    held = lines.where("hash is not null")
    marked = (join_counted(held, drops, ["hash"], "n", total)
              .where(F.col("owner").isNotNull() & (F.col("owner") != F.col("doc"))))
    # the lines that go, as ranks in a sorted list of a document's own lines
    gone = (marked.groupBy("doc", "version")
            .agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    rows = docs.select("doc_id", "text").select(
        "*", F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    out = rows.join(gone, ["doc", "version"], "left")
    parts = split_lines(F.col("text"))
    # stretches of kept lines between two dropped ones: linear in the lines
    ends = F.concat(F.col("gone"), F.array(F.size(parts)))
    starts = F.concat(F.array(F.lit(-1)), F.col("gone"))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(F.col("parts"), s + 2, e - s - 1)))
    return (out.withColumn("parts", parts)
            .select("doc_id", F.size("parts").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
                    .otherwise(F.array_join(kept, "\n")).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, (o.owner IS NOT NULL AND o.owner <> l.doc_id) AS gone
  FROM keyed l LEFT JOIN owners o ON o.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
