"""Centroid clustering over an incremental distance matrix.

Vectors become integers (``floor(64 * x)`` by component), so every sum below is
exact.  The state is a written table with one row per vector: its integers and
its dot product with every centroid.  A squared distance is
``|v|^2 - 2 v.c + |c|^2``, so a round needs the dot products only:

1. The driver holds the centroids (``k`` rows) and their change since the last
   round.  A task adds, centroid by centroid, the products of the components that
   changed; a centroid that stood still costs nothing.
2. The nearest centroid is the argmin of ``|c|^2 - 2 v.c`` (ties: smaller number).
3. Sums by cluster are combined before the shuffle (at most ``k`` rows a task).

When no centroid changes, later rounds cannot change anything and are left out.
Each round's table is in the shared folder, so a lost executor repeats one task;
the table before it is deleted when the next one is whole.

Edge cases: vectors that are null, of another length, or that hold a null or a
non-finite component are left out; with fewer vectors than ``k`` there are so many
centroids; rows that repeat (also with one vec_id) count each; a null vec_id is
clustered, but starts a centroid only after all others; equal start hashes are
ordered by their vectors; an empty table gives an empty result; other columns are
not read, whatever their names.  The table has no texts, so no long ones.
Components beyond ``LIMIT`` raise, since distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: integers below this in size keep a squared distance of 64 components in a long
LIMIT = 1 << 27
STATE = "vec_id long, cells array<int>, dots array<long>, cluster int, distance long"


@dataclass
class Clustering:
    """``rows``: vec_id, cells, dots, cluster, distance; ``centroids``: k rows of integers;
    ``updates``: changed (centroid, component) entries of each round."""

    rows: DataFrame
    centroids: np.ndarray
    updates: list[int]


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cells) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    cell = F.transform(x, lambda e: F.when(F.abs(e * scale) < LIMIT - 1, F.floor(e * scale).cast("int"))
                       .otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT} / {scale}"))))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), cell.alias("cells"))


def first_centroids(cells: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least hashes, in hash order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = (cells.select(name.alias("name"), "cells")
             .orderBy(F.col("name").asc_nulls_last(), "cells").limit(k).collect())
    return np.array([r["cells"] for r in least], np.int64)


def _update(change: np.ndarray, norms: np.ndarray):
    """Dot products moved by the changed components, then the argmin."""
    k, dims = change.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cells = batch.column("cells").flatten().to_numpy().reshape(n, dims).astype(np.int64)
            dots = batch.column("dots").flatten().to_numpy().reshape(n, k).copy()
            for c in range(k):
                moved = np.flatnonzero(change[c])
                if len(moved):
                    dots[:, c] += cells[:, moved] @ change[c, moved]
            cost = norms - 2 * dots
            nearest = cost.argmin(axis=1)
            distance = (cells * cells).sum(axis=1) + cost[np.arange(n), nearest]
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cells"),
                 pa.ListArray.from_arrays(ends, pa.array(dots.ravel())),
                 pa.array(nearest.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cells", "dots", "cluster", "distance"])
    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of every non-empty cluster's exact mean; empty ones stay."""
    sums = state.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.sum(F.col("cells")[j]).alias(f"s{j}") for j in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
            scale: int = SCALE, seed: int = SEED) -> Clustering:
    """Cluster ``vectors`` (vec_id, embedding); the last assignment follows the last means."""
    cells = integers(vectors, dims, scale)
    centroids = first_centroids(cells, k, seed)
    if not len(centroids):
        return Clustering(vectors.sparkSession.createDataFrame([], STATE), centroids.reshape(0, dims), [])
    zero = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    state, before = cells.withColumn("dots", zero), np.zeros_like(centroids)
    updates = []
    for step in range(rounds + 1):
        change = centroids - before
        updates.append(int(np.count_nonzero(change)))
        moved = state.mapInArrow(_update(change, (centroids * centroids).sum(axis=1)), STATE)
        after = stored(moved, "dots")
        if step:
            discard(state)
        state, before = after, centroids
        if step < rounds:
            centroids = _means(state, centroids)
            if (centroids == before).all():
                break
    return Clustering(state, centroids, updates)


def report(found: Clustering) -> DataFrame:
    """Per vector: its cluster, its distance, the sums of both, and its centroid's digest."""
    rows, names = found.rows, ("vec_id", "cluster", "distance")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    k = max(1, len(found.centroids))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]

    def by_cluster(values, kind):
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values or [None]]), F.col("cluster"))

    return rows.select(*names, by_cluster([inertia.get(c) for c in range(k)], "long").alias("cluster_inertia"),
                       F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                       by_cluster(digests, "string").alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(cluster(table(spark, sf_dir, "embeddings")))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in plain SQL: all distances anew in every round."""
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * {k} + k) % {k} AS k, min(d) AS d
  FROM (SELECT kept.r, kept.vec_id, kept.v, c{i}.k,
               CAST(list_sum(list_transform(range(1, {dims + 1}),
                    lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS d
        FROM kept, c{i})
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
        FROM a{i}, range(1, {dims + 1}) AS t(i) GROUP BY k, i)
  GROUP BY k
  UNION ALL SELECT k, v FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))""")
    last = rounds
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.k = a.k"""


ORACLE = oracle()
