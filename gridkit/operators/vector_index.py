"""Exact nearest vectors by cosine through inverted lists that bounds can skip (c17).

Build: coarse centroids are fitted on a bounded sample of the vectors (``SAMPLE``, those
with the least hashes of their ids); every vector goes to the list of its nearest
centroid and keeps its angle to it.  Rows are written in a folder per list, sorted by
angle, dealt by ranges of (list, angle) so that a list with most of the rows is spread
over tasks and files.  The driver holds one row per list: centroid, least and greatest
angle, number of rows.

Search: angles obey the triangle inequality, so a vector at angle a to its centroid is
at least ``|a - t|`` from a query at angle t to that centroid.  A block of queries first
reads the lists nearest to each until they hold k rows; the k-th score found is a bound,
and then only the lists and angle ranges that can still beat it are read (folders are
pruned, and row groups by their angles).  No vector that belongs to the result is
skipped, so recall is 1.  Equal scores (at ``DIGITS``) go to the smaller id.

Vectors that are null, of another length, of no length or not finite have no angle and
are in no list; queries of that kind find nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: vectors that the centroids are fitted on; rounds of the fit; lists at most
SAMPLE, ROUNDS, LISTS = 20_000, 8, 4096
#: queries that share one scan, digits of a score, and how far off an angle can be
QUERY_BLOCK, DIGITS, SLACK = 256, 9, 1e-6
ROWS = "vec_id long, embedding array<double>, angle double, list int"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def usable(emb: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that have an angle."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (emb.where((F.size(x) == dims) & finite & F.exists(x, lambda e: e != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")))


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means on the sample."""
    held = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    units = _unit(np.array([r["embedding"] for r in held], np.float64))
    centroids = np.unique(units, axis=0)
    centroids = centroids[np.random.default_rng(1).permutation(len(centroids))[:lists]]
    for _ in range(rounds):
        nearest = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


@dataclass
class Search:
    """``rows`` (query, rank, vec_id, score) and what was read for each block of queries."""
    rows: DataFrame
    lists_read: list[int] = field(default_factory=list)
    rows_read: list[int] = field(default_factory=list)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, lists: pd.DataFrame):
        self.spark, self.path = spark, path
        self.list = lists["list"].to_numpy(np.int64)
        self.centroid = np.array(lists["centroid"].tolist(), np.float64).reshape(len(lists), -1 if len(lists) else 0)
        self.low, self.high = lists["low"].to_numpy(float), lists["high"].to_numpy(float)
        self.size = lists["n"].to_numpy(np.int64)

    # ----------------------------------------------------------------- build
    @classmethod
    def build(cls, emb: DataFrame, path: str, dims: int | None = None, lists: int | None = None) -> "VectorIndex":
        """Index every usable vector of ``emb`` (vec_id, embedding) under ``path``."""
        spark = emb.sparkSession
        if dims is None:
            first = emb.where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
            dims = first["n"] if first else 1
        vectors = usable(emb, dims)
        n = vectors.count()
        if n:
            centroids = fit_centroids(vectors, lists or min(LISTS, max(1, round(math.sqrt(n)))))
        else:
            centroids = np.zeros((0, dims))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    angle = _angles(_unit(np.stack(pdf["embedding"].to_numpy())), centroids)
                    nearest = angle.argmin(axis=1)
                    yield pdf.assign(angle=angle[np.arange(len(pdf)), nearest], list=nearest.astype(np.int32))

        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        (vectors.mapInPandas(assign, ROWS).repartitionByRange(parts, "list", "angle")
         .sortWithinPartitions("list", "angle").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows"))
        held = (spark.read.schema(ROWS).parquet(f"{path}/rows").groupBy("list")
                .agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")))
        table = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())],
                                      "list int, centroid array<double>")
        table.join(held, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "VectorIndex":
        return cls(spark, path, spark.read.parquet(f"{path}/lists").orderBy("list").toPandas())  # <= LISTS rows

    # ---------------------------------------------------------------- search
    def search(self, queries: Sequence[tuple[object, Sequence[float]]], k: int, query_type: str = "long") -> Search:
        """The ``k`` vectors most alike to each query, exactly."""
        schema = f"query {query_type}, vec_id long, score double"
        parts, out = [], Search(None)
        dims = self.centroid.shape[1]
        good = [(q, v) for q, v in queries if v is not None and len(v) == dims
                and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        for i in range(0, len(good) if len(self.list) else 0, QUERY_BLOCK):
            parts.append(self._block(good[i: i + QUERY_BLOCK], k, schema, out))
        found = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            found = found.unionByName(p)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")  # at most tasks x k rows a query
        out.rows = (found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
                    .select("query", "rank", "vec_id", "score"))
        return out

    def _block(self, queries, k: int, schema: str, out: Search) -> DataFrame:
        names = [q for q, _ in queries]
        units = _unit(np.array([v for _, v in queries], np.float64))
        t = _angles(units, self.centroid)
        # the lists nearest to each query that hold k rows
        order = np.argsort(t, axis=1)
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        first = np.zeros_like(t, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        near = self._scan(names, units, k, np.where(first, 0.0, np.inf), np.where(first, np.inf, -np.inf), schema)
        path = scratch_path(self.spark, f"nearest-{uuid.uuid4().hex[:10]}")
        near.write.parquet(path)  # read twice
        near = self.spark.read.schema(schema).parquet(path)
        least = {}
        ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        for r in (near.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).collect()):  # one a query
            least[r["query"]] = r["score"]
        # whatever beats the k-th score lies within this angle of the query
        reach = np.array([np.arccos(np.clip(least[q], -1.0, 1.0)) if q in least else np.pi for q in names]) + SLACK
        low, high = t - reach[:, None], t + reach[:, None]
        rest = ~first & (low <= self.high) & (high >= self.low)
        read = (first | rest).any(axis=0)
        out.lists_read.append(int(read.sum()))
        out.rows_read.append(int(self.size[read].sum()))
        if not rest.any():
            return near
        far = self._scan(names, units, k, np.where(rest, low, np.inf), np.where(rest, high, -np.inf), schema)
        return near.unionByName(far)

    def _needed(self, low: np.ndarray, high: np.ndarray) -> Column | None:
        """Lists and angles that any query of the block asks for."""
        a, b = low.min(axis=0), high.max(axis=0)
        asked = np.flatnonzero(a <= b)
        test = F.lit(False)
        for j in asked.tolist():
            if a[j] <= self.low[j] and b[j] >= self.high[j]:
                continue
            test = test | ((F.col("list") == int(self.list[j])) & F.col("angle").between(float(a[j]), float(b[j])))
        whole = [int(self.list[j]) for j in asked if a[j] <= self.low[j] and b[j] >= self.high[j]]
        return (test | F.col("list").isin(whole)) & F.col("list").isin([int(x) for x in self.list[asked]])

    def _scan(self, names, units, k, low, high, schema) -> DataFrame:
        """Each task's best ``k`` of the asked rows for each query."""
        rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/rows").where(self._needed(low, high))
        place = {int(x): j for j, x in enumerate(self.list)}
        shared = self.spark.sparkContext.broadcast((names, units, low, high, place))  # a block of queries x lists

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, units, low, high, place = shared.value
            top_s = np.full((len(names), 0), -np.inf)
            top_i = np.zeros((len(names), 0), np.int64)
            for pdf in batches:
                for of, g in pdf.groupby("list"):
                    j = place[int(of)]
                    angle = g["angle"].to_numpy()
                    asked = np.flatnonzero((low[:, j] <= angle.max()) & (high[:, j] >= angle.min()))
                    if not len(asked):
                        continue
                    m = np.stack(g["embedding"].to_numpy())
                    score = np.full((len(names), len(m)), -np.inf)
                    found = np.round((units[asked] @ m.T) / np.linalg.norm(m, axis=1), DIGITS)
                    inside = (angle >= low[asked, j][:, None]) & (angle <= high[asked, j][:, None])
                    score[asked] = np.where(inside, found, -np.inf)
                    all_s = np.concatenate([top_s, score], axis=1)
                    all_i = np.concatenate([top_i, np.broadcast_to(g["vec_id"].to_numpy(), score.shape)], axis=1)
                    order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    top_s, top_i = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            q, c = np.nonzero(np.isfinite(top_s))
            yield pd.DataFrame({"query": [names[x] for x in q], "vec_id": top_i[q, c], "score": top_s[q, c]})

        return rows.select("vec_id", "embedding", "angle", "list").mapInPandas(best, schema)
