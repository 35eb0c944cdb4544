"""Quality scores from preference pairs (Bradley-Terry).

Every text becomes a vector of shape features (case, punctuation, repetition,
word lengths).  A labelled good text is preferred to a labelled bad one; pairs
are formed by numbering both sides in an order by hash, under ``ROUNDS`` salts: a
row of the larger side meets the row of its number modulo the smaller side, so each
row has a pair under each salt and their number is ROUNDS times the larger side,
never the product.  The utility w.x is fitted by Newton steps on the
logistic loss of the feature differences; each step is one Spark job that sums
gradient and curvature per partition.  The cut is the quantile of the training
utilities with the highest training accuracy (of equals, the lowest: it keeps
more); the score is the logistic of utility minus cut.

All labelled training rows are used; no label, language, source or id enters a
score.  Edge cases: null and empty texts are scored as texts without words; a
null id is not held out; if labels of one kind are missing all scores are 0.5
and every row is kept; equal hashes are ordered by id, and equal utilities get equal
scores; very long texts are measured whole; only doc_id, text and the label columns are
read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import U, Powers, Words, flat, mix, pieces
from .common import discard, stored, table

ROUNDS, STEPS, RIDGE = 4, 12, 1e-3
#: training rows that are numbered in one part
PART_ROWS = 10_000
#: quantiles tried as a cut
GRID = 400

_KIND = np.zeros(256, np.int64)          # 0 other, 1 upper, 2 lower, 3 digit, 4 mark, 5 white, 6 not ASCII
_KIND[33:127] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[32, 9, 10, 11, 12, 13]] = 5


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(offsets: np.ndarray, data: np.ndarray, powers: Powers) -> np.ndarray:
    """One row per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    kind = np.bincount(text_of * 8 + _KIND[data], minlength=n * 8).reshape(n, 8).astype(float)
    words = Words(offsets, data, powers)
    many = np.diff(words.bounds)
    word_text = np.repeat(np.arange(n), many)
    length = words.end - words.start
    marks = np.zeros(len(data) + 1)
    np.cumsum(_KIND[data] == 4, out=marks[1:])
    marked = marks[words.end] - marks[words.start]
    per_text = lambda w: np.bincount(word_text, weights=w, minlength=n)
    h = words.hash
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:])], float)
    three = np.zeros(len(h), U)
    if len(h) > 2:
        three[:-2] = mix(h[:-2] * U(0xD6E8FEB86659FD93) + h[1:-1] * U(0xA24BAED4963EE407) + h[2:])
    triples = np.array([len(np.unique(three[a:b - 2])) if b - a > 2 else 0
                        for a, b in zip(words.bounds[:-1], words.bounds[1:])], float)
    letters = kind[:, 1] + kind[:, 2] + kind[:, 6]
    base = [
        _ratio(kind[:, 1], letters), _ratio(kind[:, 3], size), _ratio(kind[:, 4], size),
        _ratio(per_text(length.astype(float)), many) / 10, 1 - _ratio(distinct, many),
        _ratio(per_text(again), many), 1 - _ratio(triples, np.maximum(many - 2, 1)),
        _ratio(per_text((marked >= 2).astype(float)), many), _ratio(per_text((marked == length).astype(float)), many),
        _ratio(per_text((length <= 3).astype(float)), many), _ratio(per_text((length >= 12).astype(float)), many),
    ]
    base = np.stack(base, axis=1)
    return np.concatenate([base, np.sqrt(np.clip(base, 0, None)), np.log1p(many)[:, None] / 5,
                           (np.log1p(many)[:, None] / 5) * base[:, 4:7]], axis=1)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        offsets, data = flat(batch.column(1))
        for a, b in pieces(offsets):
            x = features(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], powers)
            values = pa.array(x.ravel(), pa.float64())
            cuts = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.ListArray.from_arrays(cuts, values)],
                names=["doc_id", "x"])


def featurise(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(texts.mapInArrow(_featurise, "doc_id long, x array<double>"), "features")


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % 3 == 1


def preference_pairs(train: DataFrame) -> DataFrame | None:
    """(good, bad) feature vectors; None if one side is empty."""
    sides = {r["quality"]: r["n"] for r in train.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sides.get(0) or not sides.get(1):
        return None
    salts = F.explode(F.array(*[F.lit(i) for i in range(ROUNDS)])).alias("salt")
    rows = _numbered(train.select("doc_id", "quality", "x", salts), max(sides.values()))
    bucket = F.pmod("number", F.lit(min(sides[0], sides[1]))).alias("bucket")
    good = rows.where("quality = 1").select("salt", bucket, F.col("x").alias("good"))
    bad = rows.where("quality = 0").select("salt", bucket, F.col("x").alias("bad"))
    return good.join(bad, ["salt", "bucket"]).select("good", "bad")


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """``number``: 0, 1, ... within salt and label, in an order by hash; counted
    within parts of the hash and moved on by the rows of the parts before."""
    parts = max(1, -(-most // PART_ROWS))
    side = ["salt", "quality"]
    rows = rows.withColumn("place", F.xxhash64("doc_id", "quality", "salt"))
    rows = rows.withColumn("part", F.pmod("place", F.lit(parts)))
    before = Window.partitionBy(*side).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*side, "part").agg(F.count("*").alias("n"))
               .select(*side, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = F.row_number().over(Window.partitionBy(*side, "part").orderBy("place", "doc_id", "x"))
    return (rows.withColumn("inside", inside).join(offsets, [*side, "part"])
            .withColumn("number", F.col("offset") + F.col("inside") - 1))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _step(weights: np.ndarray, scale: np.ndarray):
    """Sums of a partition: curvature, gradient and loss of the logistic loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(weights)
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            x = (_matrix(batch.column(0)) - _matrix(batch.column(1))) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
            total[:d, :d] += (x * (p * (1 - p))[:, None]).T @ x
            total[d, :d] += (p - 1) @ x
            total[d, d] += len(x)
        flat_total = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_total)), pa.int32()), pa.array(flat_total)],
                                         names=["i", "v"])

    return run


def fit(train: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and scales of the utility; None without both labels."""
    pairs = preference_pairs(train)
    if pairs is None:
        return None
    pairs = stored(pairs, "pairs")
    d = len(train.first()["x"])
    spread = train.select(*[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in spread])
    weights = np.zeros(d)
    for _ in range(STEPS):
        sums = pairs.mapInArrow(_step(weights, scale), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        total = np.zeros((d + 1) ** 2)
        for r in sums.collect():  # (d + 1) squared numbers, whatever the data
            total[r["i"]] = r["v"]
        total = total.reshape(d + 1, d + 1)
        n = max(total[d, d], 1.0)
        move = np.linalg.solve(total[:d, :d] / n + RIDGE * np.eye(d), total[d, :d] / n + RIDGE * weights)
        weights = weights - move
        if np.abs(move).max() < 1e-4:
            break
    discard(pairs)
    return np.round(weights, 6), scale


def _utility(weights: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _matrix(batch.column(1)) @ (weights / scale) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(u)], names=["doc_id", "u"])
    return run


def best_cut(scored: DataFrame) -> float:
    """The quantile of the training utilities that separates the labels best."""
    marks = [i / GRID for i in range(GRID + 1)]
    cuts = sorted(set(scored.select(F.percentile_approx("u", marks, 100_000).alias("q")).first()["q"]))
    above = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("u")))
    counts = {(r["k"], r["quality"]): r["n"] for r in scored.groupBy(above.alias("k"), "quality")
              .agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    best, where = -1, cuts[0]
    for i, cut in enumerate(cuts):  # a row is kept if its utility reaches the cut
        right = sum(n for (k, q), n in counts.items() if (k > i) == (q == 1))
        if right > best:
            best, where = right, cut
    return float(where) if total else 0.0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    x = featurise(docs)
    known = (labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                      F.col("quality").cast("int").alias("quality"))
             .dropDuplicates(["doc_id"]))
    train = stored(x.where(~held_out(F.col("doc_id"))).join(known, "doc_id"), "train")
    model = fit(train)
    out = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"))
    if model is None:
        return out.select("*", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    run = _utility(*model)
    cut = best_cut(train.select("doc_id", "x").mapInArrow(run, "doc_id long, u double")
                   .join(known, "doc_id"))
    u = x.mapInArrow(run, "doc_id long, u double")
    s = 1 / (1 + F.exp(-F.least(F.greatest(F.col("u") - F.lit(cut), F.lit(-50.0)), F.lit(50.0))))
    return u.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"),
                    F.when(s >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
