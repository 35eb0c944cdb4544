"""The pipeline: each stage's decisions on its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF001
from test_operators import ROWS, SCHEMA, brute_components, rows, shingle_set


def stage_inputs(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for name, f in P.STAGES:
        f(spark, out[-1], sf_dir).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_stages(spark, tmp_path):
    sf = SF001.replace("0.001", "0.01")  # the smallest has too few labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw, quality, exact, near, clean, packed = stage_inputs(spark, docs, sf, tmp_path)
    for df in (quality, exact, near, clean):
        assert df.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in quality.collect()}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(right) >= 0.97 * len(right)

    texts = {r["doc_id"]: r["text"] for r in quality.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    assert {r["doc_id"] for r in exact.collect()} == set(first.values())

    texts = {r["doc_id"]: r["text"] for r in exact.collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    ids = sorted(sets)
    find = brute_components((a, b) for i, a in enumerate(ids) for b in ids[:i]
                            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in near.collect()} == {find(d) for d in ids}

    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip()
    items = [fold(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in near.collect() if any(i in fold(r["text"]) for i in items)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - leaks
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {d for d, _ in tokens} == {r["doc_id"] for r in clean.collect()}
    assert all(n == want for (_, want), n in tokens.items())


def test_awkward_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, f in P.STAGES:
        assert rows(f(spark, docs.where("false"), SF001)) == []
        rows(f(spark, docs, SF001))


def test_one_row_stays_of_equal_rows(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "c"), (6, "c"), (None, "c")], SCHEMA)
    assert Counter(rows(P.exact(spark, docs, SF001))) == Counter([(5, "a b"), (5, "c")])


def test_columns_with_clashing_names_travel_along(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA)
    extra = docs
    for c in ("score", "predicted", "kept", "component", "keep_id", "sha", "size", "__id_", "key", "n", "start", "ids",
              "item_id", "edits", "batch", "shard", "length"):
        extra = extra.withColumn(c, F.lit("clash"))
    for name, f in P.STAGES:
        plain, wide = f(spark, docs, SF001), f(spark, extra, SF001)
        if name == "pack":
            assert sorted(wide.columns) == sorted(plain.columns)
        else:
            assert wide.columns == extra.columns
            assert Counter(rows(wide.select("doc_id", "text"))) == Counter(rows(plain.select("doc_id", "text"))), name
            assert wide.where("score <> 'clash'").isEmpty()
