"""The inverted lists give exactly the scan's neighbours and skip what bounds allow."""

import numpy as np
import pytest

from conftest import SF001
from gridkit.operators import vector_index as V
from gridkit.session import scratch_path


def brute(data, queries, k):
    out = []
    for q, v in queries:
        if v is None or len(v) != 8 or not np.all(np.isfinite(v)) or not any(v):
            continue
        v = np.array(v) / np.linalg.norm(v)
        scored = []
        for i, e in data:
            if e is None or len(e) != 8 or any(x is None for x in e) or not np.all(np.isfinite(e)) or not any(e):
                continue
            scored.append((-round(float(v @ np.array(e)) / float(np.linalg.norm(e)), 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clustered(rng, n, kinds=12):
    centers = rng.normal(0, 1, (kinds, 8))
    return [(i, (centers[i % kinds] * rng.uniform(0.5, 3) + rng.normal(0, 0.08, 8)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = clustered(rng, 900)
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies: ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7), (2003, [1.0] * 7 + [float("nan")]),
             (2004, [1.0] * 7 + [None]), (2005, [float("inf")] + [1.0] * 7), (2006, [1e-30] * 8), (2007, [1e30] * 8)]
    return rows


def rows_of(found):
    return sorted(tuple(r) for r in found.rows.collect())


@pytest.mark.parametrize("lists,k", [(1, 5), (24, 1), (24, 7), (200, 60)])
def test_equal_to_the_scan(spark, data, lists, k):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    index = V.VectorIndex.build(df, scratch_path(spark, f"vectors-{lists}-{k}"), dims=8, lists=lists)
    rng = np.random.default_rng(4)
    queries = [(i, v) for i, v in data[::37] if v is not None and None not in v]
    queries += [(5000 + i, rng.normal(0, 1, 8).tolist()) for i in range(20)]
    queries += [(6000, None), (6001, [0.0] * 8), (6002, [1.0])]
    got, want = rows_of(index.search(queries, k)), brute(data, queries, k)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-9)
    again = V.VectorIndex.open(spark, index.path)
    assert rows_of(again.search(queries[:3], k)) == [r for r in got if r[0] in {q for q, _ in queries[:3]}]


def test_lists_are_skipped(spark):
    rows = clustered(np.random.default_rng(5), 2000, 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = V.VectorIndex.build(df, scratch_path(spark, "vectors-skip"), dims=8, lists=40)
    found = index.search(rows[:2], 10)
    assert [r[:3] for r in rows_of(found)] == [r[:3] for r in brute(rows, rows[:2], 10)]
    assert found.lists_read[0] < 20 and found.rows_read[0] < 1000


def test_blocks_of_queries_and_empty_tables(spark, monkeypatch):
    rows = clustered(np.random.default_rng(6), 120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = V.VectorIndex.build(df, scratch_path(spark, "vectors-blocks"), dims=8)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    found = index.search(rows[:20], 4)
    assert [r[:3] for r in rows_of(found)] == [r[:3] for r in brute(rows, rows[:20], 4)]
    assert len(found.lists_read) == 3
    assert rows_of(index.search([], 4)) == []
    none = V.VectorIndex.build(df.where("false"), scratch_path(spark, "vectors-none"), dims=8)
    assert rows_of(none.search(rows[:2], 3)) == []


def test_every_row_of_the_table_is_indexed(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    index = V.VectorIndex.build(emb, scratch_path(spark, "vectors-table"))
    assert int(index.size.sum()) == emb.count()
