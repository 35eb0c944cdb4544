"""Spread interval values equal a plain loop; shuffled rows follow the intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkit.operators.intervals import spread


def brute(rows):
    out = {}
    for key, a, b, v in rows:
        if a is None or b is None or b <= a:
            continue
        for step in range(a, b):
            known, total = out.get((key, step), (0, 0.0))
            out[key, step] = (known + (v is not None), total + (v or 0.0) / (b - a))
    return {k: total if known else None for k, (known, total) in out.items()}


ROWS = [("a", 0, 1, 5.0), ("a", 0, 10, 3.0), ("a", 3, 7, None), ("b", 5, 5, 1.0), ("b", 9, 4, 1.0), ("c", None, 4, 1.0),
        ("d", -700, 900, 1600.0), ("d", 64, 128, 0.1), ("d", 128, 129, 0.2), (None, 2, 4, 1.0), ("e", 7, 9, None),
        ("f", 63, 64, 1.0), ("f", 64, 65, 2.0), ("g", 0, 64, 6.4), ("g", 192, 256, 6.4), ("a", 0, 10, 3.0)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 100000])
def test_equal_to_a_loop(spark, chunk):
    rng = np.random.default_rng(2)
    rows = ROWS + [(f"k{int(rng.integers(4))}", int(a), int(a + rng.integers(1, 300)), float(rng.uniform(-5, 50)))
                   for a in rng.integers(-500, 500, 120)]
    df = spark.createDataFrame(rows, "k string, a long, b long, v double")
    got = [tuple(r) for r in spread(df, ["k"], F.col("a"), F.col("b"), "v", chunk).collect()]
    want = brute(rows)
    assert len(got) == len(want) == len({r[:2] for r in got})
    for k, step, total in got:
        w = want[k, step]
        assert (total is None) == (w is None) and (w is None or abs(total - w) < 1e-8)


def test_nothing_is_left_after_an_interval(spark):
    df = spark.createDataFrame([("a", 0, 3, 0.1), ("a", 1, 8, 0.7), ("a", 10, 11, 0.3)], "k string, a long, b long, v double")
    steps = sorted(r["step"] for r in spread(df, ["k"], F.col("a"), F.col("b"), "v").collect())
    assert steps == [0, 1, 2, 3, 4, 5, 6, 7, 10]


def test_shuffled_rows_follow_the_intervals(spark):
    """Intervals a hundred times longer change nothing before the last step."""
    sizes = []
    for length in (50, 5000):
        df = spark.range(400).select((F.col("id") % 5).alias("k"), (F.col("id") * 3).alias("a"), F.lit(1.0).alias("v"))
        out = spread(df, ["k"], F.col("a"), F.col("a") + length, "v", chunk=2000)
        exploded = out._jdf.queryExecution().optimizedPlan().toString()
        assert exploded.index("Generate") < exploded.index("Window")  # the steps come after every window
        sizes.append(out.select("k").count())
    assert sizes[1] > 5 * sizes[0]
