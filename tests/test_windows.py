"""trailing() equals a brute-force window on random data with a hot key."""

import datetime as dt
import random

from pyspark.sql import functions as F

import pytest

from gridkit.operators import windows as W
from gridkit.operators.windows import trailing


@pytest.mark.parametrize("days,width", [(3, None), (3, 86400), (3, 3600), (365, 86400), (365, 365 * 86400)])
def test_trailing_matches_brute_force(spark, days, width):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows, rid = [], 0
    for key, n in (("hot", 400), ("a", 30), ("b", 5)):
        for _ in range(n):
            rid += 1
            sec = rnd.randrange(0, (20 if days < 30 else 1500) * 86400)
            if rnd.random() < 0.1 and rows:
                sec = int((rows[-1][2] - t0).total_seconds())   # duplicate timestamps
            rows.append((rid, key, t0 + dt.timedelta(seconds=sec), float(rnd.randrange(100))))
    rows += [(rid + 1 + i, None, t0 + dt.timedelta(days=i), 1.5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")
    lookback = days * 86400
    got = {r.id: (r.n, r.s, r.mn, r.mx) for r in trailing(
        df, "k", "ts", lookback,
        {"n": ("count", F.lit(1)), "s": ("sum", "v"), "mn": ("min", "v"), "mx": ("max", "v")}, width).collect()}
    assert len(got) == len(rows)
    for rid_, key, ts, _ in rows:
        win = [v for (_, k2, ts2, v) in rows
               if k2 == key and ts - dt.timedelta(seconds=lookback) <= ts2 <= ts]
        n, s, mn, mx = got[rid_]
        assert n == len(win) and abs(s - sum(win)) < 1e-6 and mn == min(win) and mx == max(win)


def test_merged_outages_overlap_touch_disjoint(spark):
    from fixtures import ASSETS, REGION, SITES, tables
    from gridkit.operators.windows import merged_outages
    T = dt.datetime
    outs = [
        (1, 10, 1, T(2024, 1, 1, 0), T(2024, 1, 1, 5), "w", True, 1.0),
        (2, 10, 1, T(2024, 1, 1, 3), T(2024, 1, 1, 8), "w", True, 2.0),    # overlaps 1
        (3, 10, 1, T(2024, 1, 1, 8), T(2024, 1, 1, 9), "w", True, 4.0),    # touches 2
        (4, 10, 1, T(2024, 1, 3, 0), T(2024, 1, 3, 1), "w", True, 8.0),    # disjoint
        (5, 20, 2, T(2024, 1, 1, 0), T(2024, 1, 1, 2), "w", True, 1.0),
        (6, 20, 2, T(2024, 1, 1, 0), T(2024, 1, 1, 1), "w", True, 1.0),    # same start
    ]
    t = tables(spark, regions=REGION, sites=SITES, assets=ASSETS, outages=outs)
    got = sorted((r.asset_id, r.merged_start, r.merged_end, r.outages, r.lost_mwh)
                 for r in merged_outages(t).collect())
    assert got == [(10, T(2024, 1, 1, 0), T(2024, 1, 1, 9), 3, 7.0),
                   (10, T(2024, 1, 3, 0), T(2024, 1, 3, 1), 1, 8.0),
                   (20, T(2024, 1, 1, 0), T(2024, 1, 1, 2), 2, 2.0)]


def test_null_values_and_chunk_width(spark):
    """Windows of nulls alone stay null across chunks; the width follows the fullest key."""
    rows = [("a", i, None if i % 7 else float(i)) for i in range(0, 60, 2)] + [("b", 3 * i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, at long, v double")
    for width in (1, 2, 6, 12):
        out = W.trailing_on(df, "k", F.col("at"), 12, {"n": ("count", "v"), "s": ("sum", "v"), "mn": ("min", "v")}, width)
        for r in out.collect():
            win = [v for k, a, v in rows if k == r.k and r.at - 12 <= a <= r.at and v is not None]
            assert (r.n, r.s, r.mn) == (len(win), sum(win) if win else None, min(win) if win else None)
    with pytest.raises(ValueError):
        W.trailing_on(df, "k", F.col("at"), 12, {"n": ("count", "v")}, 5)
    assert W.packed_width(df, "k", F.col("at"), 12, rows=100) == 12
    assert W.packed_width(df, "k", F.col("at"), 12, rows=2) == 4
    assert W.packed_width(df.where("false"), "k", F.col("at"), 12) == 12
