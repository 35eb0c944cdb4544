"""Literal logical tables for branches the supplied data cannot reach."""

import datetime as dt

from gridkit.sources.bindings import LOGICAL_TABLES, Tables
from gridkit.sources.schemas import empty, frame

D = dt.date
T = dt.datetime


def tables(spark, **rows):
    """Tables.from_frames with the given literal rows, other tables empty."""
    frames = {}
    for t in LOGICAL_TABLES:
        frames[t] = frame(spark, t, rows[t]) if t in rows else empty(spark, t)
    return Tables.from_frames(spark, frames)


REGION = [(1, "R1")]
SITES = [(1, 1, "S1", "wind", 100.0, D(2010, 1, 1)), (2, 1, "S2", "solar", 50.0, D(2011, 1, 1))]
ASSETS = [
    (10, 1, "WIN-10", "wind_turbine", "OEM-0", D(2015, 1, 1), 20, 5.0),
    (11, 1, "TRF-11", "transformer", "OEM-1", D(2015, 1, 1), 20, 5.0),
    (20, 2, "INV-20", "inverter", "OEM-2", D(2016, 1, 1), 20, 3.0),
]
