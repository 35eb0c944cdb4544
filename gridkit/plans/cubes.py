"""Pre-aggregated tables of a metric view that answer every measure.

A measure is an expression over aggregate calls.  ``measure_plan`` takes the calls
out of its text: each becomes one or more *states* that can be merged further, and
the rest of the text, over the merged states, is the measure's finaliser.

=================  =======================================  ====================
call               states written per group                 merged by
=================  =======================================  ====================
SUM(x)             SUM(x)                                   SUM
COUNT(x | *)       COUNT(x)                                 SUM (0 when empty)
MIN(x), MAX(x)     MIN(x) / MAX(x)                          MIN / MAX
AVG(x)             SUM(x as double), COUNT(x)               sum over count
STDDEV, VARIANCE   COUNT(x), exact SUM(x), SUM(x * x)       moments
COUNT(DISTINCT x)  a table of its own: one row per group    count of the distinct
                   and key                                  keys of the new group
=================  =======================================  ====================

Keys are rows, never arrays, so a group of any size is spread over tasks.  A cube
is written to a ``states`` table and ``distinct_<key>`` tables under one path; a query sums the
states and the key counts of its own groups in one union, so nothing is joined and
null groups need no care.  ``route`` answers a query from the smallest cube that
holds its dimensions and states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metric_view import Field, MetricView, _meta

_CALL = re.compile(r"\b(SUM|COUNT|MIN|MAX|AVG|STDDEV|STDDEV_SAMP|VARIANCE|VAR_SAMP)\s*\(", re.IGNORECASE)
_QUOTED = re.compile(r"'[^']*'")
#: exact moments: as many digits as a product of two of these keeps
_EXACT = "CAST({} AS DECIMAL(19,6))"


def aggregate_calls(expr: str) -> list[tuple[int, int, str, str]]:
    """(start, end, function, argument) of the aggregate calls of a measure."""
    plain = _QUOTED.sub(lambda m: "'" + "x" * (len(m.group()) - 2) + "'", expr)
    out, at = [], 0
    while m := _CALL.search(plain, at):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        out.append((m.start(), end, m.group(1).upper(), expr[m.end(): end - 1].strip()))
        at = end
    return out


@dataclass(frozen=True)
class State:
    """One mergeable column: its name, the call that makes it and the one that merges it."""
    name: str
    make: str
    merge: str


@dataclass(frozen=True)
class Plan:
    """What a measure needs: states, distinct keys (name -> expression), finaliser."""
    states: tuple[State, ...]
    keys: tuple[tuple[str, str], ...]
    final: str


def _name(kind: str, arg: str) -> str:
    digest = hashlib.sha256(re.sub(r"\s+", " ", arg).encode()).hexdigest()[:12]
    return f"{kind}_{digest}"


def _state(fn: str, arg: str) -> State:
    name = _name(fn.lower(), arg)
    merge = f"COALESCE(SUM({name}), 0)" if fn == "COUNT" else f"{fn if fn in ('MIN', 'MAX') else 'SUM'}({name})"
    return State(name, f"{fn}({arg})", merge)


def measure_plan(measure: Field) -> Plan:
    states: dict[str, State] = {}
    keys: dict[str, str] = {}

    def use(fn: str, arg: str) -> str:
        s = _state(fn, arg)
        states[s.name] = s
        return s.name

    text, at = "", 0
    for start, end, fn, arg in aggregate_calls(measure.expr):
        distinct = re.match(r"DISTINCT\s+", arg, re.IGNORECASE)
        if distinct and fn == "COUNT":
            key = arg[distinct.end():]
            new = _name("distinct", key)
            keys[new] = key
        elif distinct and fn in ("MIN", "MAX"):
            new = use(fn, arg[distinct.end():])
        elif distinct:
            raise ValueError(f"{measure.name}: no mergeable state for {fn}({arg})")
        elif fn == "AVG":
            new = f"({use('SUM', f'CAST({arg} AS DOUBLE)')} / NULLIF({use('COUNT', arg)}, 0))"
        elif fn in ("SUM", "COUNT", "MIN", "MAX"):
            new = use(fn, arg)
        else:
            x = _EXACT.format(arg)
            n, s, q = use("COUNT", arg), use("SUM", x), use("SUM", f"{x} * {x}")
            # the difference of the exact moments, then one division
            moment = f"GREATEST(CAST({q} AS DOUBLE) - CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / {n}, 0.0D)"
            new = f"(CASE WHEN {n} > 1 THEN {moment} / ({n} - 1) END)"
            if fn.startswith("STDDEV"):
                new = f"SQRT{new}"
        text += measure.expr[at:start] + new
        at = end
    return Plan(tuple(states.values()), tuple(keys.items()), text + measure.expr[at:])


@dataclass(frozen=True)
class Cube:
    """A written pre-aggregate of ``view``: its dimensions, states and key tables."""
    view: MetricView
    path: str
    dims: tuple[str, ...]
    states: frozenset[str]
    keys: frozenset[str]
    rows: int

    def covers(self, dims: Sequence[str], measures: Sequence[str], where: str | None = None) -> bool:
        need = set(dims) | set(self.view.named_dimensions(where))
        plans = [measure_plan(self.view.measure(m)) for m in measures]
        return (need <= set(self.dims)
                and all(s.name in self.states for p in plans for s in p.states)
                and all(k in self.keys for p in plans for k, _ in p.keys))

    def query(self, spark, dims: Sequence[str] = (), measures: Sequence[str | tuple[str, str]] = (),
              where: str | None = None, order_by: Sequence[str] | None = None,
              limit: int | None = None) -> DataFrame:
        """What ``view.query`` returns, from this cube's tables."""
        named = [(m, m) if isinstance(m, str) else tuple(m) for m in measures]
        if not self.covers(dims, [m for m, _ in named], where):
            raise KeyError(f"{self.view.name}: the cube of {list(self.dims)} lacks a dimension or state "
                           f"of {list(dims)} x {[m for m, _ in named]}")
        plans = {m: measure_plan(self.view.measure(m)) for m, _ in named}
        states = {s.name: s for p in plans.values() for s in p.states}
        keys = {k for p in plans.values() for k, _ in p.keys}

        def read(part):
            df = spark.read.parquet(f"{self.path}/{part}")
            return df.where(F.expr(where)) if where else df

        parts = [read("states").select(*dims, *states)]
        for k in sorted(keys):
            parts.append(read(k).select(*dims, "key").distinct().groupBy(*dims).agg(F.count("key").alias(k)))
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        grouped = merged.groupBy(*dims).agg(
            *[F.expr(s.merge).alias(s.name) for s in states.values()],
            *[F.expr(f"COALESCE(SUM({k}), 0)").alias(k) for k in sorted(keys)],
            F.lit(1).alias("__group"))
        out = grouped.select(*dims, *[F.expr(plans[m].final).alias(a, metadata=_meta(self.view.measure(m)))
                                      for m, a in named])
        return self.view.ordered(out, dims, order_by, limit)


def write_cube(view: MetricView, tables, dims: Sequence[str], path: str,
               measures: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> Cube:
    """Aggregate ``view`` to ``dims`` and write the states of ``measures`` (all of them
    by default) and one key table per distinct count."""
    plans = [measure_plan(view.measure(m)) for m in measures or [m.name for m in view.measures]]
    states = {s.name: s for p in plans for s in p.states}
    keys = {k: e for p in plans for k, e in p.keys}
    texts = [s.make for s in states.values()] + list(keys.values())
    rows = view.projected(tables, dims, texts)

    def write(df, part):
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{part}")

    # a cube of distinct counts alone still knows its groups
    aggs = [F.expr(s.make).alias(s.name) for s in states.values()] or [F.count(F.lit(1)).alias("count_rows")]
    write(rows.groupBy(*dims).agg(*aggs), "states")
    for k, expr in keys.items():
        write(rows.select(*dims, F.expr(expr).alias("key")).where("key IS NOT NULL").distinct(), k)
    n = rows.sparkSession.read.parquet(f"{path}/states").count()
    return Cube(view, path, tuple(dims), frozenset(states), frozenset(keys), n)


def route(cubes: Sequence[Cube], dims: Sequence[str], measures: Sequence[str],
          where: str | None = None) -> Cube | None:
    """The smallest cube that can answer the query."""
    fit = [c for c in cubes if c.covers(dims, measures, where)]
    return min(fit, key=lambda c: c.rows) if fit else None
