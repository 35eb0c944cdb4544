"""Cubes: measures split into states, merged at any coarser grain, routed by size."""

import math

import pytest

from conftest import SF001
from gridkit.plans import cubes as C
from gridkit.plans import q_cubes
from gridkit.plans.metric_view import Field, MetricView
from gridkit.plans.views import all_views
from gridkit.session import scratch_path
from gridkit.sources.bindings import load


def test_every_measure_has_a_plan():
    n = 0
    for v in all_views().values():
        for m in v.measures:
            plan = C.measure_plan(m)
            n += 1
            assert plan.states or plan.keys
            assert not C.aggregate_calls(plan.final) and "DISTINCT" not in plan.final
    assert n == 55


def test_calls_with_nested_brackets_and_quotes():
    calls = C.aggregate_calls("SUM(CASE WHEN a IN ('x)', '(y') THEN 1 END) / NULLIF(COUNT(DISTINCT b), 0)")
    assert [(fn, arg) for _, _, fn, arg in calls] == [
        ("SUM", "CASE WHEN a IN ('x)', '(y') THEN 1 END"), ("COUNT", "DISTINCT b")]
    with pytest.raises(ValueError):
        C.measure_plan(Field("bad", "SUM(DISTINCT x)"))


ROWS = [("a", 1, 2.5, "k"), ("a", 1, 1e6, "k"), ("a", 2, None, "l"), ("b", 1, -3.0, None), ("b", 2, 4.25, "k"),
        (None, 1, 7.0, "m"), (None, None, 0.125, "k"), ("c", 3, None, None), ("b", 2, 4.25, "k")]
MEASURES = [("total", "SUM(source.x)"), ("mean", "AVG(source.x)"), ("n", "COUNT(*)"), ("filled", "COUNT(source.x)"),
            ("least", "MIN(source.x)"), ("most", "MAX(source.x)"), ("kinds", "COUNT(DISTINCT source.k)"),
            ("spread", "STDDEV(source.x)"), ("variance", "VARIANCE(source.x)"),
            ("ratio", "100.0D * SUM(source.x) / NULLIF(COUNT(DISTINCT source.k), 0)"),
            ("mixed", "COALESCE(AVG(source.x), 0.0D) + MAX(source.d) - COUNT(DISTINCT source.g)")]


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame(ROWS, "g string, d int, x double, k string")
    view = MetricView("small", "", lambda t: t, dimensions=(Field("g", "source.g"), Field("d", "source.d")),
                      measures=tuple(Field(n, e) for n, e in MEASURES))
    return view, df, C.write_cube(view, df, ["g", "d"], scratch_path(spark, "cube-small"))


def _same(a, b):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    got, want = rows(a), rows(b)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (g, w)


@pytest.mark.parametrize("dims", [[], ["g"], ["d"], ["d", "g"]])
@pytest.mark.parametrize("where", [None, "g = 'b' OR d IS NULL", "g = 'none'"])
def test_merged_states_equal_the_direct_query(spark, small, dims, where):
    view, df, cube = small
    names = [n for n, _ in MEASURES]
    _same(cube.query(spark, dims, names, where), view.query(df, dims, names, where))


def test_order_limit_alias_and_missing_parts(spark, small):
    view, df, cube = small
    args = (["g"], [("kinds", "k_count"), "n"], None, ["k_count DESC"], 2)
    assert [tuple(r) for r in cube.query(spark, *args).collect()] == [
        tuple(r) for r in view.query(df, *args).collect()]
    part = C.write_cube(view, df, ["g"], scratch_path(spark, "cube-part"), ["total", "n"])
    assert not part.covers(["d"], ["n"]) and not part.covers([], ["n"], "d = 1") and not part.covers([], ["kinds"])
    assert C.route([cube, part], ["g"], ["total"]) is part and C.route([cube, part], ["g"], ["mean"]) is cube
    assert C.route([part], [], ["kinds"]) is None
    with pytest.raises(KeyError):
        part.query(spark, ["d"], ["n"])


def test_routes_of_the_registered_cubes(spark):
    held = q_cubes.cubes(spark, SF001, q_cubes.M.GO)
    assert held["coarse"].rows < held["fine"].rows
    every = list(held.values())
    assert C.route(every, ["month"], ["mtbf_hours"]) is held["coarse"]
    assert C.route(every, ["month"], ["mtbf_hours"], "asset_type = 'inverter'") is held["fine"]
    direct = q_cubes.M.views()[q_cubes.M.GO].query(load(spark, SF001), ["quarter"], ["mtbf_hours"])
    _same(held["coarse"].query(spark, ["quarter"], ["mtbf_hours"]), direct)
