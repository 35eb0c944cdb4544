"""Registered metric queries answered from written cubes (m04): every measure of the
four views from a fine and from a coarse pre-aggregate, and routed queries."""

from __future__ import annotations

import uuid

from ..session import scratch_path
from ..sources.bindings import load
from . import q_metrics as M
from .cubes import Cube, route, write_cube
from .registry import register

#: the fine cubes: every dimension of the view (of work orders, those of an asset's day)
FINE = {v: [d.name for d in M.views()[v].dimensions] for v in (M.GO, M.FIN, M.EX)}
FINE[M.MW] = ["asset_id", "asset_type", "site_name", "region_name", "work_order_type", "priority", "status",
              "created_date", "created_month"]
#: the coarse cubes: a region's month
COARSE = {M.GO: ["region_name", "month", "quarter", "year"], M.FIN: ["region_name", "month", "quarter", "year"],
          M.MW: ["region_name", "created_month"], M.EX: ["region_name", "month", "quarter"]}

_WRITTEN: dict[tuple, tuple] = {}


def cubes(spark, sf_dir: str, view: str) -> dict[str, Cube]:
    """The fine and the coarse cube of a view, written once per state of the source."""
    t = load(spark, sf_dir)
    key = (id(getattr(spark, "_jsparkSession", spark)), sf_dir, view)
    held = _WRITTEN.get(key)
    if held is None or held[0] is not spark or held[1] != t.state:
        path = scratch_path(spark, f"cubes-{view}-{uuid.uuid4().hex[:10]}")
        made = {name: write_cube(M.views()[view], t, dims[view], f"{path}/{name}")
                for name, dims in (("fine", FINE), ("coarse", COARSE))}
        held = _WRITTEN[key] = (spark, t.state, made)
    return held[2]


def cube_query(name, view, grain, dims, measures, where=None):
    """Register a metric query answered by the cube of ``grain``, or by the smallest
    that covers it when ``grain`` is None."""
    def run(spark, sf_dir):
        held = cubes(spark, sf_dir, view)
        text = M._spark_where(where)
        names = [m if isinstance(m, str) else m[0] for m in measures]
        cube = held[grain] if grain else route(list(held.values()), dims, names, text)
        return cube.query(spark, dims, measures, text)
    run.__name__ = name
    register(name, M.metric_sql(view, dims, measures, where))(run)


for _view, _short, _fine, _coarse in (
        (M.GO, "grid", ["asset_type", "month"], ["region_name", "quarter"]),
        (M.FIN, "finance", ["generation_type", "month"], ["region_name", "quarter"]),
        (M.MW, "maintenance", ["work_order_type", "priority"], ["region_name", "created_month"]),
        (M.EX, "executive", ["generation_type", "executive_risk_level"], ["region_name", "quarter"])):
    _all = [m.name for m in M.views()[_view].measures]
    cube_query(f"m04_{_short}_fine_cube", _view, "fine", _fine, _all)
    cube_query(f"m04_{_short}_coarse_cube", _view, "coarse", _coarse, _all)

cube_query("m04_routed_total", M.GO, None, [], M.GO_MEASURES)
cube_query("m04_routed_filter", M.GO, None, ["region_name"],
           ["mtbf_hours", "avg_vibration", "grid_instability_risk_score", "capacity_factor_pct"],
           where="{asset_health_status} IN ('Watchlist', 'Critical') AND {month} IS NOT NULL")
cube_query("m04_routed_quarter", M.FIN, None, ["quarter"],
           ["profit_margin_pct", "revenue_loss_from_outages_usd"], where="{region_name} <> 'ASIA'")
