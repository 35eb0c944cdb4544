"""Metric layer: named dimensions and measures over a source with nested
many-to-one joins, compiled to DataFrame aggregations.

A view is declared once (:class:`MetricView`) and queried with
``view.query(tables, dims, measures, where, order_by, limit)``, which is the
DataFrame form of ``SELECT dims, MEASURE(m) ... GROUP BY dims``.

Compilation
-----------
* The source rows are wrapped into one struct column ``source`` so source
  columns can never clash with dimension / measure names.
* Each join is a left join on its key; a joined table becomes a struct
  column named after the join (``asset``), and nested joins become nested
  structs (``asset.site.region.region_name`` resolves as struct access).
* Only joins whose alias (or nested path) occurs in the requested
  dimension, measure or filter expressions are attached; nested
  dimensions are joined to their parent *before* the parent meets the
  source, so the big side sees exactly one join per top-level alias.
* Joins carry no hint: a joined table is broadcast only when its known or
  measured size is under the threshold.
* Dimensions are projected first, the filter runs on them, then the
  group-by aggregates the measure expressions (partial + final).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Join:
    """``LEFT JOIN <table> AS <name> ON <parent>.<parent_key> = <name>.<key>``."""
    name: str
    table: str
    parent_key: str
    key: str
    joins: tuple["Join", ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    expr: str
    display_name: str = ""
    synonyms: tuple[str, ...] = ()
    format: str | None = None


@dataclass
class MetricView:
    name: str
    comment: str
    source: Callable[[object], DataFrame]
    joins: tuple[Join, ...] = ()
    dimensions: tuple[Field, ...] = ()
    measures: tuple[Field, ...] = ()
    version: str = "1.1"
    _dims: dict = field(init=False, repr=False)
    _meas: dict = field(init=False, repr=False)

    def __post_init__(self):
        self._dims = {d.name: d for d in self.dimensions}
        self._meas = {m.name: m for m in self.measures}

    # ------------------------------------------------------------ lookup
    def dimension(self, name: str) -> Field:
        try:
            return self._dims[name]
        except KeyError:
            raise KeyError(f"{self.name}: unknown dimension {name!r}") from None

    def measure(self, name: str) -> Field:
        try:
            return self._meas[name]
        except KeyError:
            raise KeyError(f"{self.name}: unknown measure {name!r}") from None

    def fields(self) -> list[tuple[str, Field]]:
        return ([("dimension", d) for d in self.dimensions]
                + [("measure", m) for m in self.measures])

    # ------------------------------------------------------------ compile
    def _needed_paths(self, texts: Sequence[str]) -> set[str]:
        """Join paths (``asset``, ``asset.site`` ...) referenced by the texts."""
        need: set[str] = set()

        def walk(j: Join, prefix: str):
            path = f"{prefix}{j.name}"
            pat = re.compile(r"(?<![\w.])" + re.escape(path) + r"\.")
            if any(pat.search(t) for t in texts):
                need.add(path)
                parts = path.split(".")
                for i in range(1, len(parts)):
                    need.add(".".join(parts[:i]))
            for c in j.joins:
                walk(c, path + ".")

        for j in self.joins:
            walk(j, "")
        return need

    def _build_join(self, tables, j: Join, path: str, need: set[str]) -> DataFrame:
        """One row per key of ``j.table``: ``(_k, <j.name> struct)``."""
        t = tables[j.table]
        cols = [F.col(c) for c in t.columns]
        df = t
        for c in j.joins:
            cpath = f"{path}.{c.name}"
            if cpath not in need:
                continue
            child = self._build_join(tables, c, cpath, need)
            child = child.withColumnRenamed("_k", f"_k_{c.name}")
            df = df.join(child, df[c.parent_key] == child[f"_k_{c.name}"], "left")
            cols.append(F.col(c.name))
        return df.select(F.col(j.key).alias("_k"), F.struct(*cols).alias(j.name))

    def frame(self, tables, texts: Sequence[str]) -> DataFrame:
        """Source rows with the joins the given expressions need."""
        src = self.source(tables)
        need = self._needed_paths(texts)
        keys = {j.parent_key for j in self.joins if j.name in need}
        base = src.select(F.struct(*[F.col(c) for c in src.columns]).alias("source"),
                          *[F.col(k).alias(f"_p_{k}") for k in sorted(keys)])
        for j in self.joins:
            if j.name not in need:
                continue
            dim = self._build_join(tables, j, j.name, need)
            base = base.join(dim, base[f"_p_{j.parent_key}"] == dim["_k"], "left").drop("_k")
        return base

    def all_joins(self) -> list[tuple[str, Join]]:
        """(path, join) of the whole tree."""
        def walk(joins, prefix):
            for j in joins:
                yield f"{prefix}{j.name}", j
                yield from walk(j.joins, f"{prefix}{j.name}.")
        return list(walk(self.joins, ""))

    def repeated_keys(self, tables, only: str | None = None) -> DataFrame:
        """``(join, key, rows)`` of the keys that a joined table holds more than
        once: the joins are many-to-one, such a key would multiply measures."""
        found = [tables[j.table].groupBy(F.col(j.key).cast("string").alias("key"))
                 .agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND key IS NOT NULL")
                 .select(F.lit(path).alias("join"), "key", "rows")
                 for path, j in self.all_joins() if only in (None, path)]
        if not found:
            return tables.spark.createDataFrame([], "join string, key string, rows long")
        return reduce(DataFrame.unionByName, found)

    def check_keys(self, tables) -> None:
        """Raise if a joined table repeats a key."""
        bad = self.repeated_keys(tables).limit(5).collect()
        if bad:
            raise ValueError(f"{self.name}: joined keys repeat: "
                             + ", ".join(f"{r['join']} {r['key']} ({r['rows']} rows)" for r in bad))

    def query(self, tables, dims: Sequence[str] = (),
              measures: Sequence[str | tuple[str, str]] = (),
              where: str | None = None,
              order_by: Sequence[str] | None = None,
              limit: int | None = None, check_keys: bool = False) -> DataFrame:
        """``SELECT dims, MEASURE(m) [AS alias] ... [WHERE] GROUP BY dims``.

        ``check_keys`` first verifies that no joined table repeats a key.

        ``where`` may reference any dimension name of the view.  ``order_by``
        items are output names with optional ``ASC``/``DESC``; with a
        ``limit`` the dimensions are appended as tie-breakers so the cut is
        deterministic.
        """
        if check_keys:
            self.check_keys(tables)
        meas = [(m, m) if isinstance(m, str) else tuple(m) for m in measures]
        meas_fields = [(self.measure(m), alias) for m, alias in meas]
        proj = self.projected(tables, dims, [m.expr for m, _ in meas_fields], where)
        aggs = [F.expr(m.expr).alias(alias, metadata=_meta(m)) for m, alias in meas_fields]
        if dims:
            out = proj.groupBy(*[F.col(d) for d in dims]).agg(*aggs)
        else:
            out = proj.agg(*aggs)
        return self.ordered(out.select(*dims, *[a for _, a in meas]), dims, order_by, limit)

    def named_dimensions(self, where: str | None) -> list[str]:
        """The dimensions that a filter names."""
        return [d.name for d in self.dimensions
                if where and re.search(rf"(?<![\w.]){re.escape(d.name)}(?![\w])", where)]

    def projected(self, tables, dims: Sequence[str], texts: Sequence[str],
                  where: str | None = None) -> DataFrame:
        """Filtered source rows with ``dims`` as columns and the joins that they, the
        filter and ``texts`` need."""
        fields = [self.dimension(d) for d in dims]
        fields += [self.dimension(d) for d in self.named_dimensions(where) if d not in dims]
        base = self.frame(tables, [d.expr for d in fields] + list(texts))
        proj = base.select("*", *[F.expr(d.expr).alias(d.name) for d in fields])
        return proj.filter(F.expr(where)) if where else proj

    @staticmethod
    def ordered(out: DataFrame, dims: Sequence[str], order_by: Sequence[str] | None,
                limit: int | None) -> DataFrame:
        keys = [_order_col(o) for o in (order_by or [])]
        if limit is not None:
            keys += [F.col(d).asc_nulls_first() for d in dims]
        if keys:
            out = out.orderBy(*keys)
        return out.limit(limit) if limit is not None else out

    def resolve(self, term: str) -> str:
        """m08: field name for an analyst term (name, display name or synonym,
        case-insensitive).  Raises on unknown or ambiguous terms."""
        t = term.strip().lower()
        hits = {f.name for _, f in self.fields()
                if t == f.name.lower() or t == f.display_name.lower()
                or t in (x.lower() for x in f.synonyms)}
        exact = {h for h in hits if h.lower() == t}
        if exact:
            return exact.pop()
        if not hits:
            raise KeyError(f"{self.name}: no field for term {term!r}")
        if len(hits) > 1:
            raise ValueError(f"{self.name}: term {term!r} is ambiguous: {sorted(hits)}")
        return hits.pop()

    def describe(self, spark) -> DataFrame:
        """m10: one row per field with display name, synonyms and format."""
        rows = [(self.name, kind, f.name, f.display_name, list(f.synonyms), f.format, f.expr)
                for kind, f in self.fields()]
        return spark.createDataFrame(
            rows, "view string, kind string, field string, display_name string, "
                  "synonyms array<string>, format string, expr string")


def _meta(f: Field) -> dict:
    """m09: display name and format travel with the output column."""
    m = {"display_name": f.display_name}
    if f.format:
        m["format"] = f.format
    return m


def _order_col(item: str) -> Column:
    parts = item.strip().split()
    name = parts[0]
    desc = len(parts) > 1 and parts[1].upper() == "DESC"
    c = F.col(name)
    return c.desc_nulls_last() if desc else c.asc_nulls_first()
