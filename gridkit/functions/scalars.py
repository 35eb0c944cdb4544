"""Column-expression helpers.  All JVM-side built-ins; no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    """A DOUBLE literal (a bare ``24.0`` in SQL text is DECIMAL in Spark)."""
    return F.lit(float(x)).cast("double")


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of an ANSI division error."""
    d = col(den)
    return col(num) / F.when(d != 0, d)


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch (``UNIX_TIMESTAMP``)."""
    return F.unix_timestamp(col(ts))


def hours_between(start, end) -> Column:
    """``(UNIX_TIMESTAMP(end) - UNIX_TIMESTAMP(start)) / 3600`` as DOUBLE."""
    return (epoch_seconds(end) - epoch_seconds(start)) / dbl(3600)


def trunc_ts(unit: str, ts) -> Column:
    """``date_trunc`` that keeps zone-less input zone-less."""
    return F.date_trunc(unit, col(ts)).cast("timestamp_ntz")


def add_hours(ts, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return F.timestamp_add("HOUR", h.cast("int"), col(ts))


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(hi)), F.lit(lo))


def sigmoid(x) -> Column:
    return dbl(1) / (dbl(1) + F.exp(-col(x)))


def sum_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def count_if(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)``."""
    return F.count(F.when(cond, F.lit(1)))


def case_ladder(arms: Sequence[tuple[Column, object]], default) -> Column:
    """Searched CASE; first matching arm wins, UNKNOWN falls through."""
    out = None
    for cond, val in arms:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d) if out is not None else d


def case_value(x, mapping: Iterable[tuple[object, object]], default) -> Column:
    """Simple CASE ``x WHEN v THEN r ... ELSE default END``."""
    c = col(x)
    return case_ladder([(c == F.lit(k), v) for k, v in mapping], default)


# Reports sum and round in decimals: a decimal sum does not depend on the order
# of its terms, and a decimal tie is a tie in every engine, at any magnitude.
EXACT = "decimal(28,9)"
REPORT = "decimal(38,9)"


def exact_sum(x) -> Column:
    """``SUM`` of DOUBLE values taken at nine decimals (DECIMAL result)."""
    return F.sum(col(x).cast(EXACT))


def exact_avg(x) -> Column:
    """``AVG`` from the exact sum (DOUBLE result)."""
    return exact_sum(x).cast("double") / F.count(col(x))


def rnd(x, scale: int = 0) -> Column:
    """``ROUND(x, scale)`` half away from zero on the decimal value of ``x``."""
    return F.round(col(x).cast(REPORT), scale).cast("double")


#: beyond this a scaled double is no longer a whole number that a long and a double
#: share; and so near to a tie the digits of the decimal value decide
_ROUND_BOUND, _TIE = 1e9, 1e-3


def round_double(x, scale: int, exactly=rnd) -> Column:
    """``exactly(x, scale)`` of a DOUBLE, in plain arithmetic where that is the same: the
    scaled value goes to the nearest whole number.  Near ties, large values, NaN and
    infinities take the decimal way."""
    c, unit = col(x), float(10 ** scale)
    scaled = F.abs(c) * dbl(unit)
    near = F.signum(c) * F.floor(scaled + dbl(0.5)) / dbl(unit) + dbl(0)
    plain = (F.abs(c) < _ROUND_BOUND) & (F.abs(scaled - F.floor(scaled) - dbl(0.5)) > _TIE)
    return F.when(plain, near).otherwise(exactly(c, scale))


def asset_tag(asset_type, asset_id) -> Column:
    """f14: ``TYP-00042`` -- first three letters of the type, upper case, and
    the zero-padded id."""
    return F.format_string("%s-%05d", F.upper(F.substring(col(asset_type), 1, 3)),
                           col(asset_id).cast("long"))


def site_label(region_name, generation_type, seq) -> Column:
    """f14: ``REGION-TYPE-001`` site label."""
    return F.format_string("%s-%s-%03d", col(region_name), F.upper(col(generation_type)),
                           col(seq).cast("long"))


def sql_quote_col(c) -> Column:
    """f15: escape single quotes for a SQL literal (``'`` -> ``''``)."""
    return F.replace(col(c), F.lit("'"), F.lit("''"))


def iso_date(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")
