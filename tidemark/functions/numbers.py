"""Numeric rules shared by all operators. Everything is a Column expression, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rounded(x, digits: int = 0) -> Column:
    """Halves go up (-2.5 -> -2). What isn't finite becomes null, as in the JSON that users see."""
    x, p = _col(x).cast("double"), float(10**digits)
    big = F.abs(x) * p >= 2.0**53  # has no digits beyond these anyway
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.when(big, x).otherwise(F.floor(F.when(big, F.lit(0.0)).otherwise(x) * p + 0.5).cast("double") / p))


def ratio(a, b) -> Column:
    """a / b on doubles with signed infinities and NaN instead of an error, for ratios that are ranked."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    inf = F.lit(float("inf"))
    zero = F.when(a > 0, inf).when(a < 0, -inf).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def pct_change(latest, base) -> Column:
    """In percent; null where the base is null or 0."""
    latest, base = _col(latest).cast("double"), _col(base).cast("double")
    return (latest / F.nullif(base, F.lit(0.0)) - 1) * 100


def annualized(latest, base, years: int) -> Column:
    latest, base = _col(latest).cast("double"), _col(base).cast("double")
    return (F.pow(latest / F.nullif(base, F.lit(0.0)), F.lit(1.0 / years)) - 1) * 100


def share(part, whole, digits: int = 1) -> Column:
    """part of whole in percent; null where there is no whole. The quotient is scaled once, so that halves such as 23 of 80 (28.75) aren't
    lost to a second rounding."""
    part, whole, p = _col(part).cast("double"), _col(whole).cast("double"), float(10**digits)
    return F.when(whole > 0, F.floor(part / F.nullif(whole, F.lit(0.0)) * (100 * p) + 0.5).cast("double") / p)


def parsed(text) -> Column:
    """The number a text begins with (1.23% -> 1.23), else null."""
    return F.regexp_extract(_col(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def whole_number(text, default: int, least: int) -> Column:
    """An integer parameter: 0 and what isn't a number give the default; nothing below `least`."""
    n = F.regexp_extract(_col(text), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    return F.greatest(F.lit(least), F.coalesce(F.nullif(n, F.lit(0)), F.lit(default)))


def heat(value, most, cap: float | None = None) -> Column:
    """Intensity of a cell: against the column's largest value, or against a fixed cap."""
    v = F.abs(_col(value))
    if cap is not None:
        return F.least(v / cap, F.lit(1.0)) * 0.55
    return 0.12 + 0.38 * F.least(F.lit(1.0), v / F.nullif(_col(most), F.lit(0.0)))


def signed_percent(value, digits: int = 2) -> Column:
    v = _col(value)
    return F.when(v.isNull(), F.lit("—")).otherwise(F.format_string(f"%+.{digits}f%%", v))
