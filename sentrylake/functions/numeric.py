"""Lenient numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(c, text: bool) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if text:
        # A trailing type suffix ("1d", "2f") is a number to the JVM but not to the data format.
        c = F.when(~c.rlike("[dDfF]\\s*$"), c)
    return c.try_cast("double")


def finite(c, default: float = 0.0, text: bool = False) -> Column:
    """Number, or ``default`` when it is missing, unreadable, NaN or infinite."""
    v = _num(c, text)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(v)


def safe_num(c, lo: float = -1e12, hi: float = 1e12, default: float = 0.0, text: bool = False) -> Column:
    """``finite`` limited to [lo, hi]."""
    return F.least(F.greatest(finite(c, default, text), F.lit(float(lo))), F.lit(float(hi)))


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """num / den, or ``default`` when the denominator is 0 or either side is unreadable."""
    n, d = _num(num, False), _num(den, False)
    usable = n.isNotNull() & d.isNotNull() & (d != 0.0)
    return F.when(usable, safe_num(F.try_divide(n, d), default=default)).otherwise(F.lit(float(default)))


def to_number(c, default: float = 0.0) -> Column:
    """Number with only unreadable or NaN values replaced (infinities stay)."""
    return F.coalesce(F.nanvl(_num(c, False), F.lit(float(default))), F.lit(float(default)))


def to_int(c) -> Column:
    """Whole number; anything unreadable becomes 0."""
    return F.coalesce(finite(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def port_norm(c) -> Column:
    return to_number(c) / F.lit(65535.0)


def conform_vector(vec, n: int) -> Column:
    """Array of doubles padded with zeros, or cut, to length ``n``."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def unit_interval(c) -> Column:
    """NaN and -Inf to 0, +Inf to 1, everything else clipped to [0, 1]."""
    return F.least(F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
