"""Time expressions.  None depends on the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OFFSET = r"([zZ]|[+-]\d{2}:?\d{2})\s*$"
_DATE_ONLY = r"^\s*\d{4}-\d{2}-\d{2}\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_instant(c) -> Column:
    """ISO text to an instant; text without an offset is UTC, unreadable text is NULL."""
    c = _c(c)
    zoned = (
        F.when(c.rlike(_OFFSET), F.trim(c))
        .when(c.rlike(_DATE_ONLY), F.concat(F.trim(c), F.lit("T00:00:00Z")))
        .otherwise(F.concat(F.trim(c), F.lit("Z")))
    )
    return zoned.try_cast("timestamp")


def parse_micros(c) -> Column:
    return F.unix_micros(parse_instant(c))


def parse_epoch(c) -> Column:
    """Whole seconds since 1970, 0 when unreadable."""
    return F.coalesce(F.unix_seconds(parse_instant(c)), F.lit(0).cast("bigint"))


def parse_local(c) -> Column:
    """Wall clock in the event's own offset."""
    return _c(c).try_cast("timestamp_ntz")


def ntz_micros(c) -> Column:
    """Microseconds of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(c))


def micros_to_ntz(c) -> Column:
    """Zone-less timestamp of UTC microseconds."""
    return F.timestamp_add("MICROSECOND", _c(c), F.lit("1970-01-01").cast("timestamp_ntz"))


def hour_of(local) -> Column:
    return F.coalesce(F.hour(_c(local)), F.lit(0))


def weekday_of(local) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(_c(local)), F.lit(0))


def cyclic(c, period: int) -> tuple[Column, Column]:
    angle = _c(c) * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def parse_windows(windows: DataFrame, local_tz: str = "Asia/Jakarta") -> DataFrame:
    """Table of text ``(start, end)`` to inclusive epoch-second windows ``(start_s, end_s)``.

    A bound is an integer epoch or ISO text; text without an offset is in ``local_tz``.
    Windows with an unreadable bound or with end before start are dropped.
    """

    def bound(name: str) -> Column:
        c = F.trim(F.col(name))
        naive = F.convert_timezone(F.lit(local_tz), F.lit("UTC"), c.try_cast("timestamp_ntz"))
        return (
            F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
            .when(c.rlike(_OFFSET), F.unix_seconds(c.try_cast("timestamp")))
            .otherwise(F.floor(ntz_micros(naive) / F.lit(1_000_000)).cast("bigint"))
        )

    return (
        windows.select(bound("start").alias("start_s"), bound("end").alias("end_s"))
        .filter(F.col("end_s") >= F.col("start_s"))
    )
