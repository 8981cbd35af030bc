"""Flow features as column expressions.

Input columns: ``t_us`` (event time), ``start_us``/``end_us`` (flow bounds), the four counters
``pkts_toserver``, ``pkts_toclient``, ``bytes_toserver``, ``bytes_toclient`` and, where the
source has them, the alternates ``fwd_pkts_tot``, ``bwd_pkts_tot``, ``fwd_data_pkts_tot``,
``bwd_data_pkts_tot`` and ``flow_duration``.  The ``*_data_pkts_tot`` features hold bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLOW_FEATURES, HEADER_FEATURES
from .numeric import finite, safe_ratio

_COUNTERS = {
    "fwd_pkts_tot": "pkts_toserver",
    "bwd_pkts_tot": "pkts_toclient",
    "fwd_data_pkts_tot": "bytes_toserver",
    "bwd_data_pkts_tot": "bytes_toclient",
}
RATIO_MODES = ("live", "eval", "vector")


def duration_us(has_fallback: bool = False) -> Column:
    """Flow length in microseconds, never negative; event time stands in for a missing bound."""
    span = F.coalesce(F.col("end_us"), F.col("t_us")) - F.coalesce(F.col("start_us"), F.col("t_us"))
    zero = F.lit(0).cast("bigint")
    if has_fallback:  # stays NULL where no bound is known
        return F.when(span.isNotNull(), F.greatest(span, zero))
    return F.greatest(span, zero)


def ratio(fwd: Column, bwd: Column, mode: str) -> Column:
    """Backward per forward packet; the three callers treat ``fwd = 0`` differently."""
    if mode == "live":
        return safe_ratio(bwd, fwd)
    if mode == "eval":
        return finite(bwd / F.greatest(fwd, F.lit(1)))
    if mode == "vector":
        return (
            F.when(fwd > 0, F.try_divide(bwd.cast("double"), fwd.cast("double")))
            .when(bwd > 0, F.lit(999.0))
            .otherwise(F.lit(0.0))
        )
    raise ValueError(f"mode must be one of {RATIO_MODES}")


def flow_feature_columns(columns, mode: str = "live") -> dict[str, Column]:
    """The nine flow features for a table with the given ``columns``."""
    columns = set(columns)

    def counter(name: str) -> Column:
        order = [_COUNTERS[name], name]
        if mode == "vector":
            order.reverse()
        elif mode == "live":
            order = order[:1]
        present = [F.col(c) for c in order if c in columns]
        return F.coalesce(*present, F.lit(0)).cast("bigint")

    fwd, bwd = counter("fwd_pkts_tot"), counter("bwd_pkts_tot")
    if mode == "vector" and "flow_duration" in columns:
        seconds = F.coalesce(duration_us(True) / F.lit(1e6), finite("flow_duration"))
    else:
        seconds = duration_us() / F.lit(1e6)
    per = F.when(seconds > 0, seconds).otherwise(F.lit(1.0))

    def limit(c: Column) -> Column:
        # whole counts over a positive length: never NaN, so only the live path's bounds remain
        return F.least(F.greatest(c, F.lit(-1e12)), F.lit(1e12)) if mode == "live" else c

    return {
        "flow_duration": limit(seconds),
        "fwd_pkts_tot": fwd,
        "bwd_pkts_tot": bwd,
        "fwd_data_pkts_tot": counter("fwd_data_pkts_tot"),
        "bwd_data_pkts_tot": counter("bwd_data_pkts_tot"),
        "fwd_pkts_per_sec": limit(fwd / per),
        "bwd_pkts_per_sec": limit(bwd / per),
        "flow_pkts_per_sec": limit((fwd + bwd) / per),
        "down_up_ratio": ratio(fwd, bwd, mode),
    }


def with_flow_features(df: DataFrame, mode: str = "live", headers: bool = False) -> DataFrame:
    feats = flow_feature_columns(df.columns, mode)
    if headers:
        feats |= {h: F.lit(0.0) for h in HEADER_FEATURES}
    # One projection, so that no feature reads another that was just replaced.
    kept = [F.col(c) for c in df.columns if c not in feats]
    return df.select(*kept, *[c.alias(n) for n, c in feats.items()])


__all__ = ["FLOW_FEATURES", "duration_us", "flow_feature_columns", "ratio", "with_flow_features"]
