"""Per-source rates over the last seconds before each alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .scan import window_counts

RATE_COLUMNS = (
    "flows_per_sec", "alerts_count_5s", "syn_only_ratio", "hits_30s", "hits_2s", "multi_hit", "syn_flood_trigger",
)


def has_syn(sig: str = "signature"):
    return F.lower(F.coalesce(F.col(sig), F.lit(""))).contains("syn")


def syn_flood_hint(sig: str = "signature"):
    text = F.lower(F.coalesce(F.col(sig), F.lit("")))
    return text.contains("syn") & text.contains("flood")


STAMPS = "src_ip string, t_us long, _flow boolean, _alert boolean, _syn boolean"


def source_stamps(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """What the counts depend on: one row per flow and alert."""
    none = F.lit(False)
    return flows.select(
        "src_ip", "t_us", F.lit(True).alias("_flow"), none.alias("_alert"), none.alias("_syn")
    ).unionByName(
        alerts.select("src_ip", "t_us", none.alias("_flow"), F.lit(True).alias("_alert"), has_syn().alias("_syn"))
    )


def source_counts(flows: DataFrame, alerts: DataFrame, params: Params = DEFAULTS, earlier: DataFrame | None = None) -> DataFrame:
    """Raw counts per (src_ip, t_us) of an alert: one exchange of pre-aggregated stamps for all frames.

    ``earlier`` holds stamps of rows before those given (columns of ``STAMPS``).
    """
    stamps = source_stamps(flows, alerts)
    if earlier is not None:
        stamps = stamps.unionByName(earlier)
    return window_counts(
        stamps, "src_ip", "t_us",
        counters={"flow": F.col("_flow"), "alert": F.col("_alert"), "syn": F.col("_syn")},
        frames={
            "n_flows": ("flow", params.flow_window_us),
            "n_alerts": ("alert", params.alert_window_us),
            "n_syn": ("syn", params.alert_window_us),
            "n_hits": ("alert", params.hit_window_us),
            "n_syn_hits": ("alert", params.syn_hit_window_us),
        },
        wanted="alert",
        slice_us=params.slice_us,
    )


def with_source_rates(alerts: DataFrame, flows: DataFrame, params: Params = DEFAULTS, earlier: DataFrame | None = None) -> DataFrame:
    """Adds the rate columns to each alert.  ``alerts`` are the admitted ones, ``flows`` all flows."""
    counts = source_counts(flows, alerts, params, earlier)
    return rates_from_counts(alerts.join(counts, ["src_ip", "t_us"], "left"), alerts.columns, params)


def rates_from_counts(joined: DataFrame, alert_columns, params: Params = DEFAULTS) -> DataFrame:
    """Rate columns from the raw counts; every event of a window counts."""

    def counted(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    n_alerts, hits_30s, hits_2s = counted("n_alerts"), counted("n_hits"), counted("n_syn_hits")
    return joined.select(
        *alert_columns,
        (counted("n_flows") / F.lit(params.flow_window_us / 1e6)).alias("flows_per_sec"),
        n_alerts.alias("alerts_count_5s"),
        (counted("n_syn") / F.greatest(n_alerts, F.lit(1).cast("bigint"))).alias("syn_only_ratio"),
        hits_30s.alias("hits_30s"),
        hits_2s.alias("hits_2s"),
        (hits_30s >= params.min_hits).alias("multi_hit"),
        (syn_flood_hint() & ((hits_2s >= params.min_hits) | (n_alerts >= params.min_hits))).alias("syn_flood_trigger"),
    )
