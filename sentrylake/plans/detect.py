"""The detection pipeline: admit, enrich, rate, label, decide, block, notify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import admit_alerts, split_events
from ..operators.joins import FLOW_CARRY, asof_flow_features, drop_whitelisted
from ..operators.policy import (
    block_intervals,
    decide,
    dedup_notifications,
    with_binary_label,
    with_labels,
)
from ..operators.scan import materialise
from ..operators.windows import with_source_rates
from ..params import DEFAULTS, Params

Model = Callable[[DataFrame], DataFrame]

OUTPUT = (
    "event_id", "t_us", "src_ip", "dest_ip", "src_port", "dest_port", "proto", "signature", "category", "severity",
    "hit", "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
    "flows_per_sec", "syn_only_ratio", "alerts_count_5s", "multi_hit", "syn_flood_trigger",
    "auto_label", "auto_label_conf", "label_sources", "action", "confidence", "y_attack", "y_reason",
    "should_block", "reason",
)


OPENED = "event_id long, src_ip string, t_us long, should_block boolean, reason string, confidence double"


@dataclass(frozen=True)
class History:
    """What earlier rows (up to ``since``) leave for later ones: latest flows, stamps of the windows,
    last announcements, and the requests that opened a block."""

    since: int
    flows: DataFrame
    stamps: DataFrame
    sent: DataFrame
    opened: DataFrame


def decisions(events: DataFrame, model: Model, params: Params = DEFAULTS, past: History | None = None) -> DataFrame:
    """One row per admitted alert with everything but the block and notification state.

    ``model`` adds ``action`` and ``confidence`` to enriched alerts.
    """
    flows, alerts = split_events(events)
    admitted = admit_alerts(alerts, params)
    known = flows
    if past is not None:
        known = flows.select(*[f.split()[0] for f in FLOW_CARRY.split(", ")]).unionByName(past.flows)
    enriched = asof_flow_features(admitted, known, params)
    rated = with_source_rates(enriched, flows, params, None if past is None else past.stamps)
    labelled = with_binary_label(model(with_labels(rated, params)), params)
    return decide(labelled, params)


def detect(events: DataFrame, model: Model, params: Params = DEFAULTS) -> DataFrame:
    """Decisions with ``blocked`` (this alert opened a block) and ``notified`` (this alert was announced).

    The decisions are written once to the checkpoint folder; blocks and notifications read them
    from there instead of repeating the enrichment.
    """
    return detect_with(events, model, params)[0]


def detect_with(
    events: DataFrame, model: Model, params: Params = DEFAULTS, past: History | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions with flags, requests that opened a block, stamps announced); with the past taken into account.

    An opened block or an announcement of the past is the first link of its key's chain, and is
    left out of what comes back.
    """
    judged = decisions(events, model, params, past)
    more = [c for c in ("attack_type",) if c in judged.columns]  # given by models that tell types apart
    decided = materialise(judged.select(*OUTPUT, *more))
    names = [f.split()[0] for f in OPENED.split(", ")]
    requests = drop_whitelisted(decided, params).select(*names)
    stamps = decided.select("src_ip", "signature", "t_us")
    if past is not None:
        requests, stamps = requests.unionByName(past.opened), stamps.unionByName(past.sent)
    blocks = block_intervals(requests, params=params)
    sent = dedup_notifications(stamps, params=params)
    if past is not None:
        blocks, sent = blocks.filter(F.col("block_us") > past.since), sent.filter(F.col("t_us") > past.since)
    blocks, sent = materialise(blocks), materialise(sent)
    opened = blocks.select("event_id", F.lit(True).alias("blocked"))
    # a missing source or signature counts as an empty one, as in the suppression itself
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("src_ip", "signature")]
    first = decided.groupBy(*keys, "t_us").agg(F.min("event_id").alias("event_id"))
    announced = first.join(sent, ["src_ip", "signature", "t_us"]).select("event_id", F.lit(True).alias("notified"))
    found = (
        decided.join(opened, "event_id", "left")
        .join(announced, "event_id", "left")
        .withColumns({
            "blocked": F.coalesce("blocked", F.lit(False)),
            "notified": F.coalesce("notified", F.lit(False)),
        })
    )
    requested = blocks.select(
        "event_id", F.col("ip").alias("src_ip"), F.col("block_us").alias("t_us"), F.lit(True).alias("should_block"), "reason", "confidence"
    )
    return found, requested, sent
