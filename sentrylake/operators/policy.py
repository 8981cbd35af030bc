"""Decisions, block intervals and notification suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..params import ATTACK_LABELS, DEFAULTS, Params
from .scan import asof_last, chained_gap


def with_labels(enriched: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``auto_label``, ``auto_label_conf``, ``label_sources`` from alert text and flow features."""
    alert = L.label_alert_live("signature", "category", "severity")
    flow = L.label_flow_rules(
        "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "flow_pkts_per_sec", "dest_port", params
    )
    resolved = (
        enriched.withColumns({"_alert": alert, "_flow": flow})
        .withColumn("_auto", L.resolve_pair("_alert", "_flow"))
    )
    return resolved.select(
        *enriched.columns,
        F.col("_auto.label").alias("auto_label"),
        F.col("_auto.confidence").alias("auto_label_conf"),
        F.col("_auto.sources").alias("label_sources"),
    )


def with_binary_label(labelled: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``y_attack`` and ``y_reason`` from the model's action and the automatic label."""
    binary = L.binary_label("action", "confidence", "auto_label", "auto_label_conf", params)
    return labelled.withColumn("_y", binary).select(
        *labelled.columns, F.col("_y.y_attack").alias("y_attack"), F.col("_y.y_reason").alias("y_reason")
    )


def _two(c) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def decision_conditions(params: Params = DEFAULTS) -> tuple[Column, Column, Column]:
    """(ready to block, strong automatic label, allow-listed): the parts that need no history."""
    ready = F.lit(params.monitoring_on) & (F.col("action") > 0) & (F.col("confidence") >= params.min_confidence)
    strong = (
        F.col("auto_label").isin(*ATTACK_LABELS)
        & (F.col("auto_label_conf") >= params.auto_confidence)
        & F.array_contains("label_sources", "alert")
        & F.array_contains("label_sources", "flow")
    )
    return ready, strong, L.is_allowlisted("signature", "category", "proto", "dest_port")


def decide(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``should_block`` and ``reason``.

    A positive, confident model action blocks when alert and flow agree on an attack, or when
    the event is not allow-listed and its source was seen often enough.
    """
    conf = F.col("confidence")
    ready, strong, allowed = decision_conditions(params)
    repeated = ~allowed & (F.col("multi_hit") | F.col("syn_flood_trigger"))
    # Fixed formats of the reason text.
    auto = F.concat(F.col("auto_label"), F.lit("@"), _two(F.col("auto_label_conf")))
    fast = F.concat(
        F.lit("DRL=BLOCK fast-track (conf "), _two(conf), F.lit("); auto="), auto, F.lit(" from alert+flow")
    )
    slow = F.concat(
        F.lit("DRL=BLOCK (conf "), _two(conf), F.lit("); auto="), auto, F.lit("; "),
        F.when(F.col("multi_hit"), F.lit("multi-hit OK")).otherwise(F.lit("SYN-flood policy")),
        F.lit("; agg(fps="), _two(F.col("flows_per_sec")),
        F.lit(", syn_ratio="), _two(F.col("syn_only_ratio")),
        F.lit(", alerts5s="), F.col("alerts_count_5s").cast("string"), F.lit(")"),
    )
    block = F.coalesce(ready & (strong | repeated), F.lit(False))
    return df.withColumns({
        "should_block": block,
        "reason": F.when(~block, F.lit("")).when(strong, fast).otherwise(slow),
    })


def block_intervals(
    decisions: DataFrame,
    block_us: int | None = None,
    params: Params = DEFAULTS,
    commands: DataFrame | None = None,
    id_col: str = "event_id",
) -> DataFrame:
    """Blocks opened by decisions: ``ip, block_us, unblock_us, reason, confidence, event_id``.

    A block opens unless its address is already blocked, and lasts ``block_us``.  Optional
    ``commands`` (``ip``, ``t_us``) close a block early; a request at the same instant opens a
    new one.  Requests for the whitelist or the local host must be removed before.
    """
    length = params.block_us if block_us is None else block_us
    requests = decisions.filter("should_block").select(
        F.col("src_ip").alias("ip"), "t_us", id_col, "reason", "confidence"
    )
    keys = ["ip"]
    if commands is not None:
        # A command ends whatever is open, so the rule starts afresh after it.
        commands = commands.select("ip", "t_us").distinct()
        parts = asof_last(requests, commands, ["ip"], "t_us", [], slice_us=params.slice_us)
        parts = parts.select("ip", "t_us", F.coalesce("_entry_t", F.lit(-(1 << 62))).alias("_since"))
        requests = requests.join(parts, ["ip", "t_us"])
        keys = ["ip", "_since"]
    opened = chained_gap(requests, keys, "t_us", length)
    first = requests.groupBy(*keys, "t_us").agg(F.min_by(F.struct(id_col, "reason", "confidence"), id_col).alias("_r"))
    blocks = opened.join(first, [*keys, "t_us"]).select(
        "ip",
        F.col("t_us").alias("block_us"),
        (F.col("t_us") + length).alias("unblock_us"),
        F.col("_r.reason").alias("reason"),
        F.col("_r.confidence").alias("confidence"),
        F.col(f"_r.{id_col}").alias(id_col),
    )
    if commands is None:
        return blocks
    # next command after the opening: an as-of lookup on the reversed time line
    later = asof_last(
        blocks.select("ip", (-(F.col("block_us") + 1)).alias("_r")),
        commands.select("ip", (-F.col("t_us")).alias("_r")),
        ["ip"], "_r", [], slice_us=params.slice_us,
    ).select("ip", (-F.col("_r") - 1).alias("block_us"), (-F.col("_entry_t")).alias("_stop"))
    return (
        blocks.join(later, ["ip", "block_us"], "left")
        .withColumn("unblock_us", F.least("unblock_us", F.coalesce("_stop", "unblock_us")))
        .drop("_stop")
    )


def active_blocks(blocks: DataFrame, at_us) -> DataFrame:
    """Blocks in force at an instant; a block is released at its unblock time."""
    at = at_us if isinstance(at_us, Column) else F.lit(at_us)
    return blocks.filter((F.col("block_us") <= at) & (F.col("unblock_us") > at))


def list_blocked(active: DataFrame) -> DataFrame:
    return active.orderBy(F.col("block_us").desc(), "ip")


def dedup_notifications(
    alerts: DataFrame, gap_us: int | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Notifications sent per (src_ip, signature): the first, then each one a gap after the last sent."""
    keyed = alerts.select(
        F.coalesce("src_ip", F.lit("")).alias("src_ip"), F.coalesce("signature", F.lit("")).alias("signature"), "t_us"
    )
    return chained_gap(keyed, ["src_ip", "signature"], "t_us", params.notify_gap_us if gap_us is None else gap_us)
