"""Enrichment and membership joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.flow import flow_feature_columns
from ..params import DEFAULTS, Params
from ..schema import FLOW_FEATURES
from .scan import asof_last, extent_of, materialise, slice_of

_COUNTERS = ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")
RAW_FLOW = _RAW = ("start_us", "end_us", *_COUNTERS)
#: What a flow must keep to be found by later alerts.
FLOW_CARRY = (
    "event_id long, t_us long, community_id string, flow_id long, src_ip string, dest_ip string, src_port int, dest_port int, "
    "proto string, start_us long, end_us long, pkts_toserver long, pkts_toclient long, bytes_toserver long, bytes_toclient long"
)


def flow_keys() -> Column:
    """The up to three lookup keys of an event, the preferred one first.

    Key texts of different kinds never meet, so one column can hold all of them.
    """
    return F.expr("""
        array_compact(array(
          CASE WHEN community_id <> '' THEN named_struct('prio', 0, 'key', concat('c|', community_id)) END,
          CASE WHEN flow_id <> 0 THEN named_struct('prio', 1, 'key', concat('f|', flow_id)) END,
          named_struct('prio', 2, 'key', concat_ws('|', 't', coalesce(src_ip, ''), coalesce(dest_ip, ''),
            coalesce(src_port, 0), coalesce(dest_port, 0), upper(coalesce(proto, '')))))
        )""")


def asof_flow_features(
    alerts: DataFrame,
    flows: DataFrame,
    params: Params = DEFAULTS,
    id_col: str = "event_id",
) -> DataFrame:
    """Adds the flow features of the latest earlier flow, ``hit`` and ``hit_key`` to each alert.

    The community id decides before the flow id, that before the address tuple, however old its
    entry is within the time to live.  Without a hit the features come from the alert's own flow
    record (``has_flow``), else they are 0.
    """
    keyed_flows = flows.select(
        F.explode(flow_keys()).alias("_k"), "t_us", F.col(id_col).alias("_flow_id"), *_RAW
    ).select("_k.key", "t_us", "_flow_id", *_RAW)
    asked = alerts.select(id_col, "t_us", F.explode(flow_keys()).alias("_k")).select(
        id_col, "t_us", "_k.prio", "_k.key"
    )
    found = asof_last(
        asked, keyed_flows, ["key"], "t_us", _RAW, tie="_flow_id", slice_us=params.slice_us,
        extent=extent_of((alerts, "t_us"), (flows, "t_us")),
    ).filter(F.col("t_us") - F.col("_entry_t") <= params.flow_ttl_us)
    values = {"t_us": F.col("_entry_t")} | {c: F.col(c) for c in _RAW}
    best = (
        asked.join(found, ["key", "t_us"])
        .groupBy(id_col)
        .agg(F.min("prio").alias("prio"), *[F.min_by(v, F.col("prio")).alias(f"_h_{c}") for c, v in values.items()])
        .select(id_col, F.struct("prio", *[F.col(f"_h_{c}").alias(c) for c in values]).alias("_hit"))
    )
    return features_from_hit(alerts.join(best, id_col, "left"), alerts.columns)


def features_from_hit(joined: DataFrame, alert_columns) -> DataFrame:
    """Flow features from the struct ``_hit`` (prio, t_us and raw flow columns; NULL for a miss)."""
    own = "has_flow" if "has_flow" in alert_columns else "true"
    kept = [c for c in alert_columns if c not in _RAW and c not in FLOW_FEATURES]
    # One set of raw columns: the hit's, else the alert's own, else zeros.
    counters = [f"CASE WHEN _hit IS NOT NULL THEN _hit.{c} WHEN {own} THEN {c} END AS {c}" for c in _COUNTERS]
    anchor = "coalesce(_hit.t_us, t_us)"
    bounds = [
        f"CASE WHEN _hit IS NOT NULL THEN coalesce(_hit.{c}, {anchor}) WHEN {own} THEN {c} ELSE t_us END AS {c}"
        for c in ("start_us", "end_us")
    ]
    raw = joined.selectExpr(*kept, *bounds, *counters, "_hit IS NOT NULL AS hit", "_hit.prio AS hit_key")
    feats = flow_feature_columns(raw.columns, "live")
    return raw.select(*kept, "hit", "hit_key", *[c.alias(n) for n, c in feats.items()])


def _addresses(attackers: DataFrame | None) -> DataFrame | None:
    """Distinct trimmed addresses as a written table; None for no address at all."""
    if attackers is None:
        return None
    ips = materialise(attackers.select(F.trim("ip").alias("ip")).filter("ip <> ''").distinct())
    return None if ips.isEmpty() else ips


def _spans(windows: DataFrame | None, bucket_s: int) -> DataFrame | None:
    """Windows merged where they meet, then cut at bucket borders: at most one per bucket and gap; None for none.

    The table of windows is settings, one row per window; it is sorted as a whole.
    """
    if windows is None:
        return None
    ordered = W.orderBy("start_s", "end_s")
    reach = F.max("end_s").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    marked = windows.filter("start_s <= end_s").select("start_s", "end_s").distinct().withColumn(
        "_new", F.coalesce((F.col("start_s") > reach + 1).cast("int"), F.lit(1))
    )
    merged = marked.withColumn("_island", F.sum("_new").over(ordered)).groupBy("_island").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )
    spans = merged.select(
        "start_s", "end_s",
        F.explode(F.sequence(slice_of("start_s", bucket_s), slice_of("end_s", bucket_s))).alias("_wb"),
    ).select(
        "_wb",
        F.greatest("start_s", F.col("_wb") * bucket_s).alias("_ws"),
        F.least("end_s", F.col("_wb") * bucket_s + bucket_s - 1).alias("_we"),
    )
    spans = materialise(spans)
    return None if spans.isEmpty() else spans


def attack_flags(
    events: DataFrame, attackers: DataFrame | None, windows: DataFrame | None, bucket_s: int = 3600
) -> DataFrame:
    """Adds boolean ``in_attack``: attacker address and attack window both match.

    ``attackers`` has ``ip``; ``windows`` has inclusive ``start_s, end_s``.  A missing or empty table
    puts no condition; with both missing or empty nothing matches.  Both are written first, so Spark
    knows their size and broadcasts them below its threshold: the events are then not shuffled at
    all.  Larger tables are joined by shuffle; no side is hinted.
    """
    ips, spans = _addresses(attackers), _spans(windows, bucket_s)
    if ips is None and spans is None:
        return events.withColumn("in_attack", F.lit(False))
    out, conds = events, []
    if spans is not None:
        second = slice_of(F.coalesce(F.col("t_us"), F.lit(0).cast("bigint")), 1_000_000)
        out = out.withColumn("_sec", second).withColumn("_bucket", slice_of("_sec", bucket_s))
        inside = (F.col("_bucket") == F.col("_wb")) & F.col("_sec").between(F.col("_ws"), F.col("_we"))
        out = out.join(spans, inside, "left")
        conds.append(F.col("_ws").isNotNull())
    if ips is not None:
        # outside the windows the address does not matter: such rows look up NULL and match nothing
        asked = [F.when(conds[0], F.col(c)) if conds else F.col(c) for c in ("src_ip", "dest_ip")]
        for c, name in zip(asked, ("_src", "_dst")):
            out = out.withColumn(f"{name}_ip", c)
            found = ips.select(F.col("ip").alias(f"{name}_key"), F.lit(True).alias(name))
            out = out.join(found, F.col(f"{name}_ip") == F.col(f"{name}_key"), "left")
        conds.append(F.coalesce("_src", "_dst", F.lit(False)))
    flag = conds[0] if len(conds) == 1 else conds[0] & conds[1]
    return out.withColumn("in_attack", flag).select(*events.columns, "in_attack")


def override_labels(labelled: DataFrame) -> DataFrame:
    """Rows in an attack window take the window label (needs ``in_attack``)."""
    hit = F.col("in_attack")
    return labelled.withColumns({
        "auto_label": F.when(hit, F.lit("attacker_window")).otherwise(F.col("auto_label")),
        "auto_label_conf": F.when(hit, F.lit(0.95)).otherwise(F.col("auto_label_conf")),
        "label_sources": F.when(hit, F.lit("attacker_ip_window")).otherwise(F.col("label_sources")),
    }).drop("in_attack")


def drop_whitelisted(requests: DataFrame, params: Params = DEFAULTS, whitelist: DataFrame | None = None,
                     ip: str = "src_ip") -> DataFrame:
    """Removes requests to block a whitelisted address or the local host."""
    fixed = requests.filter(~F.coalesce(F.col(ip), F.lit("")).isin(*params.whitelist, params.local_ip))
    if whitelist is None:
        return fixed
    return fixed.join(whitelist.select(F.col("ip").alias(ip)).distinct(), ip, "left_anti")


def drop_already_blocked(requests: DataFrame, active: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Removes requests for an address in ``active`` (column ``ip``)."""
    return requests.join(active.select(F.col("ip").alias(ip)).distinct(), ip, "left_anti")


