"""Row filters (all usable on streams except ``first_n_alerts``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import standardise_reason
from ..functions.net import in_network
from ..functions.numeric import to_int
from ..functions.text import contains_any, first_truthy, hash32
from ..functions.times import parse_instant
from ..params import DEFAULTS, Params


def of_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.filter(F.col("event_type") == event_type)


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, alerts); every other record type is dropped."""
    return of_type(events, "flow"), of_type(events, "alert")


def destination(columns) -> Column:
    names = [c for c in ("dest_ip", "dst_ip") if c in columns]
    return first_truthy(*names, empty="")


def admission(columns, params: Params = DEFAULTS) -> Column:
    """Alert is aimed at the local host and carries a signature that is not ignored."""
    sig = F.coalesce(F.col("signature"), F.lit(""))
    aimed = F.coalesce(destination(columns) == params.local_ip, F.lit(False))
    return aimed & (sig != "") & ~contains_any(sig, params.ignored_signatures)


def admit_alerts(alerts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return alerts.filter(admission(alerts.columns, params))


def admit_benign_flows(flows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Inbound flows large enough to serve as benign samples."""
    dst = destination(flows.columns)
    pkts = F.coalesce("pkts_toserver", F.lit(0)) + F.coalesce("pkts_toclient", F.lit(0))
    size = F.coalesce("bytes_toserver", F.lit(0)) + F.coalesce("bytes_toclient", F.lit(0))
    return flows.filter(
        (F.coalesce(F.col("src_ip"), F.lit("")) != "")
        & dst.isNotNull()
        & (F.col("src_ip") != dst)
        & (pkts >= params.flow_min_pkts)
        & (size >= params.flow_min_bytes)
        & in_network(dst, params.home_net)
    )


def benign_sample(flows: DataFrame, params: Params = DEFAULTS, id_col: str = "event_id") -> DataFrame:
    """Keeps a fixed share of the flows, chosen by a hash of the id, labelled as benign."""
    pick = hash32(F.col(id_col).cast("string")) % 10000 <= int(round(params.benign_sample_rate * 10000))
    return flows.filter(pick).withColumns({
        "signature": F.lit("BENIGN_FLOW"),
        "status": F.lit("benign"),
        "direction": F.lit("inbound"),
        "action": F.lit(0),
        "confidence": F.lit(0.0),
        "y_attack": F.lit(0),
        "y_reason": F.lit("benign"),
    })


def first_n_alerts(alerts: DataFrame, n: int, order=("t_us", "event_id")) -> DataFrame:
    """First ``n`` alerts in file order (a top-k, not a full sort)."""
    return alerts.orderBy(*order).limit(n)


def valid_timestamps(df: DataFrame, column: str = "timestamp", required=()) -> DataFrame:
    """Drops rows whose time stamp cannot be read; a missing column is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.filter(parse_instant(column).isNotNull())


def require_rows(df: DataFrame, at_least: int = 1) -> DataFrame:
    """Raises when the table has fewer rows; reads no more than ``at_least`` of them."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise ValueError(f"{found} rows, at least {at_least} are needed")
    return df


def attacks_only(df: DataFrame, reason: str = "y_reason") -> DataFrame:
    """Attack rows with a standard attack type in ``attack_type``."""
    return (
        df.filter(to_int("y_attack") == 1)
        .withColumn("attack_type", standardise_reason(reason))
        .filter(F.col("attack_type").isNotNull())
    )
