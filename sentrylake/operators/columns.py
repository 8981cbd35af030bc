"""Column-level preparation: conforming, renaming, defaults, flattening, features sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net, numeric, text, times
from ..functions.flow import flow_feature_columns
from ..params import COLUMN_ALIASES, LABEL_PRIORITY, POSITIVE_STATUS
from ..schema import CLASSIFIER_FEATURES, DATASET_COLUMNS, RUNTIME_FEATURES


def conform_columns(df: DataFrame, columns=DATASET_COLUMNS, default: str = "") -> DataFrame:
    """Exactly ``columns`` in that order: missing ones become ``default``, others are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(default).alias(c) for c in columns])


def merge_versions(parts: list[DataFrame], columns=DATASET_COLUMNS) -> DataFrame:
    """Tables of different ages as one table with the canonical columns, all text."""
    out = None
    for part in parts:
        have = set(part.columns)
        view = part.select(*[F.col(c).cast("string") for c in columns if c in have])
        out = view if out is None else out.unionByName(view, allowMissingColumns=True)
    have = set(out.columns)
    return out.select(*[(F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns])


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case, stripped names; known aliases renamed where the target name is free."""
    names = [c.strip().lower() for c in df.columns]
    df = df.toDF(*names)
    for alias, target in COLUMN_ALIASES:
        if alias in names and target not in names:
            names[names.index(alias)] = target
    df = df.toDF(*names)
    if "flow_pkts_per_sec" not in names and {"fwd_pkts_per_sec", "bwd_pkts_per_sec"} <= set(names):
        both = numeric.to_number("fwd_pkts_per_sec") + numeric.to_number("bwd_pkts_per_sec")
        df = df.withColumn("flow_pkts_per_sec", both)
    return df


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Absent columns are added; NULLs in present ones take the same default."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()
    })


def dest_port_fallback(df: DataFrame) -> DataFrame:
    """Uses ``dst_port`` for the whole table, but only if every ``dest_port`` is 0."""
    if "dst_port" not in df.columns:
        return df
    if "dest_port" not in df.columns:
        return df.withColumn("dest_port", F.col("dst_port"))
    all_zero = df.agg(F.coalesce(F.every(F.coalesce(F.col("dest_port"), F.lit(-1)) == 0), F.lit(True))).scalar()
    return df.withColumn("dest_port", F.when(all_zero, F.col("dst_port")).otherwise(F.col("dest_port")))


def flatten_event(eve: DataFrame) -> DataFrame:
    """Nested records as one level of ``outer_inner`` columns.

    A top-level column wins over a nested one of the same flat name.
    """
    flat: dict[str, Column] = {}
    nested = [f for f in eve.schema.fields if hasattr(f.dataType, "fields")]
    for field in nested:
        for f in field.dataType.fields:
            flat[f"{field.name}_{f.name}"] = F.col(field.name)[f.name]
    flat |= {c: F.col(c) for c in eve.columns if c not in {f.name for f in nested}}
    return eve.select(*[c.alias(n) for n, c in flat.items()])


def normalise_event(eve: DataFrame) -> DataFrame:
    """Nested records to the flat event columns that every operator of this package reads.

    The alternates of the flow counters and the given duration stay columns of their own, since
    live, evaluation and vector features prefer different ones.  The destination is the first
    address that is not empty and the first port that is not 0.
    """
    flow, alert = F.col("flow"), F.col("alert")
    passthrough = [c for c in ("event_id", "log_file", "event_date") if c in eve.columns]
    return eve.select(
        *passthrough,
        "timestamp",
        times.parse_micros("timestamp").alias("t_us"),
        times.parse_local("timestamp").alias("ts_local"),
        "event_type",
        "src_ip",
        text.first_truthy("dest_ip", "dst_ip", empty="").alias("dest_ip"),
        "src_port",
        F.coalesce(text.first_truthy("dest_port", "dst_port", empty=0), "dest_port", "dst_port").alias("dest_port"),
        "proto", "flow_id", "community_id",
        flow.isNotNull().alias("has_flow"),
        alert.isNotNull().alias("has_alert"),
        *[flow[c].alias(c) for c in (
            "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
            "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot", "flow_duration",
        )],
        times.parse_micros(F.coalesce(flow["start"], F.col("flow_start"))).alias("start_us"),
        times.parse_micros(F.coalesce(flow["end"], F.col("flow_end"))).alias("end_us"),
        alert["signature"].alias("signature"),
        alert["category"].alias("category"),
        alert["severity"].alias("severity"),
        alert["signature_id"].alias("signature_id"),
    )


def runtime_features(df: DataFrame, keep=("event_id",)) -> DataFrame:
    """The 17 raw features of the detector, computed from flat events."""
    flow = flow_feature_columns(df.columns, "vector")
    flags = net.proto_flags("proto")
    cols = {
        "src_port": numeric.to_number("src_port"),
        "dest_port": numeric.to_number("dest_port"),
        "proto_tcp": flags["proto_tcp"],
        "proto_udp": flags["proto_udp"],
        "hour": times.hour_of("ts_local"),
        "weekday": times.weekday_of("ts_local"),
        "sig_len": text.signature_length("signature"),
        "sig_hash": text.signature_hash("signature"),
    } | flow
    return df.select(*keep, *[cols[c].cast("double").alias(c) for c in RUNTIME_FEATURES])


def runtime_features_from_dataset(df: DataFrame, keep=("event_id",)) -> DataFrame:
    """The same 17 features read from a stored data set, where the flow features are columns."""
    flags = net.proto_flags("proto")
    special = {
        "proto_tcp": flags["proto_tcp"],
        "proto_udp": flags["proto_udp"],
        "hour": times.hour_of(times.parse_local("timestamp")),
        "weekday": times.weekday_of(times.parse_local("timestamp")),
        "sig_len": text.signature_length("signature"),
        "sig_hash": text.signature_hash("signature"),
    }
    have = set(df.columns)

    def column(c: str) -> Column:
        if c in special:
            return special[c].cast("double")
        return numeric.to_number(c) if c in have else F.lit(0.0)

    base = dest_port_fallback(fill_defaults(df, {c: "" for c in ("timestamp", "proto", "signature") if c not in have}))
    have = set(base.columns)
    return base.select(*keep, *[column(c).alias(c) for c in RUNTIME_FEATURES])


def classifier_features(df: DataFrame, keep=("event_id",), local: str = "ts_local", port: str = "dest_port") -> DataFrame:
    """The 17 features of the attack-type classifier; flow features must be present columns."""
    flags = net.proto_flags("proto")
    hour_sin, hour_cos = times.cyclic(times.hour_of(local), 24)
    day_sin, day_cos = times.cyclic(times.weekday_of(local), 7)
    special = flags | {
        "hour_sin": hour_sin, "hour_cos": hour_cos,
        "weekday_sin": day_sin, "weekday_cos": day_cos,
        "dst_port_norm": numeric.port_norm(port),
    }
    have = set(df.columns)

    def column(c: str) -> Column:
        if c in special:
            return special[c]
        return numeric.to_number(c) if c in have else F.lit(0.0)

    return df.select(*keep, *[column(c).cast("double").alias(c) for c in CLASSIFIER_FEATURES])


def label_by_priority(df: DataFrame, priority=LABEL_PRIORITY, out: str = "y") -> DataFrame:
    """Binary label from the first column of ``priority`` that the table has."""
    have = set(df.columns)
    chosen = next((c for c in priority if c in have), None)
    if chosen is None:
        raise ValueError(f"the table has none of the label columns {list(priority)}")
    as_text = F.lower(F.trim(F.coalesce(F.col(chosen).cast("string"), F.lit(""))))
    rules = {
        "label": numeric.to_int(chosen),
        "y_attack": (numeric.to_number(chosen) > 0).cast("bigint"),
        "auto_label": (as_text != "benign").cast("bigint"),
        "status": as_text.isin(*POSITIVE_STATUS).cast("bigint"),
        "action": (numeric.to_number(chosen) > 0).cast("bigint"),
        "threat_score": (numeric.to_number(chosen) > 70).cast("bigint"),
    }
    return df.withColumn(out, rules[chosen].cast("int"))
