"""Row shapes of the stored tables and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text
from ..functions.flow import with_flow_features
from ..functions.numeric import to_int
from ..operators.joins import attack_flags, override_labels
from ..schema import AGGREGATE_COLUMNS, DATASET_COLUMNS, EVAL_COLUMNS, HEADER_FEATURES, LOG_COLUMNS


def _or(columns, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)


def dataset_rows(decided: DataFrame, keep=()) -> DataFrame:
    """Training data set rows: the canonical columns, then the per-source aggregates."""
    have = set(decided.columns)
    special = {
        "dst_ip": F.coalesce("dst_ip", F.lit("")) if "dst_ip" in have else _or(have, "dest_ip", ""),
        "dst_port": _or(have, "dest_port", 0) if "dest_port" in have else _or(have, "dst_port", 0),
        "src_ip": _or(have, "src_ip", ""),
        "src_port": _or(have, "src_port", 0),
        "proto": _or(have, "proto", "unknown"),
        "signature": text.clean_text("signature"),
        "action": to_int("action").cast("int"),
        "confidence": F.col("confidence").cast("double"),
        "status": _or(have, "status", "detected"),
        "direction": _or(have, "direction", "inbound"),
        "auto_label": _or(have, "auto_label", ""),
        "auto_label_conf": F.col("auto_label_conf") if "auto_label_conf" in have else F.lit(None).cast("double"),
        "label_sources": text.join_list("label_sources") if "label_sources" in have else F.lit(""),
        "y_attack": (to_int("y_attack") != 0).cast("int") if "y_attack" in have else F.lit(0),
        "y_reason": _or(have, "y_reason", ""),
        "flows_per_sec": _or(have, "flows_per_sec", 0.0),
        "syn_only_ratio": _or(have, "syn_only_ratio", 0.0),
        "alerts_count_5s": _or(have, "alerts_count_5s", 0).cast("bigint"),
    }

    def column(c: str) -> Column:
        if c in special:
            return special[c].alias(c)
        if c in HEADER_FEATURES and c not in have:
            return F.lit(0.0).alias(c)
        return F.col(c)

    return decided.select(*keep, *[column(c) for c in (*DATASET_COLUMNS, *AGGREGATE_COLUMNS)])


def training_rows(decided: DataFrame, benign: DataFrame, keep=()) -> DataFrame:
    """Rows of one training data set: decided alerts, and sampled benign flows with flow features."""
    return dataset_rows(decided, keep).unionByName(dataset_rows(benign, keep))


def eval_rows(
    events: DataFrame, attackers: DataFrame | None = None, windows: DataFrame | None = None,
    all_events: bool = False, keep=(),
) -> DataFrame:
    """Evaluation rows of flat events; only flow records unless ``all_events``."""
    rows = events if all_events else events.filter(F.col("event_type") == "flow")
    rows = attack_flags(rows, attackers, windows)
    feats = with_flow_features(rows, "eval")
    has_alert = F.col("has_alert") if "has_alert" in events.columns else None
    sid = "signature_id" if "signature_id" in events.columns else F.lit(0)
    label = L.label_alert_eval("signature", "category", "severity", sid, has_alert)
    labelled = feats.withColumn("_c", label).withColumns({
        "auto_label": F.col("_c.label"),
        "auto_label_conf": F.col("_c.score"),
        "label_sources": F.col("_c.src"),
    })
    out = override_labels(labelled).withColumns({
        "dst_ip": F.col("dest_ip"),
        "dst_port": F.col("dest_port"),
        "y_attack": L.eval_binary("auto_label"),
    })
    return out.select(*keep, *EVAL_COLUMNS)


def alert_log(admitted: DataFrame, keep=()) -> DataFrame:
    """Log rows of admitted alerts."""
    have = set(admitted.columns)
    cols = {
        "timestamp": F.col("timestamp"),
        "src_ip": F.col("src_ip"),
        "dst_ip": F.coalesce("dest_ip", F.lit("")),
        "signature": F.col("signature"),
        "status": F.lit("detected"),
        "action_by": F.lit("system"),
        "confidence": F.lit(None).cast("double"),
        "log_file": F.col("log_file") if "log_file" in have else F.lit(None).cast("string"),
        "jenis_serangan": L.classify_signature("signature"),
        "direction": F.lit("inbound"),
    }
    return admitted.select(*keep, *[cols[c].alias(c) for c in LOG_COLUMNS])


def append_table(df: DataFrame, path: str, partition_by=("event_date",)) -> None:
    df.write.mode("append").partitionBy(*[c for c in partition_by if c in df.columns]).parquet(path)


def batch_writer(path: str, shape=None):
    """``foreachBatch`` function that replaces the directory of its own batch, so retries do no harm."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if shape is None else shape(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


