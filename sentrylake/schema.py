"""Schemas and column orders."""

from __future__ import annotations

from pyspark.sql import types as T

EVE_FLOW = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("pkts_toserver", T.LongType()),
    T.StructField("pkts_toclient", T.LongType()),
    T.StructField("bytes_toserver", T.LongType()),
    T.StructField("bytes_toclient", T.LongType()),
    T.StructField("fwd_pkts_tot", T.LongType()),
    T.StructField("bwd_pkts_tot", T.LongType()),
    T.StructField("fwd_data_pkts_tot", T.LongType()),
    T.StructField("bwd_data_pkts_tot", T.LongType()),
    T.StructField("flow_duration", T.DoubleType()),
])

EVE_ALERT = T.StructType([
    T.StructField("signature", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("signature_id", T.LongType()),
])

EVE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("community_id", T.StringType()),
    T.StructField("flow_id", T.LongType()),
    T.StructField("flow_start", T.StringType()),
    T.StructField("flow_end", T.StringType()),
    T.StructField("flow", EVE_FLOW),
    T.StructField("alert", EVE_ALERT),
])

# Canonical column orders of the stored tables and the two feature sets.
DATASET_COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
    "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
    "fwd_header_size_tot", "fwd_header_size_min", "fwd_header_size_max",
    "bwd_header_size_tot", "bwd_header_size_min", "bwd_header_size_max",
    "signature", "action", "confidence", "status", "direction",
    "auto_label", "auto_label_conf", "label_sources", "y_attack", "y_reason",
)
AGGREGATE_COLUMNS = ("flows_per_sec", "syn_only_ratio", "alerts_count_5s")

EVAL_COLUMNS = (
    "timestamp", "event_type", "src_ip", "dst_ip", "src_port", "dst_port", "dest_port", "proto",
    "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
    "signature", "auto_label", "auto_label_conf", "label_sources", "y_attack",
)

LOG_COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "signature", "status", "action_by",
    "confidence", "log_file", "jenis_serangan", "direction",
)

RUNTIME_FEATURES = (
    "src_port", "dest_port", "proto_tcp", "proto_udp", "flow_duration",
    "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
    "hour", "weekday", "sig_len", "sig_hash",
)

CLASSIFIER_FEATURES = (
    "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
    "proto_tcp", "proto_udp", "proto_icmp",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "dst_port_norm",
)

CATEGORY_FEATURES = (
    "src_ip_enc", "dest_ip_enc", "src_port", "dest_port", "proto_enc",
    "flow_pkts_toserver", "flow_pkts_toclient", "flow_bytes_toserver", "flow_bytes_toclient",
    "hour_of_day", "day_of_week",
)

FLOW_FEATURES = (
    "flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot",
    "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec", "down_up_ratio",
)
HEADER_FEATURES = (
    "fwd_header_size_tot", "fwd_header_size_min", "fwd_header_size_max",
    "bwd_header_size_tot", "bwd_header_size_min", "bwd_header_size_max",
)

RETRAIN_REQUIRED = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
    "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot", "signature",
)
