"""Scaling, encoding, splitting and weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text, times
from ..schema import CATEGORY_FEATURES
from .scan import materialise, range_codes, take_by_hash


def fit_minmax(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with ``min_<f>`` and ``max_<f>``; save it to reuse the scaler."""
    return train.agg(
        *[F.min(f).cast("double").alias(f"min_{f}") for f in features],
        *[F.max(f).cast("double").alias(f"max_{f}") for f in features],
    )


def apply_minmax(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scales to [0, 1] with the one-row ``stats`` as a scalar subquery; constant columns give 0."""
    packed = stats.select(F.struct(*stats.columns)).scalar()
    scaled = {}
    for f in features:
        lo, hi = F.col(f"_stats.min_{f}"), F.col(f"_stats.max_{f}")
        span = hi - lo
        # a zero range is replaced by 1, so a constant training column becomes x - min
        scaled[f] = numeric.unit_interval((F.col(f).cast("double") - lo) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    return df.withColumn("_stats", packed).withColumns(scaled).drop("_stats")


def varying_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with more than one value; reads one aggregate row."""
    row = df.agg(*[(F.min(f) < F.max(f)).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def drop_constant_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    keep = set(varying_features(df, features))
    return df.select(*[c for c in df.columns if c not in features or c in keep])


def category_codes(df: DataFrame, column: str, missing: str, first_seen: Sequence[str] | None = None) -> DataFrame:
    """Dictionary ``value, code``: alphabetical, or by first appearance in ``first_seen`` order."""
    v = F.coalesce(F.col(column), F.lit(missing)).alias("value")
    if first_seen is None:
        return range_codes(df.select(v).distinct(), "value", "code")
    first = df.select(v, F.struct(*first_seen).alias("_at")).groupBy("value").agg(F.min("_at").alias("_at"))
    return range_codes(first, "_at", "code").select("value", "code")


def encode(df: DataFrame, column: str, missing: str, codes: DataFrame, out: str) -> DataFrame:
    """Adds the code of ``column``; Spark broadcasts the dictionary only if it measures small."""
    key = F.coalesce(F.col(column), F.lit(missing))
    named = materialise(codes.select(F.col("value").alias("_v"), F.col("code").alias(out)))
    return df.withColumn("_v", key).join(named, "_v", "left").drop("_v")


def encode_categories(alerts: DataFrame, order=("t_us", "event_id")) -> DataFrame:
    """``category_enc`` by first appearance, ``proto_enc`` and ``sig_enc`` alphabetical."""
    out = encode(alerts, "category", "Unknown", category_codes(alerts, "category", "Unknown", order), "category_enc")
    out = encode(out, "proto", "na", category_codes(alerts, "proto", "na"), "proto_enc")
    return encode(out, "signature", "none", category_codes(alerts, "signature", "none"), "sig_enc")


def category_features(alerts: DataFrame, keep=("event_id",)) -> DataFrame:
    """The 11 raw features of the category data set."""
    coded = encode(alerts, "proto", "na", category_codes(alerts, "proto", "na"), "proto_enc")
    cols = {
        "src_ip_enc": text.ip_hash("src_ip"),
        "dest_ip_enc": text.ip_hash("dest_ip"),
        "src_port": F.coalesce("src_port", F.lit(0)),
        "dest_port": F.coalesce("dest_port", F.lit(0)),
        "proto_enc": F.col("proto_enc"),
        "flow_pkts_toserver": F.coalesce("pkts_toserver", F.lit(0)),
        "flow_pkts_toclient": F.coalesce("pkts_toclient", F.lit(0)),
        "flow_bytes_toserver": F.coalesce("bytes_toserver", F.lit(0)),
        "flow_bytes_toclient": F.coalesce("bytes_toclient", F.lit(0)),
        "hour_of_day": times.hour_of("ts_local"),
        "day_of_week": times.weekday_of("ts_local"),
    }
    return coded.select(*keep, *[cols[c].cast("double").alias(c) for c in CATEGORY_FEATURES])


def category_feature_set(alerts: DataFrame, keep=("event_id",)) -> DataFrame:
    """The category features without constant columns, scaled to [0, 1]."""
    raw = category_features(alerts, keep)
    names = varying_features(raw, CATEGORY_FEATURES)
    return apply_minmax(raw.select(*keep, *names), fit_minmax(raw, names), names)


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """A repeatable random order."""
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256)
    return df.orderBy(h, id_col)


def _with_hash(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    return df.withColumn("_h", text.hash32(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))))


def train_val_split(df: DataFrame, fraction: float = 0.8, seed: int = 42, id_col: str = "event_id",
                    out: str = "is_train") -> DataFrame:
    """Marks exactly ``int(fraction * n)`` rows as training rows, in hash order, without a sort."""
    marked = take_by_hash(_with_hash(df, seed, id_col), "_h", id_col, F.floor(F.col("_total") * F.lit(fraction)))
    return marked.withColumnRenamed("_taken", out).drop("_h")


def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42, id_col: str = "event_id",
                     out: str = "is_test", per_class: bool = True) -> DataFrame:
    """Marks a test share: at least one row of every class, or of the whole table.

    Share and method are the caller's choice (``can_stratify`` tells whether every class has two
    rows); neither changes with the size of the table.
    """
    hashed = _with_hash(df, seed, id_col)
    if per_class:
        take = F.greatest(F.floor(F.col("_total") * F.lit(fraction) + F.lit(0.5)), F.lit(1))
        marked = take_by_hash(hashed, "_h", id_col, take, [label])
    else:
        marked = take_by_hash(hashed, "_h", id_col, F.ceil(F.col("_total") * F.lit(fraction)))
    return marked.withColumnRenamed("_taken", out).drop("_h")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds n / (k * class count); the class table has one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.withColumn("_t", totals).select(
        label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias(out)
    )
    return df.join(materialise(weights), label)
