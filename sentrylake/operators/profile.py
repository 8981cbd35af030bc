"""Class profiles and suggested thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.text import contains_any
from ..params import LABEL_SYNONYMS, PROFILE_DEFAULTS, PROFILE_FEATURES, PROFILE_KEYWORDS, PROFILE_QUANTILES
from .scan import exact_quantiles


def infer_status(df: DataFrame, out: str = "status") -> DataFrame:
    """Status from the first usable column: status, attack flag, class label, signature, else 'unknown'."""
    have = df.columns
    flag = next((c for c in ("y_attack", "is_attack", "attack") if c in have), None)
    label = next((c for c in ("label", "kelas", "class", "category") if c in have), None)
    sig = next((c for c in ("signature", "signature_text", "alert") if c in have), None)
    if "status" in have:
        status = F.lower(F.col("status").cast("string"))
    elif flag:
        n = numeric.to_int(flag)
        status = F.when(n == 0, F.lit("benign")).when(n == 1, F.lit("attack")).otherwise(n.cast("string"))
    elif label:
        lab = F.lower(F.col(label).cast("string"))
        status = lab
        for word, meaning in LABEL_SYNONYMS.items():
            status = F.when(lab == word, F.lit(meaning)).otherwise(status)
    elif sig:
        s = F.coalesce(F.col(sig).cast("string"), F.lit(""))
        status = F.when((F.upper(s) == "BENIGN_FLOW") | (s == ""), F.lit("benign")).otherwise(F.lit("attack"))
    else:
        status = F.lit("unknown")
    return df.withColumn(out, status)


def profile_class(signature, status) -> Column:
    """benign, scan, dos, bruteforce or unknown; keyword order differs from live labelling."""
    text = F.lower(F.coalesce(F.col(signature).cast("string"), F.lit("")))
    out = F.when(F.lower(F.coalesce(F.col(status).cast("string"), F.lit(""))) == "benign", F.lit("benign"))
    for name, words in PROFILE_KEYWORDS.items():
        out = out.when(contains_any(text, words), F.lit("bruteforce" if name == "brute" else name))
    return out.otherwise(F.lit("unknown"))


def with_bucket(df: DataFrame) -> DataFrame:
    """Adds ``cls`` and ``bucket`` (NULL outside the four buckets).

    The bruteforce bucket holds bruteforce and unknown rows on port 22; if there is none at all,
    every bruteforce row.
    """
    df = df.withColumns({"cls": profile_class("signature", "status"), "_port": numeric.to_number("dst_port")})
    ssh = F.col("cls").isin("bruteforce", "unknown") & (F.col("_port") == 22)
    any_ssh = df.agg(F.coalesce(F.bool_or(ssh), F.lit(False))).scalar()
    bucket = (
        F.when(F.col("cls").isin("benign", "scan", "dos"), F.col("cls"))
        .when(ssh | (~any_ssh & (F.col("cls") == "bruteforce")), F.lit("bruteforce"))
    )
    return df.withColumn("bucket", bucket).drop("_port")


def bucket_counts(bucketed: DataFrame) -> DataFrame:
    return bucketed.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n_rows"))


def _long(bucketed: DataFrame, features) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), numeric.to_number(f).alias("value")) for f in features
    ])
    return bucketed.filter("bucket IS NOT NULL").select("bucket", F.explode(pairs).alias("_p")).select(
        "bucket", "_p.feature", "_p.value"
    )


def quantile_profile(bucketed: DataFrame, features=PROFILE_FEATURES, approximate: bool = False) -> DataFrame:
    """p50, p90, p95, p98, p99 and max of each feature per bucket.

    ``approximate`` uses mergeable sketches: one pass, bounded state, rank error below 1/10000.
    """
    long = _long(bucketed, features)
    names = ["p50", "p90", "p95", "p98", "p99", "max"]
    if approximate:
        q = long.groupBy("bucket", "feature").agg(
            F.percentile_approx("value", list(PROFILE_QUANTILES), 10000).alias("_q")
        )
        return q.select("bucket", "feature", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    q = exact_quantiles(long, ["bucket", "feature"], "value", PROFILE_QUANTILES)
    return q.groupBy("bucket", "feature").agg(*[
        F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("quantile"))).alias(n)
        for p, n in zip(PROFILE_QUANTILES, names)
    ])


# (output, bucket, feature, quantile, whole number, default when the bucket has no rows)
_SUGGESTIONS = (
    ("dos_pps_thr", "benign", "flow_pkts_per_sec", 0.99, False, None),
    ("dos_fwd_thr", "benign", "fwd_pkts_tot", 0.99, True, None),
    ("scan_dur_thr", "scan", "flow_duration", 0.60, False, PROFILE_DEFAULTS.scan_dur),
    ("scan_bwd_thr", "scan", "bwd_pkts_tot", 0.50, True, PROFILE_DEFAULTS.scan_bwd),
    ("bf_fwd_min", "bruteforce", "fwd_pkts_tot", 0.50, True, PROFILE_DEFAULTS.bf_fwd_min),
    ("bf_bwd_max", "bruteforce", "bwd_pkts_tot", 0.50, True, PROFILE_DEFAULTS.bf_bwd_max),
)


def suggest_thresholds(bucketed: DataFrame) -> DataFrame:
    """One row of thresholds for the flow rules; no row when there is no benign data."""
    wanted = F.lit(False)
    for _, bucket, feature, *_rest in _SUGGESTIONS:
        wanted = wanted | ((F.col("bucket") == bucket) & (F.col("feature") == feature))
    features = sorted({s[2] for s in _SUGGESTIONS})
    long = _long(bucketed.filter(F.col("bucket") != "dos"), features).filter(wanted)
    q = exact_quantiles(long, ["bucket", "feature"], "value", sorted({s[3] for s in _SUGGESTIONS}))
    aggs = []
    for out, bucket, feature, p, whole, default in _SUGGESTIONS:
        hit = (F.col("bucket") == bucket) & (F.col("feature") == feature) & (F.abs(F.col("prob") - p) < 1e-9)
        v = F.max(F.when(hit, F.col("quantile")))
        if whole:
            v = v.cast("bigint")
        aggs.append((F.coalesce(v, F.lit(default)) if default is not None else v).alias(out))
    return q.agg(*aggs).filter(F.col("dos_pps_thr").isNotNull())
