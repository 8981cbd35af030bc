"""Registered queries: each operator over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import flow as FF
from ..functions import labels as L
from ..functions import net, numeric, text, times
from ..operators import columns as C
from ..operators import evaluate as E
from ..operators import filters as B
from ..operators import joins as J
from ..operators import models as M
from ..operators import policy, prep, profile, scan, windows
from ..params import ENV_COST, TRAINING_COST
from ..sources import eve as SE
from ..sources import flow_csv, tables
from ..streaming import blocks, dedup, evaluation, follow, rates
from ..streaming import detect as SD
from . import detect, fixture
from .fixture import FIXTURE_PARAMS, SNAPSHOT_US
from .oracle import ALLOWLISTED, FLOW_RULE, FLOW_SCORE, SEEDED_ID, chain, flow_features, hash32, r6, signature_class, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, extra: dict[str, str] | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if select is not None:
            ORACLES[name] = sql(select, extra)
        return fn

    return register


def r(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name)


def rounded(df: DataFrame, names) -> DataFrame:
    names = set(names)
    return df.select(*[r(c, c) if c in names else F.col(c) for c in df.columns])


FEATS = S.FLOW_FEATURES
FEATS_SQL = ", ".join(r6(c, c) for c in FEATS)
COUNTS = [c for c in FEATS if c.endswith("_tot")]


# ---------------------------------------------------------------------------
# scans, sources, sinks
# ---------------------------------------------------------------------------

_EVENT_COLS = (
    "event_id", "event_type", "src_ip", "dest_ip", "src_port", "dest_port", "proto", "flow_id", "community_id",
    "t_us", "start_us", "end_us", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
    "signature", "category", "severity",
)


@query("read_eve_json", f"SELECT {', '.join(_EVENT_COLS)} FROM ev")
def read_eve_json(spark, sf):
    path = fixture.write_json_lines(spark, sf, f"{fixture.scratch(spark)}/eve.json", noise=True)
    return C.normalise_event(SE.read_eve_json(spark, path)).select(*_EVENT_COLS)


@query("parse_eve_text", f"SELECT {', '.join(_EVENT_COLS)} FROM ev")
def parse_eve_text(spark, sf):
    lines = fixture.as_nested(fixture.events(spark, sf)).select(F.to_json(F.struct("*")).alias("value"))
    noisy = lines.select(F.explode(F.array(F.lit("{oops"), F.lit(""), F.col("value"))).alias("value"))
    return C.normalise_event(SE.parse_eve_text(noisy)).select(*_EVENT_COLS)


@query("stream_eve", "SELECT event_id, event_type, t_us, src_ip, signature FROM ev")
def stream_eve(spark, sf):
    work = fixture.scratch(spark)
    events = follow.follow_events(spark, fixture.write_chunks(spark, sf, f"{work}/in"))
    rows = events.select("event_id", "event_type", "t_us", "src_ip", "signature")
    follow.drain(rows.writeStream.format("parquet").option("path", f"{work}/out")
                 .option("checkpointLocation", f"{work}/state"))
    return spark.read.schema(rows.schema).parquet(f"{work}/out")


@query("daily_partitions", """SELECT event_id, CAST(CAST(make_timestamp(orig_us) AS DATE) AS VARCHAR) AS event_date, src_ip
  FROM eve WHERE CAST(make_timestamp(orig_us) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def daily_partitions(spark, sf):
    path = f"{fixture.scratch(spark)}/events"
    SE.write_daily(fixture.raw_events(spark, sf), path, "orig_us")
    days = SE.read_daily(spark, path, "2024-01-10", "2024-01-12")
    return days.select("event_id", F.col("event_date").cast("string").alias("event_date"), "src_ip")


@query("read_flow_csv", "SELECT event_id, src_ip, dest_port, proto, signature, CASE WHEN k % 2 = 0 THEN 'NA' ELSE '' END AS note FROM eve")
def read_flow_csv(spark, sf):
    path = f"{fixture.scratch(spark)}/flows.csv"
    ev = fixture.raw_events(spark, sf)
    good = F.concat_ws(
        ";", F.col("event_id").cast("string"), "src_ip", F.col("dest_port").cast("string"), "proto",
        F.concat(F.lit('"'), "signature", F.lit('"')), F.when(F.col("k") % 2 == 0, F.lit("NA")).otherwise(F.lit("")),
    )
    lines = ev.select(F.explode(F.array(good, F.concat(good, F.lit(";too;many")))).alias("value"))
    # each file of a CSV table carries its own header
    body = lines.select("value", F.spark_partition_id().alias("_f"), F.lit(1).alias("_o"))
    head = F.lit("event_id;src_ip;dest_port;proto;signature;note").alias("value")
    heads = body.select("_f").distinct().select(head, "_f", F.lit(0).alias("_o"))
    body.unionByName(heads).repartition("_f").sortWithinPartitions("_f", "_o").select("value").write.text(path)
    table = flow_csv.read_flow_csv(spark, path)
    return table.withColumns({"event_id": F.col("event_id").cast("bigint"), "dest_port": F.col("dest_port").cast("int")})


_CONFORM = ("timestamp", "src_ip", "dst_ip", "signature", "action", "y_reason")


@query("conform_columns", """SELECT "timestamp", src_ip, '' AS dst_ip, signature, '' AS action, '' AS y_reason FROM alerts
  UNION ALL SELECT "timestamp", src_ip, dest_ip, '' AS signature, '0' AS action, '' AS y_reason FROM flows""")
def conform_columns(spark, sf):
    old = fixture.alerts(spark, sf).select("timestamp", "src_ip", "signature", "k")
    new = fixture.flows(spark, sf).select(
        F.lit(0).alias("action"), F.col("dest_ip").alias("dst_ip"), "src_ip", "timestamp")
    return C.conform_columns(C.merge_versions([old, new], _CONFORM), _CONFORM)


def _decisions(spark, sf, staged: DataFrame | None = None) -> DataFrame:
    events = fixture.staged(spark, sf) if staged is None else staged
    return detect.decisions(events, fixture.model, FIXTURE_PARAMS)


@query("write_dataset", f"""SELECT event_id, src_ip, dest_ip AS dst_ip, src_port, dest_port AS dst_port, proto, {FEATS_SQL},
  0.0::DOUBLE AS fwd_header_size_tot, signature, action, {r6('confidence', 'confidence')}, 'detected' AS status, 'inbound' AS direction,
  auto_label, {r6('auto_label_conf', 'auto_label_conf')}, label_sources, y_attack, y_reason,
  {r6('flows_per_sec', 'flows_per_sec')}, {r6('syn_only_ratio', 'syn_only_ratio')}, alerts_count_5s FROM decided""")
def write_dataset(spark, sf):
    path = f"{fixture.scratch(spark)}/dataset"
    rows = tables.dataset_rows(
        _decisions(spark, sf).withColumns({
            "signature": F.concat("signature", F.lit("\n")),
            "timestamp": F.timestamp_micros("t_us").cast("string"),
            "event_date": F.timestamp_micros("t_us").cast("date"),
        }), keep=("event_id", "event_date"))
    tables.append_table(rows, path)
    back = spark.read.parquet(path).withColumn("signature", F.rtrim("signature"))
    names = ["event_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", *FEATS, "fwd_header_size_tot", "signature",
             "action", "confidence", "status", "direction", "auto_label", "auto_label_conf", "label_sources", "y_attack",
             "y_reason", *S.AGGREGATE_COLUMNS]
    return rounded(back.select(*names), {*FEATS, "confidence", "auto_label_conf", "flows_per_sec", "syn_only_ratio"})


_BENIGN = """starts_with(dest_ip, '192.168.38.') AND src_ip <> dest_ip
  AND pkts_toserver + pkts_toclient >= 4 AND bytes_toserver + bytes_toclient >= 600"""


def _training_rows(spark, sf) -> DataFrame:
    """The stored data set of alerts and sampled benign flows, read back."""
    path = f"{fixture.scratch(spark)}/dataset"
    stamp = F.timestamp_micros("t_us").cast("string")
    events = fixture.staged(spark, sf)
    flows = B.admit_benign_flows(B.of_type(events, "flow"), FIXTURE_PARAMS)
    benign = FF.with_flow_features(B.benign_sample(flows, FIXTURE_PARAMS)).withColumn("timestamp", stamp)
    decided = _decisions(spark, sf, events).withColumn("timestamp", stamp)
    rows = scan.materialise(tables.training_rows(decided, benign, keep=("event_id",)))  # decided once, written twice
    # one directory per batch number, replaced if the batch is written again
    write = tables.batch_writer(path)
    write(rows, 0)
    write(rows, 0)
    return spark.read.parquet(path).drop("batch")


_FULL = ("src_ip", "dst_ip", "signature", "action", "status", "y_attack", "y_reason")


@query("write_dataset_full", f"""SELECT event_id, src_ip, dest_ip AS dst_ip, signature, action, 'detected' AS status, y_attack, y_reason, {FEATS_SQL} FROM decided
  UNION ALL SELECT event_id, src_ip, dest_ip, 'BENIGN_FLOW', 0, 'benign', 0, 'benign', {FEATS_SQL} FROM ffeat
  WHERE event_id IN (SELECT event_id FROM flows WHERE {_BENIGN} AND {hash32('CAST(event_id AS VARCHAR)')} % 10000 <= 1500)""")
def write_dataset_full(spark, sf):
    return rounded(_training_rows(spark, sf).select("event_id", *_FULL, *FEATS), FEATS)


_EVAL_SQL = f"""SELECT event_id, "timestamp", event_type, src_ip, dest_ip AS dst_ip, src_port, dest_port AS dst_port, dest_port, proto,
  {FEATS_SQL}, signature, auto_label, {r6('auto_label_conf', 'auto_label_conf')}, label_sources, y_attack FROM evalrows"""


def _eval_out(df):
    return rounded(df, {*FEATS, "auto_label_conf"})


@query("write_eval_stream", _EVAL_SQL + " WHERE event_type = 'flow'")
def write_eval_stream(spark, sf):
    work = fixture.scratch(spark)
    events = follow.follow_events(spark, fixture.write_chunks(spark, sf, f"{work}/in"))
    follow.drain(evaluation.write_eval_stream(
        events, f"{work}/out", f"{work}/state", fixture.attackers(spark), fixture.windows(spark), keep=("event_id",)))
    return _eval_out(spark.read.parquet(f"{work}/out"))


@query("eval_rows_all_events", _EVAL_SQL)
def eval_rows_all_events(spark, sf):
    return _eval_out(tables.eval_rows(
        fixture.events(spark, sf), fixture.attackers(spark), fixture.windows(spark), True, ("event_id",)))


@query("alert_log", f"""SELECT event_id, "timestamp", src_ip, dest_ip AS dst_ip, signature, 'detected' AS status, 'system' AS action_by,
  'eve-2024-01-01.json' AS log_file, {signature_class('signature')} AS jenis_serangan, 'inbound' AS direction FROM admitted""")
def alert_log(spark, sf):
    path = fixture.write_json_lines(spark, sf, f"{fixture.scratch(spark)}/eve-2024-01-01.json")
    events = C.normalise_event(SE.read_eve_json(spark, path))
    log = tables.alert_log(B.admit_alerts(B.of_type(events, "alert"), FIXTURE_PARAMS), ("event_id",))
    return log.withColumn("log_file", F.element_at(F.split("log_file", "/"), -2)).drop("confidence")


def _log(spark, sf):
    return tables.alert_log(B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS), ("event_id",))


@query("normalise_attack_type", f"SELECT event_id, {signature_class('signature')} AS attack_type FROM admitted")
def normalise_attack_type(spark, sf):
    kind = F.col("jenis_serangan")
    old = F.when((kind == "BRUTEFORCE") & (F.col("event_id") % 2 == 0), F.lit("BRUTE")).when(
        (kind == "DOS") & (F.col("event_id") % 2 == 0), F.lit("DDoS")).otherwise(kind)
    aged = _log(spark, sf).withColumn("jenis_serangan", old)
    return aged.select("event_id", L.normalise_attack_type("jenis_serangan").alias("attack_type"))


# ---------------------------------------------------------------------------
# projections, filters
# ---------------------------------------------------------------------------

@query("split_events", "SELECT event_id, event_type FROM ev WHERE event_type IN ('flow', 'alert')")
def split_events(spark, sf):
    flows, alerts = B.split_events(fixture.events(spark, sf))
    return flows.unionByName(alerts).select("event_id", "event_type")


@query("admit_alerts", "SELECT event_id, src_ip, signature FROM admitted")
def admit_alerts(spark, sf):
    return B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS).select("event_id", "src_ip", "signature")


@query("in_home_net", "SELECT event_id, starts_with(dest_ip, '192.168.38.') AS dest_home, starts_with(src_ip, '10.0.') AS src_home FROM eve")
def in_home_net(spark, sf):
    return fixture.raw_events(spark, sf).select(
        "event_id", net.in_network("dest_ip", FIXTURE_PARAMS.home_net).alias("dest_home"),
        net.in_network("src_ip", "10.0.0.0/16").alias("src_home"))


@query("admit_benign_flows", f"SELECT event_id FROM flows WHERE {_BENIGN}")
def admit_benign_flows(spark, sf):
    return B.admit_benign_flows(fixture.flows(spark, sf), FIXTURE_PARAMS).select("event_id")


@query("benign_sample", f"""SELECT event_id, 'BENIGN_FLOW' AS signature, 'benign' AS status, 0 AS y_attack, 'benign' AS y_reason
  FROM flows WHERE {_BENIGN} AND {hash32('CAST(event_id AS VARCHAR)')} % 10000 <= 1500""")
def benign_sample(spark, sf):
    kept = B.benign_sample(B.admit_benign_flows(fixture.flows(spark, sf), FIXTURE_PARAMS), FIXTURE_PARAMS)
    return kept.select("event_id", "signature", "status", "y_attack", "y_reason")


@query("is_allowlisted", f"SELECT event_id, {ALLOWLISTED} AS allowed FROM eve")
def is_allowlisted(spark, sf):
    return fixture.raw_events(spark, sf).select(
        "event_id", L.is_allowlisted("signature", "category", "proto", "dest_port").alias("allowed"))


@query("first_n_alerts", "SELECT event_id, t_us FROM alerts ORDER BY t_us, event_id LIMIT 2000")
def first_n_alerts(spark, sf):
    return B.first_n_alerts(fixture.alerts(spark, sf), 2000).select("event_id", "t_us")


@query("normalise_columns", f"""SELECT event_id, dest_port AS dst_port, src_port, signature, proto AS protocol,
  {r6('fwd_pkts_per_sec + bwd_pkts_per_sec', 'flow_pkts_per_sec')} FROM evfeat""")
def normalise_columns(spark, sf):
    feats = FF.with_flow_features(fixture.raw_events(spark, sf))
    odd = feats.select(
        "event_id", F.col("dest_port").alias(" DPort "), F.col("src_port").alias("Sport"), F.col("signature").alias("SIG"),
        F.col("proto").alias("Proto"), "fwd_pkts_per_sec", "bwd_pkts_per_sec")
    return C.normalise_columns(odd).select(
        "event_id", "dst_port", "src_port", "signature", "protocol", r("flow_pkts_per_sec", "flow_pkts_per_sec"))


@query("fill_defaults", "SELECT event_id, coalesce(community_id, 'none') AS community_id, coalesce(flow_id, -1) AS flow_id, 0 AS tcp_flags, '' AS note FROM eve")
def fill_defaults(spark, sf):
    base = fixture.raw_events(spark, sf).select("event_id", "community_id", "flow_id")
    return C.fill_defaults(base, {"community_id": "none", "flow_id": -1, "tcp_flags": 0, "note": ""})


@query("valid_timestamps", "SELECT event_id, \"timestamp\" FROM eve WHERE k % 10 <> 3")
def valid_timestamps(spark, sf):
    bad = F.when(F.col("k") % 10 == 3, F.lit("not a time")).otherwise(F.col("timestamp"))
    rows = fixture.raw_events(spark, sf).withColumn("timestamp", bad)
    return B.valid_timestamps(rows, "timestamp", ("timestamp", "src_ip")).select("event_id", "timestamp")


_REASON_SQL = """CASE k % 5 WHEN 0 THEN 'Port.Scan' WHEN 1 THEN 'SSH-Brute' WHEN 2 THEN 'SYN flood' WHEN 3 THEN 'none' END"""
_STANDARD = """CASE k % 5 WHEN 0 THEN 'scan' WHEN 1 THEN 'bruteforce' WHEN 2 THEN 'dos' END"""


def _reasons(spark, sf):
    return fixture.raw_events(spark, sf).withColumns(
        {"y_reason": F.expr(_REASON_SQL), "y_attack": (F.col("k") % 2).cast("string")})


@query("attacks_only", f"SELECT event_id, {_STANDARD} AS attack_type FROM eve WHERE k % 2 = 1 AND k % 5 < 3")
def attacks_only(spark, sf):
    return B.attacks_only(_reasons(spark, sf)).select("event_id", "attack_type")


# ---------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------

_ENRICHED_SQL = f"SELECT event_id, hit, hit_key, {FEATS_SQL} FROM "


def _enriched(spark, sf, ttl_us=900_000_000):
    from dataclasses import replace
    flows, alerts = B.split_events(fixture.staged(spark, sf))
    return J.asof_flow_features(B.admit_alerts(alerts, FIXTURE_PARAMS), flows, replace(FIXTURE_PARAMS, flow_ttl_us=ttl_us))


def _enriched_out(df):
    return df.select("event_id", "hit", "hit_key", *[r(c, c) for c in FEATS])


@query("asof_flow_features", _ENRICHED_SQL + "enriched")
def asof_flow_features(spark, sf):
    return _enriched_out(_enriched(spark, sf))


@query("asof_flow_features_ttl60", _ENRICHED_SQL + "enriched60")
def asof_flow_features_ttl60(spark, sf):
    return _enriched_out(_enriched(spark, sf, 60_000_000))


@query("attack_window_label", f"""SELECT event_id, CASE WHEN in_attack THEN 'attacker_window' ELSE e_label END AS auto_label,
  {r6('CASE WHEN in_attack THEN 0.95 ELSE e_conf END', 'auto_label_conf')},
  CASE WHEN in_attack THEN 'attacker_ip_window' ELSE e_src END AS label_sources FROM evalbase""")
def attack_window_label(spark, sf):
    ev = fixture.events(spark, sf)
    label = L.label_alert_eval("signature", "category", "severity", "signature_id", F.col("has_alert"))
    base = ev.withColumn("_c", label).withColumns(
        {"auto_label": F.col("_c.label"), "auto_label_conf": F.col("_c.score"), "label_sources": F.col("_c.src")})
    out = J.override_labels(J.attack_flags(base, fixture.attackers(spark), fixture.windows(spark)))
    return out.select("event_id", "auto_label", r("auto_label_conf", "auto_label_conf"), "label_sources")


@query("drop_whitelisted", "SELECT event_id, src_ip FROM admitted WHERE src_ip NOT IN ('10.0.0.1', '192.168.38.10', '10.0.0.9', '10.0.0.50')")
def drop_whitelisted(spark, sf):
    admitted = B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS)
    return J.drop_whitelisted(admitted, FIXTURE_PARAMS, fixture.attackers(spark)).select("event_id", "src_ip")


@query("drop_already_blocked", "SELECT event_id, src_ip FROM admitted WHERE src_ip NOT IN (SELECT ip FROM active60)")
def drop_already_blocked(spark, sf):
    admitted = B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS)
    active = policy.active_blocks(_blocks(spark, sf, 60_000_000), SNAPSHOT_US)
    return J.drop_already_blocked(admitted, active).select("event_id", "src_ip")


# ---------------------------------------------------------------------------
# aggregations
# ---------------------------------------------------------------------------

@query("attack_type_counts", f"SELECT {signature_class('signature')} AS jenis_serangan, count(*) AS n_events FROM admitted GROUP BY 1")
def attack_type_counts(spark, sf):
    return E.attack_type_counts(_log(spark, sf))


@query("blocked_count", "SELECT count(*) AS n_blocked FROM active60")
def blocked_count(spark, sf):
    return E.blocked_count(policy.active_blocks(_blocks(spark, sf, 60_000_000), SNAPSHOT_US))


def _bucketed(spark, sf):
    feats = FF.with_flow_features(fixture.raw_events(spark, sf)).withColumnRenamed("dest_port", "dst_port")
    cols = ("event_id", "signature", "dst_port", *FEATS)
    # profiling reads a stored data set
    return profile.with_bucket(profile.infer_status(scan.materialise(feats.select(*cols))))


@query("bucket_counts", "SELECT bucket, count(*) AS n_rows FROM bucketed WHERE bucket IS NOT NULL GROUP BY 1")
def bucket_counts(spark, sf):
    return profile.bucket_counts(_bucketed(spark, sf))


_Q = ", ".join(r6(f"quantile_cont(v, {p})", n) for p, n in
               ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.98, "p98"), (0.99, "p99"))) + ", " + r6("max(v)", "max")


@query("quantile_profile", " UNION ALL ".join(
    f"SELECT bucket, '{f}' AS feature, {_Q} FROM (SELECT bucket, {f}::DOUBLE AS v FROM bucketed WHERE bucket IS NOT NULL) q GROUP BY 1"
    for f in profile.PROFILE_FEATURES))
def quantile_profile(spark, sf):
    return rounded(profile.quantile_profile(_bucketed(spark, sf)), {"p50", "p90", "p95", "p98", "p99", "max"})


@query("suggest_thresholds", f"""SELECT {r6("quantile_cont(flow_pkts_per_sec, 0.99) FILTER (WHERE bucket = 'benign')", 'dos_pps_thr')},
  CAST(trunc(quantile_cont(fwd_pkts_tot::DOUBLE, 0.99) FILTER (WHERE bucket = 'benign')) AS BIGINT) AS dos_fwd_thr,
  {r6("coalesce(quantile_cont(flow_duration, 0.6) FILTER (WHERE bucket = 'scan'), 1.0)", 'scan_dur_thr')},
  coalesce(CAST(trunc(quantile_cont(bwd_pkts_tot::DOUBLE, 0.5) FILTER (WHERE bucket = 'scan')) AS BIGINT), 2) AS scan_bwd_thr,
  coalesce(CAST(trunc(quantile_cont(fwd_pkts_tot::DOUBLE, 0.5) FILTER (WHERE bucket = 'bruteforce')) AS BIGINT), 12) AS bf_fwd_min,
  coalesce(CAST(trunc(quantile_cont(bwd_pkts_tot::DOUBLE, 0.5) FILTER (WHERE bucket = 'bruteforce')) AS BIGINT), 4) AS bf_bwd_max
  FROM bucketed""")
def suggest_thresholds(spark, sf):
    return rounded(profile.suggest_thresholds(_bucketed(spark, sf)), {"dos_pps_thr", "scan_dur_thr"})


def _labelled_all(spark, sf) -> DataFrame:
    """Decisions with a 0/1 truth that differs from the model's action on part of the rows."""
    return _decisions(spark, sf).withColumns({
        "truth": F.col("auto_label").isin("dos", "scan").cast("int"),
        "actual": F.when(F.col("event_id") % 7 == 0, F.lit("scan")).otherwise(F.col("auto_label")),
    })


@query("dataset_info", "SELECT count(*) AS n_samples, count(*) FILTER (WHERE y_attack = 1) AS n_positive, count(*) FILTER (WHERE y_attack = 0) AS n_negative, 17 AS n_features FROM decided")
def dataset_info(spark, sf):
    return E.dataset_info(_decisions(spark, sf), "y_attack", len(S.RUNTIME_FEATURES))


@query("class_counts", "SELECT auto_label, count(*) AS n_rows FROM decided GROUP BY 1")
def class_counts(spark, sf):
    return E.class_counts(_decisions(spark, sf), "auto_label")


@query("can_stratify", "SELECT count(*) >= 2 AND min(n) >= 2 AS stratify FROM (SELECT auto_label, count(*) AS n FROM decided GROUP BY 1) q")
def can_stratify(spark, sf):
    return E.can_stratify(E.class_counts(_decisions(spark, sf), "auto_label"))


def _cost_sql(c) -> str:
    w = f"CASE WHEN action = 1 AND truth = 1 THEN {c.tp} WHEN action = 0 AND truth = 0 THEN {c.tn} WHEN action = 1 THEN {c.fp} ELSE {c.fn} END"
    counts = ", ".join(f"count(*) FILTER (WHERE action = {a} AND truth = {t}) AS {n}" for a, t, n in ((1, 1, "tp"), (0, 0, "tn"), (1, 0, "fp"), (0, 1, "fn")))
    return (f"SELECT {r6(f'sum({w})', 'total_reward')}, {r6(f'avg({w}::DOUBLE)', 'mean_reward')}, {counts} FROM "
            "(SELECT *, CASE WHEN auto_label IN ('dos', 'scan') THEN 1 ELSE 0 END AS truth FROM decided) q")


@query("cost_score", _cost_sql(ENV_COST))
def cost_score(spark, sf):
    return rounded(E.cost_score(_labelled_all(spark, sf), "action", "truth", ENV_COST), {"total_reward", "mean_reward"})


@query("cost_score_training", _cost_sql(TRAINING_COST))
def cost_score_training(spark, sf):
    return rounded(E.cost_score(_labelled_all(spark, sf), "action", "truth", TRAINING_COST), {"total_reward", "mean_reward"})


@query("category_cost_score", """SELECT round(sum(w)::DOUBLE, 6) AS total_reward, round(avg(w)::DOUBLE, 6) AS mean_reward, count(*) AS n_events FROM (
  SELECT CASE WHEN k % 4 = 1 + k % 3 THEN 10 WHEN k % 4 = 0 THEN -5 ELSE -10 END AS w FROM alerts) q""")
def category_cost_score(spark, sf):
    rows = fixture.alerts(spark, sf).select((F.col("k") % 4).alias("predicted"), (1 + F.col("k") % 3).alias("actual"))
    return rounded(E.category_cost_score(rows, "predicted", "actual"), {"total_reward", "mean_reward"})


@query("classification_report", """SELECT c AS class, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1, support FROM (
    SELECT c, precision, recall, f1, support FROM per
    UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT sum(tp)::DOUBLE / sum(support) AS a, sum(support)::BIGINT AS n FROM per) q
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per) z""",
       {"pairs": "SELECT CASE WHEN event_id % 7 = 0 THEN 'scan' ELSE auto_label END AS y, auto_label AS p FROM decided",
        "per": """SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE y = c AND p = c) AS tp,
          coalesce(count(*) FILTER (WHERE y = c AND p = c)::DOUBLE / nullif(count(*) FILTER (WHERE p = c), 0), 0) AS precision,
          coalesce(count(*) FILTER (WHERE y = c AND p = c)::DOUBLE / nullif(count(*) FILTER (WHERE y = c), 0), 0) AS recall,
          coalesce(2.0::DOUBLE * count(*) FILTER (WHERE y = c AND p = c) / nullif(count(*) FILTER (WHERE y = c) + count(*) FILTER (WHERE p = c), 0), 0) AS f1
          FROM pairs, (SELECT DISTINCT unnest([y, p]) AS c FROM pairs) k WHERE y = c OR p = c GROUP BY c"""})
def classification_report(spark, sf):
    return E.classification_report(_labelled_all(spark, sf), "actual", "auto_label")


@query("enrichment_hit_rate", f"SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, {r6('avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)', 'hit_rate')} FROM enriched60")
def enrichment_hit_rate(spark, sf):
    return rounded(E.hit_rate(_enriched(spark, sf, 60_000_000)), {"hit_rate"})


# ---------------------------------------------------------------------------
# per-source windows
# ---------------------------------------------------------------------------

def _rated(spark, sf):
    flows, alerts = B.split_events(fixture.staged(spark, sf))
    return windows.with_source_rates(B.admit_alerts(alerts, FIXTURE_PARAMS), flows, FIXTURE_PARAMS)


@query("flows_per_sec", f"SELECT event_id, {r6('flows_per_sec', 'flows_per_sec')} FROM rated_alerts")
def flows_per_sec(spark, sf):
    return _rated(spark, sf).select("event_id", r("flows_per_sec", "flows_per_sec"))


@query("alert_rates", f"SELECT event_id, alerts_count_5s, {r6('syn_only_ratio', 'syn_only_ratio')} FROM rated_alerts")
def alert_rates(spark, sf):
    return _rated(spark, sf).select("event_id", "alerts_count_5s", r("syn_only_ratio", "syn_only_ratio"))


@query("alerts_count_5s", "SELECT event_id, alerts_count_5s FROM rated_alerts")
def alerts_count_5s(spark, sf):
    return _rated(spark, sf).select("event_id", "alerts_count_5s")


@query("syn_only_ratio", f"SELECT event_id, {r6('syn_only_ratio', 'syn_only_ratio')} FROM rated_alerts")
def syn_only_ratio(spark, sf):
    return _rated(spark, sf).select("event_id", r("syn_only_ratio", "syn_only_ratio"))


@query("multi_hit", "SELECT event_id, multi_hit FROM rated_alerts")
def multi_hit(spark, sf):
    return _rated(spark, sf).select("event_id", "multi_hit")


@query("syn_flood_trigger", "SELECT event_id, syn_flood_trigger FROM rated_alerts")
def syn_flood_trigger(spark, sf):
    return _rated(spark, sf).select("event_id", "syn_flood_trigger")


@query("rolling_mean_100", f"SELECT event_id, {r6('avg(pkts_toserver) OVER (PARTITION BY src_ip ORDER BY t_us, event_id ROWS 99 PRECEDING)', 'mean_100')} FROM flows")
def rolling_mean_100(spark, sf):
    flows = fixture.flows(spark, sf).select("event_id", "t_us", "src_ip", "pkts_toserver")
    out = scan.rolling_mean(flows, "src_ip", ["t_us", "event_id"], "pkts_toserver", 100, "mean_100")
    return out.select("event_id", r("mean_100", "mean_100"))


@query("fill_timestamps", """SELECT event_id, coalesce(
    last_value(ts IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(ts IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled_us
  FROM (SELECT event_id, event_type AS file, CASE WHEN k % 4 <> 1 THEN t_us END AS ts FROM eve) q""")
def fill_timestamps(spark, sf):
    rows = fixture.raw_events(spark, sf).select(
        "event_id", F.col("event_type").alias("file"), F.when(F.col("k") % 4 != 1, F.col("timestamp")).otherwise(F.lit("?")).alias("timestamp"))
    parsed = rows.withColumn("ts", times.parse_micros("timestamp"))
    return scan.fill_both_ways(parsed, "file", "event_id", "ts", "filled_us").select("event_id", "filled_us")


# ---------------------------------------------------------------------------
# sort
# ---------------------------------------------------------------------------

@query("list_blocked", "SELECT ip, block_us, unblock_us FROM active60 ORDER BY block_us DESC, ip")
def list_blocked(spark, sf):
    active = policy.active_blocks(_blocks(spark, sf, 60_000_000), SNAPSHOT_US)
    return policy.list_blocked(active).select("ip", "block_us", "unblock_us")


@query("shuffle_rows", "SELECT event_id, src_ip FROM eve ORDER BY sha256(concat('42|', event_id)), event_id")
def shuffle_rows(spark, sf):
    return prep.shuffle_rows(fixture.raw_events(spark, sf).select("event_id", "src_ip"))


# ---------------------------------------------------------------------------
# scalar functions
# ---------------------------------------------------------------------------

def _features_query(mode, source):
    def run(spark, sf):
        return FF.with_flow_features(source(spark, sf), mode).select("event_id", *[r(c, c) for c in FEATS])
    return run


for _name, _mode in (("flow_features", "live"), ("flow_features_eval", "eval"), ("flow_features_vector", "vector")):
    query(_name, f"SELECT event_id, {FEATS_SQL} FROM ({flow_features('ev', _mode)}) f")(
        _features_query(_mode, fixture.events))


@query("safe_num", f"""SELECT event_id, {r6("CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1e12 WHEN 4 THEN -1e12 ELSE pkts_toserver END", 'num')},
  {r6('CASE WHEN pkts_toclient = 0 THEN -1 ELSE pkts_toserver::DOUBLE / pkts_toclient END', 'ratio')} FROM eve""")
def safe_num(spark, sf):
    texts = F.expr("CASE k % 6 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN '-inf' WHEN 3 THEN '1e13' WHEN 4 THEN '-9e15' ELSE CAST(pkts_toserver AS STRING) END")
    return fixture.raw_events(spark, sf).select(
        "event_id", r(numeric.safe_num(texts, text=True), "num"),
        r(numeric.safe_ratio(F.col("pkts_toserver"), F.col("pkts_toclient"), -1.0), "ratio"))


@query("safe_ratio", f"SELECT event_id, {r6('CASE WHEN pkts_toserver = 0 THEN 0 ELSE pkts_toclient::DOUBLE / pkts_toserver END', 'ratio')} FROM eve")
def safe_ratio(spark, sf):
    return fixture.raw_events(spark, sf).select(
        "event_id", r(numeric.safe_ratio(F.col("pkts_toclient"), F.col("pkts_toserver")), "ratio"))


@query("time_features", "SELECT event_id, CAST(hour(ts_local) AS INT) AS hour, CAST(isodow(ts_local) - 1 AS INT) AS weekday FROM (SELECT event_id, make_timestamp(orig_us + 25200000000) AS ts_local FROM eve) q")
def time_features(spark, sf):
    local = times.micros_to_ntz(F.col("orig_us") + fixture.LOCAL_OFFSET_US)
    rows = fixture.raw_events(spark, sf).select("event_id", local.alias("ts_local"))
    return rows.select("event_id", times.hour_of("ts_local").alias("hour"), times.weekday_of("ts_local").alias("weekday"))


@query("cyclic_time", f"""SELECT event_id, {r6('sin(2 * pi() * h / 24)', 'hour_sin')}, {r6('cos(2 * pi() * h / 24)', 'hour_cos')},
  {r6('sin(2 * pi() * w / 7)', 'weekday_sin')}, {r6('cos(2 * pi() * w / 7)', 'weekday_cos')}
  FROM (SELECT event_id, hour(make_timestamp(orig_us)) AS h, isodow(make_timestamp(orig_us)) - 1 AS w FROM eve) q""")
def cyclic_time(spark, sf):
    rows = fixture.raw_events(spark, sf).select("event_id", times.micros_to_ntz("orig_us").alias("ts"))
    hs, hc = times.cyclic(times.hour_of("ts"), 24)
    ws, wc = times.cyclic(times.weekday_of("ts"), 7)
    return rows.select("event_id", r(hs, "hour_sin"), r(hc, "hour_cos"), r(ws, "weekday_sin"), r(wc, "weekday_cos"))


@query("proto_flags", "SELECT event_id, (proto = 'TCP')::INT::DOUBLE AS proto_tcp, (proto = 'UDP')::INT::DOUBLE AS proto_udp, (proto = 'ICMP')::INT::DOUBLE AS proto_icmp FROM eve")
def proto_flags(spark, sf):
    flags = net.proto_flags(F.when((F.col("proto") == "ICMP") & (F.col("event_id") % 2 == 0), F.lit("IPv6-ICMP")).otherwise(F.col("proto")))
    return fixture.raw_events(spark, sf).select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("signature_features", f"""SELECT event_id, CAST(length(trim(coalesce(signature, ''))) AS INT) AS sig_len,
  CASE WHEN coalesce(signature, '') = '' THEN 0 ELSE {hash32('signature')} % 1000 END AS sig_hash FROM ev""")
def signature_features(spark, sf):
    return fixture.events(spark, sf).select(
        "event_id", text.signature_length("signature").alias("sig_len"), text.signature_hash("signature").alias("sig_hash"))


@query("ip_hash", f"SELECT event_id, {hash32('src_ip')} % 10000 AS src_ip_enc, {hash32('dest_ip')} % 10000 AS dest_ip_enc FROM eve")
def ip_hash(spark, sf):
    return fixture.raw_events(spark, sf).select(
        "event_id", text.ip_hash("src_ip").alias("src_ip_enc"), text.ip_hash("dest_ip").alias("dest_ip_enc"))


@query("port_norm", f"SELECT event_id, {r6('dest_port / 65535.0::DOUBLE', 'dst_port_norm')} FROM eve")
def port_norm(spark, sf):
    return fixture.raw_events(spark, sf).select("event_id", r(numeric.port_norm("dest_port"), "dst_port_norm"))


@query("coalesce_fields", """SELECT event_id, coalesce(a, dest_ip) AS ip_present, coalesce(nullif(a, ''), nullif(dest_ip, '')) AS ip_truthy,
  coalesce(p, dest_port) AS port_present, coalesce(nullif(p, 0), nullif(dest_port, 0)) AS port_truthy FROM (
  SELECT *, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '1.2.3.4' END AS a, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 8443 END AS p FROM eve) q""")
def coalesce_fields(spark, sf):
    rows = fixture.raw_events(spark, sf).withColumns({
        "a": F.expr("CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '1.2.3.4' END"),
        "p": F.expr("CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 8443 END")})
    return rows.select(
        "event_id", text.first_present("a", "dest_ip").alias("ip_present"), text.first_truthy("a", "dest_ip", empty="").alias("ip_truthy"),
        text.first_present("p", "dest_port").alias("port_present"), text.first_truthy("p", "dest_port", empty=0).alias("port_truthy"))


@query("dest_port_fallback", "SELECT event_id, dest_port AS filled, 1 AS kept FROM eve WHERE k % 2 = 0 UNION ALL SELECT event_id, dest_port, CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END FROM eve WHERE k % 2 = 1")
def dest_port_fallback(spark, sf):
    ev = fixture.raw_events(spark, sf)
    empty = ev.filter("k % 2 = 0").select("event_id", F.lit(0).alias("dest_port"), F.col("dest_port").alias("dst_port"))
    some = ev.filter("k % 2 = 1").select("event_id", F.expr("CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END").alias("dest_port"), F.col("dest_port").alias("dst_port"))
    filled = C.dest_port_fallback(empty).select("event_id", F.col("dest_port").alias("filled"), F.lit(1).alias("kept"))
    kept = C.dest_port_fallback(some).select("event_id", F.col("dst_port").alias("filled"), F.col("dest_port").alias("kept"))
    return filled.unionByName(kept)


@query("parse_times", """SELECT event_id, CASE k % 4 WHEN 3 THEN 0 WHEN 1 THEN (t_us + 25200000000) // 1000000 ELSE t_us // 1000000 END AS epoch_s,
  CASE k % 4 WHEN 3 THEN NULL WHEN 1 THEN t_us + 25200000000 ELSE t_us END AS instant_us FROM eve""")
def parse_times(spark, sf):
    t = F.col("timestamp")
    shapes = (
        F.when(F.col("k") % 4 == 0, t)
        .when(F.col("k") % 4 == 1, F.substring_index(t, "+", 1))
        .when(F.col("k") % 4 == 2, F.concat(F.substring_index(t, "+", 1), F.lit("+07:00")))
        .otherwise(F.lit("yesterday")))
    rows = fixture.raw_events(spark, sf).select("event_id", shapes.alias("s"))
    return rows.select("event_id", times.parse_epoch("s").alias("epoch_s"), times.parse_micros("s").alias("instant_us"))


@query("parse_windows", """SELECT * FROM (SELECT CASE WHEN k % 3 = 0 THEN t_us // 1000000 ELSE (t_us - t_us % 1000000) // 1000000 END AS start_s,
  t_us // 1000000 + k % 5 - 1 AS end_s FROM eve) q WHERE end_s >= start_s""")
def parse_windows(spark, sf):
    sec = F.floor(F.col("t_us") / 1_000_000)

    def iso(s, suffix):
        return F.concat(F.date_format(times.micros_to_ntz((s * 1_000_000 + fixture.LOCAL_OFFSET_US).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))

    end = sec + F.col("k") % 5 - 1
    shape = F.col("k") % 3
    table = fixture.raw_events(spark, sf).select(
        F.when(shape == 0, sec.cast("string")).when(shape == 1, iso(sec, "+0700")).otherwise(iso(sec, "")).alias("start"),
        F.when(shape == 0, end.cast("string")).when(shape == 1, iso(end, "+07:00")).otherwise(iso(end, "")).alias("end"))
    return times.parse_windows(table, "Asia/Jakarta")


@query("flatten_event", "SELECT event_id, event_type, pkts_toserver AS flow_pkts_toserver, bytes_toclient AS flow_bytes_toclient, signature AS alert_signature, severity AS alert_severity FROM ev")
def flatten_event(spark, sf):
    flat = C.flatten_event(fixture.as_nested(fixture.events(spark, sf)))
    return flat.select("event_id", "event_type", "flow_pkts_toserver", "flow_bytes_toclient", "alert_signature", "alert_severity")


@query("clean_text", "SELECT event_id, concat(coalesce(signature, ''), '  x') AS signature, concat(CASE WHEN k % 2 = 0 THEN 'alert;' ELSE '' END, 'flow') AS label_sources FROM ev")
def clean_text(spark, sf):
    sources = F.when(F.col("k") % 2 == 0, F.array(F.lit("flow"), F.lit("alert"))).otherwise(F.array(F.lit("flow")))
    return fixture.events(spark, sf).select(
        "event_id", text.clean_text(F.concat(F.coalesce("signature", F.lit("")), F.lit("\r\nx"))).alias("signature"),
        text.join_list(sources).alias("label_sources"))


@query("conform_vector", "SELECT event_id, k::DOUBLE AS a, v AS b, 0::DOUBLE AS c, k::DOUBLE AS cut_a FROM (SELECT event_id, k, pkts_toserver::DOUBLE AS v FROM eve) q")
def conform_vector(spark, sf):
    vec = F.array(F.col("k").cast("double"), F.col("pkts_toserver").cast("double"))
    rows = fixture.raw_events(spark, sf).select("event_id", numeric.conform_vector(vec, 3).alias("x"), numeric.conform_vector(vec, 1).alias("y"))
    return rows.select("event_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"), F.col("y")[0].alias("cut_a"))


_RUNTIME_SQL = "SELECT event_id, " + ", ".join(r6(c, c) for c in S.RUNTIME_FEATURES) + " FROM runtime"


@query("feature_set_runtime", _RUNTIME_SQL)
def feature_set_runtime(spark, sf):
    return rounded(C.runtime_features(fixture.events(spark, sf)), S.RUNTIME_FEATURES)


@query("feature_set_runtime_dataset", _RUNTIME_SQL)
def feature_set_runtime_dataset(spark, sf):
    stored = FF.with_flow_features(fixture.events(spark, sf), "vector")
    return rounded(C.runtime_features_from_dataset(stored), S.RUNTIME_FEATURES)


_CLASSIFIER_SQL = ", ".join(r6(c, c) for c in FEATS) + ", " + ", ".join([
    "(proto = 'TCP')::INT::DOUBLE AS proto_tcp", "(proto = 'UDP')::INT::DOUBLE AS proto_udp", "(proto = 'ICMP')::INT::DOUBLE AS proto_icmp",
    r6("sin(2 * pi() * hour(ts_local) / 24)", "hour_sin"), r6("cos(2 * pi() * hour(ts_local) / 24)", "hour_cos"),
    r6("sin(2 * pi() * (isodow(ts_local) - 1) / 7)", "weekday_sin"), r6("cos(2 * pi() * (isodow(ts_local) - 1) / 7)", "weekday_cos"),
    r6("dest_port / 65535.0::DOUBLE", "dst_port_norm")])


@query("feature_set_classifier", f"SELECT event_id, {_CLASSIFIER_SQL} FROM evfeat")
def feature_set_classifier(spark, sf):
    feats = FF.with_flow_features(fixture.raw_events(spark, sf))
    return rounded(C.classifier_features(feats), S.CLASSIFIER_FEATURES)


# ---------------------------------------------------------------------------
# labelling
# ---------------------------------------------------------------------------

@query("classify_signature", f"SELECT event_id, {signature_class('signature')} AS attack_class FROM eve")
def classify_signature(spark, sf):
    return fixture.raw_events(spark, sf).select("event_id", L.classify_signature("signature").alias("attack_class"))


def _candidate(df, col):
    return df.withColumn("_c", col).select("event_id", F.col("_c.label").alias("label"), r("_c.score", "score"), F.col("_c.src").alias("src"))


@query("label_alert_live", f"SELECT event_id, a_label AS label, {r6('a_score', 'score')}, CASE WHEN a_label IS NOT NULL THEN 'alert' END AS src FROM cands")
def label_alert_live(spark, sf):
    return _candidate(B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS), L.label_alert_live("signature", "category", "severity"))


@query("label_alert_eval", f"SELECT event_id, e_label AS label, {r6('e_conf', 'score')}, e_src AS src FROM evalbase")
def label_alert_eval(spark, sf):
    return _candidate(fixture.events(spark, sf), L.label_alert_eval("signature", "category", "severity", "signature_id", F.col("has_alert")))


@query("label_flow_rules", f"SELECT event_id, {FLOW_RULE} AS label, {r6(FLOW_SCORE, 'score')}, 'flow' AS src FROM evfeat")
def label_flow_rules(spark, sf):
    feats = FF.with_flow_features(fixture.raw_events(spark, sf))
    return _candidate(feats, L.label_flow_rules("flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "flow_pkts_per_sec", "dest_port"))


@query("resolve_labels", f"SELECT event_id, auto_label, {r6('auto_label_conf', 'auto_label_conf')}, label_sources FROM labelled")
def resolve_labels(spark, sf):
    labelled = policy.with_labels(_enriched(spark, sf), FIXTURE_PARAMS)
    return labelled.select("event_id", "auto_label", r("auto_label_conf", "auto_label_conf"), text.join_list("label_sources").alias("label_sources"))


@query("resolve_candidates", f"SELECT event_id, auto_label, {r6('auto_label_conf', 'auto_label_conf')}, label_sources FROM labelled")
def resolve_candidates(spark, sf):
    cands = F.array(
        L.label_alert_live("signature", "category", "severity"),
        L.label_flow_rules("flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "flow_pkts_per_sec", "dest_port"))
    rows = _enriched(spark, sf).withColumn("_cands", cands).withColumn("_a", L.resolve_candidates("_cands"))
    return rows.select("event_id", F.col("_a.label").alias("auto_label"), r("_a.confidence", "auto_label_conf"), text.join_list("_a.sources").alias("label_sources"))


@query("binary_label", "SELECT event_id, y_attack, y_reason FROM judged")
def binary_label(spark, sf):
    return _decisions(spark, sf).select("event_id", "y_attack", "y_reason")


@query("eval_binary", "SELECT event_id, CASE WHEN e_label = 'benign' THEN 0 ELSE 1 END AS y_attack FROM evalbase")
def eval_binary(spark, sf):
    label = L.label_alert_eval("signature", "category", "severity", "signature_id", F.col("has_alert"))
    return fixture.events(spark, sf).withColumn("_c", label).select("event_id", L.eval_binary("_c.label").alias("y_attack"))


@query("label_by_priority", """SELECT event_id, 'y_attack' AS rule, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS y FROM eve
  UNION ALL SELECT event_id, 'status', CASE WHEN event_type = 'alert' THEN 1 ELSE 0 END FROM eve
  UNION ALL SELECT event_id, 'threat_score', CASE WHEN pkts_toserver > 70 THEN 1 ELSE 0 END FROM eve""")
def label_by_priority(spark, sf):
    ev = fixture.raw_events(spark, sf)
    shape = F.expr("CASE k % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE 'bad' END")
    parts = {
        "y_attack": ev.select("event_id", shape.alias("y_attack"), F.lit("blocked").alias("status")),
        "status": ev.select("event_id", F.upper("event_type").alias("status"), F.lit(1).alias("action")),
        "threat_score": ev.select("event_id", F.col("pkts_toserver").alias("threat_score")),
    }
    out = None
    for rule, part in parts.items():
        one = C.label_by_priority(part).select("event_id", F.lit(rule).alias("rule"), "y")
        out = one if out is None else out.unionByName(one)
    return out


@query("infer_status", "SELECT event_id, status, cls, bucket FROM bucketed")
def infer_status(spark, sf):
    return _bucketed(spark, sf).select("event_id", "status", "cls", "bucket")


@query("bucket", "SELECT event_id, bucket FROM bucketed WHERE bucket IS NOT NULL")
def bucket(spark, sf):
    return _bucketed(spark, sf).filter("bucket IS NOT NULL").select("event_id", "bucket")


@query("standardise_reason", f"SELECT event_id, {_STANDARD} AS attack_type FROM eve")
def standardise_reason(spark, sf):
    return _reasons(spark, sf).select("event_id", L.standardise_reason("y_reason").alias("attack_type"))


# ---------------------------------------------------------------------------
# decisions and state
# ---------------------------------------------------------------------------

@query("dedup_notifications", "SELECT src_ip, signature, t_us FROM sent")
def dedup_notifications(spark, sf):
    return policy.dedup_notifications(B.admit_alerts(fixture.alerts(spark, sf), FIXTURE_PARAMS), params=FIXTURE_PARAMS)


@query("dedup_notifications_stream", "SELECT src_ip, signature, t_us FROM sent")
def dedup_notifications_stream(spark, sf):
    work = fixture.scratch(spark)
    for i in range(3):
        landing = fixture.write_chunk(spark, sf, f"{work}/in", i, 3)
        stream = dedup.DedupStream(spark, landing, f"{work}/state", FIXTURE_PARAMS)
        stream.advance()
    stream.finish()
    return stream.result()


def _blocks(spark, sf, length=None):
    decided = scan.materialise(_decisions(spark, sf).select("event_id", "src_ip", "t_us", "should_block", "reason", "confidence"))
    return policy.block_intervals(J.drop_whitelisted(decided, FIXTURE_PARAMS), length, FIXTURE_PARAMS)


_BLOCK_SQL = f"SELECT ip, block_us, unblock_us, reason, {r6('confidence', 'confidence')}, event_id FROM "


@query("block_intervals", _BLOCK_SQL + "blocks")
def block_intervals(spark, sf):
    return rounded(_blocks(spark, sf), {"confidence"})


@query("block_intervals_60s", _BLOCK_SQL + "blocks60")
def block_intervals_60s(spark, sf):
    return rounded(_blocks(spark, sf, 60_000_000), {"confidence"})


@query("block_intervals_commands", """SELECT c.ip, c.t_us AS block_us,
    least(c.t_us + 60000000, coalesce((SELECT min(m.t_us) FROM cmd m WHERE m.ip = c.ip AND m.t_us > c.t_us), c.t_us + 60000000)) AS unblock_us,
    d.reason, round(d.confidence, 6) AS confidence, d.event_id
  FROM chained c JOIN requests q USING (ip, t_us) JOIN decided d USING (event_id)""", {
    "cmd": "SELECT DISTINCT src_ip AS ip, t_us FROM flows WHERE k % 9 = 0",
    "reqs": "SELECT q.ip, q.t_us, coalesce((SELECT max(c.t_us) FROM cmd c WHERE c.ip = q.ip AND c.t_us <= q.t_us), -1) AS since FROM requests q",
    "chained": chain("reqs", ["ip", "since"], 60_000_000).replace("{self}", "chained")})
def block_intervals_commands(spark, sf):
    decided = scan.materialise(_decisions(spark, sf).select("event_id", "src_ip", "t_us", "should_block", "reason", "confidence"))
    commands = fixture.flows(spark, sf).filter("k % 9 = 0").select(F.col("src_ip").alias("ip"), "t_us")
    blocks = policy.block_intervals(J.drop_whitelisted(decided, FIXTURE_PARAMS), 60_000_000, FIXTURE_PARAMS, commands)
    return rounded(blocks, {"confidence"})


@query("active_blocks", "SELECT ip, block_us, unblock_us FROM active60")
def active_blocks(spark, sf):
    return policy.active_blocks(_blocks(spark, sf, 60_000_000), SNAPSHOT_US).select("ip", "block_us", "unblock_us")


def _block_stream(spark, sf, with_commands):
    """Requests (and commands) arrive in three parts; some of the first part come with the last, when they are late."""
    work = fixture.scratch(spark)
    staged = fixture.staged(spark, sf)
    decided = J.drop_whitelisted(_decisions(spark, sf, staged), FIXTURE_PARAMS).filter("should_block")
    decided = scan.materialise(decided.select("src_ip", "t_us", "should_block", "reason", "confidence", "event_id"))
    commands = B.of_type(staged, "flow").filter("k % 9 = 0").select(F.col("src_ip").alias("ip"), "t_us", "event_id")
    for i in range(3):
        fixture.write_rows_chunk(decided, f"{work}/requests", i)
        closing = None
        if with_commands:
            fixture.write_rows_chunk(commands, f"{work}/commands", i)
            closing = spark.readStream.schema("ip string, t_us long").parquet(f"{work}/commands")
        requests = blocks.follow_decisions(spark, f"{work}/requests")
        events = blocks.block_events(requests, closing, 60_000_000, FIXTURE_PARAMS)
        blocks.write_blocks(events, f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out")


_IN_TIME = f"NOT ({fixture.LATE} AND t_us < {fixture.START_US + fixture.SPAN_US // 3})"
_STREAM_SQL = {
    "s_requests": f"SELECT * FROM requests WHERE {_IN_TIME}",
    "s_cmd": f"SELECT DISTINCT src_ip AS ip, t_us FROM flows WHERE k % 9 = 0 AND {_IN_TIME}",
}


@query("active_blocks_stream", """SELECT ip, t_us AS block_us, t_us + 60000000 AS unblock_us, ended AS released
  FROM chained, w, (SELECT unnest([false, true]) AS ended) WHERE CASE WHEN ended THEN t_us + 60000000 ELSE t_us END <= w.upto""", {
    **_STREAM_SQL, "chained": chain("s_requests", ["ip"], 60_000_000).replace("{self}", "chained"),
    "w": "SELECT max(t_us) // 1000 * 1000 - 10000000 AS upto FROM s_requests"})
def active_blocks_stream(spark, sf):
    return _block_stream(spark, sf, False).select("ip", "block_us", "unblock_us", "released")


@query("block_intervals_stream", f"""SELECT ip, block_us, unblock_us, reason, {r6('confidence', 'confidence')}, event_id FROM (
    SELECT c.ip, c.t_us AS block_us,
      least(c.t_us + 60000000, coalesce((SELECT min(m.t_us) FROM s_cmd m WHERE m.ip = c.ip AND m.t_us > c.t_us), c.t_us + 60000000)) AS unblock_us,
      d.reason, d.confidence, d.event_id
    FROM chained c JOIN s_requests q USING (ip, t_us) JOIN decided d USING (event_id)) b, w WHERE unblock_us <= w.upto""", {
    **_STREAM_SQL,
    "reqs": "SELECT q.ip, q.t_us, coalesce((SELECT max(c.t_us) FROM s_cmd c WHERE c.ip = q.ip AND c.t_us <= q.t_us), -1) AS since FROM s_requests q",
    "chained": chain("reqs", ["ip", "since"], 60_000_000).replace("{self}", "chained"),
    "w": """SELECT least(r, c) // 1000 * 1000 - 10000000 AS upto
      FROM (SELECT max(t_us) AS r FROM s_requests) a, (SELECT max(t_us) AS c FROM s_cmd) b"""})
def block_intervals_stream(spark, sf):
    ended = _block_stream(spark, sf, True).filter("released").drop("released")
    return rounded(ended.select("ip", "block_us", "unblock_us", "reason", "confidence", "event_id"), {"confidence"})


_ALT = ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")
_ALT_NAMES = ("fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot")


def _alternates(mode: str) -> str:
    plain, other = "CASE WHEN event_id % 3 <> 0 THEN {c} END", "CASE WHEN event_id % 3 < 2 THEN {c} + 7 END"
    pick = {"live": plain, "eval": f"coalesce({plain}, {other})", "vector": f"coalesce({other}, {plain})"}[mode]
    rel = f"(SELECT * REPLACE ({', '.join(pick.format(c=c) + ' AS ' + c for c in _ALT)}) FROM flows) {mode}_rel"
    return f"SELECT event_id, '{mode}' AS path, {FEATS_SQL} FROM ({flow_features(rel, mode)}) {mode}_q"


def _real_records(spark, sf):
    """Records as logs have them: alternates of counters, an empty dest_ip and port 0 beside filled dst_ip and dst_port."""
    nested = fixture.as_nested(fixture.events(spark, sf))
    third = F.col("event_id") % 3
    flow = F.struct(
        "flow.start", "flow.end", *[F.when(third != 0, F.col(f"flow.{c}")).alias(c) for c in _ALT],
        *[F.when(third < 2, F.col(f"flow.{c}") + 7).alias(n) for c, n in zip(_ALT, _ALT_NAMES)],
    )
    odd = nested.withColumns({
        "flow": F.when(F.col("flow").isNotNull(), flow), "dst_ip": F.col("dest_ip"), "dest_ip": F.lit(""),
        "dst_port": F.col("dest_port"), "dest_port": F.lit(0),
    })
    path = f"{fixture.scratch(spark)}/real"
    odd.write.json(path)
    return C.normalise_event(SE.read_eve_json(spark, path))


@query("flow_features_alternates", " UNION ALL ".join(map(_alternates, FF.RATIO_MODES)))
def flow_features_alternates(spark, sf):
    flows = B.of_type(scan.materialise(_real_records(spark, sf)), "flow")
    out = None
    for mode in FF.RATIO_MODES:
        part = FF.with_flow_features(flows, mode).select("event_id", F.lit(mode).alias("path"), *FEATS)
        out = part if out is None else out.unionByName(part)
    return rounded(out, FEATS)


@query("admit_alerts_fallback", "SELECT event_id, dest_port FROM admitted")
def admit_alerts_fallback(spark, sf):
    alerts = B.of_type(_real_records(spark, sf), "alert")
    return B.admit_alerts(alerts, FIXTURE_PARAMS).select("event_id", "dest_port")


@query("decide", "SELECT event_id, should_block, reason FROM decided")
def decide(spark, sf):
    return _decisions(spark, sf).select("event_id", "should_block", "reason")


_DETECT_COLS = [c for c in detect.OUTPUT if c not in ("category",)] + ["blocked", "notified"]
_DETECT_ROUND = {*FEATS, "flows_per_sec", "syn_only_ratio", "auto_label_conf", "confidence"}
_DETECT_SQL = "SELECT " + ", ".join(r6(c, c) if c in _DETECT_ROUND else c for c in _DETECT_COLS) + " FROM detected"


def _detect_out(df):
    return rounded(df.withColumn("label_sources", text.join_list("label_sources")).select(*_DETECT_COLS), _DETECT_ROUND)


@query("detect_pipeline", _DETECT_SQL)
def detect_pipeline(spark, sf):
    return _detect_out(detect.detect(fixture.staged(spark, sf), fixture.model, FIXTURE_PARAMS))


@query("windowed_source_rates", """SELECT s * 1000000 AS window_start_us, src_ip,
  count(*) FILTER (WHERE event_type = 'flow') AS n_flows, count(*) FILTER (WHERE event_type = 'alert') AS n_alerts
  FROM (SELECT src_ip, event_type, t_us // 1000000 - unnest(range(10)) AS s FROM ev WHERE event_type IN ('flow', 'alert')) q GROUP BY 1, 2""")
def windowed_source_rates(spark, sf):
    return rates.windowed_source_rates(fixture.events(spark, sf))


@query("stream_detect", _DETECT_SQL)
def stream_detect(spark, sf):
    work = fixture.scratch(spark)
    for i in range(3):
        landing = fixture.write_chunk(spark, sf, f"{work}/in", i, 3)
        stream = SD.DetectStream(spark, landing, f"{work}/state", fixture.model, FIXTURE_PARAMS)
        stream.advance()
    stream.finish()
    return _detect_out(stream.result())


# ---------------------------------------------------------------------------
# preparation, training, evaluation
# ---------------------------------------------------------------------------

def _runtime(spark, sf):
    return C.runtime_features(fixture.events(spark, sf), ("event_id", "event_type"))


def _scaled_sql(cols) -> str:
    return ", ".join(
        r6(f"CASE WHEN mx.{c}_hi = mx.{c}_lo THEN least(greatest({c} - mx.{c}_lo, 0), 1) ELSE least(greatest(({c} - mx.{c}_lo) / (mx.{c}_hi - mx.{c}_lo), 0), 1) END", c)
        for c in cols)


def _extent_sql(cols, rel) -> str:
    return "SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in cols) + f" FROM {rel}"


@query("minmax_scale", f"SELECT event_id, {_scaled_sql(S.RUNTIME_FEATURES)} FROM split, mx",
       {"mx": _extent_sql(S.RUNTIME_FEATURES, "split WHERE is_train")})
def minmax_scale(spark, sf):
    marked = scan.materialise(prep.train_val_split(scan.materialise(_runtime(spark, sf))))
    path = f"{fixture.scratch(spark)}/scaler"
    prep.fit_minmax(marked.filter("is_train"), S.RUNTIME_FEATURES).write.parquet(path)
    stats = spark.read.parquet(path)
    return rounded(prep.apply_minmax(marked, stats, S.RUNTIME_FEATURES).select("event_id", *S.RUNTIME_FEATURES), S.RUNTIME_FEATURES)


@query("drop_constant_features", "SELECT event_id, src_port, pkts_toserver FROM eve")
def drop_constant_features(spark, sf):
    rows = fixture.raw_events(spark, sf).select("event_id", "src_port", "pkts_toserver", F.lit(1).alias("one"), F.lit(0.0).alias("zero"))
    return prep.drop_constant_features(rows, ["src_port", "pkts_toserver", "one", "zero"])


_CODES = """SELECT {c} AS {c}, CAST(row_number() OVER (ORDER BY {o}) - 1 AS INT) AS {n} FROM (SELECT {c}, min((t_us, event_id)) AS f FROM alerts GROUP BY 1) q"""


@query("encode_categories", "SELECT event_id, category_enc, proto_enc, sig_enc FROM alerts JOIN c1 USING (category) JOIN c2 USING (proto) JOIN c3 USING (signature)",
       {"c1": _CODES.format(c="category", o="f", n="category_enc"), "c2": _CODES.format(c="proto", o="proto", n="proto_enc"),
        "c3": _CODES.format(c="signature", o="signature", n="sig_enc")})
def encode_categories(spark, sf):
    return prep.encode_categories(fixture.staged(spark, sf).filter("event_type = 'alert'")).select("event_id", "category_enc", "proto_enc", "sig_enc")


@query("train_val_split", "SELECT event_id, is_train FROM split")
def train_val_split(spark, sf):
    return prep.train_val_split(fixture.raw_events(spark, sf).select("event_id"))


_STRAT = f"""SELECT event_id, attack_type, row_number() OVER (PARTITION BY attack_type ORDER BY {hash32("concat('42|', event_id)")}, event_id)
  <= greatest(floor(count(*) OVER (PARTITION BY attack_type) * 0.2::DOUBLE + 0.5), 1) AS is_test FROM atk"""
_ATK = {"atk": f"SELECT event_id, {_STANDARD} AS attack_type FROM eve WHERE k % 2 = 1 AND k % 5 < 3"}


@query("stratified_split", _STRAT, _ATK)
def stratified_split(spark, sf):
    return prep.stratified_split(B.attacks_only(_reasons(spark, sf)).select("event_id", "attack_type"), "attack_type")


@query("balanced_weights", f"SELECT event_id, attack_type, {r6('(count(*) OVER ())::DOUBLE / ((SELECT count(DISTINCT attack_type) FROM atk) * count(*) OVER (PARTITION BY attack_type))', 'weight')} FROM atk", _ATK)
def balanced_weights(spark, sf):
    rows = B.attacks_only(_reasons(spark, sf)).select("event_id", "attack_type")
    return prep.balanced_weights(rows, "attack_type").select("event_id", "attack_type", r("weight", "weight"))


_CAT = [c for c in S.CATEGORY_FEATURES if c not in ("hour_of_day", "day_of_week")]
_CAT_EXTRA = {
    "pc": "SELECT proto, row_number() OVER (ORDER BY proto) - 1 AS proto_code FROM (SELECT DISTINCT proto FROM alerts) q",
    "catf": f"""SELECT event_id, ({hash32('src_ip')} % 10000)::DOUBLE AS src_ip_enc, ({hash32('dest_ip')} % 10000)::DOUBLE AS dest_ip_enc,
      src_port::DOUBLE AS src_port, dest_port::DOUBLE AS dest_port, proto_code::DOUBLE AS proto_enc, pkts_toserver::DOUBLE AS flow_pkts_toserver,
      pkts_toclient::DOUBLE AS flow_pkts_toclient, bytes_toserver::DOUBLE AS flow_bytes_toserver, bytes_toclient::DOUBLE AS flow_bytes_toclient
      FROM alerts JOIN pc USING (proto)""",
    "mx": _extent_sql(_CAT, "catf"),
}


@query("category_feature_set", f"SELECT event_id, {_scaled_sql(_CAT)} FROM catf, mx", _CAT_EXTRA)
def category_feature_set(spark, sf):
    return rounded(prep.category_feature_set(fixture.staged(spark, sf).filter("event_type = 'alert'")), S.CATEGORY_FEATURES)


def _attacks(spark, sf, staged: DataFrame | None = None) -> DataFrame:
    """Decided alerts with an attack label, with the classifier's features."""
    decided = _decisions(spark, sf, staged).filter(F.col("auto_label").isin("dos", "scan", "bruteforce"))
    local = times.micros_to_ntz(F.col("t_us") + fixture.LOCAL_OFFSET_US)
    rows = decided.withColumns({"ts_local": local, "attack_type": L.standardise_reason("auto_label")})
    return scan.materialise(C.classifier_features(rows, ("event_id", "attack_type")))


_ATTACKS = {"atk": "SELECT event_id, auto_label AS attack_type FROM decided WHERE auto_label IN ('dos', 'scan', 'bruteforce')"}
_TEST = {**_ATTACKS, "test": f"SELECT * FROM ({_STRAT}) q WHERE is_test"}
# what SQL can know of a report: supports, and that the model is at least as good as the commonest class
_REPORT_SQL = """SELECT attack_type AS class, count(*) AS support, TRUE AS useful FROM test GROUP BY 1
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), TRUE FROM test"""


def _report(report: DataFrame) -> DataFrame:
    lines = scan.materialise(report)
    own = ~F.col("class").isin("accuracy", "macro avg", "weighted avg")
    share = lines.filter(own).agg((F.max("support") / F.sum("support")).alias("share")).scalar()
    useful = (F.col("class") != "accuracy") | (F.col("f1") >= F.lit(share) - 0.001)
    return lines.filter((F.col("support") > 0)).select("class", "support", useful.alias("useful"))


@query("train_attack_classifier", _REPORT_SQL, _TEST)
def train_attack_classifier(spark, sf):
    _, report = M.train_attack_classifier(_attacks(spark, sf), f"{fixture.scratch(spark)}/classifier")
    return _report(report)


@query("train_attack_classifier_mlp", _REPORT_SQL, _TEST)
def train_attack_classifier_mlp(spark, sf):
    _, report = M.train_attack_classifier(_attacks(spark, sf), f"{fixture.scratch(spark)}/classifier", model_type="mlp")
    return _report(report)


@query("score_attack_type_agreement", "SELECT attack_type, count(*) AS n_rows, TRUE AS useful FROM atk GROUP BY attack_type", _ATTACKS)
def score_attack_type_agreement(spark, sf):
    """Useful: predictions agree with labels at least as often as the commonest class would."""
    rows = _attacks(spark, sf)
    scored = scan.materialise(M.score_attack_type(rows, M.fit_attack_classifier(rows, trees=100)))
    counts = scan.materialise(scored.groupBy("attack_type").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("predicted_type") == F.col("attack_type")).alias("right")))
    useful = counts.agg(F.sum("right") >= F.max("n_rows")).scalar()
    return counts.select("attack_type", "n_rows", useful.alias("useful"))


@query("score_attack_type", "SELECT event_id, attack_type, TRUE AS known FROM atk", _ATTACKS)
def score_attack_type(spark, sf):
    from pyspark.ml import PipelineModel
    rows = _attacks(spark, sf)
    path = f"{fixture.scratch(spark)}/classifier"
    M.fit_attack_classifier(rows).write().overwrite().save(path)
    known = F.col("predicted_type").isin("dos", "scan", "bruteforce").alias("known")
    return M.score_attack_type(rows, PipelineModel.load(path)).select("event_id", "attack_type", known)


_MARKED = {
    "dfeat": flow_features("ev"),
    "marked": f"SELECT event_id, CASE WHEN {FLOW_RULE} <> 'benign' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY {hash32(SEEDED_ID)}, event_id) "
              "<= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train FROM dfeat",
}


def _detector_rows(spark, sf, staged: DataFrame | None = None):
    """Runtime features of every event; the label is the flow rule's verdict."""
    feats = FF.with_flow_features(fixture.events(spark, sf) if staged is None else staged)
    label = L.label_flow_rules("flow_duration", "fwd_pkts_tot", "bwd_pkts_tot", "flow_pkts_per_sec", "dest_port")
    rows = feats.withColumn("y", (label["label"] != "benign").cast("int"))
    return scan.materialise(prep.train_val_split(scan.materialise(C.runtime_features_from_dataset(rows, ("event_id", "y")))))


@query("train_detector", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE y = 1) AS n_positive, TRUE AS beats_constant FROM marked WHERE NOT is_train", _MARKED)
def train_detector(spark, sf):
    marked = _detector_rows(spark, sf)
    train, val = marked.filter("is_train"), marked.filter("NOT is_train")
    detector, _ = M.train_detector(train, val)
    scored = M.score_detector(val, detector)
    reward = lambda action: E.cost_score(scored.withColumn("action", action), "action", "y", TRAINING_COST).select("total_reward").scalar()
    best = F.greatest(reward(F.lit(0)), reward(F.lit(1)))
    return scored.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("y") == 1).alias("n_positive"),
    ).withColumn("beats_constant", reward(F.col("action")) >= best)


@query("choose_detector", """SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE y = 1) AS n_positive, TRUE AS sound FROM thirds GROUP BY split""", {
    **_MARKED,
    "held": f"SELECT *, row_number() OVER (ORDER BY {hash32("concat('43|', event_id)")}, event_id) <= floor(count(*) OVER () * 0.5::DOUBLE) AS first FROM marked WHERE NOT is_train",
    "thirds": "SELECT y, 'train' AS split FROM marked WHERE is_train UNION ALL SELECT y, CASE WHEN first THEN 'validation' ELSE 'choice' END AS split FROM held"})
def choose_detector(spark, sf):
    """Sound: thresholds are no worse than a constant decision, the choice is no worse than the logistic model, no reward is beyond the greatest."""
    marked = _detector_rows(spark, sf)
    held = scan.materialise(prep.train_val_split(scan.materialise(marked.filter("NOT is_train")), 0.5, 43, out="first"))
    parts = {"train": marked.filter("is_train"), "validation": held.filter("first"), "choice": held.filter("NOT first")}
    _, report = M.choose_detector(*parts.values())
    rows = {r.learner: r for r in report.collect()}  # two rows
    c, out = TRAINING_COST, None
    for name, part in parts.items():
        counts = part.agg(F.lit(name).alias("split"), F.count("*").alias("n_rows"), F.count_if(F.col("y") == 1).alias("n_positive"))
        positive, negative = F.col("n_positive"), F.col("n_rows") - F.col("n_positive")
        most = positive * c.tp + negative * c.tn
        constant = F.greatest(positive * c.tp + negative * c.fp, positive * c.fn + negative * c.tn)
        chosen = next(r for r in rows.values() if r.chosen)
        sound = {
            "train": F.lit(len(rows) == 2),
            "validation": (F.lit(min(r.validation_reward for r in rows.values())) >= constant) & (F.lit(chosen.validation_reward) <= most),
            "choice": (F.lit(chosen.choice_reward) >= rows["logistic"].choice_reward) & (F.lit(chosen.choice_reward) <= most),
        }[name]
        one = counts.withColumn("sound", sound)
        out = one if out is None else out.unionByName(one)
    return out


@query("score_detector", "SELECT event_id, y, TRUE AS consistent FROM marked", _MARKED)
def score_detector(spark, sf):
    marked = _detector_rows(spark, sf)
    detector, _ = M.train_detector(marked.filter("is_train"), marked.filter("NOT is_train"))
    path = f"{fixture.scratch(spark)}/detector"
    detector.save(path)
    loaded = M.Detector.load(spark, path)
    fits = F.col("confidence") == F.when(F.col("action") == 1, 0.80).when(F.col("action") == 0, 0.75)
    return M.score_detector(marked, loaded).select("event_id", "y", fits.alias("consistent"))


@query("retrain_job", "SELECT 'v1' AS version, TRUE AS threshold_in_range, TRUE AS has_reward")
def retrain_job(spark, sf):
    def prepare(df):
        return C.runtime_features_from_dataset(df.withColumn("y", F.col("y_attack")), ("event_id", "y"))

    row = M.retrain_job(scan.materialise(_training_rows(spark, sf)), prepare, f"{fixture.scratch(spark)}/models", "v1")
    return row.select(
        "version", F.col("threshold").between(0, M.SCORE_STEPS + 1).alias("threshold_in_range"),
        F.col("validation_reward").isNotNull().alias("has_reward"),
    )


_FREE = [c for c in _DETECT_COLS if c not in ("action", "confidence", "y_attack", "y_reason", "should_block", "reason", "blocked")]


@query("detect_pipeline_trained", "SELECT " + ", ".join(r6(c, c) if c in _DETECT_ROUND else c for c in _FREE) + ", TRUE AS typed FROM detected")
def detect_pipeline_trained(spark, sf):
    """Saved and loaded models in the pipeline; SQL checks the columns that do not depend on them."""
    from pyspark.ml import PipelineModel
    staged, path = fixture.staged(spark, sf), fixture.scratch(spark)
    marked = _detector_rows(spark, sf, staged)
    detector, _ = M.train_detector(marked.filter("is_train"), marked.filter("NOT is_train"))
    detector.save(f"{path}/detector")
    M.fit_attack_classifier(_attacks(spark, sf, staged)).write().overwrite().save(f"{path}/classifier")
    model = M.as_model(M.Detector.load(spark, f"{path}/detector"), PipelineModel.load(f"{path}/classifier"))
    found = detect.detect(staged, model, FIXTURE_PARAMS)
    typed = F.col("attack_type").isin("dos", "scan", "bruteforce").alias("typed")
    out = found.withColumn("label_sources", text.join_list("label_sources")).select(*_FREE, typed)
    return rounded(out, _DETECT_ROUND)
